"""Registered query: spelling variants of the words of ``documents``."""

from parasift.sources.tables import read_table

from .registry import register
from .spelling import variants


@register("op11_spelling_variants")
def op11_spelling_variants(spark, sf_dir):
    return variants(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
