"""Registered query: leaks of ``benchmark`` in ``documents``."""

from parasift.sources.tables import read_table

from .decontaminate import leaks
from .registry import register


@register("op6_decontamination")
def op6_decontamination(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return leaks(docs, read_table(spark, sf_dir, "benchmark").select("item_id", "text"))
