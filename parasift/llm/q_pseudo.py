"""Registered query: pseudo-likelihood of ``documents``."""

from parasift.sources.tables import read_table

from . import pseudo
from .registry import register


@register("op10_pseudo_likelihood")
def op10_pseudo_likelihood(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return pseudo.score(docs, pseudo.train(docs))
