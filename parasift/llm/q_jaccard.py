"""Registered query: n-gram Jaccard join of ``documents``."""

from parasift.sources.tables import read_table

from .jaccard import classes
from .registry import register

WORDS, PERCENT = 3, 90


@register("op5_ngram_jaccard_join")
def op5_ngram_jaccard_join(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return classes(docs, words=WORDS, percent=PERCENT)
