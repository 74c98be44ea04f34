"""Registered query: language of ``documents``."""

from pyspark.sql import functions as F

from parasift.sources.tables import read_table

from . import langid
from .common import held_out, training_fold
from .registry import register


@register("op7_language_mixture")
def op7_language_mixture(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents")
    learn = docs.where(training_fold(F.col("doc_id"))).select("text", "lang")
    model = langid.train(langid.count(learn))
    return langid.predict(docs.select("doc_id", "text"), model).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "mixture")
