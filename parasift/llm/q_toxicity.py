"""Registered query: toxicity of ``documents``."""

from pyspark.sql import functions as F

from parasift.sources.tables import read_table

from . import toxicity
from .common import held_out, training_fold
from .registry import register


def labelled_rows(spark, docs, sf_dir):
    """Texts and toxic labels of the training fold.  Candidates for the bounded
    fit sample are drawn from the labels first (by id hash, a quarter more than
    the sample), so the corpus is joined with a few thousand rows at most."""
    labels = read_table(spark, sf_dir, "labels").where(training_fold(F.col("doc_id")))
    drawn = [
        labels.where(F.col("toxic") == label).select(F.col("doc_id").alias("_labelled"), F.col("toxic").alias("_toxic"))
        .orderBy(F.xxhash64("_labelled"), "_labelled").limit(n * 5 // 4)
        for label, n in toxicity.SAMPLE.items()
    ]
    drawn = F.broadcast(drawn[0].unionByName(drawn[1]))
    return docs.join(drawn, F.col("doc_id") == F.col("_labelled")).select("text", F.col("_toxic").alias("toxic"))


@register("op8_toxicity")
def op8_toxicity(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(labelled_rows(spark, docs, sf_dir))
    return toxicity.score(docs, model).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted", "margin", "windows")
