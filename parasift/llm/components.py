"""Connected components of a link table, by large-star and small-star steps.

Every step is a minimum per node (combined before the shuffle) and a join that
Spark can split at a hot node; links never leave the executors, and each round
is written to the shared folder.  The number of rounds is logarithmic in the
size of the largest component.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise


def _step(edges: DataFrame, large: bool) -> DataFrame:
    """``edges`` (u, v).  Large star: v > u meet the least neighbour of u.
    Small star: u and all v < u meet the least of them."""
    least = edges.groupBy("u").agg(F.min("v").alias("m")).select(
        F.col("u").alias("_u"), F.least("u", "m").alias("m"))
    joined = edges.join(least, F.col("u") == F.col("_u"))
    if large:
        out = joined.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            least.select(F.col("_u").alias("u"), F.col("m").alias("v")))
    return out.where(F.col("u") != F.col("v")).distinct()


def components(links: DataFrame) -> DataFrame:
    """``links`` (a, b) -> ``node, component`` (least node) for linked nodes."""
    edges = materialise(
        links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .where(F.col("u") != F.col("v")).distinct(), "components")
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        edges = materialise(_step(both, True), "components")
        edges = materialise(
            _step(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")), False), "components")
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v") % 1000003)).first()
        if state == before:
            return edges.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component"))
        before = state
