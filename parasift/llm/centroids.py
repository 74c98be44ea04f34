"""Centroid clustering in integers, nearest centroid by equal-average equal-variance search.

Centroids are sorted by their component mean.  A vector starts at the centroid
whose mean is nearest its own and scans outward on both sides.  With d
components, means m and deviations V (square root of the squared distance to
the mean line),

    distance^2 >= d (m_x - m_c)^2 + (V_x - V_c)^2

so a side is left as soon as the first term alone exceeds the best distance,
and a centroid whose two terms exceed it is skipped.  The bounds are computed
in double precision and lowered by more than their error; what they do not
reject gets its exact distance in 64-bit integers, so the result is exact.

Vectors are assigned in Arrow batches; a task returns one row of sums per
cluster, and only k * d sums reach the driver.

Edge cases: vectors of another size or with a null or non-finite component are
left out; components beyond +-2^27 after scaling (+-131,072) count as that
bound, so that distances fit 64 bits; with fewer vectors than centroids every
vector is a start; an empty table gives an empty result; vectors with equal
id are told apart by their components, equal rows both start (the second
centroid then stays empty unless vectors move to it); a null id counts as
empty text in the start order.  Other columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise

DIM, CLUSTERS, ROUNDS, SCALE, SEED = 64, 8, 10, 1024, "3"
LIMIT = 1 << 27
LONG_MAX = (1 << 63) - 1


# ------------------------------------------------------------------ search
class SortedCentroids:
    """Centroids in order of their component sums (the mean times d)."""

    def __init__(self, centroids: np.ndarray):
        self.rows = np.asarray(centroids, np.int64)
        self.number = np.argsort(self.rows.sum(axis=1), kind="stable")
        self.sorted = self.rows[self.number]
        self.sums, self.dev, self.norm = features(self.sorted)

    def nearest(self, x: np.ndarray):
        """Centroid number and squared distance of each row of ``x`` (ties:
        the smaller number), and how many distances were computed."""
        k, d, n = len(self.rows), self.rows.shape[1], len(x)
        sums, dev, norm = features(x)
        best, label = np.full(n, LONG_MAX, np.int64), np.full(n, k, np.int64)
        hi = np.searchsorted(self.sums, sums)
        lo, finished, done = hi - 1, np.zeros(n, bool), 0
        while not finished.all():
            at = np.flatnonzero(~finished)
            down = np.where(lo[at] >= 0, np.abs(sums[at] - self.sums[np.maximum(lo[at], 0)]), np.inf)
            up = np.where(hi[at] < k, np.abs(sums[at] - self.sums[np.minimum(hi[at], k - 1)]), np.inf)
            gap, low = np.minimum(down, up), down <= up
            mean_term = gap * gap / d * (1 - 1e-9)
            over = mean_term > best[at]  # the nearer side is too far, so both are
            finished[at[over]] = True
            at, low, mean_term = at[~over], low[~over], mean_term[~over]
            c = np.where(low, lo[at], hi[at])
            lo[at] -= low
            hi[at] += ~low
            slack = 1e-7 * (norm[at] + self.norm[c])  # over the error of both deviations
            apart = np.maximum(np.abs(dev[at] - self.dev[c]) - slack, 0)
            keep = mean_term + apart * apart * (1 - 1e-9) <= best[at]
            r, c = at[keep], c[keep]
            diff = x[r] - self.sorted[c]
            dist, number = np.einsum("ij,ij->i", diff, diff), self.number[c]
            done += len(r)
            better = (dist < best[r]) | ((dist == best[r]) & (number < label[r]))
            best[r[better]], label[r[better]] = dist[better], number[better]
            finished |= (lo < 0) & (hi >= k)
        return label, best, done


def features(x: np.ndarray):
    """Component sums, deviation from the mean line, and norm of each row."""
    sums = x.sum(axis=1).astype(np.float64)
    squares = np.einsum("ij,ij->i", x.astype(np.float64), x.astype(np.float64))
    return sums, np.sqrt(np.maximum(squares - sums * sums / x.shape[1], 0)), np.sqrt(squares)


# ------------------------------------------------------------------ Spark
def quantised(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", dim: int = DIM) -> DataFrame:
    """``id, v``: the vectors of ``dim`` finite components, each component as
    the integer floor(1024 * component)."""
    v = vectors[vec_col].cast("array<double>")
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    whole = lambda x: F.floor(F.least(F.greatest(x * SCALE, F.lit(float(-LIMIT))), F.lit(float(LIMIT)))).cast("int")
    return vectors.where((F.size(v) == dim) & ~F.exists(v, bad)).select(
        vectors[id_col].alias("id"), F.transform(v, whole).alias("v"))


def start_order(vec_id: Column) -> Column:
    return F.sha2(F.concat(F.lit(f"{SEED}:"), F.coalesce(vec_id.cast("string"), F.lit(""))).cast("binary"), 256)


def start(vectors: DataFrame, clusters: int = CLUSTERS) -> np.ndarray:
    """The vectors whose ids have the smallest hashes, in that order."""
    first = vectors.select(start_order(F.col("id")).alias("h"), "v").orderBy("h", "v").limit(clusters).collect()
    return np.array([r["v"] for r in first], np.int64)


def _matrix(batch: pa.RecordBatch, dim: int) -> np.ndarray:
    return batch.column(batch.schema.get_field_index("v")).flatten().to_numpy().reshape(-1, dim).astype(np.int64)


def _sums_of(centroids: np.ndarray):
    def run(batches):
        k, dim = centroids.shape
        search, count, total = SortedCentroids(centroids), np.zeros(k, np.int64), np.zeros((k, dim), np.int64)
        distance = [0] * k
        for batch in batches:
            x = _matrix(batch, dim)
            label, dist, _ = search.nearest(x)
            for c in np.unique(label).tolist():
                mine = label == c
                count[c] += mine.sum()
                total[c] += x[mine].sum(axis=0)
                distance[c] += int(dist[mine].astype(object).sum())
        used = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([
            pa.array(used.astype(np.int32)), pa.array(count[used]), pa.array([str(distance[c]) for c in used], pa.string()),
            pa.array(list(total[used]), pa.list_(pa.int64()))], names=["cluster", "n", "distance", "sums"])

    return run


def _totals(vectors: DataFrame, centroids: np.ndarray):
    """Per cluster: number of vectors, sum of squared distances, component
    sums.  A task gives one row per cluster; k * d sums are collected."""
    part = vectors.mapInArrow(_sums_of(centroids), "cluster int, n long, distance string, sums array<long>")
    rows = (part.select("cluster", "n", F.col("distance").cast("decimal(38,0)").alias("distance"), F.posexplode("sums"))
            .groupBy("cluster", "pos").agg(F.sum("n").alias("n"), F.sum("distance").alias("distance"), F.sum("col").alias("total"))
            .collect())
    return {(r["cluster"], r["pos"]): (r["n"], int(r["distance"]), r["total"]) for r in rows}


def fit(vectors: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS) -> np.ndarray:
    """Centroids after ``rounds`` rounds; an empty cluster keeps its centroid."""
    centroids = start(vectors, clusters)
    for _ in range(rounds if len(centroids) else 0):
        totals = _totals(vectors, centroids)
        for (c, pos), (n, _, total) in totals.items():
            centroids[c, pos] = total // n  # floors, also below zero
    return centroids


def cluster(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", dim: int = DIM,
            clusters: int = CLUSTERS, rounds: int = ROUNDS) -> DataFrame:
    """One row per vector: id, ``cluster, distance, cluster_inertia, inertia,
    centroid_sha256``."""
    rows = materialise(quantised(vectors, id_col, vec_col, dim), "centroid-vectors")
    centroids = fit(rows, clusters, rounds)
    inertia = {c: d for (c, pos), (_, d, _) in _totals(rows, centroids).items() if pos == 0} if len(centroids) else {}
    long = lambda x: min(x, LONG_MAX)
    digest = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in centroids]

    def label(batches):
        search = SortedCentroids(centroids) if len(centroids) else None
        for batch in batches:
            if not batch.num_rows:
                continue
            which, dist, _ = search.nearest(_matrix(batch, dim))
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array(which.astype(np.int32)), pa.array(dist),
                pa.array([long(inertia[c]) for c in which.tolist()], pa.int64()),
                pa.array([long(sum(inertia.values()))] * len(which), pa.int64()),
                pa.array([digest[c] for c in which.tolist()], pa.string()),
            ], names=["id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"])

    out = rows.mapInArrow(label, f"id {rows.schema['id'].dataType.simpleString()}, cluster int, distance long, "
                                 "cluster_inertia long, inertia long, centroid_sha256 string")
    return out.withColumnRenamed("id", id_col)
