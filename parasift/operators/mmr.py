"""Maximal Marginal Relevance selection (greedy, exact) over groups of vectors.

Rule, per group of candidate rows (each with a unit vector ``u`` and a
representativeness score ``rep``):

* pick 1 is the row with the highest ``rep``; ties go to the **highest**
  position;
* each later pick maximises ``lam * rep - (1 - lam) * max_sim`` over the rows
  not yet picked, where ``max_sim`` is the running maximum of the dot product
  with the picks so far, floored at 0; ties go to the **lowest** position;
* ``min(k, n)`` picks per group, never the same row twice.

Note the direction of ``lam``: 1.0 means "representativeness only".

Scores are compared after rounding to ``SCORE_DECIMALS`` decimals, so values
that are equal in exact arithmetic (e.g. both rows of a two-row group are
equally close to their centroid) tie in every engine and the position rule
decides, instead of the last floating-point bit.

Two exact execution paths produce identical picks:

* **grouped path** – groups of at most ``max_group_rows`` rows are shuffled to
  one task each (``groupBy().applyInPandas``) and selected with numpy.  The
  running ``max_sim`` makes one round O(n·d) instead of O(n·k·d).
* **lazy path** – larger groups (a hot document or topic holding a large share
  of all rows) never meet in one task.  A row's score never rises from one
  pick to the next, so a score computed earlier is an upper bound.  A round
  scores all open rows against the picks so far, keeps the best
  ``CANDIDATES`` of each group (bounded in every partition before the shuffle)
  and picks among them greedily for as long as a pick beats the bound of every
  row outside the list; then the next round refreshes the scores.  The first
  pick of a round is always exact, so there are at most ``k`` rounds, mostly
  one or two.  Vectors stay in the base table: what a round writes is keys,
  position, rank and score of its picks.

Routing uses the per-group row count, computed on key columns only.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.vectors import dot
from ..session import remove_scratch, write_scratch

# Largest group (rows) handled in one task by the grouped path; 50k rows of
# 384 doubles is ~150 MB of numpy memory.
DEFAULT_MAX_GROUP_ROWS = 50_000
# Keys and picks of the hot groups are broadcast while there are at most this
# many groups, their chosen vectors and candidate positions up to these sizes;
# beyond them a join that sorts and merges.
BROADCAST_MAX_GROUPS = 20_000
BROADCAST_MAX_BYTES = 64 << 20
BROADCAST_MAX_ROWS = 200_000
# Candidates of a hot group that a round looks at (at least 8 for each pick).
CANDIDATES = 64
# Resolution at which selection scores are compared.
SCORE_DECIMALS = 9


@dataclass(frozen=True)
class MMRSpec:
    keys: tuple[str, ...]
    position: str
    vector: str
    rep: str
    k: int
    lam: float
    payload: tuple[str, ...] = ()
    keep_vector: bool = False


def _select_numpy(u: np.ndarray, rep: np.ndarray, k: int, lam: float) -> tuple[list[int], list[float]]:
    """Greedy MMR on rows already sorted by ascending position."""
    n = len(rep)
    k = min(k, n)
    if k <= 0:
        return [], []
    # first pick: max rep, ties -> highest position (last index)
    first = n - 1 - int(np.argmax(np.round(rep, SCORE_DECIMALS)[::-1]))
    picks = [first]
    scores = [float(rep[first])]
    avail = np.ones(n, dtype=bool)
    avail[first] = False
    max_sim = np.zeros(n, dtype=np.float64)
    last = first
    for _ in range(1, k):
        max_sim = np.maximum(max_sim, u @ u[last])
        score = lam * rep - (1.0 - lam) * max_sim
        cmp = np.where(avail, np.round(score, SCORE_DECIMALS), -np.inf)
        best = int(np.argmax(cmp))  # ties -> lowest position (first index)
        picks.append(best)
        scores.append(float(score[best]))
        avail[best] = False
        last = best
    return picks, scores


def _grouped_path(df: DataFrame, spec: MMRSpec) -> DataFrame:
    keys, pos = list(spec.keys), spec.position
    cols = keys + [pos, spec.vector, spec.rep] + list(spec.payload)
    src = df.select(*cols)
    fields = [src.schema[c] for c in keys + [pos]]
    fields += [src.schema[c] for c in spec.payload]
    if spec.keep_vector:
        fields.append(src.schema[spec.vector])
    fields += [
        T.StructField(spec.rep, T.DoubleType()),
        T.StructField("rank", T.IntegerType()),
        T.StructField("mmr_score", T.DoubleType()),
    ]
    out_schema = T.StructType(fields)
    k, lam, vcol, rcol = spec.k, spec.lam, spec.vector, spec.rep
    out_cols = keys + [pos] + list(spec.payload) + ([vcol] if spec.keep_vector else [])

    def per_group(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(pos, kind="stable").reset_index(drop=True)
        u = np.stack([np.asarray(v, dtype=np.float64) for v in pdf[vcol]]) if len(pdf) else np.zeros((0, 0))
        rep = pdf[rcol].to_numpy(dtype=np.float64)
        picks, scores = _select_numpy(u, rep, k, lam)
        out = pdf.loc[picks, out_cols].reset_index(drop=True)
        out[rcol] = rep[picks]
        out["rank"] = np.arange(1, len(picks) + 1, dtype=np.int32)
        out["mmr_score"] = np.asarray(scores, dtype=np.float64)
        return out[[f.name for f in out_schema.fields]]

    return src.groupBy(*keys).applyInPandas(per_group, schema=out_schema)


def _greedy_candidates(spec: MMRSpec, limit: int):
    """One group's candidates -> the picks that no row outside can beat."""
    keys, pos, lam = list(spec.keys), spec.position, float(spec.lam)

    def per_group(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(pos, kind="stable").reset_index(drop=True)
        u = np.stack([np.asarray(v, dtype=np.float64) for v in pdf["_u"]])
        rep, max_sim = pdf["_rep"].to_numpy(np.float64), pdf["_ms"].to_numpy(np.float64).copy()
        have, need = int(pdf["_have"].iloc[0]), int(pdf["_need"].iloc[0])
        # upper bound of the score of any row outside the list, at any later pick
        bound = -np.inf
        if len(pdf) >= limit:
            least = float(pdf["_s"].min())
            bound = (lam * least if have == 0 else least) + 2 * 10.0**-SCORE_DECIMALS
            if not 0.0 <= lam <= 1.0:
                bound = np.inf  # scores may rise: only the first pick of a round is sure
        avail, picks, scores = np.ones(len(pdf), dtype=bool), [], []
        while have + len(picks) < need and avail.any():
            if have + len(picks) == 0:
                score = rep
                best = len(rep) - 1 - int(np.argmax(np.round(rep, SCORE_DECIMALS)[::-1]))
            else:
                score = lam * rep - (1.0 - lam) * max_sim
                best = int(np.argmax(np.where(avail, np.round(score, SCORE_DECIMALS), -np.inf)))
            if picks and not round(float(score[best]), SCORE_DECIMALS) > bound:
                break
            picks.append(best)
            scores.append(float(score[best]))
            avail[best] = False
            max_sim = np.maximum(max_sim, u @ u[best])
        out = pdf.loc[picks, keys + [pos]].reset_index(drop=True)
        out["rank"] = np.arange(have + 1, have + 1 + len(picks), dtype=np.int32)
        out["mmr_score"] = np.asarray(scores, dtype=np.float64)
        return out

    return per_group


def _lazy_path(df: DataFrame, spec: MMRSpec, n_groups: int, candidates: int | None = None) -> DataFrame:
    spark, keys, pos, lam = df.sparkSession, list(spec.keys), spec.position, float(spec.lam)
    limit = candidates or max(CANDIDATES, 8 * spec.k)
    # the rows of the hot groups are written once (payload included); rounds read the columns they need
    base, _ = write_scratch(df.select(
        *keys, pos, *spec.payload, F.col(spec.vector).alias("_u"), F.col(spec.rep).cast("double").alias("_rep"),
    ).filter("_u IS NOT NULL AND _rep IS NOT NULL"), "mmr-base")
    need, need_path = write_scratch(base.groupBy(*keys).agg(
        F.least(F.count(F.lit(1)), F.lit(spec.k)).alias("_need"), F.max(F.size("_u")).alias("_dim")), "mmr-groups")
    dim = need.agg(F.max("_dim")).first()[0] or 0
    few = n_groups <= BROADCAST_MAX_GROUPS
    few_vectors = n_groups * spec.k * dim * 8 <= BROADCAST_MAX_BYTES

    def side(small, ok):
        return F.broadcast(small) if ok else small.hint("merge")

    schema = T.StructType([base.schema[c] for c in keys + [pos]] + [
        T.StructField("rank", T.IntegerType()), T.StructField("mmr_score", T.DoubleType())])
    picks, written = None, []
    while True:
        left = need
        if picks is not None:
            left = need.join(picks.groupBy(*keys).agg(F.count(F.lit(1)).alias("_have")), keys)
        left = left.select(*keys, "_need", (F.lit(0) if picks is None else F.col("_have")).cast("long").alias("_have")).filter("_have < _need")
        n_open = left.count()
        if n_open == 0:
            break
        rows = base.select(*keys, pos, "_u", "_rep").join(side(left, few), keys)
        if picks is None:
            rows = rows.withColumn("_ms", F.lit(0.0)).withColumn("_s", F.col("_rep"))
            order = [F.round("_s", SCORE_DECIMALS).desc(), F.col(pos).desc()]
        else:
            chosen = base.select(*keys, pos, "_u").join(side(picks.select(*keys, pos), few), keys + [pos]).groupBy(*keys).agg(
                F.collect_list("_u").alias("_p"))
            rows = rows.join(side(picks.select(*keys, pos), few), keys + [pos], "left_anti").join(side(chosen, few_vectors), keys)
            rows = rows.withColumn("_ms", F.aggregate("_p", F.lit(0.0), lambda m, p: F.greatest(m, dot("_u", p))))
            rows = rows.withColumn("_s", F.lit(lam) * F.col("_rep") - F.lit(1.0 - lam) * F.col("_ms"))
            order = [F.round("_s", SCORE_DECIMALS).desc(), F.col(pos).asc()]
        top = rows.select(*keys, pos, "_ms", "_s", "_have", "_need").withColumn(
            "_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("_n") <= limit).drop("_n")
        top, top_path = write_scratch(top, "mmr-top")
        found, path = write_scratch(
            base.select(*keys, pos, "_u", "_rep").join(side(top, n_open * limit <= BROADCAST_MAX_ROWS), keys + [pos])
            .groupBy(*keys).applyInPandas(_greedy_candidates(spec, limit), schema), "mmr-picks")
        remove_scratch(spark, top_path)
        written.append(path)
        picks = spark.read.schema(schema).parquet(*written)
    remove_scratch(spark, need_path)
    if picks is None:
        picks = spark.createDataFrame([], schema)
    vec_out = [F.col("_u").alias(spec.vector)] if spec.keep_vector else []
    return base.join(side(picks, few), keys + [pos], "inner").select(  # at most k picks per hot group
        *keys, pos, *spec.payload, *vec_out, F.col("_rep").alias(spec.rep), "rank", "mmr_score"
    )


def mmr_select(
    df: DataFrame,
    keys,
    position: str,
    vector: str,
    rep: str,
    k: int,
    lam: float = 0.65,
    payload=(),
    max_group_rows: int = DEFAULT_MAX_GROUP_ROWS,
    sizes: DataFrame | None = None,
    keep_vector: bool = False,
) -> DataFrame:
    """Exact MMR picks per group.

    ``vector`` must hold unit (or zero) vectors so that a dot product is the
    cosine; ``rep`` is the representativeness score.  Returns the key columns,
    ``position``, the payload columns, ``rep``, ``rank`` (1-based pick order)
    and ``mmr_score`` (the objective at pick time; ``rep`` for the first pick).

    ``sizes`` may supply ``keys + [n]`` row counts computed from a cheaper
    upstream table; otherwise they are counted on the key columns of ``df``.
    """
    keys = (keys,) if isinstance(keys, str) else tuple(keys)
    spec = MMRSpec(keys, position, vector, rep, int(k), float(lam), tuple(payload), keep_vector)
    if spec.k <= 0:
        return _grouped_path(df.limit(0), spec)
    if sizes is None:
        sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    big = sizes.filter(F.col("n") > F.lit(max_group_rows)).select(*keys)
    n_big = big.count()
    if n_big == 0:
        return _grouped_path(df, spec)
    big_side = F.broadcast(big) if n_big <= BROADCAST_MAX_GROUPS else big
    small_rows = df.join(big_side, list(keys), "left_anti")
    big_rows = df.join(big_side, list(keys), "left_semi")
    return _grouped_path(small_rows, spec).unionByName(_lazy_path(big_rows, spec, n_big))


def mmr_reason(rank_col, shortlist_pos_col=None, reranked: bool = False):
    """Reason text of a pick: first pick is 'highly central'; under rerank the
    shortlist head (shortlist position 0) is 'rerank: highly relevant'."""
    # Reason strings.
    if reranked:
        return F.when(F.col(shortlist_pos_col) == 0, F.lit("rerank: highly relevant")).otherwise(F.lit("rerank: relevant"))
    return F.when(F.col(rank_col) == 1, F.lit("highly central")).otherwise(F.lit("diversity pick"))
