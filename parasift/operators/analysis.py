"""Selection and per-group analysis (centroid -> similarity -> MMR -> metrics)."""

from __future__ import annotations

import numpy as np
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import is_valid_vector, l2_normalize, sq_norm
from ..session import remove_scratch, write_scratch
from .mmr import DEFAULT_MAX_GROUP_ROWS, mmr_reason, mmr_select
from .similarity import centroid_similarity

UNIT = "_unit"


def _keys(keys):
    return [keys] if isinstance(keys, str) else list(keys)


def group_sizes(df: DataFrame, keys, vector: str) -> DataFrame:
    """Vector size of each group: that of most of its vectors without a null,
    NaN or infinite component; of sizes equally frequent, the smallest.  Empty
    vectors have no size."""
    k = _keys(keys)
    counts = df.filter(is_valid_vector(F.col(vector)) & (F.size(vector) > 0)).groupBy(*k, F.size(vector).alias("_size")).agg(
        F.count(F.lit(1)).alias("_n"))
    return counts.groupBy(*k).agg(F.max(F.struct("_n", -F.col("_size"))).alias("_m")).select(
        *k, (-F.col("_m.col2")).alias("_dim"))


def mark_invalid(df: DataFrame, keys, vector: str, few_groups: bool = False) -> DataFrame:
    """``df`` with the vectors that take no part set to null: those with a
    null, NaN or infinite component and those of another size than their
    group's (see :func:`group_sizes`)."""
    k = _keys(keys)
    dims = group_sizes(df, k, vector)
    marked = df.join(F.broadcast(dims) if few_groups else dims, k, "left")
    ok = is_valid_vector(F.col(vector)) & (F.size(vector) == F.col("_dim"))
    return marked.withColumn(vector, F.when(ok, F.col(vector))).drop("_dim")


def score_rows(df: DataFrame, keys, vector: str, few_groups: bool = False, marked: bool = False) -> DataFrame:
    """Valid rows with ``score_representative`` (cosine to the group centroid)
    and the unit vector ``_unit``.  Rows whose vector takes no part (see
    :func:`mark_invalid`; ``marked``: that has been done) are dropped here; the
    coverage columns report them.  ``few_groups`` broadcasts the (counted,
    small) tables of the groups."""
    valid = (df if marked else mark_invalid(df, keys, vector, few_groups)).filter(F.col(vector).isNotNull())
    scored = centroid_similarity(valid, _keys(keys), vector, broadcast_centroids=few_groups)
    return scored.withColumn(UNIT, l2_normalize(F.col(vector)))


def select_per_group(
    df: DataFrame,
    keys,
    position: str,
    vector: str,
    k: int,
    lam: float,
    payload=(),
    keep_unit: bool = False,
    max_group_rows: int = DEFAULT_MAX_GROUP_ROWS,
    sizes: DataFrame | None = None,
) -> DataFrame:
    """MMR picks per group with ``score_representative``, ``rank``,
    ``mmr_score`` and ``reason`` (``highly central`` for the first pick)."""
    scored = score_rows(df, keys, vector)
    picks = mmr_select(
        scored, _keys(keys), position, UNIT, "score_representative", k, lam,
        payload=payload, max_group_rows=max_group_rows, sizes=sizes, keep_vector=keep_unit,
    )
    return picks.withColumn("reason", mmr_reason("rank"))


def pick_stats(picks: DataFrame, keys, unit: str = UNIT) -> DataFrame:
    """``top_n`` and ``avg_pairwise_cosine`` of the picks per group (linear form)."""
    k = _keys(keys)
    # a unit vector is either of norm 1 or all zeros: "non-zero" is decided by
    # the first non-zero component (no full-length norm per row)
    agg = picks.groupBy(*k).agg(
        F.count(F.lit(1)).alias("top_n"),
        vector_to_array(Summarizer.sum(array_to_vector(F.col(unit)))).alias("_s"),
        F.sum(F.exists(F.col(unit), lambda x: x != 0).cast("long")).alias("_nnz"),
    )
    n = F.col("top_n").cast("double")
    apc = F.when(F.col("top_n") > 1, (sq_norm(F.col("_s")) - F.col("_nnz")) / (n * (n - 1))).otherwise(F.lit(0.0))
    return agg.select(*k, "top_n", apc.alias("avg_pairwise_cosine"))


def group_metrics(groups: DataFrame, rows: DataFrame, picks: DataFrame, keys, lam: float,
                  vector: str | None = None) -> DataFrame:
    """One metrics row per group of ``groups`` (also for groups with no rows).

    ``num_segments`` counts all rows; ``analyzed_segments`` the rows with a
    valid vector (when ``vector`` is given); ``top_n`` the picks.
    """
    k = _keys(keys)
    aggs = [F.count(F.lit(1)).alias("num_segments")]
    if vector is not None:
        aggs.append(F.count_if(is_valid_vector(F.col(vector))).alias("analyzed_segments"))
    counts = rows.groupBy(*k).agg(*aggs)
    stats = pick_stats(picks, k)
    out = groups.select(*k).join(counts, k, "left").join(stats, k, "left")
    cols = [
        *k,
        F.coalesce("num_segments", F.lit(0)).cast("long").alias("num_segments"),
        F.coalesce("top_n", F.lit(0)).cast("long").alias("top_n"),
        F.lit(float(lam)).alias("mmr_lambda"),
        F.coalesce("avg_pairwise_cosine", F.lit(0.0)).alias("avg_pairwise_cosine"),
    ]
    if vector is not None:
        cols.append(F.coalesce("analyzed_segments", F.lit(0)).cast("long").alias("analyzed_segments"))
    return out.select(*cols)


# --------------------------------------------------------------------------
# Fused per-group analysis: centroid, similarity, MMR and pick redundancy of
# a bounded group in one Arrow call; unbounded groups take the native path.
# --------------------------------------------------------------------------

def _analyze_group(v: np.ndarray, k: int, lam: float):
    """Centroid, cosine to it, MMR picks and pick redundancy of one group.

    ``v`` holds the group's rows in position order (NaN rows = invalid).
    Returns (picked row indices, rep of picks, mmr scores, n valid, apc, unit
    vectors of picks).
    """
    from .mmr import _select_numpy

    n = v.shape[0]
    # without a usable vector the matrix has no columns and no row takes part
    ok = np.isfinite(v).all(axis=1) if n and v.shape[1] else np.zeros(n, dtype=bool)
    idx_ok = np.nonzero(ok)[0]
    vv = v[idx_ok]
    centroid = vv.mean(axis=0) if len(vv) else np.zeros(v.shape[1] if v.ndim == 2 else 0)
    norms = np.sqrt((vv * vv).sum(axis=1))
    cn = float(np.sqrt(centroid @ centroid))
    with np.errstate(divide="ignore", invalid="ignore"):
        rep = np.where((norms > 0) & (cn > 0), (vv @ centroid) / (norms * cn), 0.0)
        u = np.where(norms[:, None] > 0, vv / norms[:, None], vv)
    picks, scores = _select_numpy(u, rep, k, lam)
    m = len(picks)
    up = u[picks]
    if m > 1:
        g = up @ up.T
        apc = float(g[np.triu_indices(m, 1)].mean())
    else:
        apc = 0.0
    return idx_ok[picks], rep[picks], np.asarray(scores, dtype=np.float64), len(idx_ok), apc, up


def _matrices(arr, bounds):
    """``(n, d)`` float64 matrix of each group ``bounds[i]:bounds[i + 1]`` of a
    list array.  d is the group's own vector size (see :func:`group_sizes`),
    never that of other groups of the batch; rows that are null or of another
    size are NaN rows."""
    lengths = arr.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
    flat = arr.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    starts = np.concatenate([[0], np.cumsum(np.maximum(lengths, 0))])
    for s, e in zip(bounds[:-1], bounds[1:]):
        own = lengths[s:e]
        if len(own) and own[0] > 0 and (own == own[0]).all():
            yield flat[starts[s]:starts[e]].reshape(e - s, own[0])
            continue
        rows = {i: flat[starts[s + i]:starts[s + i] + n] for i, n in enumerate(own) if n >= 0}
        usable = [len(r) for r in rows.values() if len(r) and np.isfinite(r).all()]
        d = min(usable, key=lambda n: (-usable.count(n), n), default=0)
        out = np.full((e - s, d), np.nan)
        for i, r in rows.items():
            if len(r) == d:
                out[i] = r
        yield out


def _fused_batches(keys, vector, k, lam, payload_cols, out_schema, emit_unit=False, buckets_dim=None):
    """``mapInArrow`` function over partitions sorted by (keys, position):
    every complete group of a batch is analysed; the trailing group of a batch
    may continue in the next batch and is carried over."""
    import pyarrow as pa

    def boundaries(tbl):
        n = tbl.num_rows
        change = np.zeros(max(n - 1, 0), dtype=bool)
        for c in keys:
            a = tbl.column(c).to_numpy(zero_copy_only=False)
            change |= a[1:] != a[:-1]
        return np.concatenate([[0], np.nonzero(change)[0] + 1, [n]])

    def process(tbl):
        b = boundaries(tbl)
        col = tbl.column(vector).combine_chunks()
        if buckets_dim is not None:
            from .embed import dense_from_buckets

            dense = dense_from_buckets(col, buckets_dim).astype(np.float64)
            groups = (dense[s:e] for s, e in zip(b[:-1], b[1:]))
        else:
            groups = _matrices(col, b)
        rows, reps, scores, ranks, gn, gv, gtop, gapc, units = [], [], [], [], [], [], [], [], []
        for s, e, v in zip(b[:-1], b[1:], groups):
            picked, rep, sc, n_ok, apc, up = _analyze_group(v, k, lam)
            m = len(picked)
            rows.append(picked + s)
            reps.append(rep)
            scores.append(sc)
            ranks.append(np.arange(1, m + 1, dtype=np.int32))
            gn.append(np.full(m, e - s, dtype=np.int64))
            gv.append(np.full(m, n_ok, dtype=np.int64))
            gtop.append(np.full(m, m, dtype=np.int64))
            gapc.append(np.full(m, apc, dtype=np.float64))
            if emit_unit:
                units.append(up)
        idx = pa.array(np.concatenate(rows) if rows else np.zeros(0, dtype=np.int64), type=pa.int64())
        cols = {c: tbl.column(c).take(idx) for c in payload_cols}
        cols["score_representative"] = pa.array(np.concatenate(reps) if reps else np.zeros(0))
        cols["rank"] = pa.array(np.concatenate(ranks) if ranks else np.zeros(0, dtype=np.int32), type=pa.int32())
        cols["mmr_score"] = pa.array(np.concatenate(scores) if scores else np.zeros(0))
        cols["group_n"] = pa.array(np.concatenate(gn) if gn else np.zeros(0, dtype=np.int64), type=pa.int64())
        cols["group_top_n"] = pa.array(np.concatenate(gtop) if gtop else np.zeros(0, dtype=np.int64), type=pa.int64())
        cols["group_apc"] = pa.array(np.concatenate(gapc) if gapc else np.zeros(0))
        cols["group_valid"] = pa.array(np.concatenate(gv) if gv else np.zeros(0, dtype=np.int64), type=pa.int64())
        if emit_unit:
            # groups may differ in vector size
            offs = np.concatenate([[0], *(np.full(len(u), u.shape[1]) for u in units)]).cumsum().astype(np.int32)
            flat = np.concatenate([u.ravel() for u in units]) if units else np.zeros(0)
            cols[UNIT] = pa.ListArray.from_arrays(pa.array(offs), pa.array(flat, type=pa.float64()))
        return pa.Table.from_pydict(cols, schema=out_schema)

    def fn(batches):
        carry = None
        for rb in batches:
            tbl = pa.Table.from_batches([rb])
            if carry is not None:
                tbl = pa.concat_tables([carry, tbl])
            if tbl.num_rows == 0:
                continue
            b = boundaries(tbl)
            cut = int(b[-2])  # start of the trailing (possibly incomplete) group
            carry = tbl.slice(cut)
            if cut > 0:
                yield from process(tbl.slice(0, cut).combine_chunks()).to_batches()
        if carry is not None and carry.num_rows:
            yield from process(carry.combine_chunks()).to_batches()

    return fn


def analyze_groups(
    vectors: DataFrame,
    keys,
    position: str,
    vector: str,
    k: int,
    lam: float,
    payload=(),
    max_group_rows: int = DEFAULT_MAX_GROUP_ROWS,
    sizes: DataFrame | None = None,
    emit_unit: bool = False,
    buckets_dim: int | None = None,
    vector_expr=None,
) -> DataFrame:
    """Picks per group with ``score_representative``, ``rank``, ``mmr_score``,
    ``reason`` and the group metrics ``group_n`` (rows), ``group_valid`` (rows
    with a valid vector), ``group_top_n``, ``group_apc`` repeated on every pick row.

    Groups of at most ``max_group_rows`` rows: the rows are hash-partitioned
    by the group keys and sorted by (keys, position) within partitions; a
    ``mapInArrow`` pass computes centroid, cosine to it, MMR and the pick
    redundancy with numpy for every complete group of each Arrow batch (a group
    straddling two batches is carried over), so many groups share one Python
    call.  With ``buckets_dim`` the ``vector`` column holds the hashing
    embedder's signed token buckets, densified in the same pass;
    ``vector_expr`` (a column expression over the columns of ``vectors``)
    computes the ``vector`` column after the shuffle, so that work is spread
    over the shuffle partitions.

    Larger groups: native partial aggregations for the centroid and the pick
    statistics, lazy MMR rounds (see :mod:`.mmr`).
    """
    from pyspark.sql import types as T
    from pyspark.sql.pandas.types import to_arrow_schema

    from .mmr import MMRSpec, _lazy_path

    kk = _keys(keys)
    if vector_expr is not None:
        needed = [c for c in vectors.columns if c not in kk + [position] + list(payload)]
        src = vectors.select(*kk, position, *payload, *[c for c in needed if c != vector])
        post = vector_expr
    else:
        src = vectors.select(*kk, position, *payload, vector)
        post = None
    fields = [vectors.schema[c] for c in kk + [position] + list(payload)]
    fields += [
        T.StructField("score_representative", T.DoubleType()),
        T.StructField("rank", T.IntegerType()),
        T.StructField("mmr_score", T.DoubleType()),
        T.StructField("group_n", T.LongType()),
        T.StructField("group_top_n", T.LongType()),
        T.StructField("group_apc", T.DoubleType()),
        T.StructField("group_valid", T.LongType()),
    ]
    if emit_unit:
        fields.append(T.StructField(UNIT, T.ArrayType(T.DoubleType())))
    out_schema = T.StructType(fields)
    fn = _fused_batches(kk, vector, int(k), float(lam), kk + [position] + list(payload),
                        to_arrow_schema(out_schema), emit_unit, buckets_dim)

    def grouped(df):
        # one exchange by the group keys, rows of a group contiguous and in
        # position order; many groups per Arrow batch
        part = df.repartition(*[F.col(c) for c in kk]).sortWithinPartitions(*kk, position)
        if post is not None:
            part = part.select(*kk, position, *payload, post.alias(vector))
        return part.mapInArrow(fn, schema=out_schema)

    if sizes is None:
        sizes = src.groupBy(*kk).agg(F.count(F.lit(1)).alias("n"))
    big = sizes.filter(F.col("n") > F.lit(max_group_rows)).select(*kk)
    n_big = big.count()
    if n_big == 0:
        out = grouped(src)
    else:
        from .mmr import BROADCAST_MAX_GROUPS

        big_side = F.broadcast(big) if n_big <= BROADCAST_MAX_GROUPS else big
        small = grouped(src.join(big_side, kk, "left_anti"))
        big_rows = src.join(big_side, kk, "left_semi")
        if post is not None:
            big_rows = big_rows.select(*kk, position, *payload, post.alias(vector))
        if buckets_dim is not None:
            from .embed import densify_column

            big_rows = densify_column(big_rows, vector, buckets_dim)
        # the same rule as in the grouped pass decides which vectors take part;
        # the centroids of the n_big hot groups are broadcast (their number was
        # just counted) so hot rows never shuffle; they are written once, as
        # three passes read them
        few = n_big <= BROADCAST_MAX_GROUPS
        hot, hot_path = write_scratch(mark_invalid(big_rows.select(*kk, position, *payload, vector), kk, vector, few), "hot-rows")
        counts, _ = write_scratch(hot.groupBy(*kk).agg(
            F.count(F.lit(1)).alias("group_n"),
            F.count(vector).cast("long").alias("group_valid"),
        ), "hot-counts")
        scored = score_rows(hot, kk, vector, few_groups=few, marked=True)
        spec = MMRSpec(tuple(kk), position, UNIT, "score_representative", int(k), float(lam), tuple(payload), True)
        picks = _lazy_path(scored, spec, n_big)  # written; the hot rows are not read again
        remove_scratch(src.sparkSession, hot_path)
        stats = pick_stats(picks, kk).withColumnRenamed("top_n", "group_top_n").withColumnRenamed(
            "avg_pairwise_cosine", "group_apc")
        big_out = picks.join(stats, kk).join(counts, kk).select(*[f.name for f in out_schema.fields])
        out = small.unionByName(big_out)
    return out.withColumn("reason", mmr_reason("rank"))
