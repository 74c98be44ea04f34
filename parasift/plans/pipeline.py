"""End-to-end plans: pages -> documents -> analysis -> summaries.

Building a plan runs small jobs (a count that routes very large documents) and
materialises the picks; everything else is lazy.  The only shuffles are on the
segment id (embed each distinct text once, join vectors back) and on the
document key (centroid, selection, metrics).  A repeated boilerplate line
(one segment id holding a large share of all rows) is collapsed map-side by
the distinct and split by AQE's skew-join handling on the way back.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ids import combined_fingerprint
from ..functions.vectors import l2_normalize
from ..operators.analysis import UNIT, analyze_groups, pick_stats
from ..operators.rerank import QUERY_MODE_CENTROID_SUMMARY, rerank, rerank_query
from ..operators.embed import HashingEmbedder, densify_column
from ..options import AnalyzerOptions
from ..session import ensure_checkpoint_dir, write_scratch


def _keys(keys):
    return [keys] if isinstance(keys, str) else list(keys)


def embed_segments(segs: DataFrame, embedder=None, store=None, text: str = "text") -> DataFrame:
    """Attach ``embedding`` to every segment row, embedding each distinct
    ``segment_id`` once (read-through the embedding store when given)."""
    embedder = embedder or HashingEmbedder()
    # segment_id is a hash of the text, so (segment_id, text) pairs are unique
    # per id; grouping on both keeps the dedup a hash aggregate with map-side
    # combine (a boilerplate line repeated everywhere collapses per task).
    uniq = segs.select("segment_id", text).distinct()
    if store is not None:
        vecs = store.read_through(uniq, embedder, text=text)
    else:
        vecs = embedder.embed(uniq, text=text).select("segment_id", "embedding")
    # The vector side grows with the corpus: never broadcast it.  A sort-merge
    # join spills instead of holding a partition's vectors in memory, and AQE
    # splits a hot segment id on the segments side.
    # An outer join: a segment whose vector is missing or invalid keeps its row.
    return segs.join(vecs.hint("merge"), "segment_id", "left")


@dataclass
class Analysis:
    selection: DataFrame  # one row per pick
    metrics: DataFrame  # one row per document (also documents with no segments)


def analyze(
    segs: DataFrame,
    docs: DataFrame,
    keys=("doc_id",),
    embedder=None,
    opts: AnalyzerOptions | None = None,
    store=None,
    vectors: DataFrame | None = None,
    scorer=None,
    sizes: DataFrame | None = None,
) -> Analysis:
    """Per-document selection of the ``top_n`` most representative and least
    redundant segments (centroid similarity + MMR) and the analysis metrics.

    ``segs`` is the long segments table (``keys, position, segment_id, text``),
    ``docs`` has one row per document (drives the metrics, so an empty
    document still gets a row).  ``vectors`` may pass segments that already
    carry an ``embedding``.  ``sizes`` (``keys, n``) may give the segment
    count per document from a cheaper source than counting ``segs`` (it only
    routes hot documents to the distributed selection path).
    """
    opts = opts or AnalyzerOptions()
    k = _keys(keys)
    embedder = embedder or HashingEmbedder()
    buckets_dim, vector_expr = None, None
    if vectors is None and store is None and isinstance(embedder, HashingEmbedder):
        # the hashing embedder is cheap and native: it is computed after the
        # shuffle by document (signed token buckets from the text) and
        # densified in the per-document step -- one shuffle of the segment
        # rows instead of dedupe + dense vectors + join back
        vectors = segs.select(*k, "position", "segment_id", "text")
        buckets_dim = embedder.dim
        vector_expr = embedder.buckets("text")
    elif vectors is None:
        vectors = embed_segments(segs, embedder, store)
    if sizes is None:
        sizes = segs.groupBy(*k).agg(F.count(F.lit(1)).alias("n"))
    if not opts.rerank:
        # picks feed both the selection and the metrics: materialised once
        # (at most top_n rows per document) with a reliable checkpoint in
        # spark.checkpoint.dir -- survives executor loss, cuts the lineage, and
        # unlike a cached plan lets AQE coalesce the per-document shuffle
        picks = _materialize(analyze_groups(
            vectors, k, "position", "embedding", k=opts.top_n, lam=opts.mmr_lambda,
            payload=("segment_id", "text"), max_group_rows=opts.max_group_rows, sizes=sizes,
            buckets_dim=buckets_dim, vector_expr=vector_expr,
        ))
        firsts = picks.filter(F.col("rank") == 1).select(*k, "group_n", "group_valid", "group_top_n", "group_apc")
        selection = picks.select(
            *k, "rank", "position", "segment_id", "score_representative",
            F.lit(0.0).alias("score_diversity"), F.lit(None).cast("double").alias("score_rerank"),
            "reason", "mmr_score", "text",
        )
    else:
        # shortlist of top_m by MMR, re-ranked against one query per document;
        # vectors that follow from the text do not travel with it
        derived = vector_expr is not None
        short = analyze_groups(
            vectors, k, "position", "embedding", k=opts.top_m, lam=opts.mmr_lambda,
            payload=("segment_id", "text"), max_group_rows=opts.max_group_rows, sizes=sizes, emit_unit=not derived,
            buckets_dim=buckets_dim, vector_expr=vector_expr,
        ).withColumn("shortlist_pos", (F.col("rank") - 1).cast("long")).drop("rank", "reason")
        queries = rerank_queries(segs, docs, k, opts.query_mode)
        final = _materialize(rerank(short, queries, k, scorer, opts.top_n))
        picked = final
        if derived:
            picked = densify_column(final.select(*k, vector_expr.alias(UNIT)), UNIT, buckets_dim).withColumn(UNIT, l2_normalize(UNIT))
        stats = pick_stats(picked, k).withColumnRenamed("top_n", "group_top_n").withColumnRenamed(
            "avg_pairwise_cosine", "group_apc")
        firsts = final.filter(F.col("rank") == 1).select(*k, "group_n", "group_valid").join(stats, k)
        selection = final.select(
            *k, "rank", "position", "segment_id", "score_representative",
            F.lit(0.0).alias("score_diversity"), "score_rerank", "reason", "mmr_score", "shortlist_pos", "text",
        )
    # all segments count, also those of a document without a single pick
    counts = sizes.select(*k, F.col("n").alias("_all"))
    metrics = docs.select(*k).join(firsts, k, "left").join(counts, k, "left").select(
        *k,
        F.coalesce("_all", F.lit(0)).cast("long").alias("num_segments"),
        F.coalesce("group_top_n", F.lit(0)).cast("long").alias("top_n"),
        F.lit(float(opts.mmr_lambda)).alias("mmr_lambda"),
        F.coalesce("group_apc", F.lit(0.0)).alias("avg_pairwise_cosine"),
        F.coalesce("group_valid", F.lit(0)).cast("long").alias("analyzed_segments"),  # coverage (V16)
    )
    return Analysis(selection, metrics)


def _materialize(df: DataFrame) -> DataFrame:
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def rerank_queries(segs: DataFrame, docs: DataFrame, keys=("doc_id",), mode: str = QUERY_MODE_CENTROID_SUMMARY,
                   title: str = "title") -> DataFrame:
    """One query per document from its title (if any) and first segment.

    The first segment is the row at position 0, so no aggregation is needed.
    """
    k = _keys(keys)
    first = segs.filter(F.col("position") == 0).select(*k, F.col("text").alias("_first"))
    tcol = F.col(title) if title in docs.columns else F.lit(None).cast("string")
    d = docs.select(*k, tcol.alias("_title")).join(first, k, "left")
    return d.select(*k, rerank_query(F.col("_title"), F.col("_first"), mode).alias("query"))


# ---------------------------------------------------------------------------
# Whole pipelines
# ---------------------------------------------------------------------------

@dataclass
class PipelineResult:
    documents: DataFrame  # nested documents, one per page
    segments: DataFrame  # long segments table
    selection: DataFrame  # one row per pick
    metrics: DataFrame  # one row per document
    analysis: DataFrame  # nested analysis records
    summary: DataFrame  # one summary per document
    observations: dict

    def release(self) -> None:
        """Give back the executors' copy of the parsed documents, once the
        outputs are written.  They can still be read (and are parsed again)."""
        self.documents.unpersist()


def nest_analysis(selection: DataFrame, metrics: DataFrame, docs: DataFrame, keys, fingerprint: str) -> DataFrame:
    """Analysis records: ``keys, doc_id, model_fingerprint, top_segments[], metrics``."""
    k = _keys(keys)
    score = F.struct("segment_id", "score_representative", "score_diversity", "score_rerank", "reason")
    top = selection.groupBy(*k).agg(F.array_sort(F.collect_list(F.struct("rank", score.alias("s")))).alias("_t"))
    m = metrics.select(*k, F.struct("num_segments", "top_n", "mmr_lambda", "avg_pairwise_cosine").alias("metrics"))
    out = docs.select(*k, "doc_id").join(m, k, "left").join(top, k, "left")
    return out.select(
        *k, "doc_id", F.lit(fingerprint).alias("model_fingerprint"),
        F.coalesce(F.transform("_t", lambda x: x["s"]), F.array().cast("array<struct<segment_id:string,score_representative:double,score_diversity:double,score_rerank:double,reason:string>>")).alias("top_segments"),
        "metrics",
    )


def run_fingerprint(embedder, opts: AnalyzerOptions, scorer=None) -> str:
    """Fingerprint of the models of one run: the embedder, and the re-ranker if used."""
    reranker = (scorer.fingerprint if scorer else "token-overlap@1") if opts.rerank else None
    return combined_fingerprint(embedder.fingerprint, reranker)


def run_pages(
    pages: DataFrame,
    analyzer_opts: AnalyzerOptions | None = None,
    summarizer_opts=None,
    embedder=None,
    store=None,
    scorer=None,
    responses: DataFrame | None = None,
    key: str = "page_id",
    fetched_at=None,
) -> PipelineResult:
    """Pages ``(key, url, html)`` -> documents -> analysis -> summary.

    The picks are materialised while the plan is built, the outputs are lazy
    (``release`` the result after use; ``plans/stages.py`` has the same job
    with every stage written and timed); per-stage row counts are collected with ``observe`` the first time each
    output is computed.
    """
    from pyspark.sql import Observation

    from ..operators.extract import extract_pages
    from ..operators.segments import build_documents, explode_document_segments
    from ..operators.summary import pick_lists, resolve_picks, summarize

    opts = analyzer_opts or AnalyzerOptions()
    embedder = embedder or HashingEmbedder()
    obs = {name: Observation(name) for name in ("pages", "documents", "segments", "picks")}
    pages = pages.observe(obs["pages"], F.count(F.lit(1)).alias("rows"))
    ex = extract_pages(pages, keep=[key, "url"])
    docs = build_documents(ex, url="url", title="title", text="text_content", fetched_at=fetched_at, keys=[key])
    # parsed documents feed segments, analysis and summary: parse HTML once
    docs = docs.observe(obs["documents"], F.count(F.lit(1)).alias("rows")).persist(StorageLevel.MEMORY_AND_DISK)
    segs = explode_document_segments(docs, keys=[key]).observe(obs["segments"], F.count(F.lit(1)).alias("rows"))
    a = analyze(segs, docs.select(key, "title"), key, embedder, opts, store, scorer=scorer,
                sizes=docs.select(key, F.size("segments").alias("n")))
    selection = a.selection.observe(obs["picks"], F.count(F.lit(1)).alias("rows"))
    fp = run_fingerprint(embedder, opts, scorer)
    analysis = nest_analysis(selection, a.metrics, docs, key, fp)
    # the picks carry their text, so no lookup join is needed here
    picks = pick_lists(selection.select(key, "rank", "segment_id", "text"), key)
    summary = summarize(docs.select(key, "title", "lang"), picks, responses, key, summarizer_opts)
    return PipelineResult(docs, segs, selection, a.metrics, analysis, summary, obs)


def _row_keyed(docs: DataFrame) -> DataFrame:
    """Documents with ``_row``, a hash of all their columns but the time of
    fetching (no result depends on it, and it may be the running query's
    clock).  ``doc_id`` is an attribute, not a key: documents that share one
    stay apart; only rows equal in all else have one key."""
    columns = [docs[c] for c in docs.columns if c != "fetched_at"]
    return docs.withColumn("_row", F.sha2(F.to_json(F.struct(*columns)), 256))


def analyze_documents(docs: DataFrame, opts: AnalyzerOptions | None = None, embedder=None, store=None,
                      scorer=None) -> DataFrame:
    """Nested documents (as read from JSON) -> nested analysis records, one
    per document row.  Rows equal in every column are analysed once and each
    get the record."""
    from ..operators.segments import explode_document_segments

    opts = opts or AnalyzerOptions()
    embedder = embedder or HashingEmbedder()
    d = _row_keyed(docs)
    # written once: segments, sizes, titles and the records read it
    once, _ = write_scratch(d.groupBy("_row", "doc_id").agg(
        *[F.first(c).alias(c) for c in docs.columns if c != "doc_id"], F.count(F.lit(1)).alias("_copies")), "analysed-documents")
    segs = explode_document_segments(once, keys=["_row"])
    sizes = once.select("_row", F.greatest(F.coalesce(F.size("segments"), F.lit(0)), F.lit(0)).alias("n"))
    a = analyze(segs, once.select("_row", "title"), "_row", embedder, opts, store, scorer=scorer, sizes=sizes)
    nested = nest_analysis(a.selection, a.metrics, once.select("_row", "doc_id"), "_row", run_fingerprint(embedder, opts, scorer))
    copies = once.select("_row", F.explode(F.sequence(F.lit(1), F.col("_copies"))).alias("_copy")).drop("_copy")
    return copies.join(nested, "_row").drop("_row")


def summarize_documents(analyses: DataFrame, docs: DataFrame, responses: DataFrame | None = None, opts=None):
    """Nested analyses + documents -> (summaries, mismatches).

    One summary per analysis whose ``doc_id`` has a document; ``mismatches``
    lists those that have none (U10).  A pick is looked up among the segments
    of all documents of that ``doc_id``; title and language are those of the
    first of them by (title, lang).
    """
    from ..operators.segments import explode_document_segments
    from ..operators.summary import pick_lists, resolve_picks, summarize

    # each read several times below: written, so that neither input is computed again
    heads, _ = write_scratch(docs.groupBy("doc_id").agg(F.min(F.struct("title", "lang")).alias("_h")).select(
        "doc_id", "_h.title", "_h.lang"), "document-heads")
    an, _ = write_scratch(_row_keyed(analyses).select("_row", "doc_id", "top_segments"), "keyed-analyses")
    mismatches = an.join(heads, "doc_id", "left_anti").select("doc_id")
    once = an.join(heads, "doc_id", "left_semi").groupBy("_row", "doc_id").agg(F.first("top_segments").alias("top_segments"))
    sel = once.select("_row", "doc_id", F.posexplode("top_segments").alias("pos", "s")).select(
        "_row", "doc_id", (F.col("pos") + 1).alias("rank"), F.col("s.segment_id").alias("segment_id"))
    segs = explode_document_segments(docs, keys=["doc_id"])
    found = resolve_picks(sel.select("doc_id", "rank", "segment_id").distinct(), segs, "doc_id")
    picks = sel.join(found.drop("rank").dropDuplicates(["doc_id", "segment_id"]), ["doc_id", "segment_id"], "left")
    out = summarize(once.select("_row", "doc_id").join(heads, "doc_id"), pick_lists(picks, "_row"), responses=None if responses is None else
                    once.select("_row", "doc_id").join(responses, "doc_id").drop("doc_id"), keys="_row", opts=opts)
    rows = an.select("_row", "doc_id").join(out, "_row").drop("_row")
    return rows, mismatches
