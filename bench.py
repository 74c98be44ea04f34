"""Benchmark the headline operators and the end-to-end pipeline.

Runs over the whole tables in ``$BENCH_SF_DIR`` (default
``/root/testdata/sf0.1``) on ``local[$BENCH_CPUS]`` and prints one JSON line.
Each step is forced to full evaluation with the ``noop`` sink (nothing is
collected to the driver).  A warm-up run (JVM JIT, Python workers) is
excluded.  Steps:

* ``segment``       documents -> segments (split, trim, ids)
* ``embed``         distinct segments -> hashing embeddings
* ``analyze``       segments -> per-document centroid + MMR selection + metrics
* ``analyze_rerank``  same with shortlist re-ranking
* ``topic_mmr``     embeddings table, MMR top-5 per label
* ``extract``       pages -> title/headings/links/main text -> segments
* ``summarize``     analysis -> extractive/API summaries per document
* ``store_lookup``  lookup of all segments against vectors of earlier segments
* ``store_second_run``  read-through of all segments from a store filled before (no embedder call)
* ``lockstep_mmr``  embeddings x 20, every topic on the distributed selection route
* ``pages_end_to_end``  pages -> documents -> analysis -> summary (P1)
"""

from __future__ import annotations

import json
import os
import sys
import time

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")

from pyspark.sql import functions as F  # noqa: E402

from parasift.plans import load_all  # noqa: E402
from parasift.plans.pipeline import run_pages  # noqa: E402
from parasift.session import local_session  # noqa: E402
from parasift.sources.tables import read_table  # noqa: E402


def run(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cores=cpus, shuffle_partitions=int(cpus) * 2)
    q, _ = load_all()

    from parasift.operators.embed import HashingEmbedder
    from parasift.operators.segments import explode_segments

    def embed_step(s, d):
        segs = explode_segments(read_table(s, d, "documents"), "doc_id", "text")
        return HashingEmbedder().embed(segs.select("segment_id", "text").distinct())

    def analyze_step(s, d):
        from parasift.plans.q_documents import _analysis

        a = _analysis(s, d)
        return a.selection.join(a.metrics, "doc_id")

    def rerank_step(s, d):
        return q["rerank_top"](s, d)

    def spread_pages(s, d):
        # one small file: the caller spreads the parsing over the cores
        return read_table(s, d, "pages").select("page_id", "url", "html").repartition(int(cpus))

    def extract_step(s, d):
        from parasift.operators.extract import extract_pages

        return explode_segments(extract_pages(spread_pages(s, d), keep=["page_id"]), "page_id", "text_content")

    def pipeline_step(s, d):
        r = run_pages(spread_pages(s, d))
        return r.summary.join(r.analysis, "page_id")

    stores = {}

    def prepare_store(s, d):
        import tempfile

        from parasift.operators.store import EmbeddingStore
        from parasift.plans.pipeline import embed_segments

        stores[d] = EmbeddingStore(s, tempfile.mkdtemp(prefix="parasift-bench-") + "/store")
        run(embed_segments(explode_segments(read_table(s, d, "documents"), "doc_id", "text"), store=stores[d]))

    def second_run_step(s, d):
        from parasift.plans.pipeline import embed_segments

        return embed_segments(explode_segments(read_table(s, d, "documents"), "doc_id", "text"), store=stores[d])

    def lockstep_step(s, d):
        from parasift.operators.analysis import analyze_groups

        # one small file: the caller spreads the rows over the cores
        e = read_table(s, d, "embeddings").select("label", "vec_id", "embedding").repartition(int(cpus))
        many = e.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(19)))).select(
            "label", (F.col("vec_id") * 20 + F.col("copy")).alias("vec_id"),
            F.transform("embedding", lambda x: x + F.col("copy") * 0.001).alias("embedding"))
        return analyze_groups(many, "label", "vec_id", "embedding", k=5, lam=0.65, max_group_rows=10)

    steps = {
        "segment": q["doc_segments"],
        "embed": embed_step,
        "analyze": analyze_step,
        "analyze_rerank": rerank_step,
        "topic_mmr": q["mmr_top5"],
        "extract": extract_step,
        "summarize": q["summary_final"],
        "store_lookup": q["store_hits"],
        "store_second_run": second_run_step,
        "lockstep_mmr": lockstep_step,
        "pages_end_to_end": pipeline_step,
    }
    warm_dir = os.environ.get("BENCH_WARM_DIR", "/root/testdata/sf0.001")
    for d in {warm_dir if os.path.isdir(warm_dir) else sf_dir, sf_dir}:
        prepare_store(spark, d)
    for fn in steps.values():  # warm-up on the small tables: JIT, Python workers
        run(fn(spark, warm_dir if os.path.isdir(warm_dir) else sf_dir))
        spark.catalog.clearCache()
    times: dict[str, float] = {}
    for name, fn in steps.items():
        spark.catalog.clearCache()  # no step reuses another step's cached data
        t0 = time.time()
        run(fn(spark, sf_dir))
        times[name] = round(time.time() - t0, 3)
    docs = read_table(spark, sf_dir, "documents").count()
    pages = read_table(spark, sf_dir, "pages").count()
    total = round(sum(times.values()), 3)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({
        "metric": "headline_steps_total",
        "value": total,
        "unit": "sec",
        "queries": times,
        "sf": float(sf) if sf.replace(".", "").isdigit() else sf,
        "cpus": int(cpus),
        "documents_per_sec_analyze": round(docs / times["analyze"], 1),
        "pages_per_sec_end_to_end": round(pages / times["pages_end_to_end"], 1),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
