"""A batch job in stages: every stage is written, counted and timed.

A stage's result is Parquet in the job's folder and the input of the next, so
pages are parsed once whatever reads them, nothing is kept in executor memory,
and a job that failed goes on with the stages it lacks.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..operators.embed import HashingEmbedder
from ..operators.extract import extract_pages
from ..operators.segments import build_documents, explode_document_segments
from ..operators.summary import pick_lists, summarize
from ..options import AnalyzerOptions
from .pipeline import analyze, nest_analysis, run_fingerprint

STAGES_SCHEMA = "stage string, position int, rows long, seconds double, reused boolean"


@dataclass
class Stage:
    name: str
    rows: int
    seconds: float
    reused: bool


class StagedJob:
    """Stages below ``folder`` (shared storage).  With ``resume``, a stage
    that an earlier run completed is read, not computed."""

    def __init__(self, spark: SparkSession, folder: str, resume: bool = False):
        self.spark, self.folder, self.resume = spark, folder.rstrip("/"), resume
        self.stages: list[Stage] = []

    def _complete(self, path: str) -> bool:
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(p)

    def run(self, name: str, build: Callable[[], DataFrame]) -> DataFrame:
        """Write the stage's rows, counted as they are written, and read them
        back.  The time includes building the plan, which may run jobs."""
        path, start = f"{self.folder}/{name}", time.monotonic()
        reused = self.resume and self._complete(path)
        if reused:
            rows = self.spark.read.parquet(path)
            n = rows.count()
        else:
            seen, df = Observation(), build()
            df.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("overwrite").parquet(path)
            rows = self.spark.read.schema(df.schema).parquet(path)
            n = int(seen.get.get("n", 0))
        self.stages.append(Stage(name, n, time.monotonic() - start, reused))
        return rows

    def table(self) -> DataFrame:
        """``stage, position, rows, seconds, reused``."""
        return self.spark.createDataFrame(
            [(s.name, i, s.rows, s.seconds, s.reused) for i, s in enumerate(self.stages)], STAGES_SCHEMA)


def run_pages_job(pages: DataFrame, folder: str, analyzer_opts: AnalyzerOptions | None = None, summarizer_opts=None, embedder=None,
                  store=None, scorer=None, responses: DataFrame | None = None, key: str = "page_id", fetched_at=None,
                  resume: bool = False) -> tuple[dict[str, DataFrame], StagedJob]:
    """P1 as a staged job: pages ``(key, url, html)`` to ``documents, segments,
    selection, metrics, analysis, summary`` below ``folder``."""
    opts, embedder = analyzer_opts or AnalyzerOptions(), embedder or HashingEmbedder()
    job, out = StagedJob(pages.sparkSession, folder, resume), {}

    def stage(name, build):
        out[name] = job.run(name, build)

    stage("documents", lambda: build_documents(
        extract_pages(pages, keep=[key, "url"]), url="url", title="title", text="text_content", fetched_at=fetched_at, keys=[key]))
    docs = out["documents"]
    stage("segments", lambda: explode_document_segments(docs, keys=[key]))
    analysis = []

    def analysed():
        if not analysis:  # one analysis gives both tables
            analysis.append(analyze(out["segments"], docs.select(key, "title"), key, embedder, opts, store, scorer=scorer,
                                    sizes=docs.select(key, F.size("segments").alias("n"))))
        return analysis[0]

    stage("selection", lambda: analysed().selection)
    stage("metrics", lambda: analysed().metrics)
    stage("analysis", lambda: nest_analysis(out["selection"], out["metrics"], docs, key, run_fingerprint(embedder, opts, scorer)))
    stage("summary", lambda: summarize(
        docs.select(key, "title", "lang"), pick_lists(out["selection"].select(key, "rank", "segment_id", "text"), key),
        responses, key, summarizer_opts))
    return out, job
