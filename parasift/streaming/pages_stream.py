"""Incremental page processing with Structured Streaming.

The reference has no stream operators; its per-page work is stateless (or
store-backed), so a stream of crawled pages is handled by running the batch
pipeline on every micro-batch through ``foreachBatch``:

* outputs are written under ``batch_id=N`` with dynamic partition overwrite,
  so a micro-batch replayed after an executor or driver failure replaces its
  own output instead of duplicating it;
* the embedding store is shared across batches (read-through, last write
  wins), so a paragraph seen in an earlier batch is never embedded again;
* progress lives in ``checkpoint_location`` on shared storage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..options import AnalyzerOptions, SummarizerOptions
from ..plans.pipeline import run_pages

PAGES_SCHEMA = T.StructType([
    T.StructField("page_id", T.LongType()),
    T.StructField("url", T.StringType()),
    T.StructField("html", T.StringType()),
])


def process_batch(batch: DataFrame, batch_id: int, out_dir: str, analyzer_opts=None, summarizer_opts=None,
                  embedder=None, store=None) -> None:
    r = run_pages(batch, analyzer_opts, summarizer_opts, embedder=embedder, store=store)
    for name, df in (("documents", r.documents), ("selection", r.selection), ("metrics", r.metrics),
                     ("summary", r.summary)):
        (df.withColumn("batch_id", F.lit(int(batch_id)))
           .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
           .partitionBy("batch_id").parquet(f"{out_dir.rstrip('/')}/{name}"))
    r.release()


def start_pages_stream(
    spark: SparkSession,
    source_dir: str,
    out_dir: str,
    checkpoint_location: str,
    analyzer_opts: AnalyzerOptions | None = None,
    summarizer_opts: SummarizerOptions | None = None,
    embedder=None,
    store=None,
    max_files_per_trigger: int | None = None,
    available_now: bool = True,
):
    """Start the stream over Parquet files of pages arriving in ``source_dir``."""
    reader = spark.readStream.schema(PAGES_SCHEMA)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    pages = reader.parquet(source_dir)

    def fn(batch_df, batch_id):
        process_batch(batch_df, batch_id, out_dir, analyzer_opts, summarizer_opts, embedder, store)

    w = pages.writeStream.foreachBatch(fn).option("checkpointLocation", checkpoint_location)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="30 seconds")
    return w.start()
