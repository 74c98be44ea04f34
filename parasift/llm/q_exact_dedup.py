"""Registered query: exact deduplication of ``documents``."""

from parasift.sources.tables import read_table

from .exact_dedup import classify
from .registry import register


@register("op9_exact_dedup", oracle="""
WITH d AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS h
  FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY h) AS keep_id, count(*) OVER (PARTITION BY h) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY h) AS kept, h AS text_sha256
FROM d
""")
def op9_exact_dedup(spark, sf_dir):
    return classify(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
