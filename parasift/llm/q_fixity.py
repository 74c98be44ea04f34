"""Registered query: fixity audit of archives made of ``pages``.

The good replica holds every page as a WARC record, 1,024 ids to an archive.
The copy is the same files with damage by rule: where the id leaves 3 modulo 97
the first byte of the record is overwritten, where it leaves 5 the record is
lost (its place in the file stays).
"""

from pyspark.sql import functions as F

from parasift.sources.tables import read_table

from . import fixity
from .common import materialise
from .registry import register

PAGES_PER_ARCHIVE, FLIPPED, LOST, CYCLE = 1024, 3, 5, 97


@register("op1_merkle_fixity_audit", oracle="""
WITH r AS (
  SELECT page_id, page_id // 1024 AS archive, page_id % 97 AS fate,
         'WARC/1.0' || chr(13) || chr(10) || 'WARC-Type: resource' || chr(13) || chr(10)
         || 'WARC-Target-URI: ' || coalesce(url, '') || chr(13) || chr(10)
         || 'WARC-Record-ID: <urn:page:' || page_id || '>' || chr(13) || chr(10)
         || 'WARC-Block-Digest: sha256:' || sha256(coalesce(html, '')) || chr(13) || chr(10)
         || 'Content-Type: text/html' || chr(13) || chr(10)
         || 'Content-Length: ' || strlen(coalesce(html, '')) || chr(13) || chr(10) || chr(13) || chr(10)
         || coalesce(html, '') || chr(13) || chr(10) || chr(13) || chr(10) AS rec
  FROM pages),
l AS (
  SELECT *, CAST(strlen(rec) AS BIGINT) AS n,
         CAST(sum(strlen(rec)) OVER (PARTITION BY archive ORDER BY page_id ROWS UNBOUNDED PRECEDING) AS BIGINT)
         - CAST(strlen(rec) AS BIGINT) AS pos FROM r)
SELECT archive, pos AS "offset", pos // 65536 AS leaf, page_id,
       CASE WHEN fate = 3 THEN 'changed' ELSE 'missing' END AS problem,
       n AS length_good, CASE WHEN fate = 3 THEN n END AS length_copy,
       sha256(rec) AS digest_good, CASE WHEN fate = 3 THEN sha256('#' || substr(rec, 2)) END AS digest_copy
FROM l WHERE fate IN (3, 5)
""")
def op1_merkle_fixity_audit(spark, sf_dir):
    pages = read_table(spark, sf_dir, "pages").select("page_id", "url", "html")
    records = pages.select(
        "page_id", (F.col("page_id") % CYCLE).alias("fate"),
        fixity.warc_record(F.col("url"), F.col("html"), F.col("page_id")).alias("record"),
    )
    damaged = F.when(F.col("fate") == FLIPPED, F.overlay("record", F.lit(b"#"), F.lit(1))).otherwise(F.col("record"))
    hashed = records.select(
        "page_id", "fate", fixity.record_length(F.col("record")).alias("length"),
        fixity.record_digest(F.col("record")).alias("good"), fixity.record_digest(damaged).alias("copy"),
    )
    archive = F.floor(F.coalesce("page_id", F.lit(-1)) / PAGES_PER_ARCHIVE)
    both = materialise(fixity.lay_out(hashed, archive, [F.col("page_id"), F.col("good")]), "fixity-records")
    good = both.select("archive", "offset", "length", F.col("good").alias("digest"))
    copy = both.where(~F.col("fate").eqNullSafe(LOST)).select(
        "archive", "offset", "length", F.col("copy").alias("digest"))
    levels = fixity.depth(good)
    found = fixity.audit(fixity.tree(good, levels), fixity.tree(copy, levels))
    return found.join(both.select("archive", "offset", "page_id"), ["archive", "offset"]).select(
        "archive", "offset", "leaf", "page_id", "problem", "length_good", "length_copy", "digest_good", "digest_copy")
