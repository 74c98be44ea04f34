"""Content identities.

Segment and document ids are content hashes, so they double as exact-dedup
keys and as embedding-store keys.  SHA-256 (``sha2(..., 256)``) stands in for
the reference's BLAKE3: only determinism and change-sensitivity matter, and
SHA-256 is a Spark built-in that DuckDB computes identically (``sha256``).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Chunking parameters and producer tag hashed into every document id of the
# page pipeline.
CHUNK_PARAMS = "paragraphs"
PRODUCER_TAG = "pages"
SCHEMA_VERSION = "1.0.0"
STORE_KEY_PREFIX = "emb:"


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def segment_id(text) -> Column:
    return F.sha2(_c(text), 256)


def doc_id_from_texts(texts, chunk_params: str = CHUNK_PARAMS, fingerprint: str = PRODUCER_TAG) -> Column:
    """Hash of the segment texts joined by newlines, then the params, then the tag."""
    joined = F.array_join(_c(texts), "\n")
    return F.sha2(F.concat(joined, F.lit(chunk_params), F.lit(fingerprint)), 256)


def model_fingerprint(repo_id: str | None = None, revision: str | None = None, local_dir: str | None = None) -> str:
    """``repo@rev`` for a published model, ``local:dir`` for a local one."""
    if local_dir is not None:
        return f"local:{local_dir}"
    return f"{repo_id}@{revision}"


def combined_fingerprint(embedder_fp: str, reranker_fp: str | None) -> str:
    return embedder_fp if not reranker_fp else f"{embedder_fp}+{reranker_fp}"


def store_key(segment_id_col, fingerprint_col) -> Column:
    """String form of an embedding-store key: ``emb:{segment_id}:{fingerprint}``."""
    return F.concat(F.lit(STORE_KEY_PREFIX), _c(segment_id_col), F.lit(":"), _c(fingerprint_col))


def parse_store_key(key) -> Column:
    """Parse a store key into ``struct(segment_id, model_fingerprint)``; null if malformed.

    The fingerprint may itself contain ``:`` (``local:`` fingerprints), so the
    key is split at the first colon after the prefix only.
    """
    k = _c(key)
    rest = F.substr(k, F.lit(len(STORE_KEY_PREFIX) + 1))
    parts = F.split(rest, ":", 2)
    ok = k.startswith(STORE_KEY_PREFIX) & (F.size(parts) == 2)
    return F.when(
        ok,
        F.struct(parts.getItem(0).alias("segment_id"), parts.getItem(1).alias("model_fingerprint")),
    )
