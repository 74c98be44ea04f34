"""Embedders: text column -> unit vector column (``array<float>``).

* :class:`HashingEmbedder` — the deterministic no-model default.  Tokens are
  the lower-cased runs of letters/digits; each token hashes (MD5, first eight
  hex digits) to a bucket ``h mod dim`` with sign ``+1`` if the ninth hex digit
  is below 8, else ``-1``.  The signed bucket counts are L2-normalised.  The
  tokenising and hashing are JVM built-ins; only the scatter of bucket counts
  into a dense vector runs in Arrow batches (numpy ``bincount`` over the whole
  batch, no per-row Python).
* :class:`ModelEmbedder` — any user model through
  ``pyspark.ml.functions.predict_batch_udf`` (the model is loaded once per
  Python worker and fed Arrow batches); outputs are L2-normalised natively.

Every embedder has a ``fingerprint`` that keys the embedding store.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.vectors import attention_mask, pad_truncate

# Fixed values of the hashing tokenizer / embedder (our own design).
TOKEN_SPLIT = r"[^\p{L}\p{N}]+"
HASH_HEX_DIGITS = 8
DEFAULT_DIM = 384
DEFAULT_VOCAB = 30522


def hash_tokens(text) -> Column:
    """Lower-cased letter/digit runs (no empty strings)."""
    c = F.col(text) if isinstance(text, str) else text
    return F.filter(F.split(F.lower(F.coalesce(c, F.lit(""))), TOKEN_SPLIT, -1), lambda t: t != F.lit(""))


def _token_hash(t: Column) -> Column:
    return F.conv(F.substring(F.md5(t), 1, HASH_HEX_DIGITS), 16, 10).cast("long")


def _token_sign(t: Column) -> Column:
    return F.when(F.substring(F.md5(t), HASH_HEX_DIGITS + 1, 1) < F.lit("8"), F.lit(1)).otherwise(F.lit(-1))


def signed_buckets(text, dim: int) -> Column:
    """``array<int>``: ``sign * (bucket + 1)`` per token (one MD5 per token)."""
    digests = F.transform(hash_tokens(text), lambda t: F.md5(t))
    return F.transform(
        digests,
        lambda h: (
            (F.conv(F.substring(h, 1, HASH_HEX_DIGITS), 16, 10).cast("long") % F.lit(dim)).cast("int") + F.lit(1)
        )
        * F.when(F.substring(h, HASH_HEX_DIGITS + 1, 1) < F.lit("8"), F.lit(1)).otherwise(F.lit(-1)),
    )


def token_ids(text, vocab: int = DEFAULT_VOCAB) -> Column:
    """Hash token ids in ``[1, vocab)``; 0 stays free for padding."""
    return F.transform(hash_tokens(text), lambda t: (_token_hash(t) % F.lit(vocab - 1) + F.lit(1)).cast("long"))


def token_window(text, max_len: int = 512, vocab: int = DEFAULT_VOCAB) -> Column:
    """``struct(ids, mask)``: ids cut/padded to ``max_len``, mask = id > 0."""
    ids = pad_truncate(token_ids(text, vocab), max_len)
    return F.struct(ids.alias("ids"), attention_mask(ids).alias("mask"))


def dense_from_buckets(col, dim: int) -> np.ndarray:
    """``(n, dim)`` float32 unit vectors from a list array of signed buckets
    (one ``bincount`` for the whole batch)."""
    n = len(col)
    lengths = col.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    vals = col.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    rows = np.repeat(np.arange(n, dtype=np.int64), lengths)
    idx = rows * dim + (np.abs(vals) - 1)
    mat = np.bincount(idx, weights=np.sign(vals).astype(np.float64), minlength=n * dim).reshape(n, dim)
    nrm = np.sqrt((mat * mat).sum(axis=1))
    nz = nrm > 0
    mat[nz] = mat[nz] / nrm[nz, None]
    return mat.astype(np.float32)


def _densify_batches(batches, dim: int, src: str, out: str, out_schema: pa.Schema):
    for rb in batches:
        n = rb.num_rows
        col = rb.column(rb.schema.get_field_index(src))
        mat = dense_from_buckets(col, dim)
        flat = pa.array(mat.ravel(), type=pa.float32())
        offsets = pa.array(np.arange(0, n * dim + 1, dim, dtype=np.int32), type=pa.int32())
        emb = pa.ListArray.from_arrays(offsets, flat)
        arrays = [rb.column(i) for i, f in enumerate(rb.schema) if f.name != src]
        yield pa.RecordBatch.from_arrays(arrays + [emb], schema=out_schema)


class HashingEmbedder:
    """Deterministic signed feature-hashing embedder (no model needed)."""

    def __init__(self, dim: int = DEFAULT_DIM):
        self.dim = int(dim)
        self.fingerprint = f"hashing-md5@{self.dim}"

    def buckets(self, text: str = "text") -> Column:
        """The compact form of the embedding (signed token buckets); the
        grouped analysis densifies it where the vectors are used."""
        return signed_buckets(text, self.dim)

    def embed(self, df: DataFrame, text: str = "text", out: str = "embedding") -> DataFrame:
        src = "_signed_buckets"
        staged = df.withColumn(src, signed_buckets(text, self.dim))
        fields = [f for f in staged.schema.fields if f.name != src]
        out_schema = T.StructType(fields + [T.StructField(out, T.ArrayType(T.FloatType()), True)])
        arrow_schema = pa.schema(
            [pa.field(f.name, _arrow_type(f.dataType), True) for f in out_schema.fields]
        )
        dim = self.dim

        def fn(batches):
            return _densify_batches(batches, dim, src, out, arrow_schema)

        return staged.mapInArrow(fn, out_schema)


def densify_column(df: DataFrame, col: str, dim: int) -> DataFrame:
    """Replace a signed-bucket column by its dense unit vector (same name)."""
    fields = [f if f.name != col else T.StructField(col, T.ArrayType(T.FloatType()), True) for f in df.schema.fields]
    out_schema = T.StructType(fields)
    arrow_schema = pa.schema([pa.field(f.name, _arrow_type(f.dataType), True) for f in out_schema.fields])
    names = [f.name for f in df.schema.fields]

    def fn(batches):
        for rb in batches:
            n = rb.num_rows
            mat = dense_from_buckets(rb.column(rb.schema.get_field_index(col)), dim)
            emb = pa.ListArray.from_arrays(pa.array(np.arange(0, n * dim + 1, dim, dtype=np.int32)),
                                           pa.array(mat.ravel(), type=pa.float32()))
            arrays = [emb if nm == col else rb.column(rb.schema.get_field_index(nm)) for nm in names]
            yield pa.RecordBatch.from_arrays(arrays, schema=arrow_schema)

    return df.mapInArrow(fn, out_schema)


def _arrow_type(dt: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(dt)


class ModelEmbedder:
    """A user model behind ``predict_batch_udf``.

    ``make_predict_fn`` is called once per Python worker and must return a
    function mapping a numpy array of strings to a ``(batch, dim)`` float
    array of sentence vectors (tokenise, run, pool inside it).  The vectors
    are L2-normalised per Arrow batch before they leave the worker.
    """

    def __init__(self, make_predict_fn: Callable, dim: int, fingerprint: str, batch_size: int = 64):
        from pyspark.ml.functions import predict_batch_udf

        self.dim = int(dim)
        self.fingerprint = fingerprint

        def make_normalised():
            predict = make_predict_fn()

            def run(texts: np.ndarray) -> np.ndarray:
                v = np.asarray(predict(texts), dtype=np.float64)
                n = np.sqrt((v * v).sum(axis=1, keepdims=True))
                return np.where(n > 0, v / np.where(n > 0, n, 1.0), v).astype(np.float32)

            return run

        self._udf = predict_batch_udf(
            make_normalised,
            return_type=T.ArrayType(T.FloatType()),
            batch_size=batch_size,
        )

    def embed(self, df: DataFrame, text: str = "text", out: str = "embedding") -> DataFrame:
        return df.withColumn(out, self._udf(F.col(text)))
