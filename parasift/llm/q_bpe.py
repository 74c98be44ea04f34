"""Registered query: byte-level BPE of ``documents``."""

from functools import cache

import public_tokenizers
from pyspark.sql import functions as F

from parasift.sources.tables import read_table

from . import bpe
from .registry import register

VOCABULARY = "byte_bpe_multi_50k.tiktoken"


@cache
def default_codec(name: str = VOCABULARY) -> bpe.Codec:
    return bpe.Codec(bpe.load_ranks(public_tokenizers.path(name)), public_tokenizers.PATTERN)


@register("op2_byte_bpe")
def op2_byte_bpe(spark, sf_dir):
    codec = default_codec()
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    ids = F.col("ids")
    return bpe.encode(docs, codec).select(
        "doc_id", F.size(ids).cast("long").alias("n_tokens"),
        F.sha2(F.array_join(ids.cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(codec.decode(ids), 256).alias("decoded_sha256"),
    )
