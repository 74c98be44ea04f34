"""Registered query: main text of ``pages``."""

from pyspark.sql import functions as F

from parasift.sources.tables import read_table

from .registry import register
from .wrapper import extract


@register("op3_wrapper_extraction")
def op3_wrapper_extraction(spark, sf_dir):
    pages = read_table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return extract(pages).select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))
