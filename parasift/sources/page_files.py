"""Pages from a folder of crawled files (S1): one page a file.

Spark plans the partitions by file size; the bytes of a file are one row.  The
url is the file's name without its suffix, percent-decoded (a name that is no
http(s) address: the path of the file).  Bytes that are UTF-8 are taken as they are;
others are read as Latin-1 if the head of the page declares that, else the page
is an error row.  An error row has a null ``html`` and says what is wrong, so
one bad file neither fails the job nor disappears.  An empty file has no row:
Spark plans none for it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Declared names of Latin-1 and of its superset, as pages write them.
LATIN1 = r"(?i)charset\s*=\s*[\"']?\s*(iso-8859-1|latin-?1|windows-1252)"
HEAD_BYTES = 2048


def read_page_files(spark: SparkSession, folder: str, pattern: str = "*.html", recursive: bool = True) -> DataFrame:
    """``page_id`` (hash of the path), ``url``, ``html``, ``path``, ``error``."""
    files = (spark.read.format("binaryFile").option("pathGlobFilter", pattern)
             .option("recursiveFileLookup", recursive).load(folder).select("path", "content"))
    name = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.[^.]*$", "")
    named = F.try_url_decode(name)
    text = F.decode("content", "ISO-8859-1")
    declared = F.decode(F.substring("content", 1, HEAD_BYTES), "ISO-8859-1").rlike(LATIN1)
    utf8 = F.is_valid_utf8(F.col("content").cast("string"))
    html = F.when(utf8, F.col("content").cast("string")).when(declared, text)
    error = F.when(~utf8 & ~declared, "bytes of an unknown character set")
    return files.select(
        F.xxhash64("path").alias("page_id"),
        F.when(named.rlike("^https?://"), named).otherwise(F.col("path")).alias("url"),
        html.alias("html"), "path", error.alias("error"))
