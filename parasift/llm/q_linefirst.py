"""Registered query: line-first cleaning of ``documents``."""

from pyspark.sql import functions as F

from parasift.sources.tables import read_table

from .linefirst import (ENTRY_WORDS, FEWEST_WORDS, MENU, MENU_WORDS, MOST_LOST, MOST_REPEATED, NOTICE, NOTICE_WORDS, OPEN_WORDS,
                        SENTENCE_END, SEPARATORS, SPACE, SYMBOL_PERCENT, SYMBOLS, judge_documents)
from .registry import register


def _text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _found(column: str, chars: str) -> str:
    return f"(length({column}) - length(translate({column}, {_text(chars)}, '')))"


_GAP = _text(SPACE)
_WORDS = f"regexp_extract_all({{}}, {_text('[^' + SPACE[1:] + '+')})"
_LOW = "translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLE = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, doc_id, text, {_WORDS.format('text')} AS ws FROM d),
win AS (SELECT r, i, ws[i] AS a, ws[i + 1] AS b, ws[i + 2] AS c FROM (SELECT r, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
twice AS (SELECT r, i, count(*) OVER (PARTITION BY r, a, b, c) AS n FROM win),
cover AS (SELECT r, count(DISTINCT p) AS n_repeat FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM twice WHERE n > 1) GROUP BY r),
split AS (SELECT r, string_split(text, chr(10)) AS parts FROM d),
line AS (SELECT r, unnest(range(1, len(parts) + 1)) AS pos, unnest(parts) AS line FROM split),
judged AS (
  SELECT r, pos, line, len({_WORDS.format('line')}) AS n,
         length(regexp_replace(line, {_GAP}, '', 'g')) AS chars,
         row_number() OVER (PARTITION BY r, line ORDER BY pos) AS seen,
         {_found('line', SYMBOLS)} AS symbols, {_found('line', SEPARATORS)} AS separators,
         regexp_matches(line, {_text(SENTENCE_END)}) AS ends,
         regexp_matches({_LOW}, {_text(MENU)}) AS menu, regexp_matches({_LOW}, {_text(NOTICE)}) AS notice
  FROM line),
ruled AS (
  SELECT *, CASE
    WHEN n = 0 THEN 'none'
    WHEN 100 * symbols > {SYMBOL_PERCENT} * n OR (n < {OPEN_WORDS} AND NOT ends) THEN 'punctuation'
    WHEN (separators >= 2 AND n <= {ENTRY_WORDS} * separators) OR (n <= {MENU_WORDS} AND menu) THEN 'navigation'
    WHEN n <= {NOTICE_WORDS} AND notice THEN 'boilerplate' ELSE 'none' END AS rule
  FROM judged),
lines AS (
  SELECT r, count(*) FILTER (n > 0 AND seen > 1) AS n_dup, count(*) FILTER (rule = 'punctuation') AS n_punctuation,
         count(*) FILTER (rule = 'navigation') AS n_navigation, count(*) FILTER (rule = 'boilerplate') AS n_boilerplate,
         CAST(coalesce(sum(chars) FILTER (rule <> 'none'), 0) AS BIGINT) AS lost_chars,
         coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (rule = 'none'), '') AS clean_text
  FROM ruled GROUP BY r),
base AS (
  SELECT w.r, w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, length(regexp_replace(text, {_GAP}, '', 'g')) AS word_chars,
         {_found('text', SYMBOLS)} AS n_symbols, coalesce(n_repeat, 0) AS n_repeat_words
  FROM w LEFT JOIN cover USING (r)),
failed AS (
  SELECT *, n_words < {FEWEST_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED} * n_words AS base_failed FROM base)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup AS n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND 100 * lost_chars <= {MOST_LOST} * word_chars AS kept,
       n_punctuation, n_navigation, n_boilerplate, lost_chars, sha256(clean_text) AS clean_sha256
FROM failed JOIN lines USING (r)
"""


@register("op12_line_first", oracle=ORACLE)
def op12_line_first(spark, sf_dir):
    judged = judge_documents(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return judged.withColumn("clean_sha256", F.sha2(F.col("clean_text").cast("binary"), 256)).drop("clean_text")
