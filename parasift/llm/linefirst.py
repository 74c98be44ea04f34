"""Line-first cleaning: rules judge lines, what is left judges the document.

Every line of a text is held against three kinds of rules; a line that one of
them names is removed:

* punctuation: a short line that no sentence end closes, or one with many
  symbols for its words;
* navigation: a list of short entries between separators, or a short line that
  begins with a menu word;
* boilerplate: a line, not of paragraph length, with a legal or site phrase.

A document is rejected if its words are too few or too repetitive before any
cleaning (``base_failed``), or if the removed lines held more than
``MOST_LOST`` percent of its word characters.

Words are runs without space and 0x09-0x0D.  One pass, no shuffle; memory is
one document at a time.

Edge cases: null counts as empty, an empty text has no words and is rejected;
lines without a word are neither judged nor removed; a repeated row gives a
repeated result; texts of any length are judged whole; an empty table gives an
empty result; ``clean_documents`` keeps all columns, whatever their names.
"""

from __future__ import annotations

import re
from collections import Counter

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FEWEST_WORDS, MOST_REPEATED = 50, 50
#: Percent of the word characters that removed lines may hold.
MOST_LOST = 30
SYMBOLS = "#*$%&|<>"
SPACE = r"[\x20\x09-\x0D]"

# Rules of one line, in this order (fixed values).
OPEN_WORDS = 15  # a line of fewer words must end a sentence
SYMBOL_PERCENT = 50  # symbols for 100 words
ENTRY_WORDS = 6  # words for each separator, at most
MENU_WORDS = 6
NOTICE_WORDS = 40
SENTENCE_END = r"""[.!?…:;"'”’»)\]。！？]""" + SPACE + "*$"
SEPARATORS = "|»›•·"
MENU = (
    r"^" + SPACE + r"*(?:home|menu|search|next|previous|prev|back to top|skip to content|skip to main content|read more|"
    r"sign in|sign up|log in|login|log out|logout|share|contact us|about us|main page|sitemap)(?:[^a-z]|$)"
)
NOTICE = (
    r"all rights reserved|copyright|licensed under|released under|cookie|javascript|terms of use|terms of service|"
    r"privacy policy|lorem ipsum|powered by|click here|follow us|subscribe to|sign up for|page not found|under construction"
)
RULES = ("punctuation", "navigation", "boilerplate")

_END, _MENU, _NOTICE = re.compile(SENTENCE_END), re.compile(MENU), re.compile(NOTICE)
_LOWER = {c: c + 32 for c in range(65, 91)}

FIELDS = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, "
    "n_punctuation long, n_navigation long, n_boilerplate long, lost_chars long, clean_text string"
)


def failed_rule(line: str, n_words: int) -> str | None:
    """The first rule that a line with words fails."""
    if 100 * _count(line, SYMBOLS) > SYMBOL_PERCENT * n_words or (n_words < OPEN_WORDS and not _END.search(line)):
        return RULES[0]
    separators = _count(line, SEPARATORS)
    low = line.translate(_LOWER)
    if (separators >= 2 and n_words <= ENTRY_WORDS * separators) or (n_words <= MENU_WORDS and _MENU.search(low)):
        return RULES[1]
    if n_words <= NOTICE_WORDS and _NOTICE.search(low):
        return RULES[2]
    return None


def _count(text: str, chars: str) -> int:
    return sum(map(text.count, chars))


def _word_chars(words: list[bytes]) -> int:
    return len(b"".join(words).decode("utf-8", "surrogatepass"))


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a window of three words found more than once."""
    windows = list(zip(words, words[1:], words[2:]))
    counts = Counter(windows)
    if len(counts) == len(windows):
        return 0
    covered = bytearray(len(words))
    for i, w in enumerate(windows):
        if counts[w] > 1:
            covered[i : i + 3] = b"\1\1\1"
    return sum(covered)


def judge(text: str | None) -> tuple:
    """The values of ``FIELDS`` for one text."""
    text = text or ""
    words = text.encode("utf-8", "surrogatepass").split()  # bytes split at exactly these six characters
    n_words, chars, repeats = len(words), _word_chars(words), repeated_words(words)
    seen, again, lost, kept, failed = set(), 0, 0, [], Counter()
    for line in text.split("\n"):
        line_words = line.encode("utf-8", "surrogatepass").split()
        if not line_words:
            kept.append(line)
            continue
        again += line in seen
        seen.add(line)
        rule = failed_rule(line, len(line_words))
        failed[rule] += 1
        if rule:
            lost += _word_chars(line_words)
        else:
            kept.append(line)
    base_failed = n_words < FEWEST_WORDS or 100 * repeats > MOST_REPEATED * n_words
    ok = not base_failed and 100 * lost <= MOST_LOST * chars
    return (n_words, chars, _count(text, SYMBOLS), again, repeats, base_failed, ok,
            *(failed[r] for r in RULES), lost, "\n".join(kept))


def judge_documents(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row per row of ``docs``: the id and the fields of ``FIELDS``."""
    names = [f.split()[0] for f in FIELDS.split(", ")]
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        for batch in batches:
            rows = [judge(t.as_py()) for t in batch.column(1)]
            columns = list(zip(*rows, strict=True)) or [()] * len(names)
            types = [{"long": pa.int64(), "boolean": pa.bool_(), "string": pa.string()}[f.split()[1]] for f in FIELDS.split(", ")]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], names=["_id", *names])

    out = docs.select(docs[id_col].alias("_id"), docs[text_col].cast("string").alias("_text")).mapInArrow(run, f"_id {kind}, {FIELDS}")
    return out.withColumnRenamed("_id", id_col)


def clean_documents(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows that stay, with all their columns and the cleaned text."""
    place = docs.columns.index(text_col)

    def run(batches):
        for batch in batches:
            rows = [judge(t.as_py())[-6:] for t in batch.column(place)]
            stays = pa.array([r[0] for r in rows], pa.bool_())
            text = pa.array([r[-1] for r in rows], pa.string())
            columns = [text if i == place else c for i, c in enumerate(batch.columns)]
            yield pa.RecordBatch.from_arrays([pc.filter(c, stays) for c in columns], names=batch.schema.names)

    return docs.withColumn(text_col, F.col(f"`{text_col}`").cast("string")).mapInArrow(run, docs.schema)
