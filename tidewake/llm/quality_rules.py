"""Line-first quality rules: judge each line, remove the lines that fail, then reject documents that lose too much text.

Rules per line (a ``\\n``-split line that holds a word; words are runs of characters other than ASCII white space):

* punctuation: symbols are over a tenth of its characters, or it holds ``!!`` at least twice, or it has at most three words and no
  sentence end while it isn't the text's only line;
* navigation: at least three separators of menus and bread crumbs, or one and at most four words;
* boilerplate: a phrase of page furniture.

A document is rejected when the failing lines hold over 30 % of its characters in words, when it has fewer than 50 words, or when over
half of its words lie in three-word windows that occur twice or more.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewake.llm._shared import text_slices

SYMBOLS = "#*$%&|<>"
SEPARATORS = "|»›•·"
SENTENCE_END = ".!?…:;\"'”’»)]。！？"
MOST_LOST = 30
LEAST_WORDS = 50
BOILERPLATE = (
    "all rights reserved", "terms of use", "terms of service", "terms and conditions", "privacy policy", "cookie policy", "accept cookies", "uses cookies",
    "enable javascript", "javascript is disabled", "click here", "sign up for our", "subscribe to our", "share this", "follow us on", "skip to content",
    "log in to", "read more...", "powered by", "back to top",
)
_SPACE = " \t\n\x0b\x0c\r"
_symbol = re.compile(f"[{re.escape(SYMBOLS)}]")
_separator = re.compile(f"[{re.escape(SEPARATORS)}]")
_boilerplate = re.compile("|".join(map(re.escape, BOILERPLATE)))
_lower = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}


def word_chars(text: str) -> int:
    return len(text) - sum(map(text.count, _SPACE))


def line_verdict(line: str, alone: bool) -> str | None:
    """The rule that a line with a word fails, or None."""
    body = line.strip(_SPACE)
    chars, words = word_chars(body), len(body.encode().split())
    separators = len(_separator.findall(body))
    if separators >= 3 or separators and words <= 4:
        return "navigation"
    if 10 * len(_symbol.findall(body)) > chars or body.count("!!") >= 2:
        return "punctuation"
    if words <= 3 and not alone and body[-1] not in SENTENCE_END:
        return "punctuation"
    if _boilerplate.search(body.translate(_lower)):
        return "boilerplate"
    return None


def repeated_words(words: list[bytes]) -> int:
    """Words in three-word windows that are found twice or more, their first occurrence included."""
    n = len(words)
    if n < 4:
        return 0
    seen: dict[bytes, int] = {}
    codes = np.array([seen.setdefault(w, len(seen)) for w in words], np.int64)
    k = len(seen)
    if k == n:
        return 0
    pair = codes[:-1] * k + codes[1:]
    if k > 1 << 20:
        pair = np.unique(pair, return_inverse=True)[1]
    _, at, count = np.unique(pair[:-1] * k + codes[2:], return_inverse=True, return_counts=True)
    often = count[at] > 1
    covered = np.zeros(n, bool)
    for shift in range(3):
        covered[shift : n - 2 + shift] |= often
    return int(covered.sum())


def judge(text: str | None) -> tuple:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, lost_chars, cleaned text)."""
    text = text or ""
    words = text.encode().split()
    chars = word_chars(text)
    lines = text.split("\n")
    full = [x for x in lines if x.strip(_SPACE)]
    repeat = repeated_words(words)
    failed = len(words) < LEAST_WORDS or 100 * repeat > 50 * len(words)
    lost, kept_lines = 0, []
    for x in lines:
        if x.strip(_SPACE) and line_verdict(x, len(full) == 1):
            lost += word_chars(x)
        else:
            kept_lines.append(x)
    return len(words), chars, sum(map(text.count, SYMBOLS)), len(full) - len(set(full)), repeat, failed, not failed and 100 * lost <= MOST_LOST * chars, lost, "\n".join(kept_lines)


def apply_rules(df: DataFrame, key: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """``key``, the base counts, ``base_failed``, ``kept``, ``lost_chars`` and ``cleaned`` (the text without failing lines) of each row, and
    the columns named in ``keep``.

    A narrow operator without a shuffle. A null text counts as empty: it has no words, so it fails. Equal rows each give a row; other
    columns are left out whatever their names; an empty table gives an empty one. Long texts are judged whole. Columns to keep may have
    any names; those named as one that is added give way to it.
    """
    longs = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    names = [*longs, "base_failed", "kept", "lost_chars", "cleaned"]
    types = [*[pa.int64()] * 5, pa.bool_(), pa.bool_(), pa.int64(), pa.string()]
    passed = [key, *(c for c in dict.fromkeys(keep) if c != key and c not in names)]
    plain = df.select(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(passed)), F.col(f"`{text}`").alias("text"))
    at = [f"c{i}" for i in range(len(passed))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, "text"):
                columns = zip(*map(judge, part.column("text").to_pylist()))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in at), *(pa.array(c, t) for c, t in zip(columns, types))], [*at, *names])

    schema = f"{', '.join(f'{c} {plain.schema[c].dataType.simpleString()}' for c in at)}, {', '.join(f'{c} long' for c in longs)}, base_failed boolean, kept boolean, lost_chars long, cleaned string"
    return plain.mapInArrow(run, schema).toDF(*passed, *names)


def _sql_class(chars: str) -> str:
    return "[" + "".join("\\" + c if c in "|*$]).?[\"'&#%<>\\" else c for c in chars).replace("'", "''") + "]"


#: DuckDB SQL for the query's rows.
ORACLE = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws, t FROM d),
base AS (SELECT doc_id, len(ws) AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) AS word_chars, len(regexp_extract_all(t, '{_sql_class(SYMBOLS)}')) AS n_symbols FROM w),
g AS (SELECT doc_id, i, ws[i] AS a, ws[i + 1] AS b, ws[i + 2] AS c FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w WHERE len(ws) > 2)),
often AS (SELECT doc_id, a, b, c FROM g GROUP BY ALL HAVING count(*) > 1),
rep AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT g.doc_id, unnest([i, i + 1, i + 2]) AS p FROM g JOIN often USING (doc_id, a, b, c)) GROUP BY doc_id),
l AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS x FROM d),
f AS (SELECT doc_id, x, count(*) OVER (PARTITION BY doc_id) AS alone, regexp_extract_all(x, '[^\x20\x09-\x0D]+') AS xw FROM l WHERE regexp_matches(x, '[^\x20\x09-\x0D]')),
v AS (SELECT doc_id, x, list_sum(list_transform(xw, lambda y: length(y))) AS chars, (
  len(regexp_extract_all(x, '{_sql_class(SEPARATORS)}')) >= 3 OR len(regexp_extract_all(x, '{_sql_class(SEPARATORS)}')) >= 1 AND len(xw) <= 4
  OR 10 * len(regexp_extract_all(x, '{_sql_class(SYMBOLS)}')) > list_sum(list_transform(xw, lambda y: length(y)))
  OR len(regexp_extract_all(x, '!!')) >= 2
  OR len(xw) <= 3 AND alone > 1 AND NOT regexp_matches(xw[len(xw)], '{_sql_class(SENTENCE_END)}$')
  OR regexp_matches(translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{"|".join(re.escape(b) for b in BOILERPLATE)}')) AS bad FROM f),
s AS (SELECT doc_id, count(*) - count(DISTINCT x) AS dup, sum(CASE WHEN bad THEN chars ELSE 0 END) AS lost FROM v GROUP BY doc_id)
SELECT doc_id, n_words, word_chars::BIGINT AS word_chars, n_symbols, coalesce(dup, 0) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words,
  (n_words < 50 OR 100 * coalesce(rep.n, 0) > 50 * n_words) AS base_failed,
  NOT (n_words < 50 OR 100 * coalesce(rep.n, 0) > 50 * n_words) AND 100 * coalesce(lost, 0) <= {MOST_LOST} * word_chars AS kept
FROM base LEFT JOIN rep USING (doc_id) LEFT JOIN s USING (doc_id)
"""
