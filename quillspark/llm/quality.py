"""Line-first quality rules.

Base statistics are computed on the whole text.  The verdict is line-first: every line is
tested by the rules below, failing lines are removed, and a document whose removed lines
held too large a share of its word characters is rejected.

* punctuation: a line of at least ``PUNCT_WORDS`` words in which more than half of the
  words hold a symbol of ``#*$%&|<>`` (mark-up debris, tables of fragments);
* navigation: at least ``NAV_PARTS`` parts with a word between separators (``|``, ``>``, ``»`` or
  bullets), of which at least half have ``NAV_PART_WORDS`` words or fewer;
* boilerplate: a line that opens like a licence, copyright, cookie or consent notice, or a line of
  at most ``NOTICE_WORDS`` words that the corpus repeats in many places: in ``NOTICE_DOCS`` documents
  or more, of which no more than a fifth have the same line before it, nor the same line after it
  (a line that only copies of one text share keeps its neighbours);
* repetition: a line of at least ``RUN_WORDS`` words in which over half equal the word
  just before.

Short and unpunctuated lines alone are no fault: headings and verses stay.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm.common import discard, lean, small_enough, stored, table

MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
PUNCT_WORDS, NAV_PARTS, NAV_PART_WORDS, RUN_WORDS = 5, 4, 3, 6
MAX_LOST_PERCENT = 50
NOTICE_WORDS, NOTICE_DOCS, NOTICE_SHARE = 15, 20, 5
SYMBOLS = "#*$%&|<>"
SEPARATORS = "|>\u00bb\u00b7\u2022"
#: openings of notices, compared in lower case
BOILERPLATE = (
    "copyright ", "\u00a9 ", "(c) 1", "(c) 2", "released under ", "all rights reserved", "licensed under ", "this work is licensed", "permission is hereby granted",
    "terms of use", "terms of service", "privacy policy", "cookie policy", "this site uses cookies", "we use cookies",
    "accept all cookies", "subscribe to our newsletter", "sign up for our newsletter", "share this article",
)


def joined(words: list[bytes]) -> int:
    """What names a line of these words in the table of repeated lines."""
    return xxhash.xxh3_64_intdigest(b" ".join(words)) - (1 << 63)


def line_verdict(line: bytes, opening: re.Pattern[bytes], repeated: frozenset[int]) -> tuple[int, str | None]:
    """Word bytes of a line and the name of the rule that it fails, if any."""
    words = line.split()
    size = sum(map(len, words))
    n = len(words)
    if not n:
        return 0, None
    if opening.match(line) or (repeated and n <= NOTICE_WORDS and joined(words) in repeated):
        return size, "boilerplate"
    parts = [len(p.split()) for p in CUT.split(line)] if CUT.search(line) else []
    parts = [p for p in parts if p]
    if len(parts) >= NAV_PARTS and 2 * sum(p <= NAV_PART_WORDS for p in parts) >= len(parts):
        return size, "navigation"
    if n >= PUNCT_WORDS and any(c in line for c in b"#*$%&|<>"):
        plain = line.translate(MARK).split()
        if 2 * sum(b"#" in w for w in plain) > n:
            return size, "punctuation"
    if n >= RUN_WORDS and 2 * sum(a == b for a, b in zip(words, words[1:], strict=False)) > n:
        return size, "repetition"
    return size, None


CUT = re.compile(b"|".join(re.escape(c.encode()) for c in SEPARATORS))
MARK = bytes(ord("#") if chr(b) in SYMBOLS else b for b in range(256))


#: Names of repeated lines that are sent to every task.
REPEATED = 200_000


def opening_pattern(phrases: tuple[str, ...] = BOILERPLATE) -> re.Pattern[bytes]:
    return re.compile(rb"[\x20\x09-\x0D]*(?:" + b"|".join(re.escape(p.encode()) for p in phrases) + b")", re.I)


def short_lines(docs: DataFrame, keyed: bool = False) -> DataFrame:
    """``(line, before, after)`` of each document's short lines, each once, by the names of the lines;
    neighbours are lines with words, null at an end.  ``keyed`` adds a digest of the text."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, 512):
                b = whole.slice(k, 512)
                out: list[tuple] = []
                for key, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    words = [w for w in (l.split() for l in (text or "").encode("utf-8", "surrogatepass").split(b"\n")) if w]
                    if not any(len(w) <= NOTICE_WORDS for w in words):
                        continue
                    names = [None, *map(joined, words), None]
                    first = {names[i + 1]: i for i in range(len(words) - 1, -1, -1) if len(words[i]) <= NOTICE_WORDS}
                    out += [(name, names[i], names[i + 2], key) for name, i in first.items()]
                cols = list(zip(*out, strict=True)) or [[], [], [], []]
                yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols[:3]), pa.array(cols[3], pa.binary())], ["line", "before", "after", "key"])

    key = F.unhex(F.md5("text")) if keyed else F.lit(None).cast("binary")
    return docs.select(key.alias("key"), "text").mapInArrow(run, "line long, before long, after long, key binary")


def repeated_lines(docs: DataFrame) -> DataFrame:
    """``line``: the names of short lines that the corpus repeats in many places."""
    lines = stored(short_lines(docs).drop("key"), "short_lines")
    found = lines.groupBy("line").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= NOTICE_DOCS)
    found = stored(found, "common_lines")
    few = F.broadcast(found) if small_enough(found, 200_000) else found
    for side in ("before", "after"):
        beside = lines.filter(F.col(side).isNotNull()).join(few, "line").groupBy("line", side).agg(F.count(F.lit(1)).alias("c"))
        most = beside.groupBy("line").agg(F.max("c").alias(side))
        found = found.join(most, "line", "left")
    share = lambda side: F.coalesce(F.col(side), F.lit(0)) * NOTICE_SHARE <= F.col("n")
    out = stored(found.filter(share("before") & share("after")).select("line"), "repeated_lines")
    discard(lines)
    return out


def assess(text: str, opening: re.Pattern[bytes], repeated: frozenset[int] = frozenset()) -> tuple:
    """All columns of one text: statistics, base verdict, method verdict, cleaned text."""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    n = len(words)
    word_chars = len(text) - (len(raw) - sum(map(len, words)))
    n_symbols = len(raw) - len(raw.translate(None, SYMBOLS.encode()))
    seen: set[bytes] = set()
    verdicts: dict[bytes, tuple[int, str | None]] = {}
    dup = total = lost = removed = 0
    kept_lines = []
    for line in raw.split(b"\n"):
        if line not in verdicts:
            verdicts[line] = line_verdict(line, opening, repeated)
        size, fault = verdicts[line]
        if line in seen:
            dup += size > 0
        else:
            seen.add(line)
        total += size
        if fault:
            lost += size
            removed += 1
        else:
            kept_lines.append(line)
    repeat = 0
    if n >= 3:
        number: dict[bytes, int] = {}
        ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, n)
        k = len(number)
        pair = ids[:-1] * k + ids[1:]
        if k * k * k >= 1 << 62:
            pair = np.unique(pair, return_inverse=True)[1]
        window = pair[:-1] * k + ids[2:]
        order = np.argsort(window, kind="stable")
        same = np.diff(window[order]) == 0
        again = np.zeros(n - 2, bool)
        again[order[1:][same]] = True
        again[order[:-1][same]] = True
        hit = np.zeros(n, bool)
        hit[:-2] |= again
        hit[1:-1] |= again
        hit[2:] |= again
        repeat = int(hit.sum())
    base_failed = n < MIN_WORDS or 100 * repeat > MAX_REPEAT_PERCENT * n
    kept = not base_failed and 100 * lost <= MAX_LOST_PERCENT * total
    return n, word_chars, n_symbols, dup, repeat, base_failed, kept, removed, lost, b"\n".join(kept_lines).decode("utf-8", "surrogatepass")


def clean(docs: DataFrame, with_text: bool = True) -> DataFrame:
    """``docs(doc_id, text)`` to one row each: statistics, verdicts and the cleaned text.

    A null or empty text has no words: every count is 0, it fails the base rule and its
    cleaned text is empty.  Rows that repeat are judged alike; other columns are ignored.
    One document at a time is in memory.  Lines that the corpus repeats are found first, from the
    names of short lines.  They are few and go to every task; were there more than ``REPEATED``, each
    document would get its own by a join on its text's digest.
    """
    repeated = repeated_lines(docs)
    everywhere = small_enough(repeated, REPEATED)
    known = frozenset(r.line for r in repeated.collect()) if everywhere else frozenset()
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_removed_lines", "removed_bytes"]
    kinds = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.int64()] * 2
    schema = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, n_removed_lines long, removed_bytes long"

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opening = opening_pattern()
        for whole in batches:
            for k in range(0, whole.num_rows, 512):
                b = whole.slice(k, 512)
                rows = [assess(t or "", opening, known if own is None else frozenset(own)) for t, own in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)]
                cols = list(zip(*rows, strict=True))
                out = [b.column(0), *(pa.array(c, t) for c, t in zip(cols, kinds, strict=False))]
                if with_text:
                    out.append(pa.array(cols[-1], pa.string()))
                yield pa.RecordBatch.from_arrays(out, ["doc_id", *names, *["cleaned"] * with_text])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    if everywhere:
        texts = texts.withColumn("own", F.lit(None).cast("array<long>"))
    else:
        own = short_lines(docs, keyed=True).join(repeated, "line").groupBy("key").agg(F.collect_set("line").alias("own"))
        texts = texts.withColumn("key", F.unhex(F.md5("text"))).join(own, "key", "left").select("doc_id", "text", "own")
    return texts.mapInArrow(run, schema + ", cleaned string" * with_text)


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``clean`` of ``documents`` without the cleaned texts."""
    return clean(table(spark, sf_dir, "documents"), with_text=False)


OP2_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS t FROM documents
), w AS (
  SELECT k, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS words FROM d
), grams AS (
  SELECT k, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS g
  FROM (SELECT k, words, unnest(range(1, len(words) - 1)) AS i FROM w WHERE len(words) >= 3)
), again AS (
  SELECT k, i FROM (SELECT k, i, count(*) OVER (PARTITION BY k, g) AS c FROM grams) WHERE c > 1
), rep AS (
  SELECT k, count(DISTINCT p) AS n_repeat_words FROM (SELECT k, unnest([i, i + 1, i + 2]) AS p FROM again) GROUP BY k
), lines AS (
  SELECT k, l, regexp_extract_all(l, '[^\x20\x09-\x0D]+') AS ws, p, row_number() OVER (PARTITION BY k, l) AS nth
  FROM (SELECT k, unnest(string_split(t, chr(10))) AS l, generate_subscripts(string_split(t, chr(10)), 1) AS p FROM d)
), named AS (
  SELECT k, p, array_to_string(ws, ' ') AS l, len(ws) AS n, lag(array_to_string(ws, ' ')) OVER o AS before, lead(array_to_string(ws, ' ')) OVER o AS after
  FROM lines WHERE len(ws) > 0 WINDOW o AS (PARTITION BY k ORDER BY p)
), short AS (
  SELECT l, arg_min(struct_pack(x := before), p).x AS before, arg_min(struct_pack(x := after), p).x AS after FROM named WHERE n <= 15 GROUP BY k, l
), common AS (SELECT l, count(*) AS n FROM short GROUP BY l HAVING count(*) >= 20
), repeated AS (
  SELECT c.l FROM common c
  LEFT JOIN (SELECT l, max(n) AS m FROM (SELECT l, before, count(*) AS n FROM short WHERE before IS NOT NULL GROUP BY ALL) GROUP BY l) b ON b.l = c.l
  LEFT JOIN (SELECT l, max(n) AS m FROM (SELECT l, after, count(*) AS n FROM short WHERE after IS NOT NULL GROUP BY ALL) GROUP BY l) a ON a.l = c.l
  WHERE 5 * coalesce(b.m, 0) <= c.n AND 5 * coalesce(a.m, 0) <= c.n
), judged AS (
  SELECT k, nth, len(ws) AS n, strlen(array_to_string(ws, '')) AS size,
    CASE WHEN len(ws) = 0 THEN false
         WHEN regexp_matches(l, '(?i)^[\x20\x09-\x0D]*(BOILER)') THEN true
         WHEN array_to_string(ws, ' ') IN (SELECT l FROM repeated) THEN true
         WHEN len(NAV) >= 4 AND 2 * len(list_filter(NAV, lambda x: x <= 3)) >= len(NAV) THEN true
         WHEN len(ws) >= 5 AND 2 * len(list_filter(ws, lambda x: regexp_matches(x, '[#*$%&|<>]'))) > len(ws) THEN true
         WHEN len(ws) >= 6 AND 2 * len(list_filter(range(2, len(ws) + 1), lambda i: ws[i] = ws[i - 1])) > len(ws) THEN true
         ELSE false END AS bad
  FROM lines
), per AS (
  SELECT k, count(*) FILTER (WHERE n > 0 AND nth > 1) AS n_dup_lines, count(*) FILTER (WHERE bad) AS n_removed_lines,
    coalesce(sum(size) FILTER (WHERE bad), 0)::BIGINT AS removed_bytes, sum(size)::BIGINT AS total
  FROM judged GROUP BY k
), stats AS (
  SELECT doc_id, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines,
    coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, n_removed_lines::BIGINT AS n_removed_lines, removed_bytes, total
  FROM w JOIN per USING (k) LEFT JOIN rep USING (k)
), based AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM stats
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND 100 * removed_bytes <= 50 * total AS kept, n_removed_lines, removed_bytes
FROM based
""".replace("NAV", "list_filter(list_transform(string_split_regex(l, '[|>\u00bb\u00b7\u2022]'), lambda p: len(regexp_extract_all(p, '[^\\x20\\x09-\\x0D]+'))), lambda x: x > 0)").replace("BOILER", "|".join(re.escape(p).replace("\\ ", " ") for p in BOILERPLATE))
