"""Secret scan with DataFrame functions only.

Three fixed patterns give base spans.  The method adds spans of kind ``entropy``: every
candidate string (a run of token characters) belongs to a character class; a window slides
over it while the sum of ``c * log2(c)`` over character counts is kept up to date by the
character that enters and the one that leaves; the candidate is reported if any window
reaches the class's bits per character, unless the allow-list names it or a base span
overlaps it.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions.kernels import emitted
from quillspark.llm.common import table

ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
KINDS = ("assign", "access", "hex", "entropy")
#: A candidate has at least WINDOW characters.
WINDOW = 20
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
#: class, patterns that a candidate must all match (each one linear in its length), bits per
#: character that make it a secret; the first class that fits is taken, and one always does.  The
#: last three hold plain words and paths too, so that they ask for more than such words reach.
CLASSES = (
    ("upper_hex", ("^[0-9A-F]+$", "[A-F]"), 3.1),
    ("base36", ("^([0-9a-z]+|[0-9A-Z]+)$", "[0-9]"), 3.6),
    ("base64", ("[0-9]", "[A-Z]", "[a-z]"), 3.9),
    ("base36_signs", ("^([0-9a-z+/_=-]+|[0-9A-Z+/_=-]+)$", "[0-9]"), 4.0),
    ("letters", ("[A-Z]", "[a-z]"), 4.1),
    ("one_case", ("^[^0-9]*$",), 3.9),
)
#: Suppressed: identifiers made to be unique rather than secret, samples, published digests.
ALLOW = r"^[0-9A-Fa-f]{8}-([0-9A-Fa-f]{4}-){3}[0-9A-Fa-f]{12}$|[Ee][Xx][Aa][Mm][Pp][Ll][Ee]|[Pp]laceholder|XXXXXX|xxxxxx|0123456789|[Aa]bcdefgh|ABCDEFGH|^sha(1|224|256|384|512)[-=]"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"


SPAN = "struct<start:int,kind:int,end:int,value:string>"


def spans(text: Column, pattern: str, kind: int, ok=None, group: int = 0) -> Column:
    """Leftmost non-overlapping matches as ``array<struct<start, kind, end, value>>``.

    Offsets count code points: gaps and matches are cut once, their lengths added up.
    ``ok(value)`` filters by the text of ``group``; nothing is tried again after a failure.
    """
    pieces = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("all"), F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias("value"))

    def step(state: Column, piece: Column) -> tuple[dict[str, Column], Column]:
        start = state["at"] + F.length(piece["gap"])
        end = start + F.length(piece["all"])
        found = F.array(F.struct(start.alias("start"), F.lit(kind).alias("kind"), end.alias("end"), piece["value"].alias("value")))
        keep = piece["all"].isNotNull() if ok is None else piece["all"].isNotNull() & ok(piece["value"])
        return {"at": F.coalesce(end, start)}, F.when(keep, found).otherwise(F.array().cast(f"array<{SPAN}>"))

    return emitted(pieces, {"at": F.lit(0)}, SPAN, step)


def apart(base: Column, maybe: Column) -> Column:
    """Candidates that overlap no base span: one walk from the end finds where the next base span
    starts, one from the start how far those before reach."""
    none = F.array().cast(f"array<{SPAN}>")

    def from_end(state: Column, x: Column) -> tuple[dict[str, Column], Column]:
        is_base = x["kind"] < 3
        return {"next": F.when(is_base, x["start"]).otherwise(state["next"])}, F.when(is_base | (state["next"] >= x["end"]), F.array(x)).otherwise(none)

    def from_start(state: Column, x: Column) -> tuple[dict[str, Column], Column]:
        is_base = x["kind"] < 3
        return {"reach": F.when(is_base, F.greatest(state["reach"], x["end"])).otherwise(state["reach"])}, F.when(~is_base & (state["reach"] <= x["start"]), F.array(x)).otherwise(none)

    backward = emitted(F.reverse(F.sort_array(F.concat(base, maybe))), {"next": F.lit(2**31 - 1)}, SPAN, from_end)
    return emitted(F.reverse(backward), {"reach": F.lit(0)}, SPAN, from_start)


def xlog2(n: int) -> float:
    return n * math.log2(n) if n else 0.0


def peak_entropy(value: Column, window: int = WINDOW) -> Column:
    """Highest Shannon entropy of any window, by incremental counts: as a character enters and one
    leaves, two counts and two terms of the sum change.  Counts are kept as a string, a character
    for each of the alphabet's, whose places are overwritten."""
    letters = F.array(*[F.lit(c) for c in ALPHABET])
    costs = F.array(*[F.lit(xlog2(n)) for n in range(window + 2)])
    codes = F.transform(F.filter(F.split(value, ""), lambda c: c != ""), lambda c: F.array_position(letters, c).cast("int"))
    moves = F.arrays_zip(codes.alias("come"), F.concat(F.array_repeat(F.lit(0), window), codes).alias("go"))
    zero = ord("A")
    start = F.struct(F.lit(chr(zero) * len(ALPHABET)).alias("n"), F.lit(0.0).alias("sum"), F.lit(0).alias("i"), F.lit(0.0).alias("best"))
    count = lambda n, k: F.ascii(F.substring(n, k, F.lit(1))) - zero
    put = lambda n, k, x: F.overlay(n, F.char(x + zero), k, F.lit(1))

    def step(s: Column, m: Column) -> Column:
        come, go = m["come"], m["go"]  # 0: nothing leaves yet
        a = count(s["n"], come)
        b = F.when(go > 0, count(s["n"], go)).otherwise(F.lit(1))
        gain = F.element_at(costs, a + 2) - F.element_at(costs, a + 1)
        loss = F.element_at(costs, b + 1) - F.element_at(costs, b)
        total = F.when(come == go, s["sum"]).otherwise(s["sum"] + gain - F.when(go > 0, loss).otherwise(F.lit(0.0)))
        more = put(s["n"], come, a + 1)
        counts = F.when(come == go, s["n"]).when(go > 0, put(more, go, b - 1)).otherwise(more)
        entropy = F.lit(math.log2(window)) - total / window
        best = F.when(s["i"] >= window - 1, F.greatest(s["best"], entropy)).otherwise(s["best"])
        return F.when(come.isNull(), s).otherwise(F.struct(counts.alias("n"), total.alias("sum"), (s["i"] + 1).alias("i"), best.alias("best")))

    return F.round(F.aggregate(moves, start, step, lambda s: s["best"]), 9)


def bits_needed(value: Column) -> Column:
    fits = lambda patterns: reduce(Column.__and__, [value.rlike(p) for p in patterns])
    return F.coalesce(*[F.when(fits(patterns), F.lit(bits)) for _, patterns, bits in CLASSES])


def secret_spans(text: Column) -> tuple[Column, Column]:
    """Base spans and candidates of a text; each pattern runs only where a cheap test hits."""
    none = F.array().cast(f"array<{SPAN}>")
    assign = F.when(text.rlike("(?i:password|passwd|secret|token|api_?key)"), spans(text, ASSIGN, 0, lambda v: F.length(v) >= 12, 2)).otherwise(none)
    access = F.when(text.contains("AKIA"), spans(text, ACCESS, 1, lambda v: F.length(v) >= 18)).otherwise(none)
    # runs of the class are maximal, so asking for 16 at once drops the shorter matches
    hexes = F.when(text.rlike(r"[0-9a-f]{16}"), spans(text, r"[0-9a-f]{16,}", 2)).otherwise(none)
    return F.concat(assign, access, hexes), F.when(text.rlike(CANDIDATE), spans(text, CANDIDATE, 3)).otherwise(none)


def scan(docs: DataFrame) -> DataFrame:
    """``docs(doc_id, text)`` to ``doc_id, base, found``: arrays of spans with their text.

    ``found`` holds base and entropy spans by start, then kind.  A null or empty text has
    none; equal rows are scanned alike; other columns are ignored; an empty table gives an empty
    result.  Row by row, no shuffle; time and memory grow with a text's length, however many
    matches it has and however long they are.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    base, maybe = secret_spans(text)
    cut = docs.select("doc_id", base.alias("b"), maybe.alias("c"))

    cut = cut.withColumn("c", F.when((F.size("c") > 0) & (F.size("b") > 0), apart(F.col("b"), F.col("c"))).otherwise(F.col("c")))
    secret = lambda c: ~c["value"].rlike(ALLOW) & (peak_entropy(c["value"]) >= bits_needed(c["value"]))
    found = F.when(F.size("c") > 0, F.filter("c", secret)).otherwise(F.col("c"))
    return cut.select("doc_id", F.sort_array("b").alias("base"), F.sort_array(F.concat("b", found)).alias("found"))


def joined(found: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``scan`` of ``documents``: counts and a digest of base spans, and all spans."""
    found = scan(table(spark, sf_dir, "documents"))
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    return found.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.col("found")).alias("spans"))


def _spans_sql(name: str, pattern: str, group: int, kind: int, keep: str) -> str:
    quoted = pattern.replace("'", "''")
    return f"""
{name} AS (
  SELECT k, {kind} AS kind, s, s + length(m) AS e, v FROM (
    SELECT k, m, v, sum(length(g) + length(coalesce(m, ''))) OVER (PARTITION BY k ORDER BY i) - length(coalesce(m, '')) AS s FROM (
      SELECT k, unnest(g) AS g, unnest(m) AS m, unnest(v) AS v, unnest(range(len(g))) AS i FROM (
        SELECT k, string_split_regex(t, '{quoted}') AS g, regexp_extract_all(t, '{quoted}') AS m, regexp_extract_all(t, '{quoted}', {group}) AS v FROM d)))
  WHERE m IS NOT NULL AND {keep}
)"""


_PLAIN_ASSIGN = ASSIGN.replace("(?i:password|passwd|secret|token|api_?key)", "|".join("".join(c if c in "_?" else f"[{c.upper()}{c}]" for c in w) for w in ("password", "passwd", "secret", "token", "api_?key")))
OP6_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS t FROM documents),
{_spans_sql("f0", _PLAIN_ASSIGN, 2, 0, "length(v) >= 12")},
{_spans_sql("f1", ACCESS, 0, 1, "length(v) >= 18")},
{_spans_sql("f2", HEX, 0, 2, "length(v) >= 16")},
{_spans_sql("f3", CANDIDATE, 0, 3, "true")},
base AS (SELECT * FROM f0 UNION ALL SELECT * FROM f1 UNION ALL SELECT * FROM f2),
free AS (
  SELECT row_number() OVER () AS c, *, CASE {" ".join("WHEN " + " AND ".join(f"regexp_matches(v, '{p}')" for p in ps) + f" THEN {bits}" for _, ps, bits in CLASSES)} END AS bits
  FROM f3 WHERE NOT regexp_matches(v, '{ALLOW}') AND NOT EXISTS (SELECT 1 FROM base b WHERE b.k = f3.k AND b.s < f3.e AND f3.s < b.e)
), chars AS (
  SELECT c, w, substr(v, w + j, 1) AS ch FROM (SELECT c, v, w, unnest(range({WINDOW})) AS j FROM (SELECT c, v, unnest(range(1, length(v) - {WINDOW} + 2)) AS w FROM free WHERE bits IS NOT NULL))
), peak AS (
  SELECT c, max(h) AS h FROM (SELECT c, w, -sum(n / {WINDOW}.0 * log2(n / {WINDOW}.0)) AS h FROM (SELECT c, w, ch, count(*) AS n FROM chars GROUP BY ALL) GROUP BY ALL) GROUP BY c
), every AS (
  SELECT k, kind, s, e FROM base UNION ALL SELECT k, kind, s, e FROM free JOIN peak USING (c) WHERE round(h, 9) >= bits
), named AS (
  SELECT k, kind, s, ['assign', 'access', 'hex', 'entropy'][kind + 1] || ':' || s::BIGINT || ':' || e::BIGINT AS x FROM every
), per AS (
  SELECT k, count(*) FILTER (WHERE kind = 0) AS a, count(*) FILTER (WHERE kind = 1) AS b, count(*) FILTER (WHERE kind = 2) AS h,
    string_agg(x, ',' ORDER BY s, kind) FILTER (WHERE kind < 3) AS bs, string_agg(x, ',' ORDER BY s, kind) AS al FROM named GROUP BY k
)
SELECT doc_id, coalesce(a, 0) AS n_assign, coalesce(b, 0) AS n_access, coalesce(h, 0) AS n_hex, sha256(coalesce(bs, '')) AS base_sha256, coalesce(al, '') AS spans
FROM d LEFT JOIN per USING (k)
"""
