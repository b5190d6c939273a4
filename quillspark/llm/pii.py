"""Personal data: fixed patterns, then bootstrapped contextual extraction.

Base spans are the seeds.  The words before a seed are its lexical patterns; the same
patterns also stand before strings of a looser shape (candidates).  Patterns and instances
form a bipartite graph that Spark scores in rounds: a pattern is worth the share of its known
instances (seeds, and candidates accepted so far) among those and its counter-examples
(candidates that are calendar dates or clock times), an instance the noisy-or of its patterns,
seeds staying at 1 and counter-examples at 0.  What is not known yet counts neither way.
Candidates of high worth are added as spans of the seed's kind.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.llm.common import discard, lean, small_enough, stored, table

KINDS = ("email", "ip", "card", "phone")
ROUNDS, MIN_SEEDS, PRIOR, PATTERN_BAR, INSTANCE_BAR = 3, 3, 1.0, 0.5, 0.7
#: Scores are rounded before they are compared, so that the order of a sum does not decide.
DIGITS_KEPT = 9

LOCAL = re.compile(r"[A-Za-z0-9._%+-]+")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# a run of digits is entered at its start only: a later start meets the same failure
IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGITS = re.compile(r"[^0-9]")
#: Shapes that a context may prove: spelt-out addresses, colon-separated addresses, bare numbers.
LOOSE = (
    (0, re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++(?:\x20?\(at\)\x20?|\x20?\[at\]\x20?|\x20at\x20)[A-Za-z0-9-]++(?:(?:\x20?\(dot\)\x20?|\x20?\[dot\]\x20?|\x20dot\x20|\.)[A-Za-z0-9-]++)+")),
    (1, re.compile(r"(?<![0-9A-Za-z:])(?:[0-9A-Fa-f]{1,4}:){2,7}:?[0-9A-Fa-f]{1,4}(?![0-9A-Za-z:])")),
    (2, re.compile(r"(?<![0-9+.-])[0-9]{4}(?:[\x20.-]?[0-9]){8,15}(?![0-9])")),
    (3, re.compile(r"(?<![0-9+.(-])\(?[0-9]{2,5}\)?(?:[\x20./-]{1,2}[0-9]{2,5}){1,4}(?![0-9])")),
)
LOOSE_HINT = re.compile(r"[0-9]{2}|[(\[\x20]at[)\]\x20]|[0-9A-Fa-f]:[0-9A-Fa-f:]")
WORDS = re.compile(r"[^\W_]+", re.UNICODE)
#: Candidates of the loose shapes that are known to be something else: clock times, calendar dates.
OTHER = {
    1: re.compile(r"(?:[01]?[0-9]|2[0-3])(?::[0-5][0-9]){2}"),
    3: re.compile(r"(?:19|20)[0-9]{2}([-./])(?:0[1-9]|1[0-2])\1(?:0[1-9]|[12][0-9]|3[01])|(?:0[1-9]|[12][0-9]|3[01])([-./])(?:0[1-9]|1[0-2])\2(?:19|20)[0-9]{2}|(?:0[1-9]|1[0-2])/(?:0[1-9]|[12][0-9]|3[01])/(?:19|20)[0-9]{2}"),
}


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """``(kind, start, end)`` of the fixed patterns, by kind, then start; linear in the text."""
    out = []
    last = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > last and LOCAL.match(text[start - 1]):
            start -= 1
        right = DOMAIN.match(text, at + 1) if start < at else None
        if right:
            out.append((0, start, right.end()))
            last = right.end()
        at = text.find("@", max(at + 1, last))
    if any(map(text.__contains__, "0123456789")):
        for m in IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split(".")):
                out.append((1, *m.span()))
        for m in CARD.finditer(text):
            digits = DIGITS.sub("", m[0])
            if 13 <= len(digits) <= 19 and luhn(digits):
                out.append((2, *m.span()))
        if "+" in text:
            out += [(3, *m.span()) for m in PHONE.finditer(text) if 9 <= len(DIGITS.sub("", m[0])) <= 15]
    return out


class Contexts:
    """The lexical patterns before places of one text: its last two and last three words there,
    whole ones however long, but for one that runs into the place; digits count as ``#``."""

    def __init__(self, text: str):
        self.text, self.words = text, [m.span() for m in WORDS.finditer(text)]

    def __call__(self, start: int) -> list[str]:
        k = bisect_left(self.words, (start, 0))
        before = [re.sub(r"[0-9]", "#", self.text[s : min(e, start)].lower()) for s, e in self.words[max(0, k - 3) : k]]
        return [self.named(" ".join(before[-n:])) for n in (2, 3) if len(before) >= n]

    @staticmethod
    def named(pattern: str) -> str:
        """Itself, or a digest where it is long: patterns are only ever compared."""
        return pattern if len(pattern) <= 200 else "md5:" + hashlib.md5(pattern.encode("utf-8", "surrogatepass")).hexdigest()


def value_of(kind: int, text: str) -> str:
    return DIGITS.sub("", text) if kind >= 2 else text.lower()


def is_other(kind: int, text: str) -> bool:
    return kind in OTHER and OTHER[kind].fullmatch(text) is not None


def candidates(text: str, taken: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Loose spans that touch no base span nor each other, the longest kind first."""
    if not LOOSE_HINT.search(text):
        return []
    busy = sorted((a, b) for _, a, b in taken)
    out: list[tuple[int, int, int]] = []
    for kind, shape in LOOSE:
        free, k = [], 0
        for m in shape.finditer(text):
            a, b = m.span()
            while k < len(busy) and busy[k][1] <= a:
                k += 1
            if (k == len(busy) or busy[k][0] >= b) and (kind != 3 or 7 <= len(DIGITS.sub("", m[0])) <= 15):
                free.append((kind, a, b))
        out += free
        busy = sorted(busy + [(a, b) for _, a, b in free])
    return out


SPAN = pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32())])
SEEN = pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("value", pa.string()), ("seed", pa.bool_()), ("other", pa.bool_()), ("patterns", pa.list_(pa.string()))])
ADDED = "_base array<struct<kind:int,start:int,end:int>>, _seen array<struct<kind:int,start:int,end:int,value:string,seed:boolean,other:boolean,patterns:array<string>>>"


def extract(docs: DataFrame, carry: tuple[str, ...]) -> DataFrame:
    """The ``carry`` columns but the text in a struct ``_carry`` (so that their names cannot clash),
    ``_text`` if it is carried, ``_base`` spans and ``_seen`` instances."""
    keep = "text" in carry

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, 512):
                b = whole.slice(k, 512)
                base, seen = [], []
                for text in b.column(1).to_pylist():
                    text = text or ""
                    found = base_spans(text)
                    loose = candidates(text, found)
                    before = Contexts(text) if found or loose else None
                    base.append([dict(zip(("kind", "start", "end"), s, strict=True)) for s in found])
                    seen.append([{"kind": k, "start": s, "end": e, "value": value_of(k, text[s:e]), "seed": seed, "other": not seed and is_other(k, text[s:e]), "patterns": before(s)} for part, seed in ((found, True), (loose, False)) for k, s, e in part])
                yield pa.RecordBatch.from_arrays([*b.columns[: 1 + keep], pa.array(base, pa.list_(SPAN)), pa.array(seen, pa.list_(SEEN))], ["_carry", *["_text"] * keep, "_base", "_seen"])

    kept = docs.select(packed(docs, carry).alias("_carry"), F.col("text").alias("_text"))
    return kept.mapInArrow(run, T.StructType(kept.schema.fields[: 1 + keep] + T.StructType.fromDDL(ADDED).fields))


def packed(docs: DataFrame, carry: tuple[str, ...]) -> Column:
    """The carried columns but the text, in one."""
    return F.struct(*([F.col(f"`{c}`") for c in carry if c != "text"] or [F.lit(None).cast("int").alias("none")]))


def unpacked(carry: tuple[str, ...]) -> list[Column]:
    """The carried columns again, in their order."""
    return [F.col("_text").alias(c) if c == "text" else F.col(f"_carry.`{c}`").alias(c) for c in carry]


def score_graph(edges: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """``edges(kind, pattern, value, seed, other)``, distinct, to ``(kind, value, worth)`` of non-seeds.

    A pattern needs ``MIN_SEEDS`` different known instances, as an accident of wording has
    not; each round counts those that the rounds before have accepted.
    """
    worth = edges.withColumn("worth", F.col("seed").cast("double"))
    # fewer instances can never be enough, and a pattern of seeds alone introduces nothing new
    useful = edges.groupBy("kind", "pattern").agg(F.count(F.when(F.col("seed"), 1)).alias("seeds"), F.count(F.lit(1)).alias("n"))
    useful = useful.filter((F.col("n") >= MIN_SEEDS) & (F.col("n") > F.col("seeds"))).select("kind", "pattern")
    if small_enough(useful, 100_000):
        useful = F.broadcast(useful)
    worth = stored(worth.join(useful, ["kind", "pattern"]), "pii_graph")
    for _ in range(rounds):
        known = F.col("worth") >= INSTANCE_BAR
        sums = [F.count(F.when(known, 1)).alias("known"), F.sum(F.when(known, F.col("worth")).otherwise(0.0)).alias("good"), F.count(F.when(F.col("other"), 1)).alias("bad")]
        patterns = worth.groupBy("kind", "pattern").agg(*sums).filter(F.col("known") >= MIN_SEEDS)
        patterns = patterns.select("kind", "pattern", F.round(F.col("good") / (F.col("good") + F.col("bad") + PRIOR), DIGITS_KEPT).alias("p")).filter(F.col("p") >= PATTERN_BAR)
        if small_enough(patterns, 100_000):
            patterns = F.broadcast(patterns)
        lit = worth.filter("NOT seed AND NOT other").join(patterns, ["kind", "pattern"])
        miss = F.exp(F.sum(F.log1p(-F.least(F.col("p"), F.lit(1 - 1e-9)))))
        values = lit.groupBy("kind", "value").agg(F.round(1 - miss, DIGITS_KEPT).alias("w"))
        if small_enough(values, 100_000):
            values = F.broadcast(values)
        before = worth
        new = F.when(F.col("seed"), 1.0).when(F.col("other"), 0.0).otherwise(F.coalesce("w", F.lit(0.0)))
        worth = stored(before.drop("worth").join(values, ["kind", "value"], "left").withColumn("worth", new).drop("w"), "pii_graph")
        discard(before)
    return worth.filter(~F.col("seed")).groupBy("kind", "value").agg(F.max("worth").alias("worth"))


def _found(docs: DataFrame, carry: tuple[str, ...]) -> DataFrame:
    """``_carry, base, spans`` of every row, and ``_text`` if it is carried."""
    rows = stored(extract(docs, carry).withColumn("_row", F.monotonically_increasing_id()), "pii_rows")
    seen = rows.select("_row", F.explode("_seen").alias("s")).select("_row", "s.*")
    edges = seen.select("kind", "value", "seed", "other", F.explode("patterns").alias("pattern")).groupBy("kind", "pattern", "value").agg(F.max("seed").alias("seed"), F.min("other").alias("other"))
    good = score_graph(edges).filter(F.col("worth") >= INSTANCE_BAR).select("kind", "value")
    if small_enough(good, 100_000):
        good = F.broadcast(good)
    added = seen.filter("NOT seed AND NOT other").join(good, ["kind", "value"]).groupBy("_row").agg(F.collect_list(F.struct("kind", "start", "end")).alias("_added"))
    added = stored(added, "pii_added")
    if small_enough(added, 20_000):
        added = F.broadcast(added)
    none = F.array().cast("array<struct<kind:int,start:int,end:int>>")
    both = rows.join(added, "_row", "left")
    return both.select("_carry", *["_text"] * ("text" in carry), F.sort_array("_base").alias("base"), F.sort_array(F.concat("_base", F.coalesce("_added", none))).alias("spans"))


def find(docs: DataFrame, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The ``carry`` columns of every row of ``docs``, ``base`` and ``spans``.

    Both are arrays of ``struct<kind, start, end>`` by kind, then start; ``spans`` holds base
    and discovered ones, which never overlap base.  A null or empty text has none; equal
    rows are treated alike; an empty table gives an empty result; other columns are ignored.
    """
    return _found(docs, carry).select(*unpacked(carry), "base", "spans")


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with every span of personal data replaced by its kind in brackets.

    All rows and columns stay, whatever their names; a null text stays null."""
    names = tuple(docs.columns)
    marked = _found(docs, names).select("_text", "spans", "_carry")

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for text, spans in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                parts, last = [], 0
                for s in sorted(spans, key=lambda s: (s["start"], -s["end"])):
                    if s["start"] >= last:
                        parts += [text[last : s["start"]], f"[{KINDS[s['kind']].upper()}]"]
                    last = max(last, s["end"])
                out.append("".join([*parts, text[last:]]) if spans else text)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()), b.column(2)], ["_text", "_carry"])

    schema = T.StructType([T.StructField("_text", T.StringType()), marked.schema["_carry"]])
    return marked.mapInArrow(run, schema).select(*unpacked(names))


def op4_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``find`` over ``documents``: counts and a digest of base spans, and all spans."""
    found = find(table(spark, sf_dir, "documents"))
    names = F.array(*[F.lit(k) for k in KINDS])
    joined = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    return found.select("doc_id", *[count(k).alias(f"n_{name}") for k, name in enumerate(KINDS)], F.sha2(joined("base"), 256).alias("base_sha256"), joined("spans").alias("spans"))
