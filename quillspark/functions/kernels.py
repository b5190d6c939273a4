"""String kernels that the rules are built from.  All are plain column expressions.

Patterns follow Java's dialect: ``(?U)`` gives Unicode classes, ``\\z`` is the true end.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache, wraps

from pyspark import SparkContext
from pyspark.sql import Column
from pyspark.sql import functions as F

CODE_SPAN = r"`+[^`]*`+"
SPANS = "array<struct<s:int,e:int>>"


def built_once(build: Callable) -> Callable:
    """A builder of columns by name, called once for equal arguments in one JVM.

    A nested rule takes thousands of calls to the JVM to build, more than to plan it; every
    micro-batch and every set of options would build the same again."""
    made = lru_cache(maxsize=256)(lambda jvm, *args: build(*args))
    return wraps(build)(lambda *args: made(SparkContext._gateway, *args))


def bind(c: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value computed once.  Rules name their input many times, so that
    nesting one in another would otherwise copy the inner one as often."""
    return F.get(F.transform(F.array(c), body), F.lit(0))


def trim(c: Column) -> Column:
    """Trim Unicode white space (the built-in trims spaces only)."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+\z", "")


def rtrim(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)\s+\z", "")


def ltrim(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+", "")


def is_blank(c: Column) -> Column:
    return ~c.rlike(r"(?U)\S")


def squash(c: Column) -> Column:
    """Words joined by single spaces."""
    return F.regexp_replace(trim(c), r"(?U)\s+", " ")


def _pieces(c: Column, pattern: str) -> Column:
    gaps = F.split(c, pattern, -1)
    hits = F.regexp_extract_all(c, F.lit(pattern), F.lit(0))
    after = lambda a: F.slice(a, F.lit(2), F.greatest(F.size(a), F.lit(1)))
    return F.arrays_zip(gaps.alias("gap"), hits.alias("hit"), after(gaps).alias("gap2"), after(hits).alias("hit2"))


#: What a fold emits grows in arrays of this length, so that a text of many matches stays linear.
BLOCK = 64


def emitted(pieces: Column, state: dict[str, Column], kind: str, step: Callable[[Column, Column], tuple[dict[str, Column], Column]]) -> Column:
    """All that ``step(state, piece)`` emits, in order: it gives the next state and an array of ``kind``."""
    none = F.array().cast(f"array<{kind}>")
    fields = lambda v, out: F.struct(*[v[k].alias(k) for k in state], out.alias("out"))

    def inner(s: Column, p: Column) -> Column:
        new, made = step(s, p)
        return fields(new, F.concat(s["out"], made))

    def whole(ps: Column) -> Column:
        def block(t: Column, b: Column) -> Column:
            now = F.aggregate(F.slice(ps, b * BLOCK + 1, F.lit(BLOCK)), fields(t["now"], none), inner)
            return F.struct(now.alias("now"), F.concat(t["done"], F.array(t["now"]["out"])).alias("done"))

        last = F.floor(F.greatest(F.size(ps) - 1, F.lit(0)) / BLOCK).cast("int")
        start = F.struct(fields(state, none).alias("now"), F.array().cast(f"array<array<{kind}>>").alias("done"))
        return F.aggregate(F.sequence(F.lit(0), last), start, block, lambda t: F.flatten(F.concat(t["done"], F.array(t["now"]["out"]))))

    return bind(pieces, whole)


def spans(c: Column, pattern: str) -> Column:
    """Start and end of every match, in code points."""

    def step(state: Column, p: Column) -> tuple[dict[str, Column], Column]:
        s = state["at"] + F.length(p["gap"])
        e = s + F.length(p["hit"])
        return {"at": F.coalesce(e, s)}, F.when(p["hit"].isNull(), F.array().cast(SPANS)).otherwise(F.array(F.struct(s.alias("s"), e.alias("e"))))

    found = emitted(_pieces(c, pattern), {"at": F.lit(0)}, "struct<s:int,e:int>", step)
    return F.when(c.rlike(pattern), found).otherwise(F.array().cast(SPANS))


def inside(protected: Column, at: Column) -> Column:
    return F.exists(protected, lambda p: (p["s"] <= at) & (at < p["e"]))


def splice(c: Column, pattern: str, rewrite: Callable[[Column, Column, Column, Column], Column]) -> Column:
    """Replace every match by ``rewrite(match, previous char, next char, start)``.

    A match that is given back unchanged has still consumed its characters, which
    look-around patterns cannot express.  Neighbours are those of the unchanged line.
    """

    def step(state: Column, p: Column) -> tuple[dict[str, Column], Column]:
        before = F.when(p["gap"] != "", F.right(p["gap"], F.lit(1))).otherwise(state["last"])
        after = F.left(F.coalesce(F.nullif(p["gap2"], F.lit("")), p["hit2"], F.lit("")), F.lit(1))
        start = state["at"] + F.length(p["gap"])
        text = F.concat(p["gap"], F.when(p["hit"].isNull(), F.lit("")).otherwise(rewrite(p["hit"], before, after, start)))
        return {"at": start + F.coalesce(F.length(p["hit"]), F.lit(0)), "last": F.coalesce(F.right(p["hit"], F.lit(1)), before)}, F.array(text)

    made = emitted(_pieces(c, pattern), {"at": F.lit(0), "last": F.lit("")}, "string", step)
    return F.when(c.rlike(pattern), F.array_join(made, "")).otherwise(c)


def splice_outside(c: Column, pattern: str, protected: Column, rewrite: Callable[..., Column]) -> Column:
    """``splice``, where ``rewrite`` is also given the protected spans, found once for all matches."""
    return bind(protected, lambda safe: splice(c, pattern, lambda *found: rewrite(*found, safe)))


def java_template(template: str, groups: dict[str, int] | int) -> str:
    """A replacement template of ``$1``, ``$name``, ``${n}`` for Java.

    A reference takes the longest run of word characters, so ``$1text`` names a group
    ``1text``; unknown groups are empty; a backslash is itself.
    """
    import re

    names = {str(k): k for k in range(groups + 1)} if isinstance(groups, int) else {**groups, **{str(v): v for v in groups.values()}, "0": 0}

    def one(m: re.Match[str]) -> str:
        if m[0] == "$$":
            return r"\$"
        name = m[1] or m[2]
        if name is None:
            return {"\\": r"\\", "$": r"\$"}[m[0]]
        return f"${{{name}}}" if name in names and not name.isdigit() else (f"${name}" if name in names else "")

    out = re.sub(r"\$\$|\$\{(\w+)\}|\$(\w+)|[\\$]", one, template)
    return out
