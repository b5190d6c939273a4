"""Link conversion: definitions joined to uses, targets deduplicated and numbered.

All steps are joins and aggregates on doc_id and a key.  Definitions in code blocks or
front matter are left alone.  Unused definitions go, as they do in the reference style.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions.kernels import built_once, is_blank, spans, trim
from quillspark.functions.lines import in_code_span
from quillspark.operators.classify import plain, regions
from quillspark.operators.lines import rows_after, whole_doc
from quillspark.sources.scratch import materialize

DEFINITION = r"(?Ud)^(\[[^\]]+\])\s*:\s*(.+)\z"
TARGET = r'(?U)^([^\s"]+)(?:\s+"([^"]+)")?\z'
INLINE, REFERENCE, IMPLICIT = r"\[[^\]]+\]\([^)]+\)", r"\[[^\]]+\]\[[^\]]+\]", r"\[[^\]]+\]"


def _target(c: Column) -> tuple[Column, Column]:
    """URL and title (null if there is none) of ``url "title"``."""
    t = trim(c)
    url = F.when(t.rlike(TARGET), F.regexp_extract(t, TARGET, 1)).otherwise(t)
    return url, F.when(t.rlike(TARGET), F.nullif(F.regexp_extract(t, TARGET, 2), F.lit("")))


def definitions(lines: DataFrame) -> DataFrame:
    """``(doc_id, key, ref_id, url, title, n)``: the last definition of each key and its line.

    A key is the bracketed id; the same in lower case, trimmed, is a second key.
    """
    t = trim(F.col("l"))
    url, title = _target(F.regexp_extract(t, DEFINITION, 2))
    own = F.regexp_extract(t, DEFINITION, 1)
    rows = lines.filter(plain() & t.rlike(DEFINITION)).select("doc_id", "n", own.alias("id"), url.alias("url"), title.alias("title"))
    ref = F.substring("id", F.lit(2), F.length("id") - 2)
    low = F.concat(F.lit("["), trim(F.lower(ref)), F.lit("]"))
    keyed = rows.withColumn("ref_id", ref).withColumn("key", F.explode(F.array_distinct(F.array(F.col("id"), low))))
    # an id as it is written wins over one that only matches in lower case
    rank = F.struct((F.col("key") == F.col("id")).alias("exact"), F.col("n").alias("n"))
    best = keyed.groupBy("doc_id", "key").agg(F.max_by(F.struct("ref_id", "url", "title", "n"), rank).alias("d"))
    return best.select("doc_id", "key", "d.*")


def is_definition_line(c: Column) -> Column:
    return trim(c).rlike(DEFINITION)


@built_once
def _hits(pattern: str, order: int) -> Column:
    l = F.col("l")
    return F.transform(spans(l, pattern), lambda x: F.struct(F.lit(order).alias("ord"), x["s"].alias("s"), x["e"].alias("e"), F.substring(l, x["s"] + 1, x["e"] - x["s"]).alias("hit")))


def find_links(lines: DataFrame) -> DataFrame:
    """``(doc_id, n, ord, s, e, text, url, title, kind, key)`` of every link-like span.

    Inline links come first, then references, then bare brackets that no earlier span
    covers and no bracket or parenthesis follows; code spans hold none.
    """
    l = F.col("l")
    body = lines.filter(plain() & l.contains("[") & ~is_definition_line(l)).select("doc_id", "n", "l")

    body = body.withColumn("first", F.concat(_hits(INLINE, 0), _hits(REFERENCE, 1)))
    after = lambda x: F.substring(l, x["e"] + 1, F.lit(1))
    bare = F.filter(_hits(IMPLICIT, 2), lambda x: ~F.exists("first", lambda p: (p["s"] <= x["s"]) & (x["s"] < p["e"])) & ~after(x).isin("[", "("))
    rows = body.withColumn("bare", bare).select("doc_id", "n", "l", F.explode(F.concat("first", "bare")).alias("x")).filter(~in_code_span(F.col("l"), F.col("x.s")))
    hit = F.col("x.hit")
    text = F.regexp_extract(hit, r"^\[([^\]]+)\]", 1)
    inner = F.regexp_extract(hit, r"^\[[^\]]+\][\[(]([^)\]]*|[^)]+)[\])]\z", 1)
    paren = F.regexp_extract(hit, r"^\[[^\]]+\]\(([^)]+)\)\z", 1)
    url, title = _target(paren)
    kind = F.element_at(F.array(F.lit("inline"), F.lit("reference"), F.lit("implicit")), F.col("x.ord") + 1)
    key = F.when(F.col("x.ord") == 1, F.concat(F.lit("["), inner, F.lit("]"))).when(F.col("x.ord") == 2, F.concat(F.lit("["), trim(F.lower(text)), F.lit("]")))
    return rows.select("doc_id", "n", F.col("x.ord").alias("ord"), F.col("x.s").alias("s"), F.col("x.e").alias("e"), text.alias("text"), F.when(kind == "inline", url).alias("url"), F.when(kind == "inline", title).alias("title"), kind.alias("kind"), key.alias("key"))


def resolve(links: DataFrame, defs: DataFrame) -> DataFrame:
    """Fill url, title and ref_id of references from definitions; unmatched ones go."""
    d = defs.select("doc_id", "key", F.col("ref_id"), F.col("url").alias("d_url"), F.col("title").alias("d_title"))
    both = links.join(d, ["doc_id", "key"], "left")
    both = both.filter((F.col("kind") == "inline") | F.col("d_url").isNotNull())
    ref = F.when(F.col("kind") == "reference", F.substring("key", F.lit(2), F.length("key") - 2)).otherwise(F.col("ref_id"))
    inline = F.col("kind") == "inline"
    return both.withColumn("ref_id", F.when(~inline, ref)).withColumn("url", F.when(inline, F.col("url")).otherwise(F.col("d_url"))).withColumn("title", F.when(inline, F.col("title")).otherwise(F.col("d_title"))).drop("d_url", "d_title")


def unreferenced(links: DataFrame, defs: DataFrame) -> DataFrame:
    """Definitions, each under the id as written, that no link uses."""
    own = defs.filter(F.col("key") == F.concat(F.lit("["), F.col("ref_id"), F.lit("]")))
    return own.join(links.filter("kind <> 'inline'").select("doc_id", "ref_id").distinct(), ["doc_id", "ref_id"], "left_anti")


def number_links(links: DataFrame, kept: DataFrame | None = None) -> DataFrame:
    """Add ``num`` to inline links: distinct targets count on from the highest number in use,
    by a link or by a definition that is ``kept``."""
    used = links.filter("kind <> 'inline'").select("doc_id", "ref_id")
    used = used if kept is None else used.unionByName(kept.select("doc_id", "ref_id"))
    used = used.groupBy("doc_id").agg(F.max(F.col("ref_id").try_cast("long")).alias("top"))
    first = links.filter("kind = 'inline'").groupBy("doc_id", "url", "title").agg(F.min(F.struct("n", "s")).alias("at"))
    rank = F.row_number().over(Window.partitionBy("doc_id").orderBy("at"))
    nums = first.join(used, "doc_id", "left").select("doc_id", "url", "title", (rank + F.coalesce("top", F.lit(0))).alias("num"))
    a, b = links.alias("a"), nums.alias("b")
    same = (F.col("a.doc_id") == F.col("b.doc_id")) & (F.col("a.url") == F.col("b.url")) & F.col("a.title").eqNullSafe(F.col("b.title")) & (F.col("a.kind") == "inline")
    return a.join(b, same, "left").select("a.*", "b.num")


def _with_title(head: Column, url: Column, title: Column, tail: str) -> Column:
    return F.concat(head, url, F.when(title.isNotNull(), F.concat(F.lit(' "'), title, F.lit('"'))).otherwise(F.lit("")), F.lit(tail))


def rewritten(links: DataFrame, inline: bool) -> DataFrame:
    """``(doc_id, n, edits)``: replacements of a line's links, by position."""
    bracket = F.concat(F.lit("["), F.col("text"), F.lit("]"))
    if inline:
        new = _with_title(F.concat(bracket, F.lit("(")), F.col("url"), F.col("title"), ")")
    else:
        ref = F.when(F.col("kind") == "inline", F.col("num").cast("string")).otherwise(F.col("ref_id"))
        new = F.when(F.col("kind") == "implicit", bracket).otherwise(F.concat(bracket, F.lit("["), ref, F.lit("]")))
    return links.groupBy("doc_id", "n").agg(F.sort_array(F.collect_list(F.struct("s", "e", new.alias("new")))).alias("edits"))


def apply_edits(c: Column, edits: Column) -> Column:
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))
    step = lambda s, x: F.when(x["s"] < s["at"], s).otherwise(F.struct(F.concat(s["out"], F.substring(c, s["at"] + 1, x["s"] - s["at"]), x["new"]).alias("out"), x["e"].alias("at")))
    return F.aggregate(edits, start, step, lambda s: F.concat(s["out"], F.substring(c, s["at"] + 1, F.length(c))))


def definition_lines(links: DataFrame, kept: DataFrame | None = None) -> DataFrame:
    """``(doc_id, k, l)``: text ids in order of first use, then numbers ascending, then ``kept``
    definitions in the order of their lines."""
    at = F.struct("n", "ord", "s")
    named = links.filter("kind <> 'inline'").groupBy("doc_id", "ref_id").agg(F.min_by(F.struct("url", "title"), at).alias("t"), F.min(at).alias("at"))
    named = named.select("doc_id", F.col("ref_id").alias("id"), "t.url", "t.title", F.struct(F.lit(0).alias("g"), F.col("at.n").cast("long").alias("a"), F.col("at.ord").cast("long").alias("b"), F.col("at.s").cast("long").alias("c")).alias("o"))
    numbers = links.filter("kind = 'inline'").select("doc_id", F.col("num").cast("string").alias("id"), "url", "title", F.struct(F.lit(1).alias("g"), F.col("num").cast("long").alias("a"), F.lit(0).cast("long").alias("b"), F.lit(0).cast("long").alias("c")).alias("o")).distinct()
    every = named.unionByName(numbers)
    if kept is not None:
        zero = F.lit(0).cast("long")
        every = every.unionByName(kept.select("doc_id", F.col("ref_id").alias("id"), "url", "title", F.struct(F.lit(2).alias("g"), F.col("n").cast("long").alias("a"), zero.alias("b"), zero.alias("c")).alias("o")))
    k = F.row_number().over(Window.partitionBy("doc_id").orderBy("o"))
    return every.select("doc_id", k.alias("k"), _with_title(F.concat(F.lit("["), F.col("id"), F.lit("]: ")), F.col("url"), F.col("title"), "").alias("l"))


def body_lines(lines: DataFrame, to_end: bool) -> DataFrame:
    """Lines without definitions and, if ``to_end``, without the blank lines after the last text.

    A document of nothing else keeps one empty line, so that it is not lost."""
    text = ~(plain() & is_definition_line(F.col("l")))
    lines = lines.withColumn("_text", text)
    if to_end:
        more = F.first(F.when(F.col("_text") & ~is_blank(F.col("l")), F.lit(1)), ignorenulls=True).over(rows_after()).isNotNull()
        lines = lines.withColumn("_more", more).withColumn("_text", F.col("_text") & (F.col("_more") | ~is_blank(F.col("l")))).drop("_more")
    lines = lines.withColumn("_any", F.max("_text").over(whole_doc())).filter(F.col("_text") | (~F.col("_any") & (F.col("n") == 0)))
    return lines.withColumn("l", F.when(F.col("_any"), F.col("l")).otherwise(F.lit(""))).drop("_text", "_any")


def convert(lines: DataFrame, inline: bool = False, at_beginning: bool = False, keep_unreferenced: bool = False) -> DataFrame:
    """``(doc_id, n, l)`` with links in one style, renumbered from 0.

    Reference style puts definitions after the last line of text, or at the beginning
    below front matter, with a blank line between; those that nothing uses go unless they are to
    be kept.  Inline style needs none.
    """
    lines = regions(lines.select("doc_id", "n", "l"))
    defs = definitions(lines)
    links = materialize(resolve(find_links(lines), defs), "links")
    spare = None
    if not inline:
        spare = unreferenced(links, defs) if keep_unreferenced else None
        links = materialize(number_links(links, spare), "numbered")
    body = body_lines(lines, not inline and not at_beginning)
    body = body.join(rewritten(links, inline), ["doc_id", "n"], "left")
    body = body.withColumn("l", F.when(F.col("edits").isNotNull(), apply_edits(F.col("l"), F.col("edits"))).otherwise(F.col("l")))
    if inline:
        rows = body.select("doc_id", F.struct(F.lit(1).alias("g"), F.col("n").alias("a")).alias("o"), "l")
    else:
        defs = definition_lines(links, spare)
        place = 0 if at_beginning else 2
        group = F.when(F.col("in_fm"), -1).otherwise(1)
        gap = defs.groupBy("doc_id").agg(F.max("k").alias("k"))
        gaps = [gap.select("doc_id", F.struct(F.lit(place).alias("g"), (F.lit(0) if place == 2 else F.col("k") + 1).cast("int").alias("a")).alias("o"), F.lit("").alias("l"))]
        if at_beginning:
            gaps.append(gap.select("doc_id", F.struct(F.lit(0).alias("g"), F.lit(0).alias("a")).alias("o"), F.lit("").alias("l")))
        rows = body.select("doc_id", F.struct(group.alias("g"), F.col("n").alias("a")).alias("o"), "l")
        for more in (defs.select("doc_id", F.struct(F.lit(place).alias("g"), F.col("k").alias("a")).alias("o"), "l"), *gaps):
            rows = rows.unionByName(more)
    return rows.select("doc_id", (F.row_number().over(Window.partitionBy("doc_id").orderBy("o")) - 1).alias("n"), "l")
