"""The whole normalization as one plan over lines.

All windows partition by doc_id and order by line, so Spark shuffles lines once for them.
Lines are written before and after link conversion, whose joins each read them again.
Decisions are made in this order: what a line is; which lines go; what survives becomes; which
blank lines come before and after, from the survivor before and the input line after.
A skipped rule adds nothing to the plan.

Inside the plan ``doc_id`` is a key of the input row: its own number, the given id and a digest of
its text.  So rows that share an id, or have none, stay apart, and neither the id nor whether the
text changed needs a join afterwards.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions import rules as R
from quillspark.functions.kernels import built_once, is_blank, ltrim, rtrim, trim
from quillspark.functions.lines import indent_of, is_deflist_item, is_fence, is_headline, is_list_item, is_preserved, is_quote, is_quote_blank, is_rule, quote_depth
from quillspark.operators import emoji, links, lists, replacements, tables
from quillspark.operators.classify import display_math, plain, regions, trailing_blanks_of_block
from quillspark.operators.lines import rows_after, rows_before, doc_order, rows_up_to, assemble, doc_lines, with_neighbours
from quillspark.operators.wrap import wrap
from quillspark.plans.options import Options
from quillspark.sources.scratch import materialize


@built_once
def changed(rule: Callable[..., Column], *settings: bool) -> Column:
    """The line after a rule on plain lines."""
    return F.when(plain(), rule(F.col("l"), *settings)).otherwise(F.col("l"))


def inline_rules(lines: DataFrame, o: Options) -> DataFrame:
    """Rules on the text of plain lines; ``raw`` keeps the line as it came."""
    lines = lines.withColumn("raw", F.col("l"))
    ok = plain()
    if o.replacements:
        lines = lines.withColumn("l", replacements.by_line(F.col("l"), list(o.replacements), F.col("in_code") | F.col("fence").isNotNull(), F.col("in_fm")))
    if o.on(23) and lines.filter(F.col("l").rlike(R.EMOJI)).limit(1).count():
        known = emoji.dictionary(lines.sparkSession, o.emoji_names or emoji.COMMON_NAMES)
        lines = emoji.emoji_names(lines, known, o.emoji_max_distance, ok & F.col("math").isNull())
    steps = []
    if o.on(24):
        steps.append(changed(R.typography, o.em_dash, o.guillemet))
    if o.on(25):
        steps += [changed(rule) for rule in ((R.reversed_emphasis,) if o.reverse_emphasis else (R.strong_emphasis, R.bold, R.italic))]
    if o.on(16):
        steps.append(changed(R.ial_spacing))
    if o.on(31):
        steps.append(changed(R.liquid_tags))
    if o.on(18):
        steps.append(changed(R.definition_spacing))
    for step in steps:  # one column at a time: nested, each pass would repeat the one before
        lines = lines.withColumn("l", step)
    if o.on(21):
        first, last = F.lag("math").over(doc_order()) == "open", F.lead("math").over(doc_order()) == "close"
        block = F.when(F.col("math").isin("open", "close"), "$$").when(first, ltrim(F.col("l"))).when(last, rtrim(F.col("l"))).otherwise(F.col("l"))
        lines = lines.withColumn("l", F.when(F.col("math").isNotNull(), block).otherwise(changed(R.inline_math)))
    if o.on(17):
        lines = lines.withColumn("l", F.when(F.col("fence").isNotNull(), R.code_language(F.col("l"))).otherwise(F.col("l")))
    return lines


def kinds(lines: DataFrame, o: Options) -> DataFrame:
    """Add ``kind``, the first that fits."""
    raw = F.col("raw")
    piped = plain() & F.col("math").isNull() & raw.contains("|") & ~is_blank(raw)
    lines = tables.table_blocks(lines, piped) if o.on(22) else lines.withColumn("tbl", F.lit(None).cast("long"))
    l = F.col("l")
    kind = (
        F.when(F.col("in_fm"), "front").when(F.col("fence").isNotNull(), "fence").when(F.col("in_code"), "code")
        .when(F.col("math").isNotNull(), "math").when(F.col("tbl").isNotNull(), "table")
        .when(is_headline(l), "head").when(is_rule(l), "rule").when(is_preserved(l), "keep")
        .when(is_list_item(l), "list").when(is_quote(l), "quote").when(is_blank(l), "blank").otherwise("para")
    )
    return lines.withColumn("kind", kind)


def list_rules(lines: DataFrame, o: Options) -> DataFrame:
    """Markers, numbers and indents of list items; ``interrupt`` where a list is split."""
    nxt = F.col("next")
    ends = F.col("next").isNull() | (~is_blank(nxt) & ~is_list_item(nxt)) if o.on(9) else F.lit(True)
    lines = lines.withColumn("list", F.col("kind") == "list").withColumn("clears", F.col("kind").isin("head", "rule", "quote", "para")).withColumn("clears_after", F.col("list") & ends)
    lines = lists.indent_unit(lists.list_runs(lines))
    lines = lines.withColumn("level", lists.level_of(F.col("l"), F.col("unit")))
    if o.on(19):
        lines = lines.withColumn("l", F.when(F.col("list"), R.task_checkbox(F.col("l"))).otherwise(F.col("l")))
    # an item wraps if it is too long once its marker and indent are settled; a number's length may differ
    body = F.regexp_extract("l", r"(?Ud)^\s*(?:[-*+]|\d+\.)\s*(.*)\z", 1)
    long = F.col("list") & (F.length(rtrim(body)) + 2 + F.col("level") > o.width) if o.on(14) else F.lit(False)
    last_text = F.last(F.when(~is_blank(F.col("l")), F.struct(F.col("list").alias("list"), long.alias("long"))), ignorenulls=True).over(rows_before())
    lines = lines.withColumn("_last", last_text)
    lines = lines.withColumn("follows", F.coalesce(F.col("_last.list"), F.lit(False))).withColumn("wrapped_before", F.coalesce(F.col("_last.long"), F.lit(False)))
    lines = lists.numbering(lines, keep_start=not o.on(27))
    item = lambda c: F.when(F.col("list"), c).otherwise(F.col("l"))
    c = F.col("l")
    if o.on(26):
        lines = lines.withColumn("l", item(lists.with_marker(c, F.col("marker"))))
    if o.on(12):
        lines = lines.withColumn("l", item(lists.tabs_for_spaces(c, F.col("unit"))))
    if o.on(13):
        lines = lines.withColumn("l", item(R.list_marker(c)))
    return lines.drop("list", "clears", "clears_after", "_last", "run", "unit", "level", "follows", "wrapped_before", "marker")


def quote_rules(c: Column, o: Options) -> Column:
    c = R.quote_markers(c) if o.on(32) else c
    return R.quote_spacing(c) if o.on(20) else c


@built_once
def wrapped(width: int) -> Column:
    """The lines that a long item, quote or paragraph becomes; any other line by itself."""
    l = F.col("l")
    lead = F.regexp_extract(l, r"(?U)^(\s*(?:[-*+]|\d+\.)\s+)", 1)
    item = wrap(F.regexp_extract(l, r"(?Ud)^\s*(?:[-*+]|\d+\.)\s+(.*)\z", 1), F.lit(width) - F.length(lead))
    item = F.transform(item, lambda x, i: F.concat(F.when(i == 0, lead).otherwise(F.repeat(F.lit(" "), F.length(lead))), x))
    marks = F.regexp_extract(l, r"(?U)^(\s*>(?:\s*>)*)", 1)
    quote = wrap(F.regexp_extract(l, r"(?Ud)^\s*>(?:\s*>)*\s*(.*)\z", 1), F.lit(width), F.concat(marks, F.lit(" ")))
    long = F.length(rtrim(l)) > width
    frags = F.when(long & (F.col("kind") == "list") & (lead != ""), item).when(long & (F.col("kind") == "quote"), quote).when(long & (F.col("kind") == "para"), wrap(trim(l), F.lit(width)))
    return F.coalesce(frags, F.array("l"))


def fragments(lines: DataFrame, o: Options) -> DataFrame:
    """Add ``frags``: the lines that a line becomes, tables apart."""
    l = F.col("l")
    lines = lines.withColumn("l", F.when(F.col("kind") == "quote", quote_rules(l, o)).when(F.col("kind") == "head", R.header_spacing(l) if o.on(4) else l).when(F.col("kind") == "para", R.trailing(l) if o.on(2) else l).otherwise(l))
    return lines.withColumn("frags", wrapped(o.width) if o.on(14) else F.array("l"))


def drop_lines(lines: DataFrame, o: Options) -> DataFrame:
    """Remove blank lines that rules 3 and 33 and the ends of blocks do away with."""
    blank = F.col("kind") == "blank"
    text = ~is_blank(F.col("l"))
    tail = F.element_at("frags", -1)
    indented = tail.rlike(r"^[ \t]")
    last = F.last(F.when(text, F.struct((F.col("kind") == "list").alias("list"), indented.alias("indented"))), ignorenulls=True).over(rows_before())
    lines = lines.withColumn("_gone", trailing_blanks_of_block(lines)).withColumn("_last", last)
    tight = blank & is_list_item(F.col("next_text")) & (F.col("_last.list") | F.col("_last.indented")) if o.on(33) else F.lit(False)
    if o.on(3):
        item = text & ~is_quote_blank(F.col("l"))
        depth = F.when(item, quote_depth(F.col("l")))
        lines = lines.withColumn("_depth", F.last(depth, ignorenulls=True).over(rows_before()))
        raw_item = ~is_blank(F.col("raw")) & ~is_quote_blank(F.col("raw"))
        lines = lines.withColumn("_next_def", F.first(F.when(raw_item, F.when(is_deflist_item(F.col("raw")), quote_depth(F.col("raw"))).otherwise(F.lit(-1))), ignorenulls=True).over(rows_after()))
        own = F.when(blank, F.lit(0)).when((F.col("kind") == "quote") & is_quote_blank(F.col("l")), quote_depth(F.col("l")))
        lines = lines.withColumn("_def", F.coalesce((own == F.col("_depth")) & (own == F.col("_next_def")), F.lit(False)))
        counted = blank & ~F.coalesce(tight, F.lit(False)) & ~F.col("_def")
        lines = lines.withColumn("_counted", counted).withColumn("_reset", F.sum(F.col("kind").isin("code", "head", "rule", "table", "list", "para").cast("int")).over(rows_up_to()))
        nth = F.sum(F.col("_counted").cast("int")).over(Window.partitionBy("doc_id", "_reset").orderBy("n").rowsBetween(Window.unboundedPreceding, 0))
        gone = F.col("_gone") | F.coalesce(tight, F.lit(False)) | F.col("_def") | (F.col("_counted") & (nth > 1))
        lines = lines.withColumn("_nth_gone", gone).drop("_gone").withColumnRenamed("_nth_gone", "_gone")
        return lines.filter("NOT _gone").drop("_gone", "_last", "_depth", "_next_def", "_def", "_counted", "_reset")
    return lines.filter(~(F.col("_gone") | F.coalesce(tight, F.lit(False)))).drop("_gone", "_last")


def blank_lines(lines: DataFrame, o: Options) -> DataFrame:
    """Put blank lines around blocks: ``frags`` gain them in front and behind."""
    kind, l, nxt = F.col("kind"), F.col("l"), F.col("next")
    text_next = nxt.isNotNull() & ~is_blank(nxt)
    none = F.lit(False)
    after_fence = text_next & ~(l.rlike(r"^[ \t]") & F.coalesce(is_list_item(F.col("next_text")), none) & F.lit(o.on(33)))
    after = (
        F.when((kind == "fence") & (F.col("fence") == "close"), after_fence if o.on(7) else none)
        .when((kind == "math") & (F.col("math") == "close"), text_next)
        .when(kind == "head", text_next & ~is_headline(nxt) & ~is_fence(nxt) if o.on(5) else none)
        .when(kind == "rule", text_next if o.on(11) else none)
        .when(kind == "list", text_next & ~is_list_item(nxt) & (indent_of(nxt) <= indent_of(l)) & ~is_quote(nxt) if o.on(9) else none)
        .otherwise(none)
    )
    lines = lines.withColumn("after", F.coalesce(after, none))
    tail = F.element_at("frags", -1)
    was = F.lag(F.struct(tail.alias("l"), (F.col("after") | is_blank(tail)).alias("blank"))).over(doc_order())
    lines = lines.withColumn("was", was)
    text = F.col("was").isNotNull() & ~F.col("was.blank")
    prev = F.col("was.l")
    before_list = ~is_list_item(prev) & ~is_quote(prev) & ~prev.rlike(r"(?U)^\s*#") & ~(prev.rlike(r"^[ \t]") & F.lit(o.on(33)))
    before = (
        F.when((kind == "fence") & (F.col("fence") == "open"), ~prev.rlike(r"(?U)^\s*`{3}") if o.on(6) else none)
        .when((kind == "math") & (F.col("math") == "open"), F.lit(True))
        .when(kind == "rule", F.lit(o.on(10)))
        .when(kind == "list", before_list & ~F.col("interrupt") if o.on(8) else none)
        .when(kind == "para", is_list_item(prev) | prev.rlike(r"(?U)^\s*`{3}"))
        .otherwise(none)
    )
    front = F.when(F.col("interrupt"), F.array(F.lit(""), F.lit("<!-- -->"), F.lit(""))).when(text & F.coalesce(before, none), F.array(F.lit(""))).otherwise(F.array().cast("array<string>"))
    back = F.when(F.col("after"), F.array(F.lit(""))).otherwise(F.array().cast("array<string>"))
    return lines.withColumn("frags", F.concat(front, "frags", back))


def keyed(docs: DataFrame) -> DataFrame:
    """``(doc_id, text)`` of rows with a text, each under a key of its own."""
    rows = docs.filter("text IS NOT NULL").select("doc_id", "text").withColumn("_row", F.monotonically_increasing_id())
    return rows.select(F.struct(F.col("_row").alias("row"), F.col("doc_id").alias("id"), F.md5("text").alias("was")).alias("doc_id"), "text")


def normalize(docs: DataFrame, options: Options | None = None) -> DataFrame:
    """``docs(doc_id, text)`` to ``(doc_id, text, changed)``, a row for each input row.

    A null text stays null, an empty one becomes a line feed; other columns are ignored.  Rows of
    one doc_id, or of a null one, are documents of their own; an empty table gives an empty result.
    """
    o = options or Options()
    text = R.line_endings(F.col("text")) if o.on(1) else F.col("text")
    work = keyed(docs).select("doc_id", text.alias("text"))
    work = replacements.by_document(work, list(o.replacements), "before")
    lines = doc_lines(work)
    if o.link_style and lines.filter(F.col("l").contains("[")).limit(1).count():
        # numbers of rows are given once: what the links are joined to must be what they came from
        lines = links.convert(materialize(lines, "lines"), o.link_style == "inline", o.link_style == "beginning", o.keep_unreferenced)
        lines = materialize(lines, "linked")
    elif o.on(23):
        lines = materialize(lines, "lines")
    lines = regions(lines)
    lines = display_math(lines) if o.on(21) else lines.withColumn("math", F.lit(None).cast("string"))
    lines = kinds(inline_rules(lines, o), o)
    lines = list_rules(with_neighbours(lines, "raw"), o)
    lines = fragments(lines, o)
    if o.on(22):
        lines = tables.tables_in_place(lines)
    lines = blank_lines(drop_lines(lines, o), o)
    out = replacements.by_document(assemble(lines.select("doc_id", "n", "frags")), list(o.replacements), "after")
    if o.on(15):
        out = out.withColumn("text", F.concat(F.regexp_replace("text", r"(?U)(\s*\n)?\s*\z", ""), F.lit("\n\n")))
        out = out.withColumn("text", F.when(is_blank(F.col("text")), F.lit("\n")).otherwise(F.col("text")))
    made = out.select(F.col("doc_id.id").alias("doc_id"), "text", (F.md5("text") != F.col("doc_id.was")).alias("changed"))
    return made.unionByName(docs.filter("text IS NULL").select("doc_id", "text", F.lit(False).alias("changed")))
