"""Lists: runs, indent unit, levels, interrupts and numbering, all as windows.

Input rows carry ``list`` (the line is a list item), ``clears`` (the line ends every list)
and ``clears_after`` (the item is the last of its run).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions.kernels import is_blank
from quillspark.functions.lines import spaces_of
from quillspark.operators.lines import rows_before, doc_order

#: Levels whose contexts are told apart; deeper ones share the deepest.
MAX_LEVELS = 16


def list_runs(lines: DataFrame) -> DataFrame:
    """Add ``run``: how often lists were cleared before the line."""
    cleared = F.sum(F.col("clears").cast("int")).over(doc_order().rowsBetween(Window.unboundedPreceding, 0))
    after = F.sum(F.col("clears_after").cast("int")).over(rows_before())
    return lines.withColumn("run", F.coalesce(cleared, F.lit(0)) + F.coalesce(after, F.lit(0)))


def indent_unit(lines: DataFrame) -> DataFrame:
    """Add ``unit``, 4 or 2 spaces a level, decided at a run's first item.

    It is told by the first item with two or more leading spaces, up to the next
    non-blank line that is no item; an item with no item line just above is not asked itself.
    """
    other = (~F.col("list") & ~is_blank(F.col("l"))).cast("int")
    lines = lines.withColumn("_block", F.sum(other).over(doc_order().rowsBetween(Window.unboundedPreceding, 0)))
    nested = F.when(F.col("list") & (spaces_of(F.col("l")) >= 2), F.when(spaces_of(F.col("l")) >= 4, 4).otherwise(2))
    lines = lines.withColumn("_nested", nested)
    block = Window.partitionBy("doc_id", "_block").orderBy("n")
    here = F.first("_nested", ignorenulls=True).over(block.rowsBetween(0, Window.unboundedFollowing))
    later = F.first("_nested", ignorenulls=True).over(block.rowsBetween(1, Window.unboundedFollowing))
    lines = lines.withColumn("_unit", F.when(F.coalesce(F.lag("list").over(doc_order()), F.lit(False)), here).otherwise(later))
    first = F.first(F.when(F.col("list"), F.struct("_unit")), ignorenulls=True).over(Window.partitionBy("doc_id", "run").orderBy("n").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return lines.withColumn("unit", F.coalesce(first["_unit"], F.lit(2))).drop("_block", "_nested", "_unit")


def level_of(c: Column, unit: Column) -> Column:
    lead = F.regexp_extract(c, r"(?U)^(\s*)", 1)
    return F.length(F.regexp_replace(lead, "[^\t]", "")) + F.floor(spaces_of(c) / unit).cast("int")


def numbering(items: DataFrame, keep_start: bool = False) -> DataFrame:
    """Lines with ``marker`` and ``interrupt`` for those that are list items.

    Needs ``doc_id, n, l, list, run, level, follows, wrapped_before``; other lines get none.

    ``follows``: the last non-blank output line came from a list item; ``wrapped_before``:
    it is a continuation of that item.  At level 0 a change between bullets and numbers
    interrupts the list, unless the item before is nested, or wrapped; then the item
    takes its list's kind.  A level's list starts anew when a shallower item came since.
    """
    run = Window.partitionBy("doc_id", "run", "list").orderBy("n")
    before = run.rowsBetween(Window.unboundedPreceding, -1)
    upto = run.rowsBetween(Window.unboundedPreceding, 0)
    own = F.regexp_extract("l", r"(?U)^\s*([-*+]|\d+\.)", 1)
    items = items.withColumn("_own", own).withColumn("_num", own.endswith("."))
    items = items.withColumn("_prev", F.lag("level").over(run))
    sets = (F.col("level") == 0) & (F.col("_prev").isNull() | ((F.col("_prev") == 0) & F.col("follows") & ~F.col("wrapped_before")))
    items = items.withColumn("_kind", F.last(F.when(sets, F.col("_num")), ignorenulls=True).over(before))
    stop = (F.col("level") == 0) & (F.col("_prev") == 0) & F.col("follows") & ~F.col("wrapped_before") & (F.col("_num") != F.col("_kind"))
    items = items.withColumn("interrupt", F.coalesce(stop, F.lit(False)))
    stops = F.sum(F.col("interrupt").cast("int")).over(upto)
    shallower = [F.coalesce(F.sum((F.col("level") < k).cast("int")).over(before), F.lit(0)) for k in range(1, MAX_LEVELS + 1)]
    items = items.withColumn("_ctx", F.when(F.col("level") == 0, stops).otherwise(F.element_at(F.array(*shallower), F.least(F.greatest("level", F.lit(1)), F.lit(MAX_LEVELS)))))
    ctx = Window.partitionBy("doc_id", "run", "list", "level", "_ctx").orderBy("n")
    every = ctx.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    start = F.coalesce(F.first(F.regexp_replace("_own", r"\.\z", "").try_cast("long")).over(every), F.lit(1)) if keep_start else F.lit(1)
    number = F.concat((start + F.row_number().over(ctx) - 1).cast("string"), F.lit("."))
    bullet = F.when(F.col("level") == 0, "*").when(F.col("level") == 1, "-").otherwise("+")
    items = items.withColumn("marker", F.when(F.col("list"), F.when(F.first("_num").over(every), number).otherwise(bullet)))
    items = items.withColumn("interrupt", F.col("interrupt") & F.col("list"))
    return items.drop("_own", "_num", "_prev", "_kind", "_ctx")


def with_marker(c: Column, marker: Column) -> Column:
    """The item with another marker, its indent and spacing kept."""
    lead = F.regexp_extract(c, r"(?U)^(\s*)", 1)
    rest = F.regexp_extract(c, r"(?Ud)^\s*(?:[-*+]|\d+\.)(.*)\z", 1)
    return F.concat(lead, marker, rest)


def tabs_for_spaces(c: Column, unit: Column) -> Column:
    """12: an indent of spaces becomes tabs, a level each, and one space follows the marker."""
    lead = F.regexp_extract(c, r"(?U)^(\s*)", 1)
    marker = F.regexp_extract(c, r"(?U)^\s*([-*+]|\d+\.)", 1)
    body = F.regexp_extract(c, r"(?Ud)^\s*(?:[-*+]|\d+\.)\s*(.*)\z", 1)
    tabs = F.repeat(F.lit("\t"), F.floor(F.length(lead) / unit).cast("int"))
    return F.when(lead.contains("\t"), c).otherwise(F.concat(tabs, marker, F.lit(" "), body))
