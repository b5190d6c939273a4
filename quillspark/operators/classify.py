"""Document state as window functions: front matter, fences, display math."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions.kernels import is_blank, trim
from quillspark.functions.lines import is_fence
from quillspark.operators.lines import doc_order, rows_after, rows_before, rows_up_to, whole_doc


def odd(flag: Column, window) -> Column:
    return F.coalesce(F.sum(flag.cast("int")).over(window), F.lit(0)) % 2 == 1


def regions(lines: DataFrame) -> DataFrame:
    """Add ``in_fm``, ``fence`` (opening, closing or null) and ``in_code``.

    Front matter opens with ``---`` on line 0 and closes with the next ``---`` or ``...``;
    unclosed, it is the whole document.  Fences within it do not count.
    """
    t = trim(F.col("l"))
    lines = lines.withColumn("_mark", t.isin("---", "..."))
    lines = lines.withColumn("_open", F.max((F.col("n") == 0) & (t == "---")).over(whole_doc())).withColumn("_close", F.min(F.when(F.col("_mark") & (F.col("n") > 0), F.col("n"))).over(whole_doc()))
    lines = lines.withColumn("in_fm", F.col("_open") & (F.col("_close").isNull() | (F.col("n") <= F.col("_close"))))
    lines = lines.withColumn("_fence", is_fence(F.col("l")) & ~F.col("in_fm"))
    lines = lines.withColumn("_odd", odd(F.col("_fence"), rows_before()))
    lines = lines.withColumn("fence", F.when(F.col("_fence"), F.when(F.col("_odd"), "close").otherwise("open")))
    lines = lines.withColumn("in_code", ~F.col("_fence") & F.col("_odd") & ~F.col("in_fm"))
    return lines.withColumn("fm_close", F.col("in_fm") & (F.col("n") == F.col("_close"))).drop("_mark", "_open", "_close", "_fence", "_odd")


def plain() -> Column:
    """Lines that rules may touch."""
    return ~F.col("in_fm") & ~F.col("in_code") & F.col("fence").isNull()


def display_math(lines: DataFrame) -> DataFrame:
    """Add ``math``: open, close, inside or null, for lines outside code."""
    mark = plain() & (trim(F.col("l")) == "$$")
    lines = lines.withColumn("_mark", mark).withColumn("_odd", odd(F.col("_mark"), rows_before()))
    state = F.when(F.col("_mark"), F.when(F.col("_odd"), "close").otherwise("open")).when(F.col("_odd") & plain(), "inside")
    return lines.withColumn("math", state).drop("_mark", "_odd")


def trailing_blanks_of_block(lines: DataFrame) -> Column:
    """Blank lines just before the end of a code block or of front matter, and just after its start."""
    closing = F.when(~is_blank(F.col("l")), F.struct("fence", "fm_close"))
    ahead = F.first(closing, ignorenulls=True).over(rows_after())
    blank = is_blank(F.col("l"))
    code = blank & F.col("in_code") & (ahead["fence"] == "close")
    front = blank & F.col("in_fm") & (ahead["fm_close"] | (F.col("n") == 1))
    return F.coalesce(code, F.lit(False)) | F.coalesce(front, F.lit(False))


def replacement_regions(lines: DataFrame) -> DataFrame:
    """Add ``region`` (text, code, front) and ``segment``: maximal runs of one region.

    An opening fence belongs to the text before it, a closing one to the code.
    """
    kind = F.when(F.col("in_fm"), "front").when(F.col("in_code") | (F.col("fence") == "close"), "code").otherwise("text")
    lines = lines.withColumn("region", kind)
    lines = lines.withColumn("_new", (~F.lag("region").over(doc_order()).eqNullSafe(F.col("region"))).cast("int"))
    return lines.withColumn("segment", F.sum("_new").over(rows_up_to())).drop("_new")
