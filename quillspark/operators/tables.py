"""Pipe tables: blocks of consecutive lines, columns aligned by window maxima."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions.kernels import trim
from quillspark.functions.lines import column_count, is_separator
from quillspark.operators.lines import doc_order, rows_up_to


def table_blocks(lines: DataFrame, eligible: Column) -> DataFrame:
    """Add ``tbl``: the number of the block of two or more eligible lines, else null."""
    lines = lines.withColumn("_in", F.coalesce(eligible, F.lit(False)))
    start = F.col("_in") & ~F.coalesce(F.lag("_in").over(doc_order()), F.lit(False))
    lines = lines.withColumn("_start", start).withColumn("_island", F.sum(F.col("_start").cast("int")).over(rows_up_to()))
    size = F.count(F.lit(1)).over(Window.partitionBy("doc_id", "_island", "_in"))
    return lines.withColumn("tbl", F.when(F.col("_in") & (size >= 2), F.col("_island"))).drop("_in", "_start", "_island")


def cells(c: Column) -> Column:
    """Cells of a row: one outer pipe a side is dropped, the rest is cut at pipes."""
    inner = F.regexp_replace(F.regexp_replace(trim(c), r"^\|", ""), r"\|\z", "")
    return F.split(inner, r"\|", -1)


def alignment(cell: Column) -> Column:
    t = trim(cell)
    ends = F.concat(F.left(t, F.lit(1)), F.right(t, F.lit(1)))
    return F.when(ends == "::", "::").when(ends == "-:", "-:").otherwise(":-")


def pad(cell: Column, align: Column, width: Column) -> Column:
    room = F.greatest(width - F.length(cell), F.lit(0))
    left = F.when(align == "::", F.floor(room / 2)).when(align == "-:", room).otherwise(F.lit(0)).cast("int")
    return F.concat(F.repeat(F.lit(" "), left), cell, F.repeat(F.lit(" "), (room - left).cast("int")))


def formatted(rows: Column) -> Column:
    """Lines of one table from its ordered lines (an array of strings).

    The first separator row sets alignments and the number of columns; without one the
    first row's columns are aligned to the left.  Short rows are filled, extra cells go.
    """
    marks = F.transform(rows, is_separator)
    at = F.coalesce(F.array_position(marks, F.lit(True)).cast("int"), F.lit(0))  # 1-based; 0: none
    made = F.array_repeat(F.lit(" --- "), column_count(F.get(rows, F.lit(0))))
    align = F.transform(F.when(at > 0, cells(F.element_at(rows, F.greatest(at, F.lit(1))))).otherwise(made), alignment)
    head = F.struct(rows.alias("rows"), at.alias("at"), align.alias("align"))

    def table(t: Column) -> Column:
        """One step at a time, each bound by a lambda, so that none is computed twice."""
        k = F.size(t["align"])

        def fill(line: Column) -> Column:
            own = F.transform(cells(line), lambda c: F.concat(F.lit(" "), trim(c), F.lit(" ")))
            return F.slice(F.concat(own, F.array_repeat(F.lit(" "), k)), F.lit(1), k)

        body = F.transform(F.filter(t["rows"], lambda x, i: i + 1 != t["at"]), fill)
        return F.struct(body.alias("body"), t["align"].alias("align"), t["at"].alias("at"))

    def lines(t: Column) -> Column:
        width = F.transform(t["align"], lambda a, c: F.greatest(F.lit(2), F.coalesce(F.array_max(F.transform(t["body"], lambda row: F.length(F.get(row, c)))), F.lit(2))))
        return F.struct(t["body"].alias("body"), t["align"].alias("align"), t["at"].alias("at"), width.alias("w"))

    def draw(t: Column) -> Column:
        line = lambda row: F.concat(F.lit("|"), F.array_join(F.transform(row, lambda c, i: pad(c, F.get(t["align"], i), F.get(t["w"], i))), "|"), F.lit("|"))
        rule = F.concat(F.lit("|"), F.array_join(F.transform(t["align"], lambda a, i: F.concat(F.left(a, F.lit(1)), F.repeat(F.lit("-"), F.get(t["w"], i) - 2), F.right(a, F.lit(1)))), "|"), F.lit("|"))
        first = F.when(t["at"] == 1, F.lit(0)).otherwise(F.lit(1))
        n = F.size(t["body"])
        return F.concat(F.transform(F.slice(t["body"], F.lit(1), first), line), F.array(rule), F.transform(F.slice(t["body"], first + 1, F.greatest(n, F.lit(1))), line))

    out = F.array(head)
    for step in (table, lines, draw):
        out = F.transform(out, step)
    return F.get(out, F.lit(0))


def format_tables(rows: DataFrame) -> DataFrame:
    """``(doc_id, n, tbl, l)`` to ``(doc_id, n, frags)``, n that of the table's first line."""
    t = rows.groupBy("doc_id", "tbl").agg(F.sort_array(F.collect_list(F.struct("n", "l"))).alias("r"))
    return t.select("doc_id", F.col("r")[0]["n"].alias("n"), formatted(F.transform("r", lambda x: x["l"])).alias("frags"))


def tables_in_place(lines: DataFrame) -> DataFrame:
    """Lines with ``tbl``, ``raw`` and ``frags``: a table's first line takes its formatted
    lines, its other lines go.  The table is gathered by a window, so no join is needed."""
    block = Window.partitionBy("doc_id", "tbl").orderBy("n")
    raw = F.when(F.col("tbl").isNotNull(), F.col("raw"))
    every = F.collect_list(raw).over(block.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    first = F.row_number().over(block) == 1
    lines = lines.withColumn("_first", F.col("tbl").isNull() | first).withColumn("_rows", F.when(F.col("tbl").isNotNull(), every))
    lines = lines.filter("_first")
    return lines.withColumn("frags", F.when(F.col("tbl").isNotNull(), formatted(F.col("_rows"))).otherwise(F.col("frags"))).drop("_first", "_rows")
