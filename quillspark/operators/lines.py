"""Documents to lines and back."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from quillspark.functions.kernels import is_blank


def doc_order() -> WindowSpec:
    """Lines of one document in order; every scan uses this one partitioning."""
    return Window.partitionBy("doc_id").orderBy("n")


def rows_before() -> WindowSpec:
    return doc_order().rowsBetween(Window.unboundedPreceding, -1)


def rows_after() -> WindowSpec:
    return doc_order().rowsBetween(1, Window.unboundedFollowing)


def rows_up_to() -> WindowSpec:
    return doc_order().rowsBetween(Window.unboundedPreceding, 0)


def whole_doc() -> WindowSpec:
    return Window.partitionBy("doc_id")


def to_lines(docs: DataFrame) -> DataFrame:
    """``(doc_id, text)`` to ``(doc_id, n, l)``: lines without line feeds, numbered from 0.

    A final line feed ends the last line rather than starting one.  A null text has no lines.
    """
    parts = F.split("text", "\n", -1)
    whole = F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)
    return docs.select("doc_id", F.posexplode(whole).alias("n", "l"))


def doc_lines(docs: DataFrame) -> DataFrame:
    """As ``to_lines``, but an empty text has one empty line, so that no document is lost."""
    return to_lines(docs.withColumn("text", F.when(F.col("text") == "", "\n").otherwise(F.col("text"))))


def assemble(out: DataFrame) -> DataFrame:
    """``(doc_id, n, frags)`` to ``(doc_id, text)``, each line ended by a line feed."""
    rows = F.sort_array(F.collect_list(F.struct("n", "frags")))
    lines = F.flatten(F.transform(rows, lambda r: r["frags"]))
    return out.groupBy("doc_id").agg(F.concat(F.array_join(lines, "\n"), F.lit("\n")).alias("text"))


def with_neighbours(lines: DataFrame, c: str = "l") -> DataFrame:
    """Add the next line and the next non-blank line of the input."""
    text = F.when(~is_blank(F.col(c)), F.col(c))
    return lines.withColumn("next", F.lead(c).over(doc_order())).withColumn("next_text", F.first(text, ignorenulls=True).over(rows_after()))
