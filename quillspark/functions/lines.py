"""Predicates of one line (which holds no line feed)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillspark.functions.kernels import trim

MARKER = r"([-*+]|\d+\.)"


def is_fence(c: Column) -> Column:
    return c.rlike(r"(?U)^\s*(`{3}|~{3})")


def is_list_item(c: Column) -> Column:
    """A marker and white space; a bare marker at the line's end counts."""
    return c.rlike(rf"(?U)^\s*{MARKER}(\s|\z)")


def is_headline(c: Column) -> Column:
    return c.rlike(r"(?U)^\s*#+(\s+\S|[^\s#])")


def is_rule(c: Column) -> Column:
    return c.rlike(r"(?U)^\s*[-*_]{3,}\s*\z")


def is_quote(c: Column) -> Column:
    return c.rlike(r"(?U)^\s*>")


def is_definition(c: Column) -> Column:
    """A link definition: ``[id]: target``."""
    return c.rlike(r"(?U)^\s*\[[^\]]+\]\s*:\s*\S")


def is_preserved(c: Column) -> Column:
    return is_fence(c) | c.rlike(r"(?U)^\s*\[[^\]]*\]:") | c.rlike(r"(?U)^\s*#") | is_rule(c) | c.contains("|")


def is_separator(c: Column) -> Column:
    return trim(c).rlike(r"^[|: -]*\|[|: -]*\z")


def quote_depth(c: Column) -> Column:
    return F.length(F.regexp_replace(F.regexp_extract(c, r"(?U)^((?:\s*>)*)", 1), "[^>]", ""))


def is_quote_blank(c: Column) -> Column:
    return c.rlike(r"(?U)^(\s*>)+\s*\z")


def is_deflist_item(c: Column) -> Column:
    return c.rlike(r"(?U)^(?:\s*>)*\s*:(\s|\z)")


def indent_of(c: Column) -> Column:
    """Characters of leading white space."""
    return F.length(F.regexp_extract(c, r"(?U)^(\s*)", 1))


def spaces_of(c: Column) -> Column:
    """Leading white space that is not tabs."""
    return F.length(F.regexp_replace(F.regexp_extract(c, r"(?U)^(\s*)", 1), "\t", ""))


def column_count(c: Column) -> Column:
    t = trim(c)
    pipes = F.regexp_count(t, F.lit(r"\|"))
    return F.when(t == "", F.lit(0)).when(t.startswith("|"), F.greatest(pipes - 1, F.lit(0))).otherwise(pipes + 1)


def in_code_span(c: Column, at: Column) -> Column:
    """Whether an odd number of back-ticks stands before a place; a backslash hides one."""
    head = F.regexp_replace(F.substring(c, F.lit(1), at), r"\\.", "")
    return F.regexp_count(head, F.lit("`")) % 2 == 1
