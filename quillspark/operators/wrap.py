"""Greedy wrapping of one line; code spans and links stay whole."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillspark.functions.kernels import squash

_FLAT = r"[^\[\]]*"
_ONE = rf"(?:\[{_FLAT}\]|[^\[\]])*"
_TWO = rf"(?:\[{_ONE}\]|[^\[\]])*"
#: A closed code span; a bracketed text (three levels deep) with a target; an unclosed
#: bracket, which takes the rest; a word.
TOKEN = rf"(?U)(`+)(?!`)(?:(?!\1(?!`)).)*?(?<!`)\1(?!`)|\[{_TWO}\](?:\([^)]*\)?|\[[^\]]*\]?)?\S*|\[.*|\S+"


#: What a text must hold for tokens to be more than words or for the guard to matter.
GUARDED = r"(?U)[\[`]|\s\d+\."


def tokens(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(TOKEN), F.lit(0))


def greedy(c: Column, room: Column) -> Column:
    """Lines of plain words, in one pass of one pattern: as many whole words as fit, or a
    word that is longer than a line."""
    pattern = F.concat(F.lit(r"(?sU)\S.{0,"), F.greatest(room - 1, F.lit(0)).cast("string"), F.lit(r"}(?!\S)|\S+"))
    return F.regexp_extract_all(squash(c), pattern, F.lit(0))


def wrap(c: Column, width: Column, prefix: Column | None = None) -> Column:
    """Lines of at most ``width`` characters, the prefix counted, unless a token is longer.

    A token like ``3.`` would make a list where it starts a line, so the word before it
    comes along.  A text that fits is given back as it is.  Only texts with brackets,
    back-ticks or such tokens are folded word by word.
    """
    head = F.lit("") if prefix is None else prefix
    room = width - F.length(head)
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("line"))

    def step(s: Column, word: Column) -> Column:
        line = s["line"]
        longer = F.when(line == "", word).otherwise(F.concat(line, F.lit(" "), word))
        fits = F.length(longer) <= room
        carry = word.rlike(r"(?U)^\d+\.") & (line != "")
        last = F.regexp_extract(line, r"([^ ]*)\z", 1)
        rest = F.regexp_replace(line, r" *[^ ]*\z", "")
        left = F.when(carry, rest).otherwise(line)
        done = F.when(left == "", s["done"]).otherwise(F.concat(s["done"], F.array(left)))
        return F.when(fits, F.struct(s["done"].alias("done"), longer.alias("line"))).otherwise(F.struct(done.alias("done"), F.when(carry, F.concat(last, F.lit(" "), word)).otherwise(word).alias("line")))

    lines = F.aggregate(tokens(c), start, step, lambda s: F.when(s["line"] == "", s["done"]).otherwise(F.concat(s["done"], F.array(s["line"]))))
    whole = F.when(F.length(c) <= room, F.array(c)).when(c.rlike(GUARDED), lines).otherwise(greedy(c, room))
    return F.transform(F.when(F.size(whole) > 0, whole).otherwise(F.array(c)), lambda x: F.concat(head, x))
