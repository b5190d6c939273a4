"""Line-local rules: column in, column out.  Numbers are those of the rule catalogue."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillspark.functions.kernels import CODE_SPAN, bind, inside, rtrim, spans, splice, splice_outside, squash, trim


def line_endings(text: Column) -> Column:
    """1, on a whole text: CRLF and CR become LF, and a text ends with LF."""
    t = F.regexp_replace(text, r"\r\n?", "\n")
    return F.when(t.endswith("\n"), t).otherwise(F.concat(t, F.lit("\n")))


def trailing(c: Column) -> Column:
    """2: exactly two trailing spaces are a line break and stay; other white space goes."""
    return F.when(c.rlike(r"(^|[^ ])  \z"), c).otherwise(rtrim(c))


def header_spacing(c: Column) -> Column:
    """4"""
    return F.regexp_replace(c, r"(?Ud)^(#+)\s*(.*)\z", "$1 $2")


def ial_spacing(c: Column) -> Column:
    """16: attribute lists, outside code spans."""
    def one(hit: Column, before: Column, after: Column, at: Column, safe: Column) -> Column:
        colon = hit.startswith("{:")
        body = squash(F.regexp_replace(hit, r"^\{:?|\}\z", ""))
        return F.when(inside(safe, at), hit).when(colon, F.concat(F.lit("{: "), body, F.lit(" }"))).otherwise(F.concat(F.lit("{"), body, F.lit("}")))

    return splice_outside(c, r"\{:?[^}]*\}", spans(c, CODE_SPAN), one)


def code_language(c: Column) -> Column:
    """17"""
    return F.regexp_replace(c, r"(?U)^(`{3}|~{3})\s+([^\s`~]+)", "$1$2")


def definition_spacing(c: Column) -> Column:
    """18"""
    return F.regexp_replace(c, r"(?U)^(\[[^\]]+\])\s*:\s*", "$1: ")


def task_checkbox(c: Column) -> Column:
    """19"""
    return F.regexp_replace(c, r"(?U)^(\s*[-*+])\s+\[[Xx]\]\s+", "$1 [x] ")


def quote_spacing(c: Column) -> Column:
    """20"""
    return F.regexp_replace(c, r"(?U)^(\s*)(>+)([^\s>])", "$1$2 $3")


def quote_markers(c: Column) -> Column:
    """32: ``> >`` becomes ``>>``; what follows the last marker stays."""
    chain = F.regexp_extract(c, r"(?U)^\s*(>(?:\s*>)*)", 1)
    rest = F.regexp_extract(c, r"(?Ud)^\s*>(?:\s*>)*(.*)\z", 1)
    return F.when(chain != "", F.concat(F.regexp_extract(c, r"(?U)^(\s*)", 1), F.regexp_replace(chain, "[^>]", ""), rest)).otherwise(c)


def list_marker(c: Column) -> Column:
    """13"""
    return F.regexp_replace(c, r"(?Ud)^(\s*)([-*+]|\d+\.)\s+(.*)\z", "$1$2 $3")


def inline_math(c: Column) -> Column:
    """21 in a line: both kinds are trimmed; what looks like amounts of money is not."""
    shown = splice(c, r"\$\$.*?\$\$", lambda hit, b, a, at: F.concat(F.lit("$$"), trim(F.regexp_replace(hit, r"^\$\$|\$\$\z", "")), F.lit("$$")))

    def one(hit: Column, before: Column, after: Column, at: Column) -> Column:
        body = F.regexp_replace(hit, r"^\$|\$\z", "")
        prose = body.rlike(r"[ \t]\z") & after.rlike(r"(?U)\S")
        money = trim(body).rlike(r"(?U)^[\d.,\s]+\z")
        return F.when(prose | money, hit).otherwise(F.concat(F.lit("$"), trim(body), F.lit("$")))

    return bind(shown, lambda x: splice(x, r"\$[^$]+?\$", one))


def typography(c: Column, em_dash: bool = True, guillemet: bool = True) -> Column:
    """24"""
    c = F.translate(c, "“”‘’", "\"\"''")
    c = F.replace(F.replace(c, F.lit("–"), F.lit("--")), F.lit("…"), F.lit("..."))
    c = F.replace(c, F.lit("—"), F.lit("---")) if em_dash else c
    return F.translate(c, "«»", '""') if guillemet else c


EMOJI = r":[a-zA-Z0-9_+-]+:"


def code_and_emoji(c: Column) -> Column:
    return F.concat(spans(c, CODE_SPAN), spans(c, EMOJI))


def strong_emphasis(c: Column) -> Column:
    """25, first pass: any balanced triple of markers becomes ``__*text*__``."""
    def one(hit: Column, before: Column, after: Column, at: Column, safe: Column) -> Column:
        opening, closing = F.left(hit, F.lit(3)), F.right(hit, F.lit(3))
        body = F.substring(hit, F.lit(4), F.length(hit) - 6)
        return F.when(inside(safe, at) | (closing != F.reverse(opening)), hit).otherwise(F.concat(F.lit("__*"), body, F.lit("*__")))

    return splice_outside(c, r"[_*]{3}.+?[_*]{3}", code_and_emoji(c), one)


def bold(c: Column) -> Column:
    """25, second pass: ``**text**`` becomes ``__text__``."""
    def one(hit: Column, before: Column, after: Column, at: Column, safe: Column) -> Column:
        third = F.substring(hit, 3, 1) == "*"
        keep = inside(safe, at) | (before == "*") | (third & (after == "*")) | (after == "_")
        return F.when(keep, hit).otherwise(F.concat(F.lit("__"), F.substring(hit, F.lit(3), F.length(hit) - 4), F.lit("__")))

    return splice_outside(c, r"\*\*.+?\*\*", code_and_emoji(c), one)


def italic(c: Column) -> Column:
    """25, third pass: ``_text_`` becomes ``*text*`` unless a word or ``_`` adjoins."""
    def one(hit: Column, before: Column, after: Column, at: Column, safe: Column) -> Column:
        keep = inside(safe, at) | before.rlike("[A-Za-z0-9_]") | after.rlike("[A-Za-z0-9_]")
        return F.when(keep, hit).otherwise(F.concat(F.lit("*"), F.substring(hit, F.lit(2), F.length(hit) - 2), F.lit("*")))

    return splice_outside(c, r"_[^_]+?_", code_and_emoji(c), one)


def bold_italic(c: Column) -> Column:
    """25"""
    return bind(strong_emphasis(c), lambda x: bind(bold(x), italic))


def reversed_emphasis(c: Column) -> Column:
    """25 the other way round: bold is ``**``, italic is ``_``, both is ``_**text**_``."""
    def both(x: Column) -> Column:
        def one(hit: Column, before: Column, after: Column, at: Column, safe: Column) -> Column:
            balanced = F.right(hit, F.lit(3)) == F.reverse(F.left(hit, F.lit(3)))
            return F.when(inside(safe, at) | ~balanced, hit).otherwise(F.concat(F.lit("_**"), F.substring(hit, F.lit(4), F.length(hit) - 6), F.lit("**_")))

        return splice_outside(x, r"[_*]{3}.+?[_*]{3}", code_and_emoji(x), one)

    def strong(x: Column) -> Column:
        def one(hit: Column, before: Column, after: Column, at: Column, safe: Column) -> Column:
            keep = inside(safe, at) | before.rlike("[A-Za-z0-9_]") | after.rlike("[A-Za-z0-9_]")
            return F.when(keep, hit).otherwise(F.concat(F.lit("**"), F.substring(hit, F.lit(3), F.length(hit) - 4), F.lit("**")))

        return splice_outside(x, r"__[^_]+?__", code_and_emoji(x), one)

    def light(x: Column) -> Column:
        def one(hit: Column, before: Column, after: Column, at: Column, safe: Column) -> Column:
            keep = inside(safe, at) | (before == "*") | (after == "*")
            return F.when(keep, hit).otherwise(F.concat(F.lit("_"), F.substring(hit, F.lit(2), F.length(hit) - 2), F.lit("_")))

        return splice_outside(x, r"\*[^*]+?\*", code_and_emoji(x), one)

    return bind(both(c), lambda x: bind(strong(x), light))


def liquid_tags(c: Column) -> Column:
    """31: one space inside a tag's marks, outside code spans."""
    def one(hit: Column, before: Column, after: Column, at: Column, safe: Column) -> Column:
        opening, closing = F.regexp_extract(hit, r"^(\{%-?)", 1), F.regexp_extract(hit, r"^\{%-?.*?(-?%\})\z", 1)
        body = trim(F.regexp_extract(hit, r"(?d)^\{%-?(.*?)-?%\}\z", 1))
        return F.when(inside(safe, at), hit).when(body == "", F.concat(opening, F.lit(" "), closing)).otherwise(F.concat(opening, F.lit(" "), body, F.lit(" "), closing))

    return splice_outside(c, r"\{%-?.*?-?%\}", spans(c, CODE_SPAN), one)
