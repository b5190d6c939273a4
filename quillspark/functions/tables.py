"""Functions that SQL can call in FROM."""

from __future__ import annotations

import re

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

FENCE = re.compile(r"\s*(`{3}|~{3})")
KINDS = (
    ("head", re.compile(r"\s*#+(\s+\S|[^\s#])")),
    ("rule", re.compile(r"\s*[-*_]{3,}\s*\Z")),
    ("keep", re.compile(r"\s*\[[^\]]*\]:|\s*#|.*\|", re.DOTALL)),
    ("list", re.compile(r"\s*([-*+]|\d+\.)(\s|\Z)")),
    ("quote", re.compile(r"\s*>")),
    ("blank", re.compile(r"\s*\Z")),
)


def line_kinds(text: str | None) -> list[tuple[int, str, str]]:
    """``(n, kind, l)`` of every line: front, fence, code, math, table, head, rule, keep, list,
    quote, blank or para.  A null text has no lines."""
    lines = (text or "").split("\n")
    lines = lines[:-1] if lines[-1] == "" else lines
    marks = [l.strip() for l in lines]
    front = 0
    if marks and marks[0] == "---":
        front = next((n + 1 for n, m in enumerate(marks) if n and m in ("---", "...")), len(lines))
    state: list[str | None] = ["front"] * front
    code = math = False
    for l, m in zip(lines[front:], marks[front:], strict=True):
        if FENCE.match(l):
            code = not code
            state.append("fence")
        elif code:
            state.append("code")
        elif m == "$$":
            math = not math
            state.append("math")
        else:
            state.append("math" if math else None)
    piped = [s is None and "|" in l for s, l in zip(state, lines, strict=True)] + [False]
    out = []
    for n, (l, s) in enumerate(zip(lines, state, strict=True)):
        if s is None and piped[n] and (piped[n + 1] or (n > 0 and piped[n - 1])):
            s = "table"
        out.append((n, s or next((kind for kind, p in KINDS if p.match(l)), "para"), l))
    return out


@udtf(returnType="n int, kind string, l string")
class MdLines:
    def eval(self, text: str):
        yield from line_kinds(text)


def register(spark: SparkSession) -> None:
    """``SELECT d.doc_id, x.* FROM documents d, LATERAL md_lines(d.text) x``"""
    spark.udtf.register("md_lines", MdLines)
