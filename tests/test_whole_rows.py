"""Registered queries take every row of their tables: wrapping by brute force."""

import re

import pytest

from quillspark.plans.queries import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"
SOURCES = {"r14_wrap": ("benchmark", "item_id"), "r14_wrap_documents": ("documents", "doc_id")}


def tokens(text):
    """Words; a closed code span or a bracketed text with its target is one, an open bracket takes the rest."""
    out, i = [], 0
    while i < len(text):
        if text[i].isspace():
            i += 1
            continue
        start = i
        if text[i] == "`":
            ticks = len(re.match("`+", text[i:])[0])
            close = next((m for m in re.finditer("`+", text[i + ticks :]) if len(m[0]) == ticks), None)
            if close:
                i += ticks + close.end()
                out.append(text[start:i])
                continue
        if text[i] == "[":
            depth = 0
            while i < len(text):
                depth += {"[": 1, "]": -1}.get(text[i], 0)
                i += 1
                if not depth:
                    break
            if i < len(text) and not depth and text[i] in "([":
                end = text.find({"(": ")", "[": "]"}[text[i]], i)
                i = len(text) if end < 0 else end + 1
            elif depth:
                out.append(text[start:])
                break
        while i < len(text) and not text[i].isspace():
            i += 1
        out.append(text[start:i])
    return out


def wrapped(text, width=60):
    if len(text) <= width:
        return [text]
    done, line = [], ""
    for word in tokens(text):
        if not line or len(line) + 1 + len(word) <= width:
            line = f"{line} {word}".lstrip(" ")
        elif re.match(r"\d+\.", word):
            rest, _, last = line.rpartition(" ")
            done += [rest.rstrip(" ")] if rest.strip(" ") else []
            line = f"{last} {word}"
        else:
            done.append(line)
            line = word
    return done + [line] if line or done else [text]


def cut(text):
    parts = text.split("\n")
    return parts[:-1] if parts[-1] == "" else parts


@pytest.mark.parametrize("name", sorted(SOURCES))
def test_wraps_every_line(spark, duck, name):
    table, key = SOURCES[name]
    got = sorted(map(tuple, QUERIES[name](spark, DATA).select("doc_id", "n", "k", "line").collect()))
    rows = duck.execute(f"SELECT {key}, text FROM {table} WHERE text IS NOT NULL").fetchall()
    assert got == sorted((i, n, k, x) for i, t in rows for n, l in enumerate(cut(t)) for k, x in enumerate(wrapped(l)))
    # the SQL wraps every line too
    assert got == sorted(duck.execute(f"SELECT doc_id, n, k, line FROM ({ORACLES[name]})").fetchall())


def test_wraps_guarded_lines(spark, tmp_path):
    """Numbers, code spans and links in a text of several lines."""
    import pyarrow as pa
    import pyarrow.parquet as pq

    long = "word " * 11 + "ends 3. not a list `a code span` and [a long link text](http://x.y/z) here"
    for table, key in SOURCES.values():
        pq.write_table(pa.table({key: [1], "text": [f"short\n{long}\n\nlast [open"]}), tmp_path / f"{table}.parquet")
    for name in SOURCES:
        got = sorted(tuple(r) for r in QUERIES[name](spark, str(tmp_path)).select("n", "k", "line").collect())
        assert got == [(n, k, x) for n, l in enumerate(["short", long, "", "last [open"]) for k, x in enumerate(wrapped(l))]
        assert not any(re.match(r"\d+\.", x) for *_, x in got)
