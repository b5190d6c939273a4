"""Corpus operators on odd rows against plain versions, hot keys and very long texts."""

import hashlib
import math
import random
import re
import time
import zlib
from collections import defaultdict

import numpy as np
import pyarrow.parquet as pq
import pytest

P = pytest.importorskip("public_tokenizers")
DATA = "/root/testdata/sf0.001"


def weird_rows(weird):
    t = pq.read_table(f"{weird}/documents.parquet").to_pydict()
    return list(zip(t["doc_id"], t["text"], strict=True))


def tiktoken_of(pattern):
    import base64

    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


# ---------------------------------------------------------------- 1 and 3


def test_token_store_odd_rows(spark, weird):
    from tokenizers import Tokenizer

    from quillspark.llm.token_store import op1_token_store

    tok = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    tok.encode_special_tokens = True
    want = sorted(((i, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())) for i, t in weird_rows(weird) for ids in [tok.encode(t or "", add_special_tokens=False).ids + [2]]), key=repr)
    got = op1_token_store(spark, weird).collect()
    assert sorted(((r.doc_id, r.n_tokens, r.ids_crc32) for r in got), key=repr) == want
    got.sort(key=lambda r: r.start)
    assert [r.start for r in got] == [sum(r.n_tokens for r in got[:k]) for k in range(len(got))]
    ids = [r.doc_id for r in got]
    assert ids == sorted(ids, key=lambda i: (i is not None, i or 0))


def test_tokenizers_of_other_settings(spark, tmp_path):
    """A normalizer, a prefix space, an added word: such texts are encoded whole."""
    from tokenizers import AddedToken, Tokenizer, normalizers, pre_tokenizers

    from quillspark.llm.token_store import encode_corpus, read_store

    texts = ["Hello World", "two  words\nThe END.", " lead", "", "see [X] here [X]"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for k in range(3):
        tok = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
        if k == 0:
            tok.normalizer = normalizers.Lowercase()
        elif k == 1:
            tok.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=True)
        else:
            tok.add_tokens([AddedToken(" words", normalized=False)])
        tok.save(str(tmp_path / f"{k}.json"))
        encode_corpus(df, str(tmp_path / f"{k}.json"), None, str(tmp_path / f"store{k}"))
        got = {r.doc_id: r.ids for r in read_store(spark, str(tmp_path / f"store{k}"), emit_ids=True).collect()}
        assert got == {i: tok.encode(t, add_special_tokens=False).ids for i, t in enumerate(texts)}


def test_bpe_odd_rows_and_other_patterns(spark, weird):
    from quillspark.llm.bpe import decode, encode, op3_byte_bpe

    tok = tiktoken_of(P.PATTERN)
    want = []
    for i, t in weird_rows(weird):
        ids = np.array(tok.encode_ordinary(t or ""), "<u4")
        want.append((i, len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert sorted(map(tuple, op3_byte_bpe(spark, weird).collect()), key=repr) == sorted(want, key=repr)
    texts = ["Hello World a1b2", " x  y\n\nz", "12345 678", ""]
    path = P.path("byte_bpe_50k.tiktoken")
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for pattern in (r"[a-z]+|[^a-z]+", r"\S+ \S+|\s|\S+"):
        own = tiktoken_of(pattern)
        for r in decode(encode(df, path, pattern), path, pattern).collect():
            assert np.frombuffer(r.ids, "<u4").tolist() == own.encode_ordinary(texts[r.doc_id]) and bytes(r.decoded).decode() == texts[r.doc_id]


# ----------------------------------------------------------------------- 2


def test_line_rules():
    from quillspark.llm.quality import line_verdict, opening_pattern

    opening = opening_pattern()
    verdict = lambda l: line_verdict(l.encode(), opening, frozenset())[1]
    for line in ("Home|About|Contact|Login", "Home > Shop > Shoes > Red", "News · Sport · Weather · Jobs", "A • B • C • D", "Start » Eins » Zwei » Drei"):
        assert verdict(line) == "navigation", line
    for line in ("Released under the MIT License.", "© 2024 X", "(c) 2024 X. All rights reserved.", "  Copyright 2020"):
        assert verdict(line) == "boilerplate", line
    for line in (">>>> a quoted reply of a mail", "(c) the third point of a list", "a > b and c > d", "| a longer cell of a table here | another one of them here | and the last one of them |"):
        assert verdict(line) is None, line


@pytest.mark.parametrize("bound", [200_000, 0])
def test_repeated_lines(spark, monkeypatch, bound):
    """A notice in many places goes, a line that only copies share stays, by either way of look-up."""
    from quillspark.llm import quality

    monkeypatch.setattr(quality, "REPEATED", bound)
    rnd = random.Random(8)
    words = lambda n: " ".join(f"w{rnd.randrange(10**6)}" for _ in range(n))
    copied = f"{words(40)}\nA line of copies.\n{words(40)}"
    rows = [(k, f"{words(30)}\nBuilt with  care by us.\n{words(30)}") for k in range(30)] + [(100 + k, copied) for k in range(40)]
    rows += [(200, "\n".join(["Built with care by us."] * 20 + [words(45)])), (None, None)]
    got = {r.doc_id: r for r in quality.clean(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[k].n_removed_lines == 1 and got[k].kept and "care" not in got[k].cleaned for k in range(30))
    assert all(got[100 + k].n_removed_lines == 0 for k in range(40)) and got[200].n_removed_lines == 20 and got[None].cleaned == ""


# ----------------------------------------------------------------------- 4


def plain_find(rows):
    """Spans by the graph, in plain Python."""
    from quillspark.llm import pii

    seen = []
    for k, (_, text) in enumerate(rows):
        text = text or ""
        base = pii.base_spans(text)
        for part, seed in ((base, True), (pii.candidates(text, base), False)):
            for kind, s, e in part:
                before = [re.sub("[0-9]", "#", w) for w in re.findall(r"[^\W_]+", text[:s].lower())]
                pats = [" ".join(before[-n:]) for n in (2, 3) if len(before) >= n]
                seen.append((k, kind, s, e, pii.value_of(kind, text[s:e]), seed, not seed and pii.is_other(kind, text[s:e]), pats))
    edges = defaultdict(dict)
    for _, kind, _, _, value, seed, other, pats in seen:
        for p in pats:
            was = edges[kind, p].get(value, (False, True))
            edges[kind, p][value] = (was[0] or seed, was[1] and other)
    worth = {(key, v): float(seed) for key, vs in edges.items() for v, (seed, _) in vs.items()}
    for _ in range(pii.ROUNDS):
        score = {}
        for key, vs in edges.items():
            good = [worth[key, v] for v in vs if worth[key, v] >= pii.INSTANCE_BAR]
            bad = sum(o for _, o in vs.values())
            p = round(sum(good) / (sum(good) + bad + pii.PRIOR), 9)
            if len(good) >= pii.MIN_SEEDS and p >= pii.PATTERN_BAR and len(vs) > sum(s for s, _ in vs.values()):
                score[key] = p
        miss = defaultdict(float)
        for key, vs in edges.items():
            for v, (seed, other) in vs.items():
                if key in score and not seed and not other:
                    miss[key[0], v] += math.log1p(-min(score[key], 1 - 1e-9))
        for (key, v) in worth:
            seed, other = edges[key][v]
            worth[key, v] = 1.0 if seed else 0.0 if other else round(1 - math.exp(miss[key[0], v]), 9) if (key[0], v) in miss else 0.0
    best = defaultdict(float)
    for (key, v), w in worth.items():
        if not edges[key][v][0]:
            best[key[0], v] = max(best[key[0], v], w)
    out = []
    for k, (doc, _) in enumerate(rows):
        mine = [(kind, s, e) for r, kind, s, e, v, seed, other, _ in seen if r == k and (seed or (not other and best[kind, v] >= pii.INSTANCE_BAR))]
        out.append((doc, sorted(mine)))
    return out


def test_graph_equals_plain_version(spark, weird):
    from quillspark.llm.pii import find

    rnd = random.Random(9)
    say = ["my phone is", "call me at", "ring the number", "we met on", "x" * 300 + " long word", "mail me at"]
    things = [lambda: f"+1 (555) 555-{rnd.randrange(1000, 1040)}", lambda: f"555-867-{rnd.randrange(1000, 1030)}", lambda: f"2021-03-{rnd.randrange(10, 28)}", lambda: f"a{rnd.randrange(9)}@b.org", lambda: f"c{rnd.randrange(9)} at d dot org", lambda: "order 12"]
    rows = [(rnd.choice([None, 1, 2, k]), "Well, " + " and then ".join(f"{rnd.choice(say)} {rnd.choice(things)()}" for _ in range(rnd.randint(0, 4)))) for k in range(250)]
    rows += weird_rows(weird)
    got = [(r.doc_id, [tuple(s) for s in r.spans]) for r in find(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    want = plain_find(rows)
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert sum(len(s) for _, s in want) > sum(len(re.findall(r"\+1|@", t or "")) for _, t in rows)


# ----------------------------------------------------------------------- 5


def plain_score(text, model):
    bias, weight = model
    clean = 1.0
    found = False
    for part in re.split(r"[.!?\n]", (text or "").lower()):
        words = set(re.sub(r"[\x00-\x7f]", lambda m: m[0] if m[0].isalnum() or m[0] == "'" else " ", part).split())
        if words:
            found = True
            z = bias + sum(weight.get(f, 0.0) for w in words for f in [w, *(f"{w[:n]}*" for n in (4, 6) if len(w) >= n)])
            clean *= 1 - 1 / (1 + math.exp(-max(-30, min(30, z))))
    return 1 - clean if found else 1 / (1 + math.exp(-bias))


def test_toxicity_equals_plain_scores_and_holds_out(spark):
    """The whole query, re-scored plainly; its accuracy on labels that training never saw."""
    from quillspark.llm.toxicity import op5_toxicity, train

    folder = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    got = {r.doc_id: r for r in op5_toxicity(spark, folder).collect()}
    model = train(docs, labels)
    rows = docs.filter("doc_id % 20 = 0").select("doc_id", "text").collect()
    assert all(abs(got[r.doc_id].score - plain_score(r.text, model)) < 1e-9 for r in rows)
    held = [(r.toxic, got[r.doc_id]) for r in labels.collect() if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert all(g.held_out and g.predicted == (g.score >= 0.5) for _, g in held)
    right = [y == g.predicted for y, g in held]
    toxic = [g.predicted for y, g in held if y]
    assert len(held) > 500 and np.mean(right) >= 0.97 and np.mean(toxic) >= 0.85


def test_toxicity_odd_rows(spark, weird):
    from quillspark.llm.toxicity import op5_toxicity, train

    docs = spark.read.parquet(f"{weird}/documents.parquet")
    model = train(docs, spark.read.parquet(f"{weird}/labels.parquet"))
    got = sorted(((r.doc_id, round(r.score, 9)) for r in op5_toxicity(spark, weird).collect()), key=repr)
    assert got == sorted(((i, round(plain_score(t, model), 9)) for i, t in weird_rows(weird)), key=repr)


# ----------------------------------------------------------------------- 6


def test_secret_scan_is_linear(spark):
    from quillspark.llm.secrets import scan

    texts = ["1A-" * 100_000, "0123456789abcdef " * 100_000, "g1" * 150_000 + "-", "token=" * 50_000, "a1b2c3d4e5f6a7b8 qWmZxKvBnTyHgRfDpLsJcUeAoI/+VbNk " * 10_000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5, "doc_id")
    began = time.time()
    got = {r.doc_id: r.found for r in scan(df).collect()}
    assert time.time() - began < 90
    assert not got[0] and len(got[1]) == 100_000 and not got[2] and len(got[4]) == 20_000
    assert [tuple(s)[:3] for s in got[1][99_999:]] == [(99_999 * 17, 2, 99_999 * 17 + 16)]


def test_candidates_apart_from_base_spans(spark):
    from quillspark.llm.secrets import scan

    key, hexes = "qWmZxKvBnTyHgRfDpLsJcUeAoI1+VbNk", "0123456789abcdef"
    text = f"{key} {hexes} x{key}/{hexes}x token={key} {key}"
    (row,) = scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    at = [m.start() for m in re.finditer(re.escape(key), text)]
    base = [s for s in row.base]
    assert [s.kind for s in base] == [2, 2, 0]
    # the second stands in one run with a hex span, the third in an assignment
    assert [s.start for s in row.found if s.kind == 3] == [at[0], at[3]]


# ----------------------------------------------------------------------- 8


def test_hot_signatures_and_hubs(spark, monkeypatch):
    """Buckets and hubs by their other way: the same result."""
    from quillspark.llm import components, jaccard
    from quillspark.llm.jaccard import near_duplicates

    rnd = random.Random(11)
    base = [f"w{k}" for k in range(60)]
    texts = []
    for k in range(60):
        t = list(base)
        t[rnd.randrange(60)] = f"x{k}"
        texts.append(" ".join(t))
    texts += [" ".join(f"u{k}_{j}" for j in range(30)) for k in range(20)] + texts[:5]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    plain = sorted(map(tuple, near_duplicates(df).collect()))
    monkeypatch.setattr(jaccard, "SHARE", 1)
    monkeypatch.setattr(jaccard, "HOT", 3)
    monkeypatch.setattr(components, "HUB", 3)
    assert sorted(map(tuple, near_duplicates(df).collect())) == plain
    sets = [{tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)} for t in texts]
    links = [sum(j != i and 100 * len(a & b) >= 80 * len(a | b) for j, b in enumerate(sets)) for i, a in enumerate(sets)]
    assert [r[3] for r in plain] == links


def test_representatives_go_by_rows(spark):
    from quillspark.llm.jaccard import representatives

    a = " ".join(f"a{k}" for k in range(50))
    z = " ".join(f"z{k}" for k in range(50))
    rows = [(1, a), (5, a + " more"), (5, z), (None, a), (7, z), (8, ""), (8, ""), (9, None), (9, None), (3, "One two"), (2, "one two"), (2, "one two")]
    df = spark.createDataFrame([(i, t, "x", k) for k, (i, t) in enumerate(rows)], "doc_id long, text string, row string, stays int")
    got = sorted(((r.doc_id, r.text) for r in representatives(df).collect()), key=repr)
    assert got == sorted([(1, a), (5, z), (8, ""), (8, ""), (9, None), (9, None), (2, "one two")], key=repr)
    assert representatives(df).columns == df.columns and representatives(df.limit(0)).count() == 0


# ----------------------------------------------------------------------- 9


def test_index_of_many_cells(spark):
    """Codebooks of 16 and more: recall over the queries, counts never above the truth."""
    from quillspark.llm import vectors

    seen = []
    fit = vectors.fit
    rng = np.random.default_rng(12)
    base = rng.standard_normal((3000, 24))
    rows = np.concatenate([base, base[:900] + 0.15 * rng.standard_normal((900, 24)) / math.sqrt(24) * 5 * 0.9, np.repeat(base[:1], 40, 0), base[1] + 0.02 * rng.standard_normal((300, 24))]).astype(np.float32)
    labels = np.concatenate([np.arange(3000) % 3, np.arange(900) % 3, [0] * 40, [1] * 300])
    df = spark.createDataFrame([(k, v.tolist(), int(y)) for k, (v, y) in enumerate(zip(rows, labels, strict=True))], "vec_id long, embedding array<float>, label int")
    x = rows.astype(np.float64)
    x /= np.sqrt((x * x).sum(1))[:, None]
    link = (x @ x.T >= 0.98) & (labels[:, None] == labels)
    np.fill_diagonal(link, False)
    vectors.fit = lambda *a: seen.append(fit(*a)) or seen[-1]
    try:
        for block in (4096, 64):
            got = sorted(vectors.near_duplicates(df, per_cell=4, block=block).collect())
            n = np.array([r.n_links for r in got])
            q = np.arange(len(rows)) % 50 == 0
            assert (n <= link.sum(1)).all() and n[q].sum() >= 0.9 * link[q].sum() and n.sum() >= 0.95 * link.sum()
            assert all(len(b) >= 16 for index in seen[-1].values() for b in index.books)
            assert any(index.visits < len(index.books[0]) * len(index.books[1]) / 2 for index in seen[-1].values())
    finally:
        vectors.fit = fit


def test_vectors_with_clashing_columns(spark):
    from quillspark.llm.vectors import near_duplicates

    df = spark.createDataFrame([(1, [1.0, 0.0], 0, 9, "k"), (2, [2.0, 0.0], 0, 9, "k"), (None, [1.0, 0.0], 0, 9, "k")], "vec_id long, embedding array<double>, label int, node int, key string")
    got = sorted(map(tuple, near_duplicates(df).collect()), key=repr)
    assert got == sorted([(1, 2, 1, True), (2, 2, 1, False), (None, 2, 1, False)], key=repr)


# ---------------------------------------------------------------------- 10


def test_rare_grams_meet_the_rest_of_the_model(spark, monkeypatch):
    from quillspark.llm import urls

    rows = [(k, f"http://h{k % 7}.{'com' if k % 2 else 'net/es'}/p{k}") for k in range(60)] + [(100 + k, f"http://h{k}.org/es/p{k}") for k in range(20)]
    df = spark.createDataFrame([(k, u, "x", 1.0) for k, u in rows], "page_id long, url string, row string, score double")
    whole = sorted((r.page_id, r.verdict, r.score) for r in urls.judge(df).collect())
    monkeypatch.setattr(urls, "BROADCAST", 10)
    parts = sorted((r.page_id, r.verdict, r.score) for r in urls.judge(df).collect())
    assert [r[:2] for r in whole] == [r[:2] for r in parts]
    assert all(abs(a[2] - b[2]) < 1e-8 for a, b in zip(whole, parts, strict=True))


# ------------------------------------------------------------- the pipeline


def test_pipeline_odd_rows(spark, weird, empty):
    """Every stage on nulls, repeated ids, columns of clashing names and empty tables."""
    import corpus_pipeline as cp

    docs = spark.read.parquet(f"{weird}/documents.parquet").selectExpr("*", "1 AS `_row`", "2 AS row", "3 AS base", "4 AS _carry", "5 AS copies", "6 AS tox", "7 AS row_key")
    rows = {(r.doc_id, r.text) for r in docs.collect()}
    toxic, near, private, mixed, coded = (f for _, f in cp.STAGES)
    for stage in (toxic, near, private, mixed):
        out = stage(spark, docs, weird)
        assert out.columns == docs.columns and {(r.doc_id, r.text) for r in out.collect()} <= rows
    # without labels nothing is known to be toxic
    assert toxic(spark, docs, empty).count() == private(spark, docs, weird).count() == coded(spark, docs, weird).count() == docs.count()
    left = near(spark, docs, weird).collect()
    same = "The same text twice over here now."
    assert [(r.doc_id, r.text) for r in left if r.text == same] == [(4, same)] and len(left) == docs.count() - 1
    nothing = spark.read.parquet(f"{empty}/documents.parquet")
    for _, stage in cp.STAGES:
        out = stage(spark, nothing, empty)
        assert out.count() == 0 and out.columns
    assert cp.run(spark, empty).count() == 0
