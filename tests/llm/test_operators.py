"""Plain versions and properties of the corpus operators."""

import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

P = pytest.importorskip("public_tokenizers")
DATA = "/root/testdata/sf0.001"


def strange_texts(n=3000):
    rnd = random.Random(0)
    parts = [" ", "\n", "a", "b", "'s", "1", "é", " ", "\t", " the", ".", "\x00", "\x1c", " ", "😀", "<|endoftext|>", "  ", "▁", "<unk>", "漢"]
    return ["".join(rnd.choices(parts, k=rnd.randint(0, 12))) for _ in range(n)]


def documents(spark, name="documents"):


    return spark.read.parquet(f"{DATA}/{name}.parquet")


# ------------------------------------------------------------ 1: token store


def test_token_store_equals_library(spark):
    from tokenizers import Tokenizer

    from quillspark.llm.token_store import op1_token_store

    tok = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    tok.encode_special_tokens = True
    rows = sorted(documents(spark).select("doc_id", "text").collect())
    ids = [e.ids + [2] for e in tok.encode_batch([r.text for r in rows], add_special_tokens=False)]
    start, want = 0, []
    for r, i in zip(rows, ids, strict=True):
        want.append((r.doc_id, start, len(i), zlib.crc32(np.array(i, "<u4").tobytes())))
        start += len(i)
    assert sorted(tuple(r) for r in op1_token_store(spark, DATA).collect()) == want


def test_chunked_encoding():
    from tokenizers import Tokenizer

    from quillspark.llm.token_store import ChunkEncoder

    tok = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    tok.encode_special_tokens = True
    texts = strange_texts()
    got = [np.frombuffer(x, "<u2").tolist() for x in ChunkEncoder(P.path("byte_bpe_50k.json")).encode(pa.array(texts, pa.string()))]
    assert got == [e.ids for e in tok.encode_batch(texts, add_special_tokens=False)]


@pytest.mark.parametrize("n", [1, 2, 3, 50, 40_000])
def test_codebook(n):
    from quillspark.llm.token_store import BLOCK, Codebook, code_lengths

    lengths = code_lengths({i: int(1.3 ** (i % 60)) + 1 for i in range(n)})
    assert sum(2.0**-b for b in lengths.values()) <= 1 and max(lengths.values()) <= 16
    book, ids = Codebook(lengths), np.random.default_rng(n).integers(0, n, 5000)
    payload, marks = book.pack(ids)
    counts = np.full(len(marks), BLOCK)
    counts[-1] = 5000 - BLOCK * (len(marks) - 1)
    assert (book.unpack(payload, marks, counts) == ids).all()
    part = slice(3, 5)  # blocks decode alone
    assert (book.unpack(payload, marks[part], counts[part]) == ids[3 * BLOCK : 5 * BLOCK]).all()


def test_code_lengths_are_optimal():
    from quillspark.llm.token_store import code_lengths

    # Fibonacci weights need 9 bits without a limit; the best code within 5 is known by search over lengths
    weights = [1, 1, 2, 3, 5, 8, 13, 21, 34, 55]
    got = code_lengths(dict(enumerate(weights)), max_bits=5)
    import itertools

    best = min(sum(w * b for w, b in zip(sorted(weights), sorted(c, reverse=True), strict=True)) for c in itertools.combinations_with_replacement(range(1, 6), 10) if sum(2.0**-b for b in c) <= 1)
    assert sum(w * got[i] for i, w in enumerate(weights)) == best


# -------------------------------------------------------------- 3: byte BPE


def test_bpe_equals_library():
    import base64

    import tiktoken

    from quillspark.llm.bpe import BpeEncoder, read_ranks

    path = P.path("byte_bpe_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    tok = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = strange_texts() + ["a" * 20_000, "ab " * 3000]
    vocab = read_ranks(path)
    for text, raw in zip(texts, BpeEncoder(path, P.PATTERN).encode(pa.array(texts, pa.string())), strict=True):
        ids = np.frombuffer(raw, "<u4").tolist()
        assert ids == tok.encode_ordinary(text)
        assert b"".join(vocab[i] for i in ids) == text.encode()


def test_bpe_query_digests(spark):
    from quillspark.llm.bpe import op3_byte_bpe

    got = {r.doc_id: r for r in op3_byte_bpe(spark, DATA).collect()}
    for r in documents(spark).collect():
        assert got[r.doc_id].decoded_sha256 == hashlib.sha256(r.text.encode()).hexdigest()


# ------------------------------------------------------------------- 4: PII

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP4 = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def plain_pii(text):
    from quillspark.llm.pii import luhn

    digits = lambda m: re.sub("[^0-9]", "", m[0])
    out = [(0, *m.span()) for m in EMAIL.finditer(text)]
    out += [(1, *m.span()) for m in IP4.finditer(text) if all(int(x) <= 255 for x in m[0].split("."))]
    out += [(2, *m.span()) for m in CARD.finditer(text) if 13 <= len(digits(m)) <= 19 and luhn(digits(m))]
    return out + [(3, *m.span()) for m in PHONE.finditer(text) if 9 <= len(digits(m)) <= 15]


def test_base_spans():
    from quillspark.llm.pii import base_spans

    rnd = random.Random(1)
    parts = ["@", ".", "1", "0", "4111111111111111", "a", "b-", "+", "+1 (555) 555-1234", " ", "-", "é", "x@y.z", "1.2.3.4", "%", "\n"]
    for _ in range(8000):
        text = "".join(rnd.choices(parts, k=rnd.randint(0, 14)))
        assert base_spans(text) == plain_pii(text), text


def test_contexts_discover(spark):
    from quillspark.llm.pii import find, redact

    rnd = random.Random(1)
    say = ["my phone number is", "please call me at", "reach the office on"]
    rows = [(i, f"Hello friend {rnd.choice(say)} +1 (555) 555-{1000 + i} thanks") for i in range(30)]
    rows += [(100 + i, f"Well {c} 555-867-53{i}9 now") for i, c in enumerate(say)] + [(200, "order number 555-867-5999 shipped"), (201, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.doc_id: r.spans for r in find(df).collect()}
    assert all(len(found[100 + i]) == 1 and found[100 + i][0].kind == 3 for i in range(3))
    assert not found[200] and not found[201]
    assert redact(df.filter("doc_id < 100 OR doc_id = 201")).filter("doc_id = 1").first().text.endswith("[PHONE] thanks")


# ------------------------------------------------------------- 5: toxicity


def test_toxicity_held_out(spark):
    """Held-out accuracy and located sentences, on made-up labels."""
    from quillspark.llm.toxicity import WordWeights, fit, offending, sentences, sigmoid

    rnd = random.Random(2)
    words = [a + b for a in "ba de ki lo mu ne po ra si tu".split() for b in "n rt st l mm".split()]

    def text(toxic):
        cut = [" ".join(rnd.choices(words, k=8)) for _ in range(rnd.randint(2, 9))]
        if toxic:
            k = rnd.randrange(len(cut))
            cut[k] = f"you {rnd.choice(['vile', 'rotten', 'nasty'])} {cut[k]}"
        return ". ".join(cut) + "."

    labels = [k % 5 == 0 for k in range(600)]
    texts = [text(t) for t in labels]
    bias, weight = fit(texts[:400], list(map(int, labels[:400])), [1.0] * 400)
    adds = WordWeights(weight)
    score = [1 - np.prod(1 - sigmoid(np.array([bias + sum(map(adds.__getitem__, s)) for s in sentences(t)]))) for t in texts[400:]]
    assert np.mean((np.array(score) >= 0.5) == np.array(labels[400:])) > 0.98
    bad = next(t for t, y in zip(texts, labels, strict=True) if y)
    (hit,) = offending(bad, bias, adds)
    assert "you " in bad[hit["start"] : hit["end"]]


def test_toxicity_query(spark):
    from quillspark.llm.toxicity import op5_toxicity

    got = {r.doc_id: r for r in op5_toxicity(spark, DATA).collect()}
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r.score <= 1 for i, r in got.items())
    toxic = [(r.toxic, got[r.doc_id].predicted) for r in documents(spark, "labels").collect() if not got[r.doc_id].held_out]
    assert np.mean([a == b for a, b in toxic]) > 0.95


# -------------------------------------------------------------- 6: secrets


def test_peak_entropy(spark):
    import math

    from pyspark.sql import functions as F

    from quillspark.llm.secrets import ALPHABET, WINDOW, peak_entropy

    rnd = random.Random(3)
    texts = ["".join(rnd.choices(ALPHABET[: rnd.choice([2, 16, 65])], k=rnd.randint(20, 60))) for _ in range(60)]

    def plain(t):
        at = (t[k : k + WINDOW] for k in range(len(t) - WINDOW + 1))
        return max(-sum(w.count(c) / WINDOW * math.log2(w.count(c) / WINDOW) for c in set(w)) for w in at)

    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for r in df.select("t", peak_entropy(F.col("t")).alias("h")).collect():
        assert abs(r.h - plain(r.t)) < 1e-8


# --------------------------------------------------------------- 7: mixing


def plain_targets(sizes, weights=(5, 2, 1), cap=3):
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    w = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    left, got, open_ = sum(sizes.values()), {}, set(names)
    while open_:
        total = sum(w[s] for s in open_)
        over = {s for s in open_ if left * w[s] / total > cap * sizes[s]}
        if not over:
            return got | {s: left * w[s] / total for s in open_}
        for s in over:
            got[s] = cap * sizes[s]
            left -= got[s]
        open_ -= over
    return got


def test_targets(spark):
    from quillspark.llm.mixing import targets

    for sizes in ({"a": 10, "b": 1000, None: 3, "c": 7}, {"a": 5}, {"a": 0, "b": 0}, {"b": 1, "a": 1, "c": 1, "d": 500}):
        df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
        got = {r.source: r.target for r in targets(df).collect()}
        assert got == pytest.approx(plain_targets(sizes))


def test_mix_is_near_targets_and_repeats(spark):
    from quillspark.llm.mixing import mix

    df = spark.range(3000).selectExpr("id AS doc_id", "repeat('w ', cast(id % 50 AS int)) AS text", "CASE WHEN id % 3 = 0 THEN 'hot' ELSE concat('s', id % 7) END AS source")
    a, b = (sorted(tuple(r) for r in mix(df).collect()) for _ in range(2))
    assert a == b and all(c <= 3 for *_, c in a)
    taken, target = {}, {}
    for _, source, size, _, t, copies in a:
        taken[source] = taken.get(source, 0) + size * copies
        target[source] = t
    assert all(abs(taken[s] - target[s]) <= 100 for s in taken)


# ---------------------------------------------------------- 8: Jaccard join


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text.translate({c: c + 32 for c in range(65, 91)}))
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def test_jaccard_families(spark):
    """Chains, copies, short texts, a large family: links and components as by brute force."""
    from quillspark.llm.jaccard import near_duplicates

    rnd = random.Random(4)
    texts = []
    for size in (3, 5, 6, 8, 12, 30, 90, 300):
        base = [f"w{rnd.randrange(10**6)}" for _ in range(size)]
        for _ in range(14):
            t = list(base)
            for _ in range(rnd.randint(0, 2 + size // 60)):
                k = rnd.randrange(len(t))
                t[k : k + 1] = rnd.choice([[], [f"x{rnd.randrange(99)}"], [t[k], "y"]])
            texts.append(" ".join(t))
    common = " ".join(f"c{k}" for k in range(40))
    texts += [common + " " + " ".join(f"u{i}_{k}" for k in range(30)) for i in range(40)] + ["", " ", "One two", "one TWO"] + texts[:5]
    rnd.shuffle(texts)
    sets = [shingles(t) for t in texts]
    link = [[j for j, b in enumerate(sets) if j != i and a and b and 100 * len(a & b) >= 80 * len(a | b)] for i, a in enumerate(sets)]
    comp = list(range(len(texts)))
    for _ in texts:
        comp = [min([comp[i], *(comp[j] for j in link[i])]) for i in range(len(texts))]
    got = sorted(tuple(r) for r in near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect())
    assert got == [(i, len(sets[i]), comp[i], len(link[i])) for i in range(len(texts))]


def test_set_signatures_meet():
    """Any two linked sets share a signature of the segments that the larger may be allotted."""
    from quillspark.llm.jaccard import PLANS, allotment, roles, set_signatures

    rng = np.random.default_rng(5)
    for _ in range(400):
        n = int(rng.integers(1, 60))
        x = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))
        drop = int(rng.integers(0, max(1, len(x) // 5 + 1)))
        y = np.sort(rng.permutation(x)[: len(x) - drop])
        if not len(y) or 100 * len(y) < 80 * len(x):
            continue
        bands = {b: need for b, _, need in roles(len(x))}
        own = roles(len(y))[0][0]
        assert own in bands
        for p in range(len(PLANS)):
            if allotment(x, own, p, 0) >= bands[own]:
                assert set(set_signatures(x, own, False, p, 0)[0]) & set(set_signatures(y, own, True, p, 0)[0])


# ------------------------------------------------------------- 9: vectors


def test_vectors_recall(spark):
    from quillspark.llm.vectors import near_duplicates

    rng = np.random.default_rng(6)
    base = rng.standard_normal((300, 16))
    rows = np.concatenate([base, base[:80] + 0.03 * rng.standard_normal((80, 16)), np.repeat(base[:1], 20, 0), base[1] + 0.02 * rng.standard_normal((60, 16))])
    labels = [k % 2 for k in range(300)] + [k % 2 for k in range(80)] + [0] * 20 + [1] * 60
    df = spark.createDataFrame([(k, v.tolist(), lab) for k, (v, lab) in enumerate(zip(rows, labels, strict=True))], "vec_id long, embedding array<double>, label int")
    unit = rows / np.linalg.norm(rows, axis=1)[:, None]
    want = ((unit @ unit.T >= 0.98) & (np.array(labels)[:, None] == np.array(labels))).sum(1) - 1
    got = np.array([r.n_links for r in sorted(near_duplicates(df).collect())])
    assert (got <= want).all() and got.sum() >= 0.97 * want.sum()


def test_components(spark):
    from quillspark.llm.components import connected_components

    rnd = random.Random(7)
    edges = [(k, k + 1) for k in range(300)] + [(1000, k) for k in range(1001, 1400)] + [(rnd.randrange(2000, 2300), rnd.randrange(2000, 2300)) for _ in range(150)]
    want = {n: n for e in edges for n in e}
    for _ in range(400):
        for a, b in edges:
            want[a] = want[b] = min(want[a], want[b])
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {n: c for n, c in want.items() if n != c}


# -------------------------------------------------------------- 10: URLs


def test_url_rules(spark):
    from pyspark.sql import functions as F

    from quillspark.llm.urls import grams_of, host_of, judge, path_of

    urls = ["HTTP://WWW.Example.com/en/1?x", "http://example.com/en/", "http://a.example.com/de/", "http://b.net/es/x", "http://com", "nothing", None, "http://example.com.evil.org/en/"]
    df = spark.createDataFrame([(k, u) for k, u in enumerate(urls)], "page_id long, url string")
    rules = {r.page_id: r.rule for r in judge(df).collect()}
    assert [rules[k] for k in range(8)] == ["www.example.com/en/", "example.com/en/", "com/", "net/es/", None, None, None, None]
    assert df.select(host_of(F.col("url")), path_of(F.col("url"))).first()[:] == ("www.example.com", "/en/1")
    text = "é" * 1500
    assert len(spark.createDataFrame([(text,)], "t string").select(grams_of(F.col("t"), 4)).first()[0]) == 1501


# ------------------------------------------------------------ the pipeline


def test_pipeline_stages(spark):
    """Each stage does what its operator decides, on its predecessor's rows."""
    import corpus_pipeline as cp

    from quillspark.llm.common import stored
    from quillspark.llm.pii import base_spans
    from quillspark.llm.toxicity import op5_toxicity

    docs = documents(spark)
    step = {}
    for name, stage in cp.STAGES:
        docs = stored(stage(spark, docs, DATA), name)
        step[name] = docs.collect()
    toxic = {r.doc_id for r in op5_toxicity(spark, DATA).collect() if r.predicted}
    start = documents(spark).collect()
    assert {r.doc_id for r in step["toxicity"]} == {r.doc_id for r in start} - toxic
    sets = {r.doc_id: shingles(r.text) for r in step["toxicity"]}
    kept = {r.doc_id for r in step["near_join"]}
    for i, a in sets.items():
        near = [j for j, b in sets.items() if j != i and a and b and 100 * len(a & b) >= 80 * len(a | b)]
        if not near:
            assert i in kept
        elif i not in kept:  # another of its class stays, a smaller one
            reach, todo = {i}, [i]
            while todo:
                x = todo.pop()
                new = {j for j, b in sets.items() if j not in reach and b and 100 * len(sets[x] & b) >= 80 * len(sets[x] | b)}
                reach |= new
                todo += new
            assert min(reach) in kept and min(reach) < i
    ids = sorted(kept)
    assert not any(100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]) for k, a in enumerate(ids) for b in ids[:k] if sets[a] and sets[b] and abs(len(sets[a]) - len(sets[b])) < len(sets[a]))
    assert all(not base_spans(r.text) and r.n_chars == len(r.text) for r in step["personal_data"])
    assert {r.doc_id for r in step["personal_data"]} == kept
    assert len(step["mixing"]) == len(step["byte_bpe"])
    assert {hashlib.sha256(r.text.encode()).hexdigest() for r in step["mixing"]} == {r.decoded_sha256 for r in step["byte_bpe"]}
