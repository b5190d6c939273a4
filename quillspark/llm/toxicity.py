"""Toxicity by multiple-instance learning.

A document is a bag of sentences.  A linear model gives each sentence a probability; a
document is toxic if any of its sentences is, so its score is the noisy-or of theirs.  Only
document labels train it: the gradient of the noisy-or credits the sentences that explain a
label, and a soft threshold keeps few features.  The same model then points at the
offending sentences.  Features are a sentence's distinct words and their first four and six
characters, so that inflected and compound forms share what was learnt.

Training uses a bounded sample of labelled rows (``SAMPLE`` per label, by hash order, whole texts of
``SAMPLE_BYTES`` in all), each class weighted back to its share of all training labels.  Scoring
covers every row.
"""

from __future__ import annotations

import re
from array import array
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.llm.common import lean, table

#: The bound of the training sample: rows taken of label 1 and of label 0.
SAMPLE = (2000, 4000)
#: Rows beyond these bytes of text, in hash order, are not taken either.
SAMPLE_BYTES = 48_000_000
MIN_DOCS, MAX_FEATURES, STEPS, RATE, SPARSITY = 3, 50_000, 200, 0.1, 3e-4
#: ASCII only, so that it holds for UTF-8 bytes: sentence ends to line feeds, other marks to spaces.
MARKS = bytes(10 if chr(b) in ".!?\n" else 32 if b < 128 and not chr(b).isalnum() and chr(b) != "'" else b for b in range(256))
SENTENCE = re.compile(r"[^.!?\n]+")


def sentences(text: str) -> list[set[str]]:
    """Distinct lower-case words of each sentence that has any; else one empty sentence."""
    marked = text.lower().encode("utf-8", "surrogatepass").translate(MARKS).decode("utf-8", "surrogatepass")
    cut = [set(s.split()) for s in marked.split("\n")]
    return [s for s in cut if s] or [set()]


def features(word: str) -> list[str]:
    return [word, *(f"{word[:n]}*" for n in (4, 6) if len(word) >= n)]


class WordWeights(dict):
    """What a word adds to its sentence; remembered, up to a bound."""

    def __init__(self, weight: dict[str, float]):
        self.weight = weight

    def __missing__(self, word: str) -> float:
        if len(self) > 500_000:
            self.clear()
        self[word] = total = sum(self.weight.get(f, 0.0) for f in features(word))
        return total


def is_held_out(doc_id: Column) -> Column:
    """Rows that training never sees; a null doc_id counts as empty text and is one of them."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit(texts: list[str], labels: list[int], weights: list[float]) -> tuple[float, dict[str, float]]:
    """Bias and the features with a weight.  Without both labels: the prior alone."""
    y, v = np.array(labels, np.float64), np.array(weights, np.float64)
    prior = float(np.clip((v * y).sum() / v.sum(), 1e-4, 1 - 1e-4)) if len(y) else 1e-4
    if not len(y) or y.min() == y.max():
        return float(np.log(prior / (1 - prior))), {}
    # texts are cut again rather than kept cut: their words would fill the driver
    seen: Counter[str] = Counter()
    for t in texts:
        seen.update({f for w in set().union(*sentences(t)) for f in features(w)})
    words = sorted((w for w, n in seen.items() if n >= MIN_DOCS), key=lambda w: (-seen[w], w))[:MAX_FEATURES]
    del seen
    number = {w: k for k, w in enumerate(words)}
    docs, rows, cols = array("i"), array("i"), array("i")
    for d, t in enumerate(texts):
        for s in sentences(t):
            hit = [number[f] for w in s for f in features(w) if f in number]
            rows.extend([len(docs)] * len(hit))
            cols.extend(hit)
            docs.append(d)
    doc_of, rows, cols = (np.frombuffer(x, np.int32) if len(x) else np.zeros(0, np.int32) for x in (docs, rows, cols))
    n = len(doc_of)
    v = v / v.sum()
    w, b = np.zeros(len(words)), float(np.log(prior / (1 - prior)) - np.log(max(1.0, n / len(texts))))
    m1, m2, c1, c2 = np.zeros(len(words)), np.zeros(len(words)), 0.0, 0.0
    for t in range(1, STEPS + 1):
        p = sigmoid(b + np.bincount(rows, w[cols], n))
        clean = np.exp(np.bincount(doc_of, np.log1p(-np.minimum(p, 1 - 1e-12)), len(texts)))
        # d(log-likelihood)/dz of a sentence: -p if the label is 0, p * clean / (1 - clean) if 1
        pull = np.where(y > 0, clean / np.maximum(1 - clean, 1e-9), -1.0) * v
        g = -p * pull[doc_of]
        gw, gb = np.bincount(cols, g[rows], len(words)), float(g.sum())
        m1, m2 = 0.9 * m1 + 0.1 * gw, 0.99 * m2 + 0.01 * gw * gw
        c1, c2 = 0.9 * c1 + 0.1 * gb, 0.99 * c2 + 0.01 * gb * gb
        rate = RATE / (np.sqrt(m2 / (1 - 0.99**t)) + 1e-8)
        step = w - rate * m1 / (1 - 0.9**t)
        w = np.sign(step) * np.maximum(np.abs(step) - rate * SPARSITY, 0)
        b -= RATE * c1 / (1 - 0.9**t) / (np.sqrt(c2 / (1 - 0.99**t)) + 1e-8)
    return b, {words[k]: float(w[k]) for k in np.flatnonzero(w)}


def training_rows(docs: DataFrame, labels: DataFrame, sample: tuple[int, int] = SAMPLE) -> tuple[list, list, list]:
    """The bounded sample.  Several labels of one doc_id count as their maximum."""
    usable = labels.filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~is_held_out(F.col("doc_id")))
    one = usable.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    share = {r.toxic: r["count"] for r in one.groupBy("toxic").count().collect()}
    picked = None
    for label, most in ((1, sample[0]), (0, sample[1])):
        part = one.filter(F.col("toxic") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
        picked = part if picked is None else picked.unionByName(part)
    # at most sum(sample) rows; a repeated doc_id brings its first text only
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(picked), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
    upto = Window.orderBy(F.xxhash64("doc_id"), "doc_id").rowsBetween(Window.unboundedPreceding, 0)  # over the picked rows only
    rows = rows.withColumn("bytes", F.sum(F.coalesce(F.octet_length("text"), F.lit(0))).over(upto)).filter(F.col("bytes") <= SAMPLE_BYTES).orderBy("doc_id").collect()
    got = Counter(r.toxic for r in rows)
    return [r.text or "" for r in rows], [r.toxic for r in rows], [share[r.toxic] / got[r.toxic] for r in rows]


def score(docs: DataFrame, model: tuple[float, dict[str, float]]) -> DataFrame:
    """All columns of ``docs`` and ``tox_score``, ``tox_worst`` (its highest sentence) and
    ``tox_spans`` (columns of these names are replaced): code-point ranges of sentences at 0.5 or more.

    A null or empty text is one empty sentence; equal rows score alike; an empty table gives an
    empty result.  Row by row, no shuffle.
    """
    bias, weight = model

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        adds = WordWeights(weight)
        for whole in batches:
            for k in range(0, whole.num_rows, 512):
                b = whole.slice(k, 512)
                total, worst, spans = [], [], []
                for text in b.column(b.num_columns - 1).to_pylist():
                    text = text or ""
                    bag = sentences(text)
                    p = sigmoid(bias + np.array([sum(map(adds.__getitem__, s)) for s in bag]))
                    total.append(float(1 - np.prod(1 - p)))
                    worst.append(float(p.max()))
                    spans.append(offending(text, bias, adds) if worst[-1] >= 0.5 else [])
                kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("p", pa.float64())]))
                yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(total, pa.float64()), pa.array(worst, pa.float64()), pa.array(spans, kind)], [*b.schema.names[:-1], "tox_score", "tox_worst", "tox_spans"])

    added = T.StructType.fromDDL("tox_score double, tox_worst double, tox_spans array<struct<start:int,end:int,p:double>>")
    kept = docs.drop("tox_score", "tox_worst", "tox_spans", "_tox_text")
    schema = T.StructType(kept.schema.fields + added.fields)
    return kept.withColumn("_tox_text", F.col("text")).mapInArrow(run, schema)


def offending(text: str, bias: float, adds: WordWeights) -> list[dict]:
    out = []
    for m in SENTENCE.finditer(text):
        (words,) = sentences(m[0])[:1]
        p = float(sigmoid(np.array(bias + sum(map(adds.__getitem__, words)))))
        if p >= 0.5:
            out.append({"start": m.start(), "end": m.end(), "p": p})
    return out


def train(docs: DataFrame, labels: DataFrame) -> tuple[float, dict[str, float]]:
    return fit(*training_rows(docs, labels))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``score`` of ``documents`` by a model of those ``labels`` that are not held out."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    scored = score(docs, train(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), F.col("tox_score").alias("score"), (F.col("tox_score") >= 0.5).cast("int").alias("predicted"), F.col("tox_worst").alias("worst_sentence"), F.size("tox_spans").alias("n_offending"))
