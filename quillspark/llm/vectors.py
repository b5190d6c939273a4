"""Embedding near-duplicates by an inverted multi-index.

Unit vectors are cut in halves; each half has a codebook of its own, and the two nearest
codewords of a vector name its cell of the product grid.  Every vector is indexed in its cell
and visits the cells nearest to it (least sum of squared half distances, the order of the
multi-sequence traversal) until the share of partners expected there reaches the
target; partners found are verified by their cosine in double precision.

Neighbouring cells form tiles, as many for each label as its vectors fill, and a vector is sent once
to every tile that it visits, as it came (two bytes of index for many of values).  There it meets
all vectors at home in the tile.  Tiles are cut in blocks of bounded size on both sides, whatever
they hold, and a block pair reports counts and a spanning forest of its links, never the links
themselves.  Exact copies are one class from the start, so they cost nothing below.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm.common import discard, lean, small_enough, stored, table
from quillspark.llm.components import connected_components, join_each

THRESHOLD, TARGET = 0.98, 0.99
#: The sample that codebooks and visits are fitted on, by hash order: rows, and rows for a code where
#: there are many codes, but no more values than these bytes of double precision.
SAMPLE, PER_CODE, SAMPLE_BYTES = 20_000, 16, 64_000_000
#: Vectors that a cell should hold on average; rows of a block on either side, fewer where they would
#: be more than these bytes of double precision.
PER_CELL, BLOCK, BLOCK_BYTES = 256, 4096, 16_000_000
#: Single precision decides all but cosines this close to the threshold.
SLACK = 1e-4


def values_of(b: pa.RecordBatch, column: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All components of a batch in one array (null ones as NaN), and each row's start and end."""
    lists = b.column(column)
    size = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = lists.flatten().to_numpy(zero_copy_only=False) + 0.0  # no negative zero
    end = np.cumsum(size)
    return flat, end - size, end


def canonical(vectors: DataFrame) -> DataFrame:
    """``(vec_id, label, dim, key, vals)``: a digest of the values, and the values as bytes.

    ``key`` and ``vals`` are null where the vector links with nothing: no label, no vector,
    no components, null or non-finite components, or length zero.  Components keep the width of
    the input, four bytes or eight.
    """
    four = dict(vectors.dtypes)["embedding"] == "array<float>"

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            flat, start, end = values_of(b, 2)
            flat = flat.astype("<f4" if four else "<f8", copy=False)
            count = lambda hit: np.concatenate([[0], np.cumsum(hit)])
            bad, some = count(~np.isfinite(flat)), count(flat != 0)
            ok = (bad[end] == bad[start]) & (some[end] > some[start]) & b.column(1).is_valid().to_numpy(zero_copy_only=False)
            vals = [flat[s:e].tobytes() if o else None for s, e, o in zip(start.tolist(), end.tolist(), ok.tolist(), strict=True)]
            keys = [v and hashlib.md5(v).digest() for v in vals]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(end - start, pa.int32()), pa.array(keys, pa.binary()), pa.array(vals, pa.binary())], ["vec_id", "label", "dim", "key", "vals"])

    kept = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<float>" if four else "array<double>").alias("embedding"))
    return kept.mapInArrow(run, "vec_id long, label long, dim int, key binary, vals binary")


def units(vals: list[bytes], dim: int) -> np.ndarray:
    """Unit vectors in double precision, a row each."""
    x = np.frombuffer(b"".join(vals), "<f4" if len(vals[0]) == 4 * dim else "<f8").reshape(len(vals), dim).astype(np.float64)
    x /= np.abs(x).max(1)[:, None]
    return x / np.sqrt((x * x).sum(1))[:, None]


def squared(x: np.ndarray, codes: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1)[:, None] - 2 * x @ codes.T + (codes * codes).sum(1), 0)


def kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 12) -> np.ndarray:
    """Codewords in the order of their main axis, so that neighbours in number are near."""
    codes = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(rounds):
        near = np.concatenate([squared(x[at : at + 4096], codes).argmin(1) for at in range(0, len(x), 4096)])
        n = np.bincount(near, minlength=len(codes))
        order = np.argsort(near, kind="stable")
        filled = np.flatnonzero(n)
        total = np.zeros_like(codes)
        total[filled] = np.add.reduceat(x[order], (np.cumsum(n) - n)[filled])
        codes = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], codes)
    axis = np.linalg.svd(codes - codes.mean(0), full_matrices=False)[2][0]
    return codes[np.argsort(codes @ axis, kind="stable")]


class MultiIndex:
    """Two codebooks for vectors of one dimension and how many cells to visit."""

    def __init__(self, sample: np.ndarray, codes: int, threshold: float = THRESHOLD, target: float = TARGET):
        rng = np.random.default_rng(7)
        self.cut = max(1, sample.shape[1] // 2)
        self.books = [kmeans(part, codes, rng) for part in self._halves(sample)]
        self.visits = self._calibrate(sample, threshold, target, rng)

    def _halves(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return x[:, : self.cut], x[:, self.cut :] if x.shape[1] > 1 else np.zeros((len(x), 1))

    def traverse(self, x: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
        """Cells of each row of ``x`` as pairs of codes, nearest first: a multi-sequence walk's.

        The cell of the i-th and j-th nearest codewords has at least (i+1)(j+1) - 1 cells
        before it, so only pairs within ``most`` need their sums compared.
        """
        d = [squared(half, book) for half, book in zip(self._halves(x), self.books, strict=True)]
        order = [np.argsort(v, axis=1, kind="stable")[:, :most] for v in d]
        dist = [np.take_along_axis(v, o, 1) for v, o in zip(d, order, strict=True)]
        pairs = np.array([(i, j) for i in range(order[0].shape[1]) for j in range(min(order[1].shape[1], most // (i + 1)))])
        total = dist[0][:, pairs[:, 0]] + dist[1][:, pairs[:, 1]]
        first = np.argsort(total, axis=1, kind="stable")[:, :most]
        return np.take_along_axis(order[0], pairs[first, 0], 1), np.take_along_axis(order[1], pairs[first, 1], 1)

    def _cells(self, x: np.ndarray, most: int) -> np.ndarray:
        i, j = self.traverse(x, most)
        return i * len(self.books[1]) + j

    def _calibrate(self, x: np.ndarray, threshold: float, target: float, rng: np.random.Generator) -> int:
        """Visits at which a link is met, from one end or the other, with the target's probability:
        for partners placed just at the threshold, and for the sample's own pairs above it."""
        own = x[:2000]
        noise = rng.standard_normal(own.shape)
        noise -= (noise * own).sum(1)[:, None] * own
        noise /= np.maximum(np.sqrt((noise * noise).sum(1)), 1e-12)[:, None]
        placed = threshold * own + np.sqrt(1 - threshold**2) * noise
        i, j = np.nonzero(own.astype(np.float32) @ x.astype(np.float32).T >= threshold)
        i, j = i[i < j][:20_000], j[i < j][:20_000]
        every = len(self.books[0]) * len(self.books[1])

        def needed(a: np.ndarray, b: np.ndarray) -> int:
            """Visits at which the target is reached over the links of rows of ``a`` and ``b``."""
            home_a, home_b, most = self._cells(a, 1), self._cells(b, 1), 8
            while True:
                ranks = []
                for left, home in ((a, home_b), (b, home_a)):
                    met = self._cells(left, min(most, every)) == home
                    ranks.append(np.where(met.any(1), met.argmax(1), every))
                rank = np.minimum(*ranks)
                if (rank < every).mean() >= target or most >= every:
                    return min(every, int(np.quantile(rank, target, method="higher")) + 1)
                most *= 2

        return max(needed(own, placed), needed(own[i], x[j]) if len(i) else 1)


def fit(classes: DataFrame, codes: int, widest: int, threshold: float, target: float) -> dict[int, MultiIndex]:
    """An index for each dimension that the sample holds; other rows share one cell each
    dimension, which is exact too."""
    rows = int(max(2, min(max(SAMPLE, PER_CODE * codes), SAMPLE_BYTES // (8 * widest))))
    picked = classes.select("dim", "vals").orderBy(F.xxhash64("key", "label"), "key", "label").limit(rows).collect()
    by_dim: dict[int, list[bytes]] = {}
    for r in picked:
        by_dim.setdefault(r.dim, []).append(bytes(r.vals))
    return {d: MultiIndex(units(v, d), max(1, min(codes, len(v) // 4)), threshold, target) for d, v in by_dim.items()}


def place(classes: DataFrame, index: dict[int, MultiIndex]) -> DataFrame:
    """Add ``tiles``: those to visit, the home tile first.  ``shift`` says how coarse a label's are."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = max(16, min([2048, *(4_000_000 // len(m.books[0]) for m in index.values())]))
        for whole in batches:
            for k in range(0, whole.num_rows, rows):
                b = whole.slice(k, rows)
                dims, shift = b.column(2).to_numpy(), b.column(5).to_numpy().astype(np.int64)
                out: list = [[0]] * b.num_rows
                for d in np.unique(dims).tolist():
                    if d not in index:
                        continue
                    at = np.flatnonzero(dims == d)
                    i, j = index[d].traverse(units(b.column(3).take(pa.array(at)).to_pylist(), d), index[d].visits)
                    tiles = (i >> shift[at][:, None]) << 32 | j >> shift[at][:, None]
                    for r, row in zip(at.tolist(), tiles.tolist(), strict=True):
                        out[r] = list(dict.fromkeys(row))
                yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(out, pa.list_(pa.int64()))], [*b.schema.names[:5], "tiles"])

    return classes.select("node", "label", "dim", "vals", "n", "shift").mapInArrow(run, "node long, label long, dim int, vals binary, n long, tiles array<long>")


def local_roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of links between node ids: ``(node, root)``."""
    ids, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = flat[: len(a)], flat[len(a) :]
    root = np.arange(len(ids))
    while True:
        low = np.minimum(root[x], root[y])
        new = root.copy()
        np.minimum.at(new, root[x], low)
        np.minimum.at(new, root[y], low)
        new = new[new]
        if (new == root).all():
            return ids, ids[root]
        root = new


def links_of(dim: int, vals: list[bytes], node: np.ndarray, n: np.ndarray, home: np.ndarray, tiles: list[list[int]], index: np.ndarray, query: np.ndarray, threshold: float) -> Iterator[tuple]:
    """One block pair: ``(node, links, root)`` columns of the links that no other one reports.

    A link is met from either end.  Its query counts it; its indexed end counts it
    here only if that end does not visit the query's home tile itself.
    """
    x = units(vals, dim)
    x4 = x.astype(np.float32)
    width = max(map(len, tiles))
    seen = np.array([[*t, *[-1] * (width - len(t))] for t in tiles])[index]
    links, ends = np.zeros(len(node), np.int64), []
    for k in range(0, len(query), 512):
        part = query[k : k + 512]
        close = x4[part] @ x4[index].T
        i, j = np.nonzero(close >= threshold - SLACK)
        sure = close[i, j] >= threshold + SLACK
        a, b = part[i], index[j]
        unsure = np.flatnonzero(~sure)
        for at in range(0, len(unsure), 65_536):
            u = unsure[at : at + 65_536]
            sure[u] = (x[a[u]] * x[b[u]]).sum(1) >= threshold
        keep = sure & (a != b)
        a, b, j = a[keep], b[keep], j[keep]
        if len(a):
            np.add.at(links, a, n[b])
            one_way = (seen[j] != home[a][:, None]).all(1)
            np.add.at(links, b[one_way], n[a[one_way]])
            ends.append(np.stack(local_roots(node[a], node[b])))
    hit = np.flatnonzero(links)
    if len(hit):
        yield node[hit], links[hit], np.full(len(hit), -1)
    if ends:
        one, root = local_roots(*np.concatenate(ends, axis=1))
        apart = one != root
        yield one[apart], np.zeros(int(apart.sum()), np.int64), root[apart]


def verify(rows: DataFrame, threshold: float) -> DataFrame:
    """Rows of block pairs, each pair's together, to ``(node, links, root)``; one pair is in memory."""
    keys = ["label", "dim", "tile", "ib", "qb"]

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def close() -> Iterator[pa.RecordBatch]:
            t = pa.Table.from_batches(held)
            node, n, tile, home = (t[c].to_numpy() for c in ("node", "n", "tile", "home"))
            index = np.flatnonzero((home == tile) & (t["own_i"].to_numpy() == t["ib"].to_numpy()))
            query = np.flatnonzero(t["own_q"].to_numpy() == t["qb"].to_numpy())
            if len(index) and len(query):
                for part in links_of(t["dim"][0].as_py(), t["vals"].to_pylist(), node, n, home, t["tiles"].to_pylist(), index, query, threshold):
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in part], ["node", "links", "root"])

        last = None
        for b in batches:
            if not b.num_rows:
                continue
            cols = np.stack([b.column(c).to_numpy().astype(np.int64) for c in range(5)])
            cuts = [0, *(np.flatnonzero((cols[:, 1:] != cols[:, :-1]).any(0)) + 1).tolist(), b.num_rows]
            for s, e in zip(cuts[:-1], cuts[1:], strict=True):
                key = tuple(cols[:, s].tolist())
                if held and key != last:
                    yield from close()
                    held = []
                last = key
                held.append(b.slice(s, e - s))
        if held:
            yield from close()

    return rows.select(*keys, "node", "n", "home", "own_i", "own_q", "tiles", "vals").mapInArrow(run, "node long, links long, root long")


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, target: float = TARGET, per_cell: int = PER_CELL, block: int = BLOCK) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for every row of ``vectors(vec_id, embedding, label)``.

    Equal vectors with equal labels link with each other; rows that link with nothing (no label, no
    vector, a null, non-finite or zero one) are their own component.  Vectors of different dimension
    never link.  Rows that repeat count as vectors of their own; a null vec_id is never a component's
    smallest; other columns are ignored; an empty table gives an empty result.
    """
    spark = vectors.sparkSession
    given = canonical(vectors)
    rows = stored(given.select("vec_id", "label", "key"), "vectors")
    classes = given.filter(F.col("key").isNotNull()).groupBy("label", "key").agg(F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("n"), F.first("dim").alias("dim"), F.first("vals").alias("vals"))
    classes = stored(classes.withColumn("node", F.monotonically_increasing_id()), "vector_classes")
    held = classes.groupBy("label", "dim").agg(F.count(F.lit(1)).alias("held"))
    most, widest = (v or 1 for v in held.agg(F.max("held"), F.max("dim")).first())
    block = max(16, min(block, BLOCK_BYTES // (8 * widest)))
    codes = int(2 ** np.ceil(np.log2(max(1.0, np.sqrt(most / per_cell)))))
    index = fit(classes, codes, widest, threshold, target)
    # a label's tiles hold less than a block: so many cells a side that its count fills
    shift = F.greatest(F.lit(0), F.least(F.lit(int(np.log2(codes))), F.floor(F.log2(F.lit(float(codes)) / F.sqrt(F.greatest(F.col("held") / block, F.lit(1.0)))))))
    held = held.select("label", "dim", shift.cast("int").alias("shift"))
    held = F.broadcast(held) if small_enough(held, 100_000) else held
    placed = stored(place(classes.join(held, ["label", "dim"]), index).withColumn("home", F.element_at("tiles", 1)), "vector_tiles")
    # one more pass over ids and tiles tells where blocks must be cut
    sent = placed.select("label", "dim", "home", F.explode("tiles").alias("tile"))
    sizes = sent.groupBy("label", "dim", "tile").agg(F.count(F.when(F.col("home") == F.col("tile"), 1)).alias("i"), F.count(F.lit(1)).alias("q"))
    cuts = sizes.filter("i > 0").select("label", "dim", "tile", F.ceil(F.col("i") / block).cast("int").alias("ni"), F.ceil(F.col("q") / block).cast("int").alias("nq"))
    cuts = stored(cuts, "vector_blocks")
    few = F.broadcast(cuts) if small_enough(cuts, 100_000) else cuts
    every = placed.select("*", F.explode("tiles").alias("tile")).join(few, ["label", "dim", "tile"])
    own = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    every = every.withColumn("own_i", own("ni")).withColumn("own_q", own("nq"))
    upto = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    pair = lambda i, q: F.struct(i.alias("ib"), q.alias("qb"))
    as_index = F.when(F.col("home") == F.col("tile"), F.transform(upto("nq"), lambda q: pair(F.col("own_i"), q))).otherwise(F.array().cast("array<struct<ib:int,qb:int>>"))
    as_query = F.transform(upto("ni"), lambda i: pair(i, F.col("own_q")))
    every = every.withColumn("at", F.explode(F.array_distinct(F.concat(as_index, as_query)))).select("label", "dim", "tile", "at.ib", "at.qb", "node", "n", "home", "own_i", "own_q", "tiles", "vals")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = ["label", "dim", "tile", "ib", "qb"]
    found = stored(verify(every.repartition(parts, *keys).sortWithinPartitions(*keys), threshold), "vector_links")
    discard(placed)
    discard(cuts)
    links = found.filter("links > 0").groupBy("node").agg(F.sum("links").alias("links"))
    comps = connected_components(found.filter("root >= 0").select(F.col("node").alias("a"), F.col("root").alias("b")))
    mine = classes.join(comps, "node", "left").join(links, "node", "left").select("label", "key", "n", "least", F.coalesce("component", "node").alias("component"), F.coalesce("links", F.lit(0)).alias("links"))
    mine = stored(mine, "vector_ids")
    least = mine.groupBy("component").agg(F.min("least").alias("component_id"))
    mine = join_each(mine, least, "component").select("label", "key", "component_id", (F.col("links") + F.col("n") - 1).alias("n_links"))
    out = rows.select("vec_id", "label", "key").join(mine, ["label", "key"], "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def op9_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``near_duplicates`` of ``embeddings``."""
    return near_duplicates(table(spark, sf_dir, "embeddings"))


OP9_SQL = r"""
WITH RECURSIVE v AS (
  SELECT row_number() OVER () AS k, vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
), c AS (
  SELECT k, vec_id, label, len(e) AS n, list_filter(e, lambda x: x IS NOT NULL AND isfinite(x)) AS e FROM v WHERE label IS NOT NULL AND e IS NOT NULL
), ok AS (
  SELECT k, vec_id, label, e, sqrt(list_dot_product(e, e)) AS size FROM c WHERE n > 0 AND len(e) = n AND list_dot_product(e, e) > 0
), link AS (
  SELECT a.k AS a, b.k AS b FROM ok a JOIN ok b ON a.label = b.label AND len(a.e) = len(b.e) AND a.k <> b.k
  WHERE list_dot_product(a.e, b.e) / (a.size * b.size) >= 0.98
), reach AS (
  SELECT a AS k, b FROM link UNION SELECT r.k, l.b FROM reach r JOIN link l ON l.a = r.b
), comp AS (
  SELECT r.k, min(v.vec_id) AS c FROM reach r JOIN v ON v.k = r.b GROUP BY r.k
), deg AS (SELECT a AS k, count(*) AS n FROM link GROUP BY a)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, least(vec_id, coalesce(c, vec_id)) AS component_id, vec_id = least(vec_id, coalesce(c, vec_id)) AS kept
FROM v LEFT JOIN comp USING (k) LEFT JOIN deg USING (k)
"""
