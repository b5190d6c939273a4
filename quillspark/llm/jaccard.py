"""Jaccard join on word shingles by universe partition and the pigeonhole principle.

Two sets with Jaccard similarity of at least 0.8 differ in at most ``(s + y) / 9`` tokens.
Hashing splits the universe of tokens in ``m`` segments (``m`` by size band), so a pair
whose difference is at most ``H`` agrees on any choice of segments of the larger set whose
allotments exceed ``H``: an allotment of 1 is kept by equal segments, one of 2 by segments
that differ in at most one token, found through one-deletion neighbourhoods.

1. ``profile``: every document's shingle set, its size, a digest (equal sets are one node
   from here on) and, for each plan, what its segments could be allotted.
2. ``choose_plans``: per size band, the plan of least index entries under which every
   document can be allotted enough.  Bands are powers of two, so these are a few rows.
3. ``signatures``: own-band segments are indexed; they and, for sets small in their band,
   those of the band below are probed.  Signatures that one node alone has are dropped.  A
   signature that very many sets share is counted by partial aggregation and its count sent to
   its rows, so that they never meet in one task.
4. ``probes``: what a set may be allotted for nothing, by segments that it alone has, is
   taken off its need; the rest is taken from its rarest shared segments.
5. ``candidate groups`` are components over bucket stars, a row per signature kept; pairs
   inside a group are verified exactly, in blocks, by a matrix product over shared tokens.

No bucket emits its pairs, no text or set is cut, and only band statistics reach the driver.
Shingles are compared by 64-bit hashes of their words: "exact" means exact but for collisions of
these, which for two given sets of a thousand shingles have a chance below 1e-13.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.llm.common import discard, lean, small_enough, stored, table
from quillspark.llm.components import connected_components, join_each

SHINGLE, PERCENT = 5, 80
#: One in SHARE signature entries is looked at to tell which signatures are hot; more than HOT of
#: them make it so.  That decides how a bucket is counted, not what is found.
SHARE, HOT = 256, 200
#: segments per token at a band's upper end, and whether segments may be allotted 2
PLANS = ((0.28, False), (0.4, False), (0.7, False), (1.5, False), (6.0, False), (0.14, True), (0.25, True), (0.6, True), (3.0, True))
BLOCK, COLUMNS, CACHE_WORDS = 512, 8192, 400_000
C = [np.uint64(c) for c in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63)]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) > CACHE_WORDS:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def shingle_set(text: str | None, words: WordHashes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's shingles.

    A-Z are lower-cased and words are runs without ASCII white space; fewer words
    than a shingle are one token together; no words give the empty set.
    """
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return np.zeros(0, np.uint64)
    w = np.fromiter(map(words.__getitem__, found), np.uint64, len(found))
    n = max(1, len(w) - SHINGLE + 1)
    h = np.full(n, len(w) if len(w) < SHINGLE else SHINGLE, np.uint64)
    for k in range(min(SHINGLE, len(w))):
        h = mix(h * C[0] + w[k : k + n] * C[k % 5] + np.uint64(k))
    h.sort()
    return h[np.concatenate([[True], h[1:] != h[:-1]])]


def segments_of(tokens: np.ndarray, m: int, salt: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tokens in order of segment, the segments that occur, and where each starts."""
    seg = (mix(tokens + np.uint64(salt + 1) * C[1]) >> np.uint64(32)) % np.uint64(m)
    order = np.argsort(seg, kind="stable")
    seg = seg[order]
    starts = np.flatnonzero(np.concatenate([[True], seg[1:] != seg[:-1]]))
    return tokens[order], seg[starts].astype(np.int64), starts


def roles(size: int) -> list[tuple[int, bool, int]]:
    """``(band, own, need)``: bands that a set of this size takes part in.

    Band ``k`` holds sizes from ``2**k`` below ``2**(k + 1)``.  ``need`` is one more than
    the largest difference to a partner of that band that is no larger than the set.
    """
    band = size.bit_length() - 1
    out = [(band, True, 2 * size * (100 - PERCENT) // (100 + PERCENT) + 1)]
    below = (1 << band) - 1
    if below and 100 * below >= PERCENT * size:
        out.append((band - 1, False, (size + below) * (100 - PERCENT) // (100 + PERCENT) + 1))
    return out


def n_segments(band: int, plan: int) -> int:
    return max(1, int(np.ceil(PLANS[plan][0] * 2 ** (band + 1))))


def row_key(doc_id: Column, text: Column) -> Column:
    """A digest of a row's id and text: rows of one key are equal."""
    return F.unhex(F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("-")), F.lit(":"), F.coalesce(text, F.lit("")))))


def profile(docs: DataFrame, salt: int) -> DataFrame:
    """``doc_id, n_shingles, node, check, own, low, row_key``; node is null for the empty set."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordHashes()
        for whole in batches:
            for k in range(0, whole.num_rows, 256):
                b = whole.slice(k, 256)
                size, node, check, own, low = [], [], [], [], []
                for text in b.column(1).to_pylist():
                    s = shingle_set(text, words)
                    size.append(len(s))
                    node.append(node_of(s, salt) if len(s) else None)
                    check.append(hashlib.md5(s.tobytes()).digest() if len(s) else None)
                    spread = mix(s + np.uint64(salt + 1) * C[1]) >> np.uint64(32)
                    can = {o: [allotted(spread, band, p) for p in range(len(PLANS))] for band, o, _ in (roles(len(s)) if len(s) else [])}
                    own.append(can.get(True))
                    low.append(can.get(False))
                ints = pa.list_(pa.int32())
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(size, pa.int64()), pa.array(node, pa.int64()), pa.array(check, pa.binary()), pa.array(own, ints), pa.array(low, ints), b.column(2)], ["doc_id", "n_shingles", "node", "check", "own", "low", "row_key"])

    doc_id = F.col("doc_id").cast("long")
    return docs.select(doc_id.alias("doc_id"), "text", row_key(doc_id, F.col("text")).alias("row_key")).mapInArrow(run, "doc_id long, n_shingles long, node long, check binary, own array<int>, low array<int>, row_key binary")


def node_of(tokens: np.ndarray, salt: int) -> int:
    return int.from_bytes(hashlib.blake2b(tokens.tobytes(), digest_size=8, salt=salt.to_bytes(8, "little")).digest(), "little", signed=True)


def allotment(tokens: np.ndarray, band: int, plan: int, salt: int) -> int:
    """The most that the set's segments can be allotted under a plan."""
    return allotted(mix(tokens + np.uint64(salt + 1) * C[1]) >> np.uint64(32), band, plan)


def allotted(spread: np.ndarray, band: int, plan: int) -> int:
    held = np.bincount((spread % np.uint64(n_segments(band, plan))).astype(np.int64))
    return int(np.minimum(held, 2).sum() if PLANS[plan][1] else np.count_nonzero(held))


def choose_plans(rows: DataFrame) -> dict[int, int] | None:
    """The cheapest feasible plan of each band, or None if some band has none."""
    band = F.floor(F.log2(F.col("n_shingles").cast("double") + 0.5)).cast("int")
    share = (100 - PERCENT, 100 + PERCENT)
    below = F.pow(F.lit(2), band).cast("long") - 1
    own = rows.filter("own IS NOT NULL").select(band.alias("band"), (F.floor(2 * F.col("n_shingles") * share[0] / share[1]) + 1).alias("need"), F.col("own").alias("can"), "n_shingles")
    low = rows.filter("low IS NOT NULL").select((band - 1).alias("band"), (F.floor((F.col("n_shingles") + below) * share[0] / share[1]) + 1).alias("need"), F.col("low").alias("can"), "n_shingles")
    stats = []
    for p, (_, twice) in enumerate(PLANS):
        slack = F.min(F.col("can")[p] - F.col("need")).alias(f"slack{p}")
        # a segment of t tokens has one entry, and t more with neighbourhoods
        stats += [slack, F.sum(F.col("can")[p] + (F.col("n_shingles") if twice else F.lit(0))).alias(f"cost{p}")]
    out = {}
    for r in own.unionByName(low).groupBy("band").agg(*stats).collect():
        fit = [(r[f"cost{p}"], p) for p in range(len(PLANS)) if r[f"slack{p}"] >= 0]
        if not fit:
            return None
        out[r.band] = min(fit)[1]
    return out


SIGS = "sig long, node long, meta int"


def signatures(docs: DataFrame, plans: dict[int, int], salt: int) -> DataFrame:
    """``sig, node, meta``; meta packs own band (bit 0), deletion (1), allotment 2 (2), segment.

    Copies within a task are emitted once; copies in other tasks name the same node.
    """

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, seen = WordHashes(), set()
        for whole in batches:
            for k in range(0, whole.num_rows, 256):
                sigs, metas, nodes, lens = [], [], [], []
                for text in whole.slice(k, 256).column(0).to_pylist():
                    s = shingle_set(text, words)
                    node = node_of(s, salt)
                    if not len(s) or node in seen:
                        continue
                    seen.add(node)
                    for band, own, _ in roles(len(s)):
                        sig, meta = set_signatures(s, band, own, plans[band], salt)
                        sigs.append(sig)
                        metas.append(meta)
                        nodes.append(node)
                        lens.append(len(sig))
                if sigs:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sigs)), pa.array(np.repeat(np.array(nodes, np.int64), lens)), pa.array(np.concatenate(metas))], ["sig", "node", "meta"])

    return docs.select("text").mapInArrow(run, SIGS)


def set_signatures(tokens: np.ndarray, band: int, own: bool, plan: int, salt: int) -> tuple[np.ndarray, np.ndarray]:
    tokens, seg, starts = segments_of(tokens, n_segments(band, plan), salt)
    value = mix(tokens ^ C[2])
    total = np.add.reduceat(value, starts)
    name = mix(seg.astype(np.uint64) * C[3] + np.array([band], np.uint64) * C[4])
    sig, meta = [mix(total + name)], [seg * 8 + own]
    if PLANS[plan][1]:
        held = np.diff(np.append(starts, len(tokens)))
        meta[0] += 4 * (held > 1)
        at = np.repeat(np.arange(len(seg)), held)
        some = held[at] > 1
        sig.append(mix(total[at[some]] - value[some] + name[at[some]]))
        meta.append(seg[at[some]] * 8 + own + 2 + 4)
    return np.concatenate(sig).view(np.int64), np.concatenate(meta).astype(np.int32)


def candidate_stars(sigs: DataFrame, rows: DataFrame, plans: dict[int, int]) -> DataFrame:
    """``(a, b)``: nodes joined to a leader of each bucket that some set must probe."""
    sigs = stored(sigs, "signatures")
    looked = sigs.select("sig").filter(F.pmod(F.xxhash64("sig", "node", "meta"), F.lit(SHARE)) == 0)
    hot = stored(looked.groupBy("sig").agg(F.count(F.lit(1)).alias("seen")).filter(F.col("seen") > HOT).select("sig"), "hot")
    bucket = Window.partitionBy("sig")
    stats = {"cost": F.count(F.lit(1)), "lo": F.min("node"), "hi": F.max("node"), "indexed": F.max(F.col("meta").bitwiseAND(1))}
    if hot.limit(1).count():
        few = F.broadcast(hot) if small_enough(hot, 200_000) else hot
        counts = sigs.join(few, "sig").groupBy("sig").agg(*[c.alias(k) for k, c in stats.items()])
        counts = stored(counts.filter("lo < hi AND indexed = 1"), "hot_counts")
        crowded = sigs.join(F.broadcast(counts) if small_enough(counts, 200_000) else counts, "sig")
        sparse = sigs.join(few, "sig", "left_anti")
        shared = sparse.select("*", *[c.over(bucket).alias(k) for k, c in stats.items()]).unionByName(crowded.select("sig", "node", "meta", *stats))
    else:
        shared = sigs.select("*", *[c.over(bucket).alias(k) for k, c in stats.items()])
    shared = shared.filter("lo < hi AND indexed = 1").select("sig", "node", "cost", F.col("meta").bitwiseAND(1).alias("own"), F.shiftright("meta", 3).alias("seg"), (1 + F.shiftright("meta", 2).bitwiseAND(1)).alias("allot"))
    shared = stored(shared, "shared")
    discard(sigs)
    # what each node needs and can be allotted in its two bands under the chosen plans
    size, share = F.col("n_shingles"), (100 - PERCENT, 100 + PERCENT)
    band = F.floor(F.log2(size.cast("double") + 0.5)).cast("int")
    below = F.pow(F.lit(2), band).cast("long") - 1
    pick = F.create_map(*[F.lit(x) for kv in sorted(plans.items()) for x in kv]) if plans else F.create_map(F.lit(-1), F.lit(0))
    sets = rows.filter("node IS NOT NULL").groupBy("node").agg(F.first("n_shingles").alias("n_shingles"), F.first("own").alias("o"), F.first("low").alias("l"))
    own = F.struct(F.lit(1).alias("own"), (F.floor(2 * size * share[0] / share[1]) + 1 - F.col("o")[F.element_at(pick, band)]).alias("lack"))
    low = F.struct(F.lit(0).alias("own"), (F.floor((size + below) * share[0] / share[1]) + 1 - F.col("l")[F.element_at(pick, band - 1)]).alias("lack"))
    lack = sets.select("node", F.explode(F.array(own, low)).alias("r")).select("node", "r.own", "r.lack").filter("lack IS NOT NULL")
    segs = shared.groupBy("node", "own", "seg").agg(F.max("cost").alias("cost"), F.first("allot").alias("allot"))
    mine = Window.partitionBy("node", "own")
    segs = segs.join(lack, ["node", "own"])
    segs = segs.withColumn("want", F.col("lack") + F.sum("allot").over(mine)).filter("want > 0")
    cheap = mine.orderBy("cost", "seg").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    chosen = segs.withColumn("before", F.sum("allot").over(cheap) - F.col("allot")).filter("before < want").select("node", "own", "seg", F.lit(1).alias("probe"))
    flagged = shared.join(chosen, ["node", "own", "seg"], "left").filter("probe = 1 OR own = 1")
    flagged = stored(flagged.select("sig", "node", "own", F.coalesce("probe", F.lit(0)).alias("probe")), "flagged")
    leaders = flagged.groupBy("sig").agg(F.max("probe").alias("probed"), F.min(F.when(F.col("own") == 1, F.col("node"))).alias("leader")).filter("probed = 1 AND leader IS NOT NULL").select("sig", "leader")
    stars = stored(flagged.join(leaders, "sig").filter("node <> leader").select(F.col("node").alias("a"), F.col("leader").alias("b")).distinct(), "stars")
    discard(shared)
    discard(flagged)
    return stars


def links_of(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of linked sets, one of ``left`` and one of ``right`` (index arrays)."""
    size = np.array([len(s) for s in sets], np.int64)
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), size)
    _, code, times = np.unique(flat, return_inverse=True, return_counts=True)
    shared = times[code] > 1
    owner, code = owner[shared], np.unique(code[shared], return_inverse=True)[1]
    width = int(code.max()) + 1 if len(code) else 0
    order = np.argsort(code, kind="stable")
    owner, code = owner[order], code[order]
    common = np.zeros((len(left), len(right)), np.float32)
    for at in range(0, width, COLUMNS):
        a, b = np.searchsorted(code, [at, at + COLUMNS])
        x = np.zeros((len(sets), min(COLUMNS, width - at)), np.float32)
        x[owner[a:b], code[a:b] - at] = 1
        common += x[left] @ x[right].T
    union = size[left][:, None] + size[right][None, :] - common
    i, j = np.nonzero(100 * common.astype(np.float64) >= PERCENT * union)
    keep = left[i] != right[j]
    return left[i[keep]], right[j[keep]]


def verify_blocks(rows: DataFrame) -> DataFrame:
    """``rows(grp, i, j, block, node, n, tokens)`` to ``(node, links, root)``.

    Rows of a block pair come sorted together; a pair of different blocks compares across
    them only.  ``links`` counts the copies that linked sets stand for.
    """

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple] = {}
        key = None

        def close() -> Iterator[pa.RecordBatch]:
            node = np.array(list(held), np.int64)
            block, n, sets = zip(*held.values(), strict=True)
            block, n = np.array(block), np.array(n, np.int64)
            one = key[1] == key[2]
            left = np.arange(len(node)) if one else np.flatnonzero(block == key[1])
            right = left if one else np.flatnonzero(block == key[2])
            if len(left) and len(right) and len(node) > 1:
                a, b = links_of(list(sets), left, right)
                if not one:
                    a, b = np.concatenate([a, b]), np.concatenate([b, a])
                if len(a):
                    links = np.bincount(a, n[b], len(node)).astype(np.int64)
                    root = np.arange(len(node))
                    while True:
                        new = root.copy()
                        np.minimum.at(new, root[a], root[b])
                        new = new[new]
                        if (new == root).all():
                            break
                        root = new
                    hit = links > 0
                    yield pa.RecordBatch.from_arrays([pa.array(node[hit]), pa.array(links[hit]), pa.array(node[root[hit]])], ["node", "links", "root"])

        for b in batches:
            for g, i, j, block, nd, n, tokens in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if (g, i, j) != key:
                    if held:
                        yield from close()
                    held, key = {}, (g, i, j)
                held[nd] = (block, n, np.frombuffer(tokens, np.uint64))
        if held:
            yield from close()

    return rows.select("grp", "i", "j", "block", "node", "n", "tokens").mapInArrow(run, "node long, links long, root long")


def classes(docs: DataFrame) -> DataFrame:
    """``row_key, doc_id, n_shingles, group_id, least, n_links`` for every row of ``docs(doc_id, text)``.

    Rows of one ``group_id`` reach each other by links; ``least`` is the smallest doc_id among
    them.  Sets without tokens link with nothing.  Equal rows are documents of their own, linked
    with each other; a null doc_id is never a component's smallest; other columns are
    ignored; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    salt, plans = 0, None
    while plans is None:
        rows = stored(profile(docs, salt), "shingles")
        plans = choose_plans(rows)
        clash = rows.filter("node IS NOT NULL").groupBy("node").agg((F.min("check") < F.max("check")).alias("c")).filter("c").limit(1).count()
        if plans is None or clash:  # another hash: every set must be coverable and have a node of its own
            salt, plans = salt + 1, None
            discard(rows)
    stars = candidate_stars(signatures(docs, plans, salt), rows, plans)
    groups = connected_components(stars)
    tops = groups.select(F.col("component").alias("node"), "component").distinct()
    members = stored(groups.unionByName(tops), "candidates")
    sets = rows.filter("node IS NOT NULL").groupBy("node").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n"))
    sizes = members.groupBy("component").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    wanted = join_each(members, sizes, "component").join(sets, "node").select(F.col("component").alias("grp"), "node", "n", "blocks", F.col("least").alias("want_id"))
    wanted = stored(wanted, "wanted")
    few = F.broadcast(wanted) if small_enough(wanted, 100_000) else wanted
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(few, F.col("doc_id").eqNullSafe(F.col("want_id")))

    @lean
    def sets_again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordHashes()
        for whole in batches:
            for k in range(0, whole.num_rows, 256):
                b = whole.slice(k, 256)
                found = [shingle_set(t, words) for t in b.column(0).to_pylist()]
                keep = pa.array([bool(len(s)) and node_of(s, salt) == node for s, node in zip(found, b.column(2).to_pylist(), strict=True)])
                out = pa.RecordBatch.from_arrays([b.column(1), b.column(2), b.column(3), b.column(4), pa.array([s.tobytes() for s in found], pa.binary())], ["grp", "node", "n", "blocks", "tokens"])
                yield out.filter(keep)

    tokens = texts.select("text", "grp", "node", "n", "blocks").mapInArrow(sets_again, "grp long, node long, n long, blocks int, tokens binary")
    own = tokens.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    pairs = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("grp", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "node", "n", "tokens")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = stored(verify_blocks(pairs.repartition(parts, "grp", "i", "j").sortWithinPartitions("grp", "i", "j")), "links")
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    comps = connected_components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    ids = sets.join(comps, "node", "left").join(links, "node", "left").select("node", "n", "least", F.coalesce("component", "node").alias("component"), F.coalesce("links", F.lit(0)).alias("links"))
    ids = stored(ids, "near_ids")
    top = ids.groupBy("component").agg(F.min("least").alias("top"))
    ids = join_each(ids, top, "component").select("node", "component", F.col("top").alias("least"), (F.col("links") + F.col("n") - 1).alias("n_links"))
    out = rows.select("row_key", "doc_id", "n_shingles", "node").join(ids, "node", "left")
    out = stored(out.select("row_key", "doc_id", "n_shingles", F.col("component").alias("group_id"), F.coalesce("least", "doc_id").alias("least"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links")), "near_classes")
    for done in (rows, stars, members, wanted, found, ids):
        discard(done)
    return out


def near_duplicates(docs: DataFrame) -> DataFrame:
    """``doc_id, n_shingles, component_id, n_links`` for every row of ``docs``: see ``classes``."""
    return classes(docs).select("doc_id", "n_shingles", F.col("least").alias("component_id"), "n_links")


def representatives(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay if each class of linked documents keeps one: that of smallest
    doc_id (null last), then of smallest digest; one of them where rows are equal.

    It goes by rows, not by ids: rows that share an id, or have none, stay or go each by its own
    text.  Documents without words all stay.  All columns are kept.
    """
    found = classes(docs).filter("group_id IS NOT NULL")
    best = found.groupBy("group_id").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row_key")).alias("best"), F.count(F.lit(1)).alias("rows")).filter("rows > 1")
    known = join_each(found.select("group_id", "row_key"), best, "group_id").select("row_key", (F.col("row_key") == F.col("best.row_key")).alias("stays"))
    # a key's rows are equal, so that one of them is enough
    known = stored(known.groupBy("row_key").agg(F.first("stays").alias("stays"), F.count(F.lit(1)).alias("rows")).filter("NOT stays OR rows > 1"), "near_copies")
    few = F.broadcast(known) if small_enough(known, 200_000) else known
    names = list(docs.columns)
    doc_id = F.col("doc_id").cast("long")
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), row_key(doc_id, F.col("text")).alias("row_key"))
    every = keyed.join(few, "row_key", "left")
    once = every.filter("stays").dropDuplicates(["row_key"])
    return every.filter("stays IS NULL").unionByName(once).select("row.*")


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``near_duplicates`` of ``documents``."""
    return near_duplicates(table(spark, sf_dir, "documents"))


OP8_SQL = r"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS k, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), s AS (
  SELECT DISTINCT k, CASE WHEN len(w) < 5 THEN array_to_string(w, ' ') ELSE array_to_string(w[i:i + 4], ' ') END AS t
  FROM (SELECT k, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)
), n AS (SELECT k, count(*) AS n FROM s GROUP BY k),
common AS (SELECT a.k AS a, b.k AS b, count(*) AS c FROM s a JOIN s b ON a.t = b.t AND a.k <> b.k GROUP BY 1, 2),
link AS (
  SELECT a, b FROM common JOIN n x ON x.k = a JOIN n y ON y.k = b WHERE 100 * c >= 80 * (x.n + y.n - c)
), reach AS (
  SELECT a AS k, b FROM link UNION SELECT r.k, l.b FROM reach r JOIN link l ON l.a = r.b
), comp AS (
  SELECT r.k, min(d.doc_id) AS c FROM reach r JOIN d ON d.k = r.b GROUP BY r.k
), deg AS (SELECT a AS k, count(*) AS n_links FROM link GROUP BY a)
SELECT doc_id, coalesce(n, 0) AS n_shingles, least(doc_id, coalesce(c, doc_id)) AS component_id, coalesce(n_links, 0) AS n_links
FROM d LEFT JOIN n USING (k) LEFT JOIN comp USING (k) LEFT JOIN deg USING (k)
"""
