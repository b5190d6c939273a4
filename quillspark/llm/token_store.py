"""Token-id output: canonical length-limited Huffman shards with block checkpoints.

Format of a token store (a directory):

``codebook/``  Parquet ``(id INT, bits INT)``: the code length of each id that occurs.
               Codes are canonical: by length, then id, so lengths alone restore them.
``shards/``    Parquet, one row per shard ``(part INT, seq INT, part_start LONG, n LONG,
               doc_ids ARRAY<LONG>, n_tokens ARRAY<INT>, checkpoints BINARY,
               payload BINARY)``; part_start counts the ids before it in its part.  Shards in
               (part, seq) order hold the documents in ascending doc_id order.  A
               document starts on a byte; every ``BLOCK`` ids of a document begin a
               block whose absolute bit offset in the payload is a little-endian
               unsigned 64-bit checkpoint.  Blocks decode independently.

Ids are counted over the whole corpus, by each task as it makes them, before any is written, so one
codebook serves all shards.  Ids go through one range exchange on doc_id, two bytes each, and are packed after it.
"""

from __future__ import annotations

import heapq
import os
import zlib
from struct import pack as pack_ids
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.llm.bpe import byte_characters
from quillspark.llm.chunks import ChunkCache, slices
from quillspark.llm.common import discard, lean, scratch_dir, stored, table, worker_cache

BLOCK = 256
SHARD_TOKENS, SHARD_DOCS = 1_000_000, 100_000
MAX_BITS = 16
SHARD_SCHEMA = "part int, seq int, part_start bigint, n bigint, doc_ids array<bigint>, n_tokens array<int>, checkpoints binary, payload binary"


# ---------------------------------------------------------------- tokenizing


class ChunkEncoder(ChunkCache):
    """Ids of a tokenizer file of the tokenizers library."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # tasks are the parallelism
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.encode_special_tokens = True
        self.wide = self.tok.get_vocab_size() > 0xFFFF
        self.code = "I" if self.wide else "H"
        # texts are cut, and lone words taken a short way, only where the file's settings allow it
        pre, model = self.tok.pre_tokenizer, self.tok.model
        plain = type(pre).__name__ == "ByteLevel" and pre.use_regex and not pre.add_prefix_space and type(model).__name__ == "BPE" and not model.dropout
        plain = plain and self.tok.normalizer is None and all(t.special for t in self.tok.get_added_tokens_decoder().values())
        super().__init__(np.dtype("<u4") if self.wide else np.dtype("<u2"), self._learn, lambda text: self._pack(self._ids(text)), keep=700_000, chunked=plain)
        self.shown = {b: c for b, c in enumerate(byte_characters())}

    def _ids(self, text: str) -> list[int]:
        return self.tok.encode_batch_fast([text], add_special_tokens=False)[0].ids

    def _pack(self, ids: list[int]) -> bytes:
        return np.asarray(ids, self.dtype).tobytes()

    def _learn(self, chunks: list[str]) -> dict[str, bytes]:
        """Encode unseen chunks: a lone word by the model itself, others in one call."""
        out: dict[str, bytes] = {}
        model, code, rest = self.tok.model.tokenize, self.code, []
        for c in chunks:
            word = c[1:] if c[:1] == " " else c
            if not word.isalpha():  # letters alone are one pre-token
                rest.append(c)
                continue
            if not c.isascii():
                word = word.encode().decode("latin-1").translate(self.shown)
            ids = [t.id for t in model("\u0120" + word if c[0] == " " else word)]
            out[c] = pack_ids(f"<{len(ids)}{code}", *ids)
        for k in range(0, len(rest), 2000):
            part = rest[k : k + 2000]
            for c, e in zip(part, self.tok.encode_batch_fast(part, add_special_tokens=False), strict=True):
                out[c] = self._pack(e.ids)
        return out


def tokenize(docs: DataFrame, tokenizer: str, end_id: int | None = None) -> DataFrame:
    """``(doc_id, wide, ids BINARY)`` for every row of ``docs(doc_id, text)``.

    A null text counts as empty.  Ids are little-endian, two bytes each, or four
    if the vocabulary needs them; ``end_id`` closes each document if given.
    """
    return counted(docs, tokenizer, end_id).filter("counts IS NULL").drop("counts")


def counted(docs: DataFrame, tokenizer: str, end_id: int | None = None) -> DataFrame:
    """As ``tokenize``, and a last row of each task, without ids, whose ``counts`` say how often each
    id occurs in the task (little-endian, eight bytes each)."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = worker_cache(f"chunks:{tokenizer}", lambda: ChunkEncoder(tokenizer))
        tail = b"" if end_id is None else np.asarray([end_id], enc.dtype).tobytes()
        total = np.zeros(0, np.int64)
        names = ["doc_id", "wide", "ids", "counts"]
        for whole in batches:
            for b in slices(whole, 1):
                ids = [x + tail for x in enc.encode(b.column(1))]
                total = summed(total, np.bincount(np.frombuffer(b"".join(ids), enc.dtype)))
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([enc.wide] * b.num_rows), pa.array(ids, pa.binary()), pa.nulls(b.num_rows, pa.binary())], names)
        if total.any():
            yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.array([enc.wide]), pa.nulls(1, pa.binary()), pa.array([total.astype("<i8").tobytes()], pa.binary())], names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, wide boolean, ids binary, counts binary")


def summed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The sum of two arrays of counts, the shorter one filled with zeros."""
    out = np.zeros(max(len(a), len(b)), np.int64)
    out[: len(a)] += a
    out[: len(b)] += b
    return out


def id_counts(counts: DataFrame) -> DataFrame:
    """``(id, n)`` over the whole corpus from ``counts(counts BINARY)`` of tasks."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for b in batches:
            for raw in b.column(0).to_pylist():
                total = summed(total, np.frombuffer(raw, "<i8"))
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int32)), pa.array(total[seen])], ["id", "n"])

    return counts.select("counts").mapInArrow(run, "id int, n long").groupBy("id").agg(F.sum("n").alias("n"))


# ------------------------------------------------------------------ Huffman


def code_lengths(counts: dict[int, int], max_bits: int = MAX_BITS) -> dict[int, int]:
    """Optimal code lengths of at most ``max_bits`` (package-merge).

    The limit rises where the alphabet cannot fit under it.  A lone id gets one bit.
    Plain Huffman lengths are returned when they already keep the limit.
    """
    ids = sorted(counts, key=lambda i: (counts[i], i))
    if len(ids) < 2:
        return dict.fromkeys(ids, 1)
    max_bits = max(max_bits, (len(ids) - 1).bit_length())
    parent, nodes = {}, len(ids)
    heap = [(counts[i], k) for k, i in enumerate(ids)]
    while len(heap) > 1:
        (a, x), (b, y) = heapq.heappop(heap), heapq.heappop(heap)
        parent[x] = parent[y] = nodes
        heapq.heappush(heap, (a + b, nodes))
        nodes += 1
    depth = [0] * nodes
    for x in range(nodes - 2, -1, -1):
        depth[x] = depth[parent[x]] + 1
    if max(depth[: len(ids)]) <= max_bits:
        return {i: depth[k] for k, i in enumerate(ids)}
    weight = np.array([counts[i] for i in ids], np.float64)
    coins = weight
    levels = []  # per level: for each item in order of weight, whether it is a package
    for _ in range(max_bits):
        if levels:
            packs = coins[: len(coins) // 2 * 2].reshape(-1, 2).sum(axis=1)
            merged = np.concatenate([weight, packs])
            order = np.argsort(merged, kind="stable")
            coins, is_pack = merged[order], order >= len(weight)
        else:
            is_pack = np.zeros(len(weight), bool)
        levels.append(is_pack)
    bits = np.zeros(len(ids), np.int64)
    take = 2 * len(ids) - 2
    for is_pack in reversed(levels):
        packs = int(is_pack[:take].sum())
        bits[: take - packs] += 1
        take = 2 * packs
    return {i: int(bits[k]) for k, i in enumerate(ids)}


class Codebook:
    """Canonical codes from lengths, and one look-up table for decoding."""

    def __init__(self, lengths: dict[int, int]):
        ids = np.array(sorted(lengths, key=lambda i: (lengths[i], i)), np.int64)
        bits = np.array([lengths[i] for i in ids.tolist()], np.int64)
        self.width = int(bits[-1]) if len(bits) else 1
        steps = np.left_shift(1, self.width - bits)
        first = np.concatenate([[0], np.cumsum(steps)[:-1]]) if len(bits) else np.zeros(0, np.int64)
        size = int(ids.max()) + 1 if len(ids) else 1
        #: of each id: its code at the top of a 64-bit word, and its length
        self.left, self.bits = np.zeros(size, np.uint64), np.zeros(size, np.uint8)
        self.left[ids] = first.astype(np.uint64) << np.uint64(64 - self.width)
        self.bits[ids] = bits
        #: by the next ``width`` bits: id and length in one integer
        self.table = np.zeros(1 << self.width, np.int64)
        filled = np.repeat(ids << 6 | bits, steps)
        self.table[: len(filled)] = filled

    def pack(self, ids: np.ndarray, counts: np.ndarray | None = None) -> tuple[bytes, np.ndarray]:
        """Bits of ``ids`` from the highest bit on, and each block's bit offset.  ``counts`` gives
        the ids of each document, which all start on a byte; else they are one document."""
        if not len(ids):
            return b"", np.zeros(0, np.uint64)
        counts = np.array([len(ids)]) if counts is None else counts
        n = self.bits[ids]
        upto = np.zeros(len(ids) + 1, np.int64)
        np.cumsum(n, out=upto[1:])
        first = np.cumsum(counts) - counts
        size = upto[first + counts] - upto[first] + 7 >> 3
        start = np.cumsum(size) - size
        at = upto[:-1] + np.repeat(8 * start - upto[first], counts)
        word, off = at >> 6, (at & 63).astype(np.uint8)
        code = self.left[ids]
        starts = np.flatnonzero(word[1:] != word[:-1]) + 1
        starts = np.concatenate([[0], starts])
        out = np.zeros(int(size.sum() + 7 >> 3) + 1, np.uint64)
        out[word[starts]] = np.bitwise_or.reduceat(code >> off, starts)
        split = np.flatnonzero(off + n > 64)  # codes that end in the next word
        out[word[split] + 1] |= code[split] << (64 - off[split]).astype(np.uint64)
        blocks = -(-counts // BLOCK)
        block = np.repeat(first, blocks) + BLOCK * (np.arange(int(blocks.sum())) - np.repeat(np.cumsum(blocks) - blocks, blocks))
        return out.astype(">u8").tobytes()[: int(size.sum())], at[block].astype(np.uint64)

    def unpack(self, payload: bytes, offsets: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Ids of all blocks, one after another; every step decodes one id of each block."""
        total = int(counts.sum())
        if not total:
            return np.zeros(0, "<u4")
        raw = np.frombuffer(payload + b"\0" * 8, np.uint8).astype(np.uint32)
        window = raw[:-4].astype(np.uint64) << 32 | (raw[1:-3] << 24 | raw[2:-2] << 16 | raw[3:-1] << 8 | raw[4:]).astype(np.uint64)
        order = np.argsort(-counts, kind="stable")
        left, at = counts[order], offsets[order].astype(np.int64)
        where = (np.cumsum(counts) - counts)[order]
        out = np.empty(total, "<u4")
        shift, mask = 40 - self.width, (1 << self.width) - 1
        alive = np.searchsorted(-left, -np.arange(1, int(left[0]) + 1), side="right")
        for step, k in enumerate(alive.tolist()):
            pos = at[:k]
            got = self.table[(window[pos >> 3] >> (shift - (pos & 7)).astype(np.uint64)).astype(np.int64) & mask]
            out[where[:k] + step] = got >> 6
            pos += got & 63
        return out


def write_store(tokens: DataFrame, counts: DataFrame, path: str, max_bits: int = MAX_BITS) -> None:
    """Write ``tokens(doc_id, wide, ids)``, counted in ``counts(counts)``, to a token store at ``path``.

    The codebook is the only thing gathered at the driver: at most one row per id of
    the vocabulary.  Equal doc_ids are ordered by their ids' bytes; a null doc_id is first.
    """
    spark = tokens.sparkSession
    rows = id_counts(counts).collect()
    lengths = code_lengths({r.id: r.n for r in rows}, max_bits)
    spark.createDataFrame([(i, n) for i, n in sorted(lengths.items())], "id int, bits int").coalesce(1).write.parquet(f"{path}/codebook")

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = tokens.repartitionByRange(parts, "doc_id", F.xxhash64("ids")).sortWithinPartitions("doc_id", F.xxhash64("ids"), "ids")

    @lean
    def shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, seq, before = TaskContext.get().partitionId(), 0, 0
        book = Codebook(lengths)
        docs: list = []
        size = 0

        def close() -> pa.RecordBatch:
            n = np.array([len(d[1]) for d in docs])
            payload, marks = book.pack(np.concatenate([d[1] for d in docs]), n)
            one = [[part], [seq], [before], [size], [[d[0] for d in docs]], [n], [marks.astype("<u8").tobytes()], [payload]]
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(one, (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary(), pa.binary()), strict=True)], SHARD_SCHEMA.replace(",", " ").split()[::2])

        for b in batches:
            for doc, wide, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                ids = np.frombuffer(raw, "<u4" if wide else "<u2")
                docs.append((doc, ids))
                size += len(ids)
                if size >= SHARD_TOKENS or len(docs) >= SHARD_DOCS:
                    yield close()
                    before += size
                    docs, size, seq = [], 0, seq + 1
        if docs:
            yield close()

    ordered.mapInArrow(shard, SHARD_SCHEMA).write.option("compression", "none").parquet(f"{path}/shards")


def read_store(spark: SparkSession, path: str, emit_ids: bool = False) -> DataFrame:
    """Decode a token store: ``doc_id, start, n_tokens, ids_crc32`` and, if asked, ``ids``.

    ``start`` is the number of ids in all documents before: an exclusive running sum
    over shards (a few numbers each), then over the documents of a shard.
    """
    lengths = {r.id: r.bits for r in spark.read.parquet(f"{path}/codebook").collect()}
    shards = spark.read.schema(SHARD_SCHEMA).parquet(f"{path}/shards")
    parts = shards.groupBy("part").agg(F.sum("n").alias("n"))
    upto = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, 0)
    # one row per partition of the writer's exchange, whose number is set, not grown by rows
    before = F.broadcast(parts.select("part", (F.sum("n").over(upto) - F.col("n")).alias("before")))

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        book = Codebook(lengths)
        for b in batches:
            for ids, n, marks, payload, start in zip(*(c.to_pylist() for c in b.columns), strict=True):
                n = np.array(n, np.int64)
                blocks = -(-n // BLOCK)
                counts = np.full(int(blocks.sum()), BLOCK, np.int64)
                last = np.cumsum(blocks)[blocks > 0] - 1
                counts[last] = (n - (blocks - 1) * BLOCK)[blocks > 0]
                got = book.unpack(payload, np.frombuffer(marks, "<u8"), counts)
                ends = np.cumsum(n)
                cols = [pa.array(ids, pa.int64()), pa.array(start + ends - n), pa.array(n), pa.array([zlib.crc32(got[a:z]) for a, z in zip((ends - n).tolist(), ends.tolist(), strict=True)], pa.int64())]
                names = ["doc_id", "start", "n_tokens", "ids_crc32"]
                if emit_ids:
                    cols.append(pa.array([got[a:z].astype(np.int32) for a, z in zip((ends - n).tolist(), ends.tolist(), strict=True)], pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(cols, names)

    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids array<int>" if emit_ids else "")
    return shards.join(before, "part").select("doc_ids", "n_tokens", "checkpoints", "payload", F.col("before") + F.col("part_start")).mapInArrow(run, schema)


def encode_corpus(docs: DataFrame, tokenizer: str, end_id: int | None, path: str, max_bits: int = MAX_BITS) -> None:
    """Tokenize ``docs(doc_id, text)`` once and write the token store.

    Defined cases: a null text is empty, an empty table gives an empty store, equal rows
    are each stored, further columns are ignored, and no text is cut.
    """
    tokens = stored(counted(docs, tokenizer, end_id), "ids")
    write_store(tokens.filter("counts IS NULL").drop("counts"), tokens.filter("counts IS NOT NULL"), path, max_bits)
    discard(tokens)


def op1_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` written to a token store and read back from it."""
    import public_tokenizers

    path = scratch_dir(spark, "token_store")
    encode_corpus(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), 2, path)
    return read_store(spark, path)
