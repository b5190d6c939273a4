"""Byte-level BPE through sentencepiece.

A sentencepiece BPE model is serialised straight from a rank file: each vocabulary entry
becomes a piece whose bytes are mapped to printable characters, scored by its negative
rank, so that "merge the best-scored pair" is "merge the pair of lowest rank".  The
normaliser is the identity.  Ids equal ranks; one unknown piece, which no byte reaches,
follows them.  Decoding maps ids to the model's pieces and their characters back to bytes.
"""

from __future__ import annotations

import base64
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm.chunks import CHUNKED, ChunkCache, slices
from quillspark.llm.common import lean, table, worker_cache


def byte_characters() -> list[str]:
    """One printable character for each byte: itself where printable in Latin-1 and not
    white space, else the next unused one from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = {b: 0x100 + k for k, b in enumerate(b for b in range(256) if b not in shown)}
    return [chr(rest.get(b, b)) for b in range(256)]


def read_ranks(path: str) -> list[bytes]:
    """Vocabulary entries of a rank file in order of rank."""
    with open(path, "rb") as f:
        rows = [line.split() for line in f if line.strip()]
    out = [b""] * len(rows)
    for token, rank in rows:
        out[int(rank)] = base64.b64decode(token)
    return out


def _field(number: int, value: bytes | int | float) -> bytes:
    """One protocol-buffer field: bytes, a float, or a non-negative integer."""
    def varint(n: int) -> bytes:
        out = bytearray()
        while n > 0x7F:
            out.append(n & 0x7F | 0x80)
            n >>= 7
        return bytes([*out, n])

    if isinstance(value, bytes):
        return varint(number << 3 | 2) + varint(len(value)) + value
    if isinstance(value, float):
        return varint(number << 3 | 5) + struct.pack("<f", value)
    return varint(number << 3) + varint(value)


def sentencepiece_model(vocab: list[bytes]) -> bytes:
    """The serialised model (field numbers of sentencepiece's public model schema)."""
    chars = byte_characters()
    normal, unknown, bpe = 1, 2, 2
    pieces = [_field(1, _field(1, "".join(chars[b] for b in token).encode()) + _field(2, float(-rank)) + _field(3, normal)) for rank, token in enumerate(vocab)]
    pieces.append(_field(1, _field(1, b"<unk>") + _field(2, 0.0) + _field(3, unknown)))
    trainer = _field(3, bpe) + _field(4, len(pieces)) + _field(40, len(vocab))
    normalizer = _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return b"".join(pieces) + _field(2, trainer) + _field(3, normalizer)


class BpeEncoder(ChunkCache):
    """Ids of texts as little-endian unsigned 32-bit integers."""

    def __init__(self, ranks: str, pattern: str):
        import sentencepiece
        from tokenizers import Regex, pre_tokenizers

        self.sp = sentencepiece.SentencePieceProcessor(model_proto=sentencepiece_model(read_ranks(ranks)))
        self.split = pre_tokenizers.Sequence([pre_tokenizers.Split(Regex(pattern), "isolated"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.bytes_of = {c: b for b, c in enumerate(byte_characters())}
        self.texts: dict[int, bytes] = {}
        super().__init__(np.dtype("<u4"), self._learn, self._direct, keep=150_000, chunked=pattern in CHUNKED)

    def decode(self, ids: bytes) -> bytes:
        """What packed ids stand for, by the inverse of the pieces' byte map."""
        found = np.frombuffer(ids, "<u4").tolist()
        try:
            return b"".join(map(self.texts.__getitem__, found))
        except KeyError:
            for i in set(found).difference(self.texts):
                self.texts[i] = bytes(map(self.bytes_of.__getitem__, self.sp.id_to_piece(i)))
            return b"".join(map(self.texts.__getitem__, found))

    def _pretokens(self, text: str) -> list[str]:
        return [piece for piece, _ in self.split.pre_tokenize_str(text)]

    def _direct(self, text: str) -> bytes:
        return b"".join(np.asarray(ids, "<u4").tobytes() for ids in self.sp.encode(self._pretokens(text), num_threads=1)) if text else b""

    def _learn(self, chunks: list[str]) -> dict[str, bytes]:
        cut = [self._pretokens(c) if c else [] for c in chunks]
        ids = iter(self.sp.encode([p for pieces in cut for p in pieces], num_threads=1))
        return {c: b"".join(struct.pack(f"<{len(got)}I", *got) for got in (next(ids) for _ in pieces)) for c, pieces in zip(chunks, cut, strict=True)}


def encode(docs: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """``docs(doc_id, text)`` to ``(doc_id, ids BINARY)``, one row for each input row.

    A null text counts as empty; other columns are ignored; whole texts are encoded.
    """

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(ranks, pattern)
        for whole in batches:
            for b in slices(whole, 1):
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(enc.encode(b.column(1)), pa.binary())], ["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, ids binary")


def encoder(ranks: str, pattern: str) -> BpeEncoder:
    return worker_cache(f"bpe:{ranks}:{pattern}", lambda: BpeEncoder(ranks, pattern))


def decode(tokens: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """``tokens(doc_id, ids)`` and ``decoded BINARY``, the bytes that ``ids`` stand for, null for null.
    The pattern does not matter to them: with it a worker's model serves both ways."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(ranks, pattern)
        for b in batches:
            texts = [enc.decode(raw.as_buffer()) if raw.is_valid else None for raw in b.column(1)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.binary())], ["doc_id", "ids", "decoded"])

    return tokens.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids binary, decoded binary")


def round_trip(docs: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """``encode`` and ``decode`` in one pass of one worker: ``(doc_id, ids, decoded)``.

    A null text counts as empty; equal rows give equal rows; other columns are ignored; an empty
    table gives an empty result; whole texts are encoded.
    """

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(ranks, pattern)
        for whole in batches:
            for b in slices(whole, 1):
                ids = enc.encode(b.column(1))
                texts = [enc.decode(raw) for raw in ids]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.binary()), pa.array(texts, pa.binary())], ["doc_id", "ids", "decoded"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, ids binary, decoded binary")


def digest(docs: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256``: ``round_trip`` reduced to hashes."""
    both = round_trip(docs, ranks, pattern)
    return both.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``digest`` of ``documents``."""
    import public_tokenizers

    return digest(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
