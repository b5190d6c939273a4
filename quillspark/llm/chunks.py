"""Whole-text encoding through remembered chunks, for byte-level BPE vocabularies."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Pre-token patterns, as published with their vocabularies, for which chunks may be
# encoded apart.  Whatever else splits a text, it is encoded whole.
CHUNKED = (
    r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+",
    r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s",
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+",
)
#: The longest chunk that a worker remembers.
CACHE_CHARS = 32
#: Texts encoded at once: rows, and bytes beyond which a smaller slice is taken.
ROWS, BYTES = 2048, 4_000_000
#: A letter or digit and a mark after it are in different pre-tokens.
MARK = r"([\pL\pN])([.,])"
IRREGULAR = r"[ \n][ \n]|[\x00\t\x0b\f\r\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def slices(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """Consecutive slices of a batch with a bounded sum of text bytes (or one row)."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)) if batch.num_rows else np.zeros(0)
    at = 0
    while at < batch.num_rows:
        before = ends[at - 1] if at else 0
        stop = max(at + 1, min(at + ROWS, int(np.searchsorted(ends, before + BYTES, side="right"))))
        yield batch.slice(at, stop - at)
        at = stop


class ChunkCache:
    """Encodes texts; most chunks of a text have been met before.

    The pre-token pattern that ``CHUNKED`` names always ends a pre-token before a space
    that a non-space follows, around a lone line feed and between a letter or digit and a mark, so the
    pieces between such places encode alike in any context.  Texts with other white space, with runs of it or
    with NUL are encoded directly.  Each distinct chunk of a slice is looked up once; two
    generations of remembered chunks bound the memory.
    """

    def __init__(self, dtype: np.dtype, learn: Callable[[list[str]], dict[str, bytes]], direct: Callable[[str], bytes], keep: int = 200_000, chunked: bool = True):
        """``keep``: distinct chunks remembered per generation; ``chunked``: whether texts may be cut."""
        self.chunked = chunked
        self.dtype, self.learn, self.direct, self.keep = dtype, learn, direct, keep
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def encode(self, texts: pa.StringArray) -> list[bytes]:
        """Packed ids of each text; a null text has none."""
        texts = pc.fill_null(texts, "")
        if not self.chunked:
            return [self.direct(t) for t in texts.to_pylist()]
        odd = pc.match_substring_regex(texts, IRREGULAR)
        plain = iter(self._plain(texts.filter(pc.invert(odd))))
        return [self.direct(t.as_py()) if o else next(plain) for t, o in zip(texts, odd.to_pylist(), strict=True)]

    def _plain(self, texts: pa.StringArray) -> list[bytes]:
        marked = pc.replace_substring_regex(texts, MARK, "\\1\x00\\2")
        marked = pc.replace_substring(pc.replace_substring(marked, " ", "\x00 "), "\n", "\x00\n\x00")
        split = pc.split_pattern(marked, "\x00")
        coded = split.flatten().dictionary_encode()
        packed = self._find(coded.dictionary.to_pylist())
        size = np.fromiter(map(len, packed), np.int64, len(packed)) // self.dtype.itemsize
        start = np.cumsum(size) - size
        which = coded.indices.to_numpy()
        count = size[which]
        ends = np.concatenate([[0], np.cumsum(count)])
        take = np.repeat((start[which] - ends[:-1]).astype(np.int32), count)
        take += np.arange(len(take), dtype=np.int32)
        ids = np.frombuffer(b"".join(packed), self.dtype)[take]
        edges = ends[split.offsets.to_numpy() - split.offsets[0].as_py()].tolist()
        return [ids[a:b].tobytes() for a, b in zip(edges[:-1], edges[1:], strict=True)]

    def _find(self, chunks: list[str]) -> list[bytes]:
        got = list(map(self.young.get, chunks))
        if None in got:
            lost = [k for k, g in enumerate(got) if g is None]
            names = [chunks[k] for k in lost]
            found = list(map(self.old.get, names))
            learnt = self.learn([c for c, g in zip(names, found, strict=True) if g is None])
            found = [learnt[c] if g is None else g for c, g in zip(names, found, strict=True)]
            for k, g in zip(lost, found, strict=True):
                got[k] = g
            self.young.update(zip(names, found, strict=True))
            for c in [c for c in names if len(c) > CACHE_CHARS]:
                del self.young[c]
            if len(self.young) > self.keep:
                self.old, self.young = self.young, {}
        return got
