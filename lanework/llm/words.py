"""Vectorised words of whole texts.

Texts of an Arrow batch lie one after the other in one UTF-8 buffer.  All word classes used here separate words by
ASCII bytes only, so words are found on bytes, by a table of 256 entries, without decoding and without a Python loop.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

#: Texts are worked on in pieces of about this many bytes, whole texts each.
CHUNK_BYTES = 4 << 20
MULTIPLIERS = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))


def byte_table(separators: bytes, lower: bool) -> np.ndarray:
    """256 entries: 0 for a separator, else the byte itself, A-Z lowered if asked."""
    table = np.arange(256, dtype=np.uint8)
    if lower:
        table[65:91] += 32
    table[list(separators)] = 0
    return table


SPACES = bytes([0x20, *range(0x09, 0x0E)])
#: Words of `[^\x20\x09-\x0D]+`.  The byte 0 is a word byte there, so it is told apart by the mask, not by the value.
PLAIN = byte_table(b"", False), SPACES
PLAIN_LOWER = byte_table(b"", True), SPACES
#: Words of ASCII letters, digits and everything outside ASCII, A-Z lowered.
ALNUM_LOWER = byte_table(b"", True), bytes([*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])


@dataclass
class Words:
    """Words of some texts: `offsets[i]:offsets[i + 1]` are the words of text i."""

    offsets: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    data: np.ndarray
    codes: np.ndarray
    lexicon: pa.Array

    @property
    def n(self) -> int:
        return len(self.starts)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word, the same in every batch."""
        each = np.fromiter(map(xxhash.xxh3_64_intdigest, self.lexicon.to_pylist()), np.uint64, len(self.lexicon))
        return each[self.codes] if self.n else np.zeros(0, np.uint64)

    def room(self) -> np.ndarray:
        """For each word, how many words of its text begin at it or later."""
        return np.repeat(self.offsets[1:], np.diff(self.offsets)) - np.arange(self.n)


def text_buffer(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts, and where each begins and ends; null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_binary()), b"")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    data = texts.buffers()[2]
    bytes_ = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return bytes_, offsets - offsets[0]


def find_words(texts: pa.Array, kind: tuple[np.ndarray, bytes]) -> Words:
    """All words of whole texts, with a lexicon of the distinct ones (exact, as bytes) and a code for each word."""
    data, offsets = text_buffer(texts)
    table, separators = kind
    inside = np.ones(256, bool)
    inside[list(separators)] = False
    mask = inside[data]
    if len(data):
        first = np.zeros(len(data) + 1, bool)
        first[offsets] = True
        starts_mask, ends_mask = mask.copy(), mask.copy()
        starts_mask[1:] &= ~mask[:-1] | first[1:-1]
        ends_mask[:-1] &= ~mask[1:] | first[1:-1]
        starts, ends = np.flatnonzero(starts_mask), np.flatnonzero(ends_mask) + 1
    else:
        starts = ends = np.zeros(0, np.int64)
    own = table[data[mask]]
    lengths = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(ends - starts, out=lengths[1:])
    every = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(lengths), pa.py_buffer(own)]).dictionary_encode()
    codes = every.indices.to_numpy(zero_copy_only=False) if len(starts) else np.zeros(0, np.int32)
    return Words(np.searchsorted(starts, offsets).astype(np.int64), starts, ends, data, codes, every.dictionary)


def lexicon_bytes(lexicon: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of words, and where each word begins and ends."""
    lexicon = lexicon.cast(pa.large_binary())
    offsets = np.frombuffer(lexicon.buffers()[1], np.int64)[lexicon.offset : lexicon.offset + len(lexicon) + 1]
    return np.frombuffer(lexicon.buffers()[2] or b"", np.uint8), offsets


def chunks(batch: pa.RecordBatch, column: str, most: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in slices of whole rows, each of about `most` bytes of text at most, or one row."""
    if not batch.num_rows:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    before = np.cumsum(sizes) - sizes
    at = 0
    while at < len(sizes):
        end = max(at + 1, int(np.searchsorted(before, before[at] + most, "left")))
        end = min(end, len(sizes))
        if end - at > 1 and before[end - 1] + sizes[end - 1] - before[at] > most:
            end -= 1
        yield batch.slice(at, end - at)
        at = end


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads the bits of 64-bit values (the splitmix64 finaliser)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=4)
def _powers(n: int, which: int) -> tuple[np.ndarray, np.ndarray]:
    base = int(MULTIPLIERS[which])
    out = []
    for x in (base, pow(base, -1, 1 << 64)):
        p = np.full(n, x, np.uint64)
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


def window_hashes(words: np.ndarray, k: int, which: int = 0) -> np.ndarray:
    """A 64-bit hash of each k consecutive word hashes (windows over the end of a text are the caller's to leave out)."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    up, down = _powers(1 << int(len(words)).bit_length(), which)
    sums = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(mix(words + MULTIPLIERS[1 - which]) * up[: len(words)], out=sums[1:])
    return mix((sums[k:] - sums[:-k]) * down[:n])


def sliding_argmin(hashes: np.ndarray, w: int) -> np.ndarray:
    """For each w consecutive hashes, where the least lies; the rightmost of equals, so that it hangs on content only."""
    n = len(hashes) - w + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    low = np.uint64(0xFFFFFFFF)
    keys = (hashes & ~low) | (low - np.arange(len(hashes), dtype=np.uint64))
    least, width = keys, 1
    while width * 2 <= w:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if width < w:
        least = np.minimum(least[: len(least) - (w - width)], least[w - width :])
    return (low - (least[:n] & low)).astype(np.int64)
