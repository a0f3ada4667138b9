"""Byte-level BPE, encoding and decoding, exactly as merging by rank gives it.

A sequence of tokens is what merging gives for its bytes if, and only if, each two neighbours are compatible: merging the
bytes of just those two gives the two again.  So a word is encoded from the left, taking the longest token that begins
here and is compatible with the one before; where none is, the token before is given up for the next shorter one.  A place
that turned out to lead nowhere is never entered again, so each place is left once and the work is linear in the word.
The longest token at a place is found in the Aho-Corasick automaton's trie over the bytes, read as Latin-1 text, and each
token knows the next shorter one that begins it.
Compatibility of two tokens is worked out once, by merging their few bytes, and memoised; so is each word's result, in a
memo of bounded size.

Ids are kept as binary: little-endian unsigned 32-bit integers, one after the other.

Scale: one pass over the rows, no shuffle; a worker holds the vocabulary, bounded memos and one bounded Arrow batch.  The
vocabulary's path is a parameter and each worker reads it for itself.

Defined results: null and empty texts have no ids and decode to no bytes; an id outside the vocabulary is an error;
repeated rows stay; other columns pass unchanged, but one with the name of an output gives way to it.
"""

from __future__ import annotations

import base64
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lanework.llm.store import bounded_batches, giving_way

#: Words in the younger half of a worker's memo, and pairs in its memo of compatibility.
MEMO_WORDS = 300_000
MEMO_PAIRS = 400_000


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f) if a}


class Codec:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.token = {i: b for b, i in ranks.items()}
        self.find = regex.compile(pattern).findall
        self.pairs: dict[tuple[int, int], bool] = {}
        self.automaton = ahocorasick.Automaton()
        self.by_text = {token.decode("latin-1"): i for token, i in ranks.items()}
        self.size = {i: len(token) for token, i in ranks.items()}
        self.most = max(self.size.values(), default=0)
        for token, i in self.by_text.items():
            self.automaton.add_word(token, i)
        self.automaton.make_automaton()
        self.shorter = Shorter(self)
        self.words, self.older = Memo(self), {}

    def merged(self, data: bytes) -> list[int]:
        """By the definition: the pair of least rank is merged, the leftmost of equals, again and again."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            best = min((r, i) if (r := self.ranks.get(parts[i] + parts[i + 1])) is not None else (len(self.ranks) + 1 << 8, i) for i in range(len(parts) - 1))
            if parts[best[1]] + parts[best[1] + 1] not in self.ranks:
                break
            parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]
        return [self.ranks[p] for p in parts]

    def compatible(self, a: int, b: int) -> bool:
        known = self.pairs.get((a, b))
        if known is None:
            known = self.merged(self.token[a] + self.token[b]) == [a, b]
            if len(self.pairs) >= MEMO_PAIRS:
                self.pairs.clear()
            self.pairs[a, b] = known
        return known

    def encode_word(self, data: bytes) -> list[int]:
        whole = self.ranks.get(data)
        if whole is not None or not data:
            return [whole] if data else []
        text, size, dead = data.decode("latin-1"), self.size, bytearray(len(data) + 1)
        out: list[int] = []
        at, tries = 0, [self.longest(text, 0)]
        while at < len(data):
            i = tries[-1]
            while i is not None and (dead[at + size[i]] or (out and not self.compatible(out[-1], i))):
                i = self.shorter[i]
            if i is not None:
                tries[-1] = i
                out.append(i)
                at += size[i]
                tries.append(self.longest(text, at) if at < len(data) else None)
            else:
                if not out:
                    raise ValueError("the vocabulary lacks single bytes")
                dead[at] = 1
                tries.pop()
                at -= size[out.pop()]
                tries[-1] = self.shorter[tries[-1]]
        return out

    def longest(self, text: str, at: int) -> int | None:
        """The longest token at this place, by the automaton's trie."""
        piece = text[at : at + self.most]
        n = self.automaton.longest_prefix(piece)
        while n and (found := self.by_text.get(piece[:n])) is None:
            n -= 1
        return found if n else None

    def encode(self, text: str) -> bytes:
        """Ids of a whole text, each match of the pattern separately."""
        return b"".join(map(self.words.__getitem__, self.find(text)))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.token.__getitem__, np.frombuffer(ids, "<u4").tolist()))


class Shorter(dict):
    """Token to the longest token that is a beginning of it, worked out when it is first asked for."""

    def __init__(self, codec: Codec):
        super().__init__()
        self.codec = codec

    def __missing__(self, i: int) -> int | None:
        text = self.codec.token[i].decode("latin-1")
        found = next((self.codec.by_text[text[:n]] for n in range(len(text) - 1, 0, -1) if text[:n] in self.codec.by_text), None)
        self[i] = found
        return found


class Memo(dict):
    """Words to packed ids.  When it is full, it becomes the older half and a new one begins."""

    def __init__(self, codec: Codec):
        super().__init__()
        self.codec = codec

    def __missing__(self, word: str) -> bytes:
        codec = self.codec
        ids = codec.older.get(word)
        if ids is None:
            ids = np.array(codec.encode_word(word.encode("utf-8")), "<u4").tobytes()
        if len(word) <= 64:
            if len(codec.words) >= MEMO_WORDS:
                codec.older, codec.words = codec.words, Memo(codec)
            codec.words[word] = ids
        return ids


@lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> Codec:
    return Codec(read_ranks(path), pattern)


def _added(df: DataFrame, of: str, kind: str, fields: list[T.StructField]) -> tuple[DataFrame, list[str], T.StructType]:
    """df with the operator's input last, the names of the columns that pass, and the result's schema."""
    bounded_batches(df.sparkSession)
    names = giving_way(df.columns, [f.name for f in fields])
    passing = df.select(*[F.col(f"`{n}`") for n in names])
    return df.select(*[F.col(f"`{n}`") for n in names], F.col(f"`{of}`").cast(kind).alias("\1in")), names, T.StructType([*passing.schema.fields, *fields])


def encode(df: DataFrame, path: str, pattern: str, text: str = "text", with_decoded: bool = False) -> DataFrame:
    """df with n_tokens and ids; asked to, with `decoded` too, the bytes that decoding just these ids gives."""
    fields = [T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.BinaryType()), *[T.StructField("decoded", T.BinaryType())] * with_decoded]
    source, names, schema = _added(df, text, "string", fields)

    def run(batches):
        own = codec(path, pattern)
        for batch in batches:
            ids = [own.encode(x.as_py() or "") for x in batch.column("\1in")]
            new = [pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())]
            if with_decoded:
                new.append(pa.array(map(own.decode, ids), pa.binary()))
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in names], *new], [*names, *[f.name for f in fields]])

    return source.mapInArrow(run, schema)


def decode(df: DataFrame, path: str, pattern: str, ids: str = "ids") -> DataFrame:
    """df with `decoded`, the bytes of binary ids."""
    source, names, schema = _added(df, ids, "binary", [T.StructField("decoded", T.BinaryType())])

    def run(batches):
        own = codec(path, pattern)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in names], pa.array((own.decode(x.as_py() or b"") for x in batch.column("\1in")), pa.binary())], [*names, "decoded"])

    return source.mapInArrow(run, schema)
