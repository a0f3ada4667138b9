"""Media columns: what is in a binary column, by its bytes.

`sniff` runs one Aho-Corasick pass over each value to find the magic bytes of all formats at once.  Each hit is only a
guess: a validator walks the format's own structure (chunks, boxes, blocks, pages, checksums) and tells where the object
ends, or that there is none.  An object that spans the value from its first to its last byte gives the value's type, which
replaces the declared one; objects inside are carved out.  `store` writes bytes losslessly as 8-bit PCM samples in a WAV
file, in SQL functions only.

Scale: one pass over the rows, no shuffle, nothing kept between rows; a task holds one bounded Arrow batch.  Validators
share what they found out about a value (`Seen`): where the next mark of a kind lies, and from which places a format's
chain of blocks leads nowhere, so that a value full of headers is walked once and not once for each header.

Defined results: a null value is an empty one, which has no type (`valid` false, the declared type stays); a hit that its
validator rejects leaves no trace; equal values give equal results; repeated rows stay; other columns pass unchanged, but
one that has the name of an output gives way to it; an empty table gives an empty table.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left
from collections.abc import Callable
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lanework.llm.store import bounded_batches, giving_way

RATE = 8000
BLOCK = 64
#: Bytes that are inflated at a time.
PIECE = 1 << 14


def le(x: Column, size: int) -> Column:
    """A number as `size` little-endian bytes."""
    digits = F.lpad(F.hex(x), 2 * size, "0")
    return F.unhex(F.concat(*[F.substring(digits, 2 * i + 1, 2) for i in reversed(range(size))]))


def padded(value: Column, block: int = BLOCK) -> Column:
    """Bytes, with bytes 0 up to a positive multiple of `block`; null is empty."""
    value = F.coalesce(value.cast("binary"), F.unhex(F.lit("")))
    n = F.octet_length(value)
    missing = F.greatest(F.ceil(n / block), F.lit(1)) * block - n
    return F.concat(value, F.unhex(F.repeat(F.lit("00"), missing.cast("int"))))


def store(payload: Column, rate: int = RATE) -> Column:
    """A WAV file of 8-bit mono samples that are the payload's bytes.  A payload of odd length gets the pad byte of RIFF."""
    n = F.octet_length(payload)
    odd = F.unhex(F.repeat(F.lit("00"), F.pmod(n, F.lit(2))))
    fmt = F.concat(F.unhex(F.lit("666D7420")), le(F.lit(16), 4), le(F.lit(1), 2), le(F.lit(1), 2), le(F.lit(rate), 4), le(F.lit(rate), 4), le(F.lit(1), 2), le(F.lit(8), 2))
    return F.concat(F.unhex(F.lit("52494646")), le(n + F.pmod(n, F.lit(2)) + 36, 4), F.unhex(F.lit("57415645")), fmt, F.unhex(F.lit("64617461")), le(n, 4), payload, odd)


class Seen:
    """What validators found out about one value: places that lead nowhere, and where marks lie."""

    def __init__(self, data: bytes):
        self.data = data
        self.dead: dict[str, set[int]] = {}
        self.marks: dict[bytes, list[int]] = {}

    def next(self, mark: bytes, at: int) -> int:
        """The first place of `mark` at or after `at`; -1 if there is none."""
        own = self._all(mark)
        i = bisect_left(own, at)
        return own[i] if i < len(own) else -1

    def last(self, mark: bytes, at: int, end: int) -> int:
        """The last place of `mark` from `at` to before `end`; -1 if there is none."""
        own = self._all(mark)
        i = bisect_left(own, end - len(mark) + 1) - 1
        return own[i] if i >= 0 and own[i] >= at else -1

    def _all(self, mark: bytes) -> list[int]:
        if mark not in self.marks:
            self.marks[mark] = [m.start() for m in re.finditer(re.escape(mark), self.data)]
        return self.marks[mark]

    def nowhere(self, kind: str, walked: list[int]) -> None:
        self.dead.setdefault(kind, set()).update(walked)

    def leads_nowhere(self, kind: str, at: int) -> bool:
        return at in self.dead.get(kind, ())


def _u(data: bytes, at: int, size: int, order: str = "little") -> int:
    return int.from_bytes(data[at : at + size], order)


def _riff(data: bytes, at: int, seen: Seen) -> tuple[str, int] | None:
    kind = {b"WAVE": "audio/wav", b"WEBP": "image/webp", b"AVI ": "video/x-msvideo"}.get(data[at + 8 : at + 12])
    end = at + 8 + _u(data, at + 4, 4)
    if not kind or end > len(data) or end < at + 12:
        return None
    names, p, walked = set(), at + 12, []
    while p + 8 <= end:
        name, size = data[p : p + 4], _u(data, p + 4, 4)
        walked.append(p)
        if seen.leads_nowhere("riff", p) or not all(0x20 <= c < 0x7F for c in name):
            seen.nowhere("riff", walked)
            return None
        if p + 8 + size > end or (name == b"fmt " and size < 16):
            return None
        names.add(name)
        p += 8 + size + size % 2
    if kind == "audio/wav" and not {b"fmt ", b"data"} <= names:
        return None
    return (kind, end - at) if p in (end, end + 1) and names else None


def _png(data: bytes, at: int, seen: Seen) -> tuple[str, int] | None:
    p, walked = at + 8, []
    if data[p : p + 8] != b"\0\0\0\rIHDR":
        return None
    while p + 12 <= len(data) and not seen.leads_nowhere("png", p):
        walked.append(p)
        size, name = _u(data, p, 4, "big"), data[p + 4 : p + 8]
        if p + 12 + size > len(data) or zlib.crc32(memoryview(data)[p + 4 : p + 8 + size]) != _u(data, p + 8 + size, 4, "big"):
            break
        p += 12 + size
        if name == b"IEND":
            return "image/png", p - at
    seen.nowhere("png", walked)
    return None


def _gif(data: bytes, at: int, seen: Seen) -> tuple[str, int] | None:
    def blocks(p: int) -> int:
        while p < len(data) and data[p]:
            p += 1 + data[p]
        return p + 1

    if at + 13 > len(data):
        return None
    flags, images, walked = data[at + 10], 0, []
    p = at + 13 + (3 << ((flags & 7) + 1) if flags & 128 else 0)
    while p < len(data) and not seen.leads_nowhere("gif", p):
        if data[p] == 0x3B:
            return ("image/gif", p + 1 - at) if images else None
        walked.append(p)
        if data[p] == 0x21:
            p = blocks(p + 2)
        elif data[p] == 0x2C and p + 10 <= len(data):
            local = data[p + 9]
            p, images = blocks(p + 11 + (3 << ((local & 7) + 1) if local & 128 else 0)), images + 1
        else:
            break
    seen.nowhere("gif", walked)
    return None


def _jpeg(data: bytes, at: int, seen: Seen) -> tuple[str, int] | None:
    p, frames, walked = at + 2, 0, []
    while p + 4 <= len(data) and data[p] == 0xFF and not seen.leads_nowhere("jpeg", p):
        kind = data[p + 1]
        walked.append(p)
        if kind == 0xFF:
            p += 1
            continue
        size = _u(data, p + 2, 2, "big")
        if size < 2 or p + 2 + size > len(data):
            break
        frames += 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC)
        p += 2 + size
        if kind == 0xDA:
            while (p := data.find(b"\xff", p)) >= 0 and p + 1 < len(data) and (data[p + 1] == 0 or 0xD0 <= data[p + 1] <= 0xD7):
                p += 2
            if p < 0 or p + 1 >= len(data):
                break
        if data[p : p + 2] == b"\xff\xd9":
            return ("image/jpeg", p + 2 - at) if frames else None
    seen.nowhere("jpeg", walked)
    return None


def _bmp(data: bytes, at: int, seen: Seen) -> tuple[str, int] | None:
    size, offset, header = _u(data, at + 2, 4), _u(data, at + 10, 4), _u(data, at + 14, 4)
    width, height = int.from_bytes(data[at + 18 : at + 22], "little", signed=True), abs(int.from_bytes(data[at + 22 : at + 26], "little", signed=True))
    bits, packing = _u(data, at + 28, 2), _u(data, at + 30, 4)
    if at + size > len(data) or _u(data, at + 6, 4) or header not in (40, 52, 56, 108, 124) or not 14 + header <= offset <= size or width <= 0 or not height or _u(data, at + 26, 2) != 1 or bits not in (1, 4, 8, 16, 24, 32):
        return None
    return ("image/bmp", size) if packing or offset + (width * bits + 31) // 32 * 4 * height <= size else None


def _au(data: bytes, at: int, seen: Seen) -> tuple[str, int] | None:
    offset, size, coding, rate, channels = (_u(data, at + 4 + 4 * i, 4, "big") for i in range(5))
    good = 24 <= offset and size != 0xFFFFFFFF and at + offset + size <= len(data) and 1 <= coding <= 27 and rate and 0 < channels <= 64
    return ("audio/basic", offset + size) if good else None


def _ogg(data: bytes, at: int, seen: Seen) -> tuple[str, int] | None:
    p, walked = at, []
    if at + 27 > len(data) or not data[at + 5] & 2:
        return None
    while data[p : p + 5] == b"OggS\0" and p + 27 <= len(data) and not seen.leads_nowhere("ogg", p):
        walked.append(p)
        last, lacing = data[p + 5] & 4, data[p + 27 : p + 27 + data[p + 26]]
        if len(lacing) < data[p + 26]:
            break
        p += 27 + len(lacing) + sum(lacing)
        if last:
            if p <= len(data):
                return "audio/ogg", p - at
            break
    seen.nowhere("ogg", walked)
    return None


def _mp4(data: bytes, at: int, seen: Seen) -> tuple[str, int] | None:
    p, walked, moov = at, [], False
    while p + 8 <= len(data) and not seen.leads_nowhere("mp4", p):
        size, name = _u(data, p, 4, "big"), data[p + 4 : p + 8]
        size = _u(data, p + 8, 8, "big") if size == 1 else size
        if size < 8 or p + size > len(data) or not all(0x20 <= c < 0x7F for c in name):
            break
        walked.append(p)
        moov |= name == b"moov"
        p += size
    if moov:
        return "video/mp4", p - at
    seen.nowhere("mp4", walked)
    return None


def _pdf(data: bytes, at: int, seen: Seen) -> tuple[str, int] | None:
    p = seen.next(b"%%EOF", at)
    if p < 0 or not data[at + 5 : at + 8].replace(b".", b"").isdigit() or seen.last(b"startxref", at, p) < 0:
        return None
    p += 5
    p += 1 if data[p : p + 1] == b"\r" else 0
    p += 1 if data[p : p + 1] == b"\n" else 0
    return "application/pdf", p - at


def _gzip(data: bytes, at: int, seen: Seen) -> tuple[str, int] | None:
    flags, p = data[at + 3] if at + 10 <= len(data) else 0xE0, at + 10
    if flags & 0xE0:
        return None
    p += 2 + _u(data, p, 2) if flags & 4 else 0
    for text in (8, 16):  # a name and a comment, each up to a byte 0
        if flags & text:
            p = seen.next(b"\0", p) + 1
            if not p:
                return None
    p += 2 if flags & 2 else 0
    if seen.leads_nowhere("gzip", p):
        return None
    d, view, crc, size, q = zlib.decompressobj(-15), memoryview(data), 0, 0, p
    try:
        while not d.eof and (q < len(data) or d.unconsumed_tail):
            fed = d.unconsumed_tail or view[q : q + PIECE]
            q += 0 if d.unconsumed_tail else len(fed)
            out = d.decompress(fed, 1 << 20)
            crc, size = zlib.crc32(out, crc), size + len(out)
    except zlib.error:
        pass
    end = q - len(d.unused_data) + 8
    if d.eof and end <= len(data) and _u(data, end - 8, 4) == crc and _u(data, end - 4, 4) == size & 0xFFFFFFFF:
        return "application/gzip", end - at
    seen.nowhere("gzip", [p])
    return None


#: Magic bytes, where they lie in their object, and the format's validator.
MAGIC: list[tuple[bytes, int, Callable[[bytes, int, Seen], tuple[str, int] | None]]] = [
    (b"RIFF", 0, _riff),
    (b"\x89PNG\r\n\x1a\n", 0, _png),
    (b"GIF87a", 0, _gif),
    (b"GIF89a", 0, _gif),
    (b"\xff\xd8\xff", 0, _jpeg),
    (b"BM", 0, _bmp),
    (b".snd", 0, _au),
    (b"OggS\0", 0, _ogg),
    (b"ftyp", 4, _mp4),
    (b"%PDF-", 0, _pdf),
    (b"\x1f\x8b\x08", 0, _gzip),
]


@lru_cache(maxsize=1)
def _automaton() -> ahocorasick.Automaton:
    out = ahocorasick.Automaton()
    for magic, before, check in MAGIC:
        out.add_word(magic.decode("latin-1"), (len(magic) + before, check))
    out.make_automaton()
    return out


def objects(data: bytes) -> list[tuple[str, int, int]]:
    """(type, offset, length) of the value itself, if it is one object, and of those inside, outermost first of nested ones."""
    out: list[tuple[str, int, int]] = []
    over, seen = 0, Seen(data)
    found = sorted(((end + 1 - before, check) for end, (before, check) in _automaton().iter(data.decode("latin-1"))), key=lambda f: f[0]) if data else []
    for at, check in found:
        if at < over or at < 0:
            continue
        if hit := check(data, at, seen):
            out.append((hit[0], at, hit[1]))
            if at or hit[1] < len(data):  # what spans the whole value may hold others
                over = at + hit[1]
    return out


def payload_of(kind: str, data: bytes) -> bytes:
    """The bytes that a carved object holds as samples: of a WAV file its data chunk, else the object itself."""
    if kind != "audio/wav":
        return data
    p = 12
    while data[p : p + 4] != b"data":
        p += 8 + _u(data, p + 4, 4) + _u(data, p + 4, 4) % 2
    return data[p + 8 : p + 8 + _u(data, p + 4, 4)]


def feature_of(kind: str, payload: bytes) -> str:
    """The type with sums over the 8-bit samples; whole numbers, so equal values give equal text everywhere."""
    x = np.frombuffer(payload, np.uint8)
    if not len(x):
        return f"{kind};frames=0"
    up = x > 127
    return f"{kind};frames={len(x)};sum={int(x.sum(dtype=np.int64))};square={int((x.astype(np.int64) ** 2).sum())};low={x.min()};high={x.max()};crossings={int((up[1:] != up[:-1]).sum())}"


SNIFFED = T.StructType([
    T.StructField("media_type", T.StringType()),
    T.StructField("valid", T.BooleanType()),
    T.StructField("payload", T.BinaryType()),
    T.StructField("feature", T.StringType()),
    T.StructField("embedded", T.ArrayType(T.StructType([T.StructField("type", T.StringType()), T.StructField("offset", T.LongType()), T.StructField("length", T.LongType())]))),
])
_EMBEDDED = pa.list_(pa.struct([("type", pa.string()), ("offset", pa.int64()), ("length", pa.int64())]))


def sniff(df: DataFrame, media: str = "media", declared: str | None = "declared_type") -> DataFrame:
    """df with media_type, valid, payload, feature, embedded."""
    bounded_batches(df.sparkSession)
    names = giving_way(df.columns, SNIFFED.names)
    said = F.col(f"`{declared}`").cast("string") if declared else F.lit(None).cast("string")
    source = df.select(*[F.col(f"`{n}`") for n in names], F.col(f"`{media}`").cast("binary").alias("\1media"), said.alias("\1said"))
    kept = source.drop("\1media", "\1said").schema.fields

    def run(batches):
        for batch in batches:
            kinds, valid, payloads, features, inside = [], [], [], [], []
            for value, said in zip(batch.column("\1media"), batch.column("\1said").to_pylist(), strict=True):
                data = value.as_py() or b""
                found = objects(data)
                whole = found.pop(0)[0] if found and found[0][1:] == (0, len(data)) else None
                payload = payload_of(whole, data) if whole else data
                kinds.append(whole or said)
                valid.append(whole is not None)
                payloads.append(payload)
                features.append(feature_of(whole or said or "unknown", payload))
                inside.append([{"type": k, "offset": a, "length": n} for k, a, n in found])
            new = [pa.array(kinds, pa.string()), pa.array(valid, pa.bool_()), pa.array(payloads, pa.binary()), pa.array(features, pa.string()), pa.array(inside, _EMBEDDED)]
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in names], *new], [*names, *SNIFFED.names])

    return source.mapInArrow(run, T.StructType([*kept, *SNIFFED.fields]))


def carve(sniffed: DataFrame, media: str = "media") -> DataFrame:
    """One row per embedded object, with its bytes, next to the row's other columns."""
    held = sniffed.withColumn("embedded", F.explode("embedded"))
    return held.withColumn("object", F.substring(F.col(media), F.col("embedded.offset").cast("int") + 1, F.col("embedded.length").cast("int")))
