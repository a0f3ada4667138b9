"""Substring dedup by seed and extend.

A window is so many consecutive words of one document; it is repeated if the same words also begin anywhere else.  Every
window holds one anchor: of its K-word seeds the one with the least hash (winnowing; of equal ones the rightmost), so
equal windows hold equal anchors at the same place, and a run of neighbouring windows shares an anchor.

1. Seed: documents meet on anchors.  Anchors are hashed into buckets; each segment of documents sends each bucket its
   distinct anchors once, and is told which of them occur elsewhere, or more than once in itself.
2. Extend: only around such anchors, windows are extended from the anchor to both sides and fingerprinted whole (two mixes of
   64-bit word hashes); equal ones meet in the anchor's bucket.  So a group of m copies costs m fingerprints for each of its
   windows and not m * m comparisons; matches are not grown word by word.
3. Keep: neighbouring repeated windows make up maximal repeats, [begin, end) in words of the document.

Scale: documents are packed into segments of a few MB, written once to the shared folder.  What a segment sends to a
bucket is sorted, distinct and packed into one binary value, so an anchor or passage that a third of all documents hold
counts once for each segment (aggregation before the shuffle).  The number of buckets grows with the number of segments,
so a bucket's size doesn't, but for a bucket with an anchor that very many segments hold: it gets a message from each of
these, and is one task (some 40 bytes a message: 25 million segments, 50 TB of text, would ask for about 1 GB).  Texts move
twice, compressed, to meet the answers for their segment.  A worker holds some thirty times a segment, which is 2 MB or one
longer text: a text of 100 MB asks for about 3 GB.

Defined results: null and empty texts have no words and lose none; documents of fewer words than the window lose none;
repeated rows are each other's repeats, whatever their ids; an empty table gives an empty table; other columns pass
unchanged, but one with the name of an output gives way to it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lanework.llm.store import bounded_batches, giving_way, segments, unpack
from lanework.llm.words import PLAIN, Words, find_words, sliding_argmin, window_hashes

WINDOW = 35
SEED = 12
#: Segments for each bucket: a bucket gets about as many anchors as so many segments have.
SEGMENTS_A_BUCKET = 16
#: Text in a segment: what a worker holds for it is some thirty times as much.
SEGMENT_BYTES = 2 << 20

MESSAGE = "bucket long, seg long, part binary"
REPLY = "seg long, bucket long, bits binary"


class Runs:
    """The windows of some texts, by their anchors."""

    def __init__(self, words: Words, window: int, seed: int):
        self.words, self.window = words, window
        own = words.hashes()
        room = words.room()
        seeds = window_hashes(own, seed)
        anchors = sliding_argmin(seeds, window - seed + 1)
        self.begins = np.flatnonzero(room >= window)  # of windows inside one text
        self.at = anchors[self.begins]
        self.anchor = seeds[self.at] if len(self.at) else np.zeros(0, np.uint64)
        self.own = own

    def distinct(self) -> tuple[np.ndarray, np.ndarray]:
        """Distinct anchors, ascending, and for each whether it lies at several places here."""
        first = np.ones(len(self.at), bool)
        first[1:] = self.at[1:] != self.at[:-1]
        places = np.unique(self.at[first])
        return _counted(self.anchor_of(places))

    def anchor_of(self, places: np.ndarray) -> np.ndarray:
        order = np.argsort(self.at, kind="stable")
        return self.anchor[order][np.searchsorted(self.at[order], places)] if len(places) else np.zeros(0, np.uint64)

    def fingerprints(self, chosen: np.ndarray) -> np.ndarray:
        """Two 64-bit hashes of each chosen window, as one record each."""
        out = np.zeros(len(chosen), [("a", "<u8"), ("b", "<u8")])
        out["a"] = window_hashes(self.own, self.window, 0)[self.begins[chosen]]
        out["b"] = window_hashes(self.own, self.window, 1)[self.begins[chosen]]
        return out


def _counted(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(values):
        return values, np.zeros(0, bool)
    order = np.sort(values, order=values.dtype.names) if values.dtype.names else np.sort(values)
    new = np.ones(len(order), bool)
    new[1:] = order[1:] != order[:-1]
    at = np.flatnonzero(new)
    return order[at], np.diff(np.append(at, len(order))) > 1


def _flagged(values: np.ndarray, several: np.ndarray) -> bytes:
    """Values, then a bit for each."""
    return len(values).to_bytes(8, "little") + values.tobytes() + np.packbits(several).tobytes()


def _parts(blob: bytes, kind: np.dtype) -> tuple[np.ndarray, np.ndarray]:
    n = int.from_bytes(blob[:8], "little")
    size = n * kind.itemsize
    return np.frombuffer(blob, kind, n, 8), np.unpackbits(np.frombuffer(blob, np.uint8, offset=8 + size), count=n).astype(bool)


ANCHOR = np.dtype("<u8")
PRINT = np.dtype([("a", "<u8"), ("b", "<u8")])


def _answer(kind: np.dtype):
    """Of a bucket's messages: which values occur several times, in all.  The answers have the messages' order."""

    def run(table: pa.Table) -> pa.Table:
        parts = [_parts(x.as_buffer().to_pybytes(), kind) for x in table.column("part")]
        values = np.concatenate([p[0] for p in parts])
        several = np.concatenate([p[1] for p in parts])
        if kind.names:  # equality of records, by dense ranks of the first half, then of both
            _, a = np.unique(values["a"], return_inverse=True)
            _, b = np.unique(values["b"], return_inverse=True)
            values = a.astype(np.int64) * (int(b.max(initial=0)) + 1) + b
        _, code, count = np.unique(values, return_inverse=True, return_counts=True)
        hot = np.bincount(code, several, len(count)) + count > 1
        bits, at = [], 0
        for own, _ in parts:
            bits.append(np.packbits(hot[code[at : at + len(own)]]).tobytes())
            at += len(own)
        return pa.table([table.column("seg"), table.column("bucket"), pa.array(bits, pa.binary())], names=["seg", "bucket", "bits"])

    return run


def _messages(seg: int, buckets: np.ndarray, values: np.ndarray, several: np.ndarray) -> pa.RecordBatch:
    """values: in the order of buckets, ascending inside each."""
    at = np.flatnonzero(np.append(True, buckets[1:] != buckets[:-1])) if len(buckets) else np.zeros(0, np.int64)
    ends = np.append(at[1:], len(buckets))
    parts = [_flagged(values[a:b], several[a:b]) for a, b in zip(at, ends, strict=True)] if len(at) else []
    return pa.RecordBatch.from_arrays([pa.array(buckets[at].astype(np.int64), pa.int64()), pa.array([seg] * len(at), pa.int64()), pa.array(parts, pa.binary())], ["bucket", "seg", "part"])


def _by_bucket(values: np.ndarray, several: np.ndarray, n_buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    buckets = (values >> np.uint64(20)) % np.uint64(n_buckets)
    order = np.argsort(buckets, kind="stable")
    return buckets[order], values[order], several[order]


def _repeated_anchors(runs: Runs, n_buckets: int, replies: dict[int, bytes]) -> np.ndarray:
    """For each window, whether its anchor also lies elsewhere."""
    buckets, values, _ = _by_bucket(*runs.distinct(), n_buckets)
    flags = _unpacked(buckets, replies)
    known = np.sort(values[flags])
    at = np.searchsorted(known, runs.anchor)
    at[at == len(known)] = 0
    return known[at] == runs.anchor if len(known) else np.zeros(len(runs.anchor), bool)


def _unpacked(buckets: np.ndarray, replies: dict[int, bytes]) -> np.ndarray:
    out = []
    for b, n in zip(*np.unique(buckets, return_counts=True), strict=True):
        out.append(np.unpackbits(np.frombuffer(replies[int(b)], np.uint8), count=int(n)).astype(bool))
    return np.concatenate(out) if out else np.zeros(0, bool)


def _window_messages(runs: Runs, n_buckets: int, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bucket, print, several) of the distinct chosen windows, and each chosen window's place among them."""
    prints = runs.fingerprints(chosen)
    buckets = (runs.anchor[chosen] >> np.uint64(20)) % np.uint64(n_buckets)
    order = np.lexsort((prints["b"], prints["a"], buckets))
    b, p = buckets[order], prints[order]
    new = np.ones(len(order), bool)
    new[1:] = (b[1:] != b[:-1]) | (p[1:] != p[:-1])
    at = np.flatnonzero(new)
    place = np.empty(len(order), np.int64)
    place[order] = np.cumsum(new) - 1
    several = np.diff(np.append(at, len(order))) > 1
    return b[at], p[at], several, place, at


def repeats(df: DataFrame, text: str = "text", window: int = WINDOW, seed: int = SEED, result=None, fields: list[T.StructField] | None = None) -> DataFrame:
    """df with n_words, n_removed, repeats (maximal, in words) and kept (the words outside them, joined by one space).

    `result` can replace the last step: a function of (table, words, removed mask of words) that gives columns for `fields`.
    """
    fields = fields or FIELDS
    if not 0 < seed <= window:
        raise ValueError("a seed is no longer than a window")
    spark, names = df.sparkSession, giving_way(df.columns, [f.name for f in fields])
    bounded_batches(spark)
    schema = df.select(*[F.col(f"`{n}`").cast("string").alias(n) if n == text else F.col(f"`{n}`") for n in names]).schema
    # the text is held once: as its own column where that passes on, else beside the others
    held = [F.col(f"`{n}`") for n in names if n != text]
    own = segments(df.select(*held, F.col(f"`{text}`").cast("string").alias("\1text")), "\1text", "substring", SEGMENT_BYTES)
    n_segments = own.count()
    n_buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), n_segments // SEGMENTS_A_BUCKET, 1)
    finish = result or _kept

    def runs_of(blob) -> tuple[pa.Table, Runs]:
        table = unpack(blob.as_buffer())
        return table, Runs(find_words(table.column("\1text"), PLAIN), window, seed)

    def seeds(batches):
        for batch in batches:
            for seg, blob in zip(batch.column("seg").to_pylist(), batch.column("blob"), strict=True):
                yield _messages(seg, *_by_bucket(*runs_of(blob)[1].distinct(), n_buckets))

    def extended(batches):
        for batch in batches:
            for seg, blob, replies in zip(batch.column("seg").to_pylist(), batch.column("blob"), batch.column("seeds").to_pylist(), strict=True):
                runs = runs_of(blob)[1]
                chosen = np.flatnonzero(_repeated_anchors(runs, n_buckets, {r["bucket"]: r["bits"] for r in replies or []}))
                buckets, prints, several, _, _ = _window_messages(runs, n_buckets, chosen)
                yield _messages(seg, buckets, prints, several)

    def kept(batches):
        for batch in batches:
            for i, blob in enumerate(batch.column("blob")):
                table, runs = runs_of(blob)
                replies = {r["bucket"]: r["bits"] for r in batch.column("seeds")[i].as_py() or []}
                answers = {r["bucket"]: r["bits"] for r in batch.column("windows")[i].as_py() or []}
                chosen = np.flatnonzero(_repeated_anchors(runs, n_buckets, replies))
                buckets, _, _, place, _ = _window_messages(runs, n_buckets, chosen)
                hot = runs.begins[chosen[_unpacked(buckets, answers)[place]]] if len(chosen) else chosen
                cover = np.zeros(runs.words.n + 1, np.int32)
                np.add.at(cover, hot, 1)
                np.add.at(cover, hot + window, -1)
                removed = np.cumsum(cover)[:-1] > 0
                new = finish(table, runs.words, removed)
                for b in pa.table([*[table.column("\1text" if n == text else n) for n in names], *new], names=[*names, *[f.name for f in fields]]).combine_chunks().to_batches():
                    yield b

    def answers(messages: DataFrame, kind: np.dtype, name: str) -> DataFrame:
        found = messages.groupBy("bucket").applyInArrow(_answer(kind), REPLY)
        return found.groupBy("seg").agg(F.collect_list(F.struct("bucket", "bits")).alias(name))

    first = answers(own.mapInArrow(seeds, MESSAGE), ANCHOR, "seeds")
    told = own.join(first, "seg", "left").select("seg", "blob", "seeds")
    second = answers(told.mapInArrow(extended, MESSAGE), PRINT, "windows")
    return told.join(second, "seg", "left").select("blob", "seeds", "windows").mapInArrow(kept, T.StructType([*schema.fields, *fields]))


FIELDS = [
    T.StructField("n_words", T.LongType()),
    T.StructField("n_removed", T.LongType()),
    T.StructField("repeats", T.ArrayType(T.StructType([T.StructField("begin", T.LongType()), T.StructField("end", T.LongType())]))),
    T.StructField("kept", T.StringType()),
]


def _spans(removed: np.ndarray) -> list[dict[str, int]]:
    edges = np.flatnonzero(np.diff(removed.astype(np.int8), prepend=0, append=0))
    return [{"begin": a, "end": b} for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True)]


def kept_texts(words: Words, removed: np.ndarray) -> list[bytes]:
    """Each text's words outside the repeats, joined by one space.  bytes.split() separates at just these words' separators."""
    data = words.data.tobytes()
    starts, ends = words.starts, words.ends
    out = []
    for a, b in zip(words.offsets[:-1].tolist(), words.offsets[1:].tolist(), strict=True):
        live = [(s["begin"] + a, s["end"] + a) for s in _spans(~removed[a:b])]
        out.append(b" ".join(b" ".join(data[starts[x] : ends[y - 1]].split()) for x, y in live))
    return out


def _kept(table: pa.Table, words: Words, removed: np.ndarray) -> list[pa.Array]:
    sums = np.zeros(words.n + 1, np.int64)
    np.cumsum(removed, out=sums[1:])
    o = words.offsets
    spans = [_spans(removed[a:b]) if n else [] for a, b, n in zip(o[:-1], o[1:], np.diff(sums[o]), strict=True)]
    kept = [x.decode("utf-8") for x in kept_texts(words, removed)]
    return [pa.array(np.diff(o), pa.int64()), pa.array(np.diff(sums[o]), pa.int64()), pa.array(spans, pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))), pa.array(kept, pa.string())]
