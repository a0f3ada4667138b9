"""Benchmark decontamination by a positional inverted index.

`build_index` turns the training texts into index segments, as search engines do: a segment holds a few MB of whole
documents, its lexicon, and for each term the gaps between the term's positions.  Segments are rows of a table in the
shared folder, so the index is distributed by document, is written once, and needs no shuffle to build or to search.
Searching a segment takes each phrase's terms from the rarest in that segment on: positions of the rarest, moved by its
offset in the phrase, are possible beginnings, and each further term's list, moved likewise, is intersected with what is
left, until nothing is.  `proximity` finds spans that hold all terms of a phrase, in any order, in so many words more.

Scale: segments are independent tasks of bounded size.  The test items are searched in blocks of bounded size
(BLOCK_BYTES): only one block at a time is read by the driver and sent out, whatever the benchmark's size; its results are
written to the shared folder before it is destroyed and the next one is read.  Every block meets every segment, so a
benchmark of b blocks reads the index b times.  A document's results of several blocks meet in one grouping by (segment,
place), of documents that were hit.

Defined results: null and empty texts have no words and no hits; an item without words has no window and never occurs; an
item of fewer words than the window's is one window; items with equal text each count; null item ids are left out of the
list of ids but their windows count as hits and items; repeated documents each get their row; empty tables give no rows
or no hits; extra columns pass through the index unchanged, but one with the name of a result gives way to it.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lanework.llm.store import bounded_batches, gathered, giving_way, pack, task_numbers, unpack, written
from lanework.llm.words import ALNUM_LOWER, find_words

WINDOW = 10
#: Test items are searched in blocks of about so many bytes.
BLOCK_BYTES = 16 << 20
#: Empty positions between two documents of a segment, so that nothing spans two.
GAP = 1
INDEX = "seg long, docs binary, first binary, n_words binary, terms binary, starts binary, gaps binary"


class Segment:
    """Term -> ascending positions, over the documents of one segment."""

    def __init__(self, terms: pa.Array, starts: np.ndarray, gaps: np.ndarray, first: np.ndarray, n_words: np.ndarray):
        self.terms, self.starts, self.gaps, self.first, self.n_words = terms, starts, gaps, first, n_words

    @classmethod
    def of(cls, texts: pa.Array) -> Segment:
        words = find_words(texts, ALNUM_LOWER)
        n_words = np.diff(words.offsets)
        first = words.offsets[:-1] + GAP * np.arange(len(n_words))
        positions = np.arange(words.n, dtype=np.int64) + GAP * np.repeat(np.arange(len(n_words)), n_words)
        order = np.argsort(words.codes, kind="stable")
        starts = np.zeros(len(words.lexicon) + 1, np.int64)
        np.cumsum(np.bincount(words.codes, minlength=len(words.lexicon)), out=starts[1:])
        by_term = positions[order]
        gaps = np.diff(by_term, prepend=0)
        heads = starts[:-1]
        gaps[heads] = by_term[heads]
        return cls(words.lexicon, starts, gaps.astype(np.uint32), first, n_words)

    def row(self, seg: int, docs: pa.Table) -> list[pa.Array]:
        terms = pack(pa.record_batch([self.terms.cast(pa.large_binary())], ["t"]))
        blobs = [pack(docs), self.first.astype(np.int64).tobytes(), self.n_words.astype(np.int64).tobytes(), terms, self.starts.astype(np.uint32).tobytes(), self.gaps.tobytes()]
        return [pa.array([seg], pa.int64()), *[pa.array([b], pa.binary()) for b in blobs]]

    @classmethod
    def read(cls, row: dict) -> Segment:
        n = lambda name, kind: np.frombuffer(row[name], kind)
        return cls(unpack(row["terms"]).column(0).combine_chunks(), n("starts", np.uint32).astype(np.int64), n("gaps", np.uint32), n("first", np.int64), n("n_words", np.int64))

    def lookup(self, terms: pa.Array) -> np.ndarray:
        """Each term's place in the lexicon, -1 if it isn't there."""
        if not len(self.terms):
            return np.full(len(terms), -1)
        own = self.terms.chunk(0) if isinstance(self.terms, pa.ChunkedArray) else self.terms
        return pc.fill_null(pc.index_in(terms, value_set=own), -1).to_numpy(zero_copy_only=False).astype(np.int64)

    def counts(self, places: np.ndarray) -> np.ndarray:
        sizes = np.append(np.diff(self.starts), 0)
        return sizes[places]

    def postings(self, place: int) -> np.ndarray:
        return np.cumsum(self.gaps[self.starts[place] : self.starts[place + 1]], dtype=np.int64)

    def document_of(self, positions: np.ndarray) -> np.ndarray:
        """The last document that begins at or before each position and isn't empty."""
        return np.searchsorted(self.first + self.n_words, positions, "right")


def _held(sorted_: np.ndarray, asked: np.ndarray) -> np.ndarray:
    at = np.searchsorted(sorted_, asked)
    at[at == len(sorted_)] = 0
    return sorted_[at] == asked


class Phrases:
    """Distinct phrases over a lexicon of test terms, and the items that hold each."""

    def __init__(self, ids: list, texts: pa.Array, window: int = WINDOW):
        words = find_words(texts, ALNUM_LOWER)
        self.terms, self.ids = words.lexicon.cast(pa.large_binary()), ids
        items: dict[tuple[int, ...], list[int]] = defaultdict(list)
        for i, (a, b) in enumerate(zip(words.offsets[:-1], words.offsets[1:], strict=True)):
            own = words.codes[a:b].tolist()
            for at in range(max(1, len(own) - window + 1) if own else 0):
                held = items[tuple(own[at : at + window])]
                if not held or held[-1] != i:
                    held.append(i)
        self.phrases = list(items)
        self.items = list(items.values())
        # rectangular, -1 where a phrase is shorter
        width = max(map(len, self.phrases), default=1)
        self.matrix = np.array([[*p, *[-1] * (width - len(p))] for p in self.phrases], np.int64).reshape(-1, width)

    def search(self, segment: Segment) -> Iterator[tuple[int, np.ndarray]]:
        """(phrase, ascending beginnings) of the phrases that occur."""
        if not self.phrases:
            return
        places = segment.lookup(self.terms)
        counts = segment.counts(places)
        counts[places < 0] = 0
        often = np.where(self.matrix >= 0, counts[self.matrix], np.iinfo(np.int64).max)
        lists: dict[int, np.ndarray] = {}
        for p in np.flatnonzero(often.min(axis=1) > 0):
            own = self.matrix[p]
            left = None
            for offset in np.argsort(often[p], kind="stable")[: len(self.phrases[p])]:
                term = own[offset]
                if term not in lists:
                    lists[term] = segment.postings(places[term])
                left = lists[term] - offset if left is None else left[_held(lists[term], left + offset)]
                if not len(left):
                    break
            if len(left):
                yield int(p), left


def build_index(docs: DataFrame, text: str = "text", name: str = "index") -> DataFrame:
    """The index of all documents, stored in the shared folder.  The other columns stay with the documents."""
    bounded_batches(docs.sparkSession)
    numbers = task_numbers

    def run(batches):
        for seg, table in zip(numbers(), gathered(batches, text), strict=False):
            held = table.drop_columns([text])
            row = Segment.of(table.column(text)).row(seg, held.append_column("\0", pa.nulls(table.num_rows, pa.int8())))
            yield pa.RecordBatch.from_arrays(row, [f.split()[0] for f in INDEX.split(", ")])

    return written(docs.mapInArrow(run, INDEX), name)


def item_blocks(items: DataFrame, item_id: str = "item_id", text: str = "text", most: int = BLOCK_BYTES) -> Iterator[tuple[list, list[str]]]:
    """The test items in blocks of bounded size; the driver holds one block at a time."""
    ids, texts, size = [], [], 0
    for row in items.select(F.col(f"`{item_id}`").alias("i"), F.col(f"`{text}`").alias("t")).toLocalIterator():
        ids.append(row["i"])
        texts.append(row["t"])
        size += len(row["t"] or "") + 64
        if size >= most:
            yield ids, texts
            ids, texts, size = [], [], 0
    if ids:
        yield ids, texts


def _searched(index: DataFrame, block: Broadcast, window: int) -> DataFrame:
    """(seg, at, n_words, spans, items) of each document: [begin, end) of hit words, and the ids of items that occur."""
    state: dict[str, Phrases] = {}

    def run(batches):
        if "own" not in state:
            known, said = block.value
            state["own"] = Phrases(known, pa.array(said, pa.string()), window)
        phrases = state["own"]
        for batch in batches:
            for row in batch.to_pylist():
                segment = Segment.read(row)
                n = len(segment.n_words)
                spans: list[list] = [[] for _ in range(n)]
                items: list[set] = [set() for _ in range(n)]
                for p, begins in phrases.search(segment):
                    size = len(phrases.phrases[p])
                    for at, d in zip(begins.tolist(), segment.document_of(begins).tolist(), strict=True):
                        spans[d].append((at - int(segment.first[d]), at - int(segment.first[d]) + size))
                        items[d].update(phrases.items[p])
                merged = [[{"begin": a, "end": b} for a, b in merge(s)] for s in spans]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([row["seg"]] * n, pa.int64()),
                        pa.array(range(n), pa.int32()),
                        pa.array(segment.n_words, pa.int64()),
                        pa.array(merged, pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))),
                        pa.array([len(x) for x in items], pa.int64()),
                        pa.array([sorted(str(phrases.ids[i]) for i in x if phrases.ids[i] is not None) for x in items], pa.list_(pa.string())),
                    ],
                    ["seg", "at", "n_words", "spans", "n_items", "items"],
                )

    return index.drop("docs").mapInArrow(run, "seg long, at int, n_words long, spans array<struct<begin:long,end:long>>, n_items long, items array<string>")


def merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _joined(spans: Column) -> Column:
    """Sorted spans, those that meet made one."""
    empty = F.array().cast("array<struct<begin:long,end:long>>")
    last = lambda done: F.element_at(done, -1)
    longer = lambda done, s: F.struct(last(done)["begin"].alias("begin"), F.greatest(last(done)["end"], s["end"]).alias("end"))
    meets = lambda done, s: (F.size(done) > 0) & (F.try_element_at(done, F.lit(-1))["end"] >= s["begin"])
    return F.aggregate(F.array_sort(spans), empty, lambda done, s: F.when(meets(done, s), F.concat(F.slice(done, 1, F.size(done) - 1), F.array(longer(done, s)))).otherwise(F.concat(done, F.array(s))))


def find_exact(index: DataFrame, items: DataFrame, item_id: str = "item_id", text: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(seg, at, n_words, spans, n_items, items) for each indexed document."""
    context, blocks = index.sparkSession.sparkContext, item_blocks(items, item_id, text, block_bytes)
    block, more = next(blocks, ([], [])), next(blocks, None)
    if more is None:
        return _searched(index, context.broadcast(block), window)
    hits = None
    while block is not None:
        sent = context.broadcast(block)
        found = written(_searched(index, sent, window), "hits")
        sent.destroy()
        hits = found if hits is None else hits.unionByName(found.where("n_items > 0"))  # the first block's rows are all documents
        block, more = more, next(blocks, None)
    every = hits.groupBy("seg", "at").agg(F.max("n_words").alias("n_words"), F.flatten(F.collect_list("spans")).alias("spans"), F.sum("n_items").alias("n_items"), F.array_sort(F.flatten(F.collect_list("items"))).alias("items"))
    return every.withColumn("spans", _joined(F.col("spans")))


def find_near(index: DataFrame, phrases: list[str], slack: int = 3) -> DataFrame:
    """(seg, at, phrase, begin, end): the spans that hold all distinct words of a phrase within its length and `slack` words more."""
    ids = list(phrases)

    def run(batches):
        asked = find_words(pa.array(ids, pa.string()), ALNUM_LOWER)
        for batch in batches:
            for row in batch.to_pylist():
                segment, out = Segment.read(row), []
                places = segment.lookup(asked.lexicon.cast(pa.large_binary()))
                for i, (a, b) in enumerate(zip(asked.offsets[:-1], asked.offsets[1:], strict=True)):
                    if b > a:
                        out += [(i, d, x, y) for d, x, y in near(segment, places[np.unique(asked.codes[a:b])], int(b - a) + slack)]
                yield pa.RecordBatch.from_arrays([pa.array([row["seg"]] * len(out), pa.int64()), pa.array([o[1] for o in out], pa.int32()), pa.array([ids[o[0]] for o in out], pa.string()), pa.array([o[2] for o in out], pa.int64()), pa.array([o[3] for o in out], pa.int64())], ["seg", "at", "phrase", "begin", "end"])

    return index.drop("docs").mapInArrow(run, "seg long, at int, phrase string, begin long, end long")


def near(segment: Segment, places: np.ndarray, span: int) -> list[tuple[int, int, int]]:
    """(document, begin, end) of the merged spans of at most `span` words that hold all the terms."""
    if (places < 0).any():
        return []
    lists = sorted((segment.postings(p) for p in places), key=len)
    begins = lists[0]
    for other in lists[1:]:  # a first sieve, from the rarest: some posting of each term within reach
        begins = begins[np.searchsorted(other, begins + span, "left") > np.searchsorted(other, begins - span + 1, "left")]
    if not len(begins):
        return []
    every = np.sort(np.concatenate(lists))
    firsts = every[(d := np.searchsorted(begins, every + span, "left") > np.searchsorted(begins, every - span + 1, "left"))] if len(begins) else every[:0]
    ends = np.full(len(firsts), -1, np.int64)
    good = np.ones(len(firsts), bool)
    for own in lists:  # the next posting of each term at or after a possible beginning
        at = np.searchsorted(own, firsts)
        good &= at < len(own)
        ends = np.maximum(ends, own[np.minimum(at, len(own) - 1)] + 1)
    docs = segment.document_of(firsts)
    good &= (ends - firsts <= span) & (segment.document_of(np.maximum(ends - 1, 0)) == docs)
    out: dict[int, list] = defaultdict(list)
    for doc, x, y in zip(docs[good].tolist(), firsts[good].tolist(), ends[good].tolist(), strict=True):
        out[doc].append((x - int(segment.first[doc]), y - int(segment.first[doc])))
    return [(doc, x, y) for doc, s in out.items() for x, y in merge(s)]


def with_columns(index: DataFrame, found: DataFrame, schema: T.StructType, keep: list[str]) -> DataFrame:
    """The documents' own columns beside what was found."""
    outputs = [c for c in found.columns if c not in ("seg", "at")]
    keep = giving_way(keep, outputs)
    doc = T.StructType([f for name in keep for f in schema.fields if f.name == name])

    def run(batches):
        for batch in batches:
            for seg, blob in zip(batch.column("seg").to_pylist(), batch.column("docs"), strict=True):
                table = unpack(blob.as_buffer())
                n = table.num_rows
                own = pa.StructArray.from_arrays([table.column(k).combine_chunks() for k in keep], keep) if n else pa.array([], pa.null())
                if n:
                    yield pa.RecordBatch.from_arrays([pa.array([seg] * n, pa.int64()), pa.array(range(n), pa.int32()), own], ["seg", "at", "\1doc"])

    own = index.select("seg", "docs").mapInArrow(run, T.StructType([T.StructField("seg", T.LongType()), T.StructField("at", T.IntegerType()), T.StructField("\1doc", doc)]))
    return own.join(found, ["seg", "at"]).select(*[F.col("\1doc")[k].alias(k) for k in keep], *outputs)
