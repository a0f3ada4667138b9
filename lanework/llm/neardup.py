"""Similarity join of documents by the Jaccard similarity of their sets of word n-grams, with a MinHash LSH forest.

1. Sign: each distinct text gets a label in each of TREES trees: DEPTH MinHash values of its n-grams, 16 bits each.
2. Sort: the labels of a tree are sorted, which makes them a prefix trie: texts whose labels share their first d values are
   neighbours.  Each row knows how many values it shares with the row before it, its level, and is tied to the first text
   of the run that shares so many: never all pairs.
3. Verify: texts tied at full depth make up candidate groups, inside which they are compared exactly, by their n-grams, in
   blocks of bounded bytes against blocks, each pair of blocks a task.  What comes back is counts and one tie for each
   text, not pairs.
4. Shorten: a pair of similarity s shares d values in some tree with probability 1 - (1 - s^d)^TREES.  From the verified
   pairs, each weighted by one over its chance of being found at full depth, follows the recall that each shorter prefix
   would have; prefixes are shortened just as far as the target recall asks for.  At most they are shortened to where
   pairs at the threshold itself would reach the target (`least_depth`).  Only candidate groups that grow by this are
   verified again.  Groups are components of verified ties only.

Equal texts are one class, found first; a class is signed and compared once, with its size as a weight.  So an exact copy
costs a hash, however many there are.

Scale: full depth comes first, so texts of little similarity hardly meet: at 0.5, one pair in nine shares a label of 8 in
32 trees, at 0.3 one in five hundred (with prefixes of 4 in 16 trees it was two in three and one in eight).  The sort is
by range, on label and text, so a prefix that a third of all texts share is cut into many tasks.  Texts move once, to meet
their group; blocks get sorted n-gram hashes.  A group of m different near-equal texts takes m * m / 2 comparisons, by
matrix products: counting each of their links needs no less; its hashes are sent once for each BLOCK_BYTES of the group.

Defined results: a text of fewer than n words, but not none, has one n-gram, all its words; null and empty texts are equal
texts (one class) and similar to no other; repeated rows are members of one class; ties of similarity at the threshold
count as similar; an empty table gives an empty table; extra columns aren't read.  A text is known by 192 bits; n-grams by
64.  A task of step 3 holds two blocks; a single text's hashes, 8 bytes a word, are never split, so a text of 100 MB asks
for some 300 MB there.  Intersections are exact up to 2^24 n-grams a text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lanework.llm.graph import components
from lanework.llm.store import bounded_batches, written
from lanework.llm.words import PLAIN_LOWER, chunks, find_words, mix, window_hashes

NGRAM = 5
THRESHOLD = 0.8
TARGET_RECALL = 0.9999
TREES = 32
DEPTH = 8
#: A block of a candidate group holds about so many bytes of n-gram hashes, and about so many texts at most.
BLOCK_BYTES = 2 << 20
BLOCK_TEXTS = 512
#: Columns of an incidence matrix at a time.
WIDE = 4096
#: N-grams that are hashed at a time, so that they stay in a core's cache.
NEAR = 1 << 15
#: Keys of texts that a task remembers, so as not to sign a copy again.
REMEMBERED = 500_000


def met(similarity: np.ndarray | float, depth: int, trees: int = TREES) -> np.ndarray | float:
    """How likely two texts share their first `depth` values in some tree."""
    return 1 - (1 - similarity**depth) ** trees


def least_depth(threshold: float = THRESHOLD, target: float = TARGET_RECALL, trees: int = TREES, depth: int = DEPTH) -> int:
    """The longest prefix with which a pair at the threshold reaches the target; at least 1."""
    while depth > 1 and met(threshold, depth, trees) < target:
        depth -= 1
    return depth


def depth_for(found: list[float], threshold: float = THRESHOLD, target: float = TARGET_RECALL, trees: int = TREES, depth: int = DEPTH) -> int:
    """How far prefixes are shortened; found: sums over the pairs verified at full depth, see `weighed`.

    One pair at the threshold is counted in, so that without any pairs the answer is the least depth.
    """
    least = least_depth(threshold, target, trees, depth)
    sums = np.array(found, np.float64) + weighed(np.array([threshold]), depth, least, trees)[0]
    for i, d in enumerate(range(depth, least, -1)):
        if sums[i + 1] / sums[0] >= target:
            return d
    return least


def weighed(similarity: np.ndarray, depth: int, least: int, trees: int = TREES) -> np.ndarray:
    """For each pair found at full depth: how many such pairs it stands for, and how many of these each depth finds."""
    own = met(similarity, depth, trees)
    return np.stack([1 / own, *[met(similarity, d, trees) / own for d in range(depth, least - 1, -1)]], -1)


def ngrams(texts: pa.Array, n: int = NGRAM) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all n-grams of whole texts, with repeats, and where each text's begin and end."""
    words = find_words(texts, PLAIN_LOWER)
    own = words.hashes()
    counts = np.diff(words.offsets)
    grams = window_hashes(own, n)[np.flatnonzero(words.room() >= n)] if words.n >= n else np.zeros(0, np.uint64)
    offsets = np.zeros(len(counts) + 1, np.int64)
    short = np.flatnonzero((counts > 0) & (counts < n))
    if not len(short):
        np.cumsum(np.maximum(counts - n + 1, 0), out=offsets[1:])
        return grams, offsets
    each = np.where(counts >= n, counts - n + 1, (counts > 0).astype(np.int64))
    np.cumsum(each, out=offsets[1:])
    out = np.empty(offsets[-1], np.uint64)
    is_short = np.zeros(offsets[-1], bool)
    is_short[offsets[short]] = True
    out[~is_short] = grams
    for i in short.tolist():
        a, b = words.offsets[i], words.offsets[i + 1]
        out[offsets[i]] = window_hashes(own[a:b], b - a)[0] ^ np.uint64(b - a)
    return out, offsets


def _multipliers(n: int) -> np.ndarray:
    return np.random.default_rng(20070101).integers(1, 1 << 63, n, np.uint64) * np.uint64(2) + np.uint64(1)


def signatures(texts: pa.Array, trees: int = TREES, depth: int = DEPTH, n: int = NGRAM) -> tuple[np.ndarray, np.ndarray]:
    """Each text's number of n-grams, and its labels of all trees, one after the other; those of no words are 0."""
    grams, offsets = ngrams(texts, n)
    sizes = np.diff(offsets)
    live = np.flatnonzero(sizes)
    out = np.zeros((len(sizes), trees * depth), ">u2")
    grams, begins = mix(grams), offsets[live]
    factors = _multipliers(trees * depth)
    at = 0
    while at < len(live):
        end = max(at + 1, int(np.searchsorted(begins, begins[at] + NEAR)))
        a, b = begins[at], begins[end] if end < len(live) else offsets[-1]
        least = np.empty((len(factors), end - at), np.uint64)
        for first in range(a, b, NEAR) if end == at + 1 else [a]:  # a long text goes in pieces of its own
            some, starts = (grams[first : min(first + NEAR, b)], np.zeros(1, np.int64)) if end == at + 1 else (grams[a:b], begins[at:end] - a)
            for i, x in enumerate(factors):
                now = np.minimum.reduceat(some * x, starts)
                least[i] = now if first == a else np.minimum(least[i], now)
        out[live[at:end]] = (mix(least) >> np.uint64(48)).T
        at = end
    return sizes, out


def signed(keyed: DataFrame, trees: int = TREES, depth: int = DEPTH, n: int = NGRAM) -> DataFrame:
    """(id, k, h, class_id, size, n, labels), one row for each distinct text, in the shared folder; `id` numbers them."""

    def run(batches):
        seen: set = set()
        for whole in batches:
            for batch in chunks(whole, "text"):
                keys = list(zip(batch.column("k").to_pylist(), batch.column("h").to_pylist(), strict=True))
                new = []
                for i, key in enumerate(keys):
                    if key not in seen:
                        seen.add(key)
                        new.append(i)
                if len(seen) > REMEMBERED:
                    seen.clear()
                sizes, labels = signatures(batch.column("text").take(pa.array(new, pa.int64())), trees, depth, n)
                counts, blobs = np.zeros(len(keys), np.int64), [None] * len(keys)
                counts[new] = sizes
                for i, row in zip(new, labels, strict=True):
                    blobs[i] = row.tobytes()
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("k"), batch.column("h"), pa.array(counts), pa.array(blobs, pa.binary())], ["doc_id", "k", "h", "n", "labels"])

    schema = keyed.select("doc_id", "k", "h").schema.add("n", "long").add("labels", "binary")
    classes = keyed.select("doc_id", "k", "h", "text").mapInArrow(run, schema).groupBy("k", "h")
    classes = classes.agg(F.min("doc_id").alias("class_id"), F.count(F.lit(1)).alias("size"), F.max("n").alias("n"), F.first("labels", ignorenulls=True).alias("labels"))
    return written(classes.withColumn("id", F.monotonically_increasing_id()), "texts")


class Trie:
    """The rows of one part of the sorted labels: their levels, and the first text of the run at each level."""

    def __init__(self, depth: int, least: int):
        self.depth, self.least = depth, least
        self.last: tuple[int, np.ndarray] | None = None
        self.heads = np.full(depth + 1, -1, np.int64)  # by level

    def ties(self, tree: np.ndarray, labels: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, first text of its run, level) of the rows of level `least` or more, for rows in order."""
        before = np.empty_like(labels)
        before[1:] = labels[:-1]
        same = np.empty(len(tree), bool)
        same[1:] = tree[1:] == tree[:-1]
        same[0], before[0] = (self.last[0] == tree[0], self.last[1]) if self.last else (False, labels[0])
        level = np.where(same, np.cumprod(labels == before, 1).sum(1), 0)
        self.last = tree[-1], labels[-1]
        u, v, w = [], [], []
        for d in range(self.least, self.depth + 1):
            heads = np.maximum.accumulate(np.where(level < d, np.arange(len(ids)), -1))
            head = np.where(heads >= 0, ids[heads], self.heads[d])
            at = np.flatnonzero((level == d) & (head != ids))
            u.append(ids[at])
            v.append(head[at])
            w.append(np.full(len(at), d, np.int32))
            self.heads[d] = head[-1]
        return np.concatenate(u), np.concatenate(v), np.concatenate(w)


def ties(texts: DataFrame, trees: int = TREES, depth: int = DEPTH, least: int = 1) -> DataFrame:
    """(u, v, level), in the shared folder: texts next to each other in some tree's sorted labels, and how many values they share."""
    width = 2 * depth
    rows = texts.where("n > 0").select("id", "labels", F.explode(F.sequence(F.lit(0), F.lit(trees - 1))).alias("tree"))
    rows = rows.select("tree", F.expr(f"substring(labels, tree * {width} + 1, {width})").alias("label"), "id")

    def run(batches):
        own, edge = Trie(depth, least), None
        for batch in batches:
            if not batch.num_rows:
                continue
            tree, ids = batch.column("tree").to_numpy(), batch.column("id").to_numpy()
            labels = np.frombuffer(b"".join(batch.column("label").to_pylist()), ">u2").reshape(-1, depth)
            if edge is None:
                edge = [(tree[0], labels[0].tobytes(), ids[0])]
            edge[1:] = [(tree[-1], labels[-1].tobytes(), ids[-1])]
            u, v, level = own.ties(tree, labels, ids)
            yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v), pa.array(level), pa.nulls(len(u), pa.int32()), pa.nulls(len(u), pa.binary())], ["u", "v", "level", "tree", "label"])
        for t, label, i in edge or []:
            yield pa.RecordBatch.from_arrays([pa.array([int(i)], pa.int64()), pa.nulls(1, pa.int64()), pa.array([-1], pa.int32()), pa.array([int(t)], pa.int32()), pa.array([label], pa.binary())], ["u", "v", "level", "tree", "label"])

    found = rows.repartitionByRange("tree", "label", "id").sortWithinPartitions("tree", "label", "id").mapInArrow(run, "u long, v long, level int, tree int, label binary")
    found = written(found, "ties")
    # where one part of the order ends and the next begins: two rows for each part
    order = Window.orderBy("tree", "label", "u")
    before = lambda c: F.lag(c).over(order)
    shared = F.coalesce(*[F.when(F.substring("label", 1, 2 * d) == F.substring(before("label"), 1, 2 * d), d) for d in range(depth, least - 1, -1)])
    edges = found.where("level = -1").select("u", before("u").alias("v"), F.when(before("tree") == F.col("tree"), shared).alias("level")).where("level is not null and u <> v")
    return found.where("level > 0").select("u", "v", "level").unionByName(edges)


def _compare(threshold: float, depth: int, least: int, trees: int):
    def run(table: pa.Table) -> pa.Table:
        m = table.num_rows
        parts = [np.frombuffer(x.as_buffer(), np.uint64) for x in table.column("grams")]
        sizes = np.array([len(x) for x in parts], np.float64)
        owner = np.repeat(np.arange(m), sizes.astype(np.int64))
        _, code = np.unique(np.concatenate(parts), return_inverse=True)
        often = np.bincount(code) > 1
        common = np.zeros((m, m), np.float32)
        place = np.cumsum(often) - 1
        held = often[code]
        owner, column = owner[held], place[code[held]]
        order = np.argsort(column, kind="stable")
        owner, column = owner[order], column[order]
        for first in range(0, int(often.sum()), WIDE):
            a, b = np.searchsorted(column, [first, first + WIDE])
            part = np.zeros((m, WIDE), np.float32)
            part[owner[a:b], column[a:b] - first] = 1
            common += part @ part.T
        union = sizes[:, None] + sizes[None, :] - common
        similar = (common >= threshold * union - 1e-6) & (common > 0)
        np.fill_diagonal(similar, False)
        block, i, j = (table.column(c).to_numpy() for c in ("b", "i", "j"))
        if i[0] != j[0]:
            similar &= block[:, None] != block[None, :]
        x, y = np.nonzero(similar)
        weights = weighed(np.minimum(common[x, y] / union[x, y], 1.0).astype(np.float64), depth, least, trees)
        found = np.stack([np.bincount(x, w, m) for w in weights.T], 1)
        ids = table.column("id").to_numpy()
        root = np.arange(m)
        for k in range(m):  # one tie for each text: to the least text that reaches it
            if root[k] == k:
                todo = [k]
                while todo:
                    more = np.flatnonzero(similar[todo.pop()] & (root == np.arange(m)) & (np.arange(m) > k))
                    root[more] = k
                    todo += more.tolist()
        docs = similar @ table.column("size").to_numpy()
        return pa.table([table.column("id"), pa.array(similar.sum(1), pa.int64()), pa.array(docs, pa.int64()), pa.array(ids[root], pa.int64()), pa.array(found.tolist(), pa.list_(pa.float64()))], names=["id", "n_texts", "n_docs", "tie", "found"])

    return run


def verified(keyed: DataFrame, texts: DataFrame, members: DataFrame, threshold: float, depth: int, least: int, trees: int, n: int, block_bytes: int) -> DataFrame:
    """(id, n_texts, n_docs, tie, found), in the shared folder: for each of `members` (id, comp) its links, by pairs of blocks.

    tie: a text that its links lead to; found: see `weighed`, summed over its links.
    """
    members = texts.select("id", "k", "h", "class_id", "size", "n").join(members, "id")
    blocks = F.greatest(F.ceil(F.sum(F.col("n") * 8) / block_bytes), F.ceil(F.count(F.lit(1)) / BLOCK_TEXTS)).cast("int")
    members = members.join(members.groupBy("comp").agg(blocks.alias("blocks")), "comp").withColumn("b", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")).drop("n")

    def hashed(batches):
        names = ["id", "size", "comp", "blocks", "b"]
        for whole in batches:
            for batch in chunks(whole, "text"):
                grams, offsets = ngrams(batch.column("text"), n)
                own = [np.unique(grams[a:b]).tobytes() for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], pa.array(own, pa.binary())], [*names, "grams"])

    # a class is one row of text: that of its least doc_id, so copies are dealt out by their own ids and go no further
    rows, own = keyed.select("k", "h", "doc_id", "text").alias("r"), members.alias("m")
    same = (F.col("r.k") == F.col("m.k")) & (F.col("r.h") == F.col("m.h")) & F.col("r.doc_id").eqNullSafe(F.col("m.class_id"))
    found = rows.join(own, same).select("r.*", *[F.col(f"m.{c}") for c in ("id", "size", "comp", "blocks", "b")]).dropDuplicates(["k", "h", "doc_id"]).drop("k", "h", "doc_id")
    found = found.mapInArrow(hashed, "id long, size long, comp long, blocks int, b int, grams binary")
    dealt = found.select("id", "size", "comp", "b", "grams", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("o"))
    dealt = dealt.select("id", "size", "comp", "b", "grams", F.least("b", "o").alias("i"), F.greatest("b", "o").alias("j"))
    return written(dealt.groupBy("comp", "i", "j").applyInArrow(_compare(threshold, depth, least, trees), "id long, n_texts long, n_docs long, tie long, found array<double>"), "links")


def linked(keyed: DataFrame, texts: DataFrame, threshold: float = THRESHOLD, target: float = TARGET_RECALL, n: int = NGRAM, trees: int = TREES, depth: int = DEPTH, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(id, n_texts, n_docs, tie) of each text with candidates, in parts to be added up."""
    least = least_depth(threshold, target, trees, depth)
    tied = ties(texts, trees, depth, least)
    deep = components(tied.where(F.col("level") == depth), "candidates")
    check = lambda members: verified(keyed, texts, members, threshold, depth, least, trees, n, block_bytes)
    links = check(deep.select(F.col("node").alias("id"), F.col("root").alias("comp")))
    sums = links.select(F.posexplode("found").alias("i", "x")).groupBy("i").agg(F.sum("x").alias("x")).collect()  # a row for each depth
    found = [0.0] * (depth - least + 2)
    for r in sums:
        found[r["i"]] = r["x"]
    shorter = depth_for(found, threshold, target, trees, depth)
    if shorter == depth:
        return links.drop("found")
    # candidate groups that shorter prefixes join, with each other or with single texts
    more, group = tied.where((F.col("level") < depth) & (F.col("level") >= shorter)).select("u", "v").distinct(), deep.withColumnRenamed("root", "g")
    for c in ("u", "v"):
        more = more.join(group.withColumnRenamed("node", c), c, "left").withColumn(c, F.coalesce("g", c)).drop("g")
    joined = written(components(more, "shortened").withColumnRenamed("node", "g").withColumnRenamed("root", "comp"), "joined")
    members = joined.join(group, "g", "left").select(F.coalesce("node", "g").alias("id"), "comp")
    again = check(members)
    return links.join(again.select("id").distinct(), "id", "left_anti").unionByName(again).drop("found")


def _keyed(docs: DataFrame, text: str, doc_id: str) -> DataFrame:
    whole: Column = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    return docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.xxhash64(whole).alias("k"), F.unhex(F.md5(whole)).alias("h"), whole.alias("text"))


def similar_groups(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", threshold: float = THRESHOLD, target: float = TARGET_RECALL, n: int = NGRAM, **options) -> DataFrame:
    """(doc_id, class_id, class_size, n_links, n_text_links, group_id, group_key), one row for each row.

    class_id: the least doc_id of the documents with just this text.  n_links: how many other documents are similar to it,
    copies included; n_text_links: how many different texts.  group_id: the least class_id that links lead to; group_key:
    the group's number in this run.
    """
    bounded_batches(docs.sparkSession)
    keyed = _keyed(docs, text, doc_id)
    texts = signed(keyed, options.get("trees", TREES), options.get("depth", DEPTH), n)
    links = linked(keyed, texts, threshold, target, n, **options)
    counts = links.groupBy("id").agg(F.sum("n_texts").alias("n_texts"), F.sum("n_docs").alias("n_docs"))
    groups = components(links.where("id <> tie").select(F.col("id").alias("u"), F.col("tie").alias("v")), "groups").withColumnRenamed("node", "id")
    met = counts.join(groups, "id", "left")  # texts with candidates only
    first = texts.select("id", "class_id").join(groups, "id").groupBy("root").agg(F.min("class_id").alias("group_id"))
    met = met.join(first, "root", "left")
    told = texts.select("id", "k", "h", "class_id", "size").join(met, "id", "left")
    rows = keyed.select("doc_id", "k", "h").join(told, ["k", "h"])
    zero = F.lit(0).cast("long")
    return rows.select("doc_id", "class_id", F.col("size").alias("class_size"), (F.col("size") - 1 + F.coalesce("n_docs", zero)).alias("n_links"), F.coalesce("n_texts", zero).alias("n_text_links"), F.coalesce("group_id", "class_id").alias("group_id"), F.coalesce("root", "id").alias("group_key"))


def one_of_each(docs: DataFrame, text: str = "text", **options) -> DataFrame:
    """The rows of docs, one of each group: the one of the least row number of those with a group's texts.  All columns stay.

    Groups are components of links, so one document can stand for another that it is like through a chain of links only.
    """
    number = "\1row"
    held = written(docs.withColumn(number, F.monotonically_increasing_id()), "numbered")
    groups = similar_groups(held, text, number, **options)
    keep = groups.groupBy("group_key").agg(F.min("doc_id").alias(number)).select(number)
    return held.join(keep, number, "left_semi").drop(number)
