"""Language-model scores of documents.

The model is log-bilinear (Mnih and Hinton, 2007) over classes of tokens: the score of a class after a class is the inner
product of a context vector and a target vector, plus a bias.  The classes are the end of a text, the most frequent words,
each its own class, and shapes of all other words (last byte, length, ASCII or not).  It is trained in numpy by
noise-contrastive estimation (Gutmann and Hyvarinen, 2010), which needs no normaliser; the normalisers are worked out
afterwards, by tasks for blocks of contexts over all classes, so token log-probabilities are exactly normalised.  A word of a
shape has the share of its count there, by absolute discounting, and the discounted rest is for words never seen: the
probabilities of all known words and one unknown word for each shape add up to one.

Counts cover all training documents: words are counted exactly, whatever their number.  Training goes over every pair of
all training documents once, after a first model from a sample.

Scale: words are counted in each task and again before the shuffle.  Words of their own class are OWN_GROWTH times the
square root of the training tokens (OWN_CLASS at least), so work a token stays the same.  They, or the HEAD most frequent
words if these are more, are sent to the workers; every other word of a document meets its count in a join, as one row for
each document and word.  Tasks train from the same model, in ROUNDS rounds, and send the rows they updated once a round.
Fixed at every size: the width of vectors, one token of context, and the shapes.

Defined results: null and empty texts have one token, the end; a null id counts as the empty text in the split; repeated
rows each get their row; without training documents every token is unknown and has base probability 1 and the model's
classes are equally likely; an empty table gives an empty table; extra columns aren't read, and
a column to keep that has the name of a result gives way to it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lanework.llm.store import bounded_batches, giving_way, task_numbers, written
from lanework.llm.words import PLAIN_LOWER, Words, chunks, find_words, lexicon_bytes

#: Words sent to workers with their counts, at least; of these, words that are classes of their own, at least.
HEAD = 1 << 17
OWN_CLASS = 1500
#: How many words are classes of their own for the square root of the training tokens.
OWN_GROWTH = 8
WIDTH = 32
#: Steps on a sample, before the pass over all pairs, and the rounds of that pass.
STEPS = 3000
ROUNDS = 2
BATCH, NOISE = 1024, 192
#: Rows of the model's tables that meet in a task.
ROWS_A_BLOCK = 1024
#: Rows of words that a task counts before it passes them on.
HELD_ROWS = 750_000
REST = T.ArrayType(T.StructType([T.StructField("word", T.StringType()), T.StructField("shape", T.IntegerType()), T.StructField("n", T.LongType())]))

_LAST = np.full(256, 35, np.int64)
_LAST[97:123] = np.arange(26)
_LAST[48:58] = 26
for _i, _c in enumerate(b".,!$#*%&"):
    _LAST[_c] = 27 + _i
_LAST[128:] = 36
SHAPES = 37 * 6


def shapes(lexicon: pa.Array) -> np.ndarray:
    """The shape of each (non-empty) word."""
    if not len(lexicon):
        return np.zeros(0, np.int64)
    data, offsets = lexicon_bytes(lexicon)
    wide = np.maximum.reduceat(data, offsets[:-1]) >= 128
    size = np.digitize(np.diff(offsets), [5, 9])
    return (_LAST[data[offsets[1:] - 1]] * 3 + size) * 2 + wide


def count_words(texts: DataFrame) -> DataFrame:
    """(word, shape, n) of a column `text`, exactly, in the shared folder."""

    def run(batches):
        held: list[pa.Table] = []

        def flush():
            table = pa.concat_tables(held).group_by(["word", "shape"]).aggregate([("n", "sum")]).rename_columns(["word", "shape", "n"])
            held.clear()
            yield from table.cast(pa.schema([("word", pa.string()), ("shape", pa.int32()), ("n", pa.int64())])).to_batches(100_000)

        for whole in batches:
            for batch in chunks(whole, "text"):
                words = find_words(batch.column("text"), PLAIN_LOWER)
                n = np.bincount(words.codes, minlength=len(words.lexicon))
                held.append(pa.table({"word": words.lexicon.cast(pa.large_string()), "shape": shapes(words.lexicon).astype(np.int32), "n": n}))
                if sum(t.num_rows for t in held) > HELD_ROWS:
                    yield from flush()
        if held:
            yield from flush()

    rows = texts.mapInArrow(run, "word string, shape int, n long")
    return written(rows.groupBy("word", "shape").agg(F.sum("n").alias("n")), "words")


def most_frequent(counts: DataFrame, most: int) -> DataFrame:
    """The words of at least such a count that they are `most` at most: no task sorts or gathers the others.

    The count is an edge of steps of an eighth of a doubling, of which there are some hundred.
    """
    step = F.floor(F.log2("n") * 8).cast("int").alias("step")
    left, least = most, None
    for r in sorted(counts.groupBy(step).agg(F.count(F.lit(1)).alias("c"), F.min("n").alias("n")).collect(), key=lambda r: -r["step"]):
        if r["c"] > left:
            break
        left, least = left - r["c"], r["n"]
    return counts.where(F.col("n") >= F.lit(least)) if least is not None else counts.where("false")


@dataclass
class Classes:
    """Classes 0 .. len(own) - 1 are words, then shapes, then the end."""

    own: pa.Array

    @property
    def n(self) -> int:
        return len(self.own) + SHAPES + 1

    @property
    def end(self) -> int:
        return self.n - 1

    def of(self, lexicon: pa.Array) -> np.ndarray:
        if not len(lexicon):
            return np.zeros(0, np.int64)
        at = pc.fill_null(pc.index_in(lexicon.cast(pa.large_string()), value_set=self.own), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        return np.where(at >= 0, at, len(self.own) + shapes(lexicon))

    def stream(self, words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Contexts and targets of all tokens, each text from the end's class to the end, and where texts begin."""
        n = np.diff(words.offsets) + 1
        offsets = np.append(0, np.cumsum(n))
        targets = np.full(offsets[-1], self.end)
        inside = np.ones(offsets[-1], bool)
        inside[offsets[1:] - 1] = False
        targets[inside] = self.of(words.lexicon)[words.codes]
        contexts = np.empty_like(targets)
        contexts[1:] = targets[:-1]
        contexts[offsets[:-1]] = self.end
        return contexts, targets, offsets


@dataclass
class LogBilinear:
    contexts: np.ndarray
    targets: np.ndarray
    bias: np.ndarray

    def normalisers(self, a: int, b: int, wide: int = 8192) -> np.ndarray:
        """ln of the sum over all targets, of contexts a to b; targets in blocks, so memory is bounded."""
        r = self.contexts[a:b]
        out = np.full(len(r), -np.inf)
        for at in range(0, len(self.bias), wide):
            s = r @ self.targets[at : at + wide].T + self.bias[at : at + wide]
            top = s.max(1, keepdims=True)
            out = np.logaddexp(out, top[:, 0] + np.log(np.exp(s - top).sum(1, dtype=np.float64)))
        return out

    def log_probabilities(self, block: int = 256) -> np.ndarray:
        """ln P(target | context) of all classes, normalised, in blocks of contexts: for few classes."""
        out = np.empty((len(self.contexts), len(self.bias)), np.float32)
        for at in range(0, len(out), block):
            out[at : at + block] = self.contexts[at : at + block] @ self.targets.T + self.bias - self.normalisers(at, at + block)[:, None]
        return out

    def of_pairs(self, contexts: np.ndarray, targets: np.ndarray, normalisers: np.ndarray, block: int = 1 << 15) -> np.ndarray:
        """ln P(target | context) of each pair."""
        out = np.empty(len(contexts))
        for at in range(0, len(out), block):
            c, t = contexts[at : at + block], targets[at : at + block]
            out[at : at + block] = np.einsum("ij,ij->i", self.contexts[c], self.targets[t]) + self.bias[t] - normalisers[c]
        return out


@dataclass
class Learner:
    """A model on its way: by noise-contrastive estimation, noise from the classes' own frequencies, with AdaGrad (a rate for each vector).

    squares: the sums of contexts' and of targets' mean squared steps.
    """

    model: LogBilinear
    squares: list[np.ndarray]
    noise: np.ndarray

    @staticmethod
    def begun(frequency: np.ndarray, width: int = WIDTH, seed: int = 3) -> Learner:
        n = len(frequency)
        random = np.random.default_rng(seed)
        noise = (frequency + 0.5) / (frequency.sum() + 0.5 * n)
        model = LogBilinear(random.normal(0, 0.1, (n, width)).astype(np.float32), random.normal(0, 0.1, (n, width)).astype(np.float32), np.log(noise).astype(np.float32))
        return Learner(model, [np.full(n, 1e-6, np.float32) for _ in range(2)], noise)

    def tables(self) -> tuple[np.ndarray, np.ndarray]:
        """Contexts, and targets with their bias."""
        return self.model.contexts, np.column_stack([self.model.targets, self.model.bias])

    def copied(self) -> Learner:
        m = self.model
        return Learner(LogBilinear(m.contexts.copy(), m.targets.copy(), m.bias.copy()), [x.copy() for x in self.squares], self.noise)

    def start(self, random: np.random.Generator) -> None:
        self.random, self.upto = random, np.cumsum(self.noise)
        self.shift = np.log(NOISE * self.noise).astype(np.float32)
        self.updates = [np.zeros(len(self.noise), np.int64) for _ in range(2)]  # of contexts, of targets

    def step(self, context: np.ndarray, target: np.ndarray, rate: float) -> None:
        """The noise's chances are (1 + tanh) / 2 of half their logits, so the halves and the ones are left to small sums."""
        model = self.model
        fake = np.minimum(np.searchsorted(self.upto, self.random.random(NOISE) * self.upto[-1], "right"), len(self.upto) - 1)
        r, q, f = model.contexts.take(context, 0), model.targets.take(target, 0), model.targets.take(fake, 0)
        true_off = 1 / (1 + np.exp(-(np.einsum("ij,ij->i", r, q) + model.bias[target] - self.shift[target]))) - 1
        wide = r.shape[1]
        with_one = np.empty((len(r), wide + 1), np.float32)
        with_one[:, :wide], with_one[:, wide] = r, 1
        half = np.column_stack([f, model.bias[fake] - self.shift[fake]]) * np.float32(0.5)
        off = with_one @ half.T
        np.tanh(off, out=off)
        grad_r = off @ f
        grad_r += f.sum(0)
        grad_r *= 0.5
        grad_r += true_off[:, None] * q
        rows = np.concatenate([target, fake])
        # changes of targets, and in the last column of their bias
        grad_q = np.concatenate([true_off[:, None] * with_one, ((with_one.T @ off).T + with_one.sum(0)) * np.float32(0.5)])
        for k, (at, x, g) in enumerate(((context, model.contexts, grad_r), (rows, model.targets, grad_q))):
            own, sums = _sums_of(at, g)
            total = sums[:, :wide]
            self.updates[k][own] += 1
            squares = self.squares[k].take(own) + np.einsum("ij,ij->i", total, total) / wide
            self.squares[k][own] = squares
            slow = (rate / np.sqrt(squares)).astype(np.float32)
            x[own] = x.take(own, 0) - slow[:, None] * total
            if k:
                model.bias[own] -= slow * sums[:, wide]


def _sums_of(at: np.ndarray, g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different rows, and the sum of g over each; most occur once and are only copied."""
    order = np.argsort((at & 0xFFFF).astype(np.uint16), kind="stable")  # 16 bits at a time are sorted by counting
    if at.max(initial=0) > 0xFFFF:
        order = order[np.argsort((at[order] >> 16).astype(np.uint16), kind="stable")]
    sorted_at = at[order]
    first = np.flatnonzero(np.append(True, sorted_at[1:] != sorted_at[:-1]))
    sums, n = g.take(order[first], 0), np.diff(np.append(first, len(order)))
    many = n > 1
    if many.any():
        begins = np.cumsum(n[many])
        sums[many] = np.add.reduceat(g.take(order[np.repeat(many, n)], 0), begins - n[many])
    return sorted_at[first], sums


def _pairs(classes: Classes, batches) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for whole in batches:
        for batch in chunks(whole, "text"):
            contexts, targets, _ = classes.stream(find_words(batch.column("text"), PLAIN_LOWER))
            yield contexts, targets


def begin(texts: DataFrame, classes: Classes, frequency: np.ndarray, steps: int = STEPS, rate: float = 0.1, seed: int = 3) -> Learner:
    """A first model that all tasks go on from, so that their vectors agree: `steps` steps on a sample of texts of about as many pairs."""
    learner = Learner.begun(frequency, seed=seed)
    share = max(1, int(frequency.sum()) // max(steps * BATCH, 1))

    def run(batches):
        for contexts, targets in _pairs(classes, batches):
            yield pa.RecordBatch.from_arrays([pa.array([np.stack([contexts, targets]).astype("<i4").tobytes()], pa.binary())], ["pairs"])

    some = texts.where(F.pmod(F.xxhash64("text", F.lit(seed)), F.lit(share)) == 0)
    held = [np.frombuffer(r["pairs"], "<i4").reshape(2, -1) for r in some.mapInArrow(run, "pairs binary").toLocalIterator()]  # about steps * BATCH pairs
    learner.start(random := np.random.default_rng(seed))
    if held:
        contexts, targets = np.concatenate(held, 1)
        for step in range(steps):
            at = random.integers(0, len(contexts), BATCH)
            learner.step(contexts[at], targets[at], rate * (1 - step / steps) + 0.005)
    return learner


def one_round(texts: DataFrame, classes: Classes, learner: Learner, number: int, rate: float, seed: int = 3) -> int:
    """Each task goes over all pairs of its texts once, from the same model; then a row's mean, by how often each task updated it.

    Returns the number of pairs that were gone over.  A task passes on how it changed the rows it updated, in half precision;
    rows of all tasks meet in blocks.
    """
    spark = texts.sparkSession
    sent = spark.sparkContext.broadcast((classes, learner))
    width, block = learner.model.contexts.shape[1], ROWS_A_BLOCK

    def run(batches):
        kinds, begun = sent.value
        task = TaskContext.get().partitionId()
        own = begun.copied()
        own.start(np.random.default_rng([seed, number, task]))
        done, left = 0, (np.zeros(0, np.int64), np.zeros(0, np.int64))
        for contexts, targets in _pairs(kinds, batches):
            contexts, targets = np.append(left[0], contexts), np.append(left[1], targets)
            order = own.random.permutation(len(contexts))
            whole = len(order) // BATCH * BATCH
            for at in range(0, whole, BATCH):
                own.step(contexts[order[at : at + BATCH]], targets[order[at : at + BATCH]], rate)
            done += whole
            left = contexts[order[whole:]], targets[order[whole:]]
        if len(left[0]):
            own.step(*left, rate)
            done += len(left[0])
        yield pa.RecordBatch.from_arrays([pa.array([x], pa.int32()) for x in (-1, 0, task)] + [pa.array([int(done).to_bytes(8, "little")], pa.binary())], ["side", "block", "task", "packed"])
        for side, (x, before) in enumerate(zip(own.tables(), begun.tables(), strict=True)):
            rows = np.flatnonzero(own.updates[side])
            cut = np.searchsorted(rows, np.arange(0, len(x) + block, block))
            for i, (a, b) in enumerate(zip(cut[:-1], cut[1:], strict=True)):
                if a < b:
                    r = rows[a:b]
                    blob = (r - i * block).astype("<i4").tobytes() + own.updates[side][r].astype("<f4").tobytes()
                    blob += (own.squares[side][r] - begun.squares[side][r]).astype("<f4").tobytes() + (x[r] - before[r]).astype("<f2").tobytes()
                    yield pa.RecordBatch.from_arrays([pa.array([v], pa.int32()) for v in (side, i, task)] + [pa.array([blob], pa.binary())], ["side", "block", "task", "packed"])

    def mean(table: pa.Table) -> pa.Table:
        table = table.sort_by("task")  # sums in one order, whenever tasks end
        side, blobs = table.column("side")[0].as_py(), table.column("packed").to_pylist()
        if side < 0:
            out = sum(int.from_bytes(b, "little") for b in blobs).to_bytes(8, "little")
        else:
            wide = width + side
            weight, s, x = np.zeros(block), np.zeros(block), np.zeros((block, wide))
            for blob in blobs:
                k = len(blob) // (12 + 2 * wide)
                r, w = np.frombuffer(blob, "<i4", k), np.frombuffer(blob, "<f4", k, 4 * k)
                weight[r] += w
                s[r] += np.frombuffer(blob, "<f4", k, 8 * k)
                x[r] += w[:, None] * np.frombuffer(blob, "<f2", k * wide, 12 * k).reshape(k, wide)
            r = np.flatnonzero(weight)
            out = r.astype("<i4").tobytes() + s[r].astype("<f4").tobytes() + (x[r] / weight[r, None]).astype("<f4").tobytes()
        return pa.table([table.column("side").slice(0, 1), table.column("block").slice(0, 1), pa.array([out], pa.binary())], names=["side", "block", "packed"])

    pairs, m = 0, learner.model
    made = texts.mapInArrow(run, "side int, block int, task int, packed binary").groupBy("side", "block").applyInArrow(mean, "side int, block int, packed binary")
    for row in made.toLocalIterator():
        side, blob = row["side"], row["packed"]
        if side < 0:
            pairs = int.from_bytes(blob, "little")
            continue
        wide = width + side
        k = len(blob) // (8 + 4 * wide)
        r = np.frombuffer(blob, "<i4", k) + row["block"] * block
        learner.squares[side][r] += np.frombuffer(blob, "<f4", k, 4 * k)
        x = np.frombuffer(blob, "<f4", k * wide, 8 * k).reshape(k, wide)
        if side == 0:
            m.contexts[r] += x
        else:
            m.targets[r] += x[:, :width]
            m.bias[r] += x[:, width]
    return pairs


def train(texts: DataFrame, classes: Classes, frequency: np.ndarray, steps: int = STEPS, rounds: int = ROUNDS, rate: float = 0.1) -> tuple[LogBilinear, int]:
    """The model after one pass over all pairs, a share of the texts a round; and how many pairs that were."""
    learner, pairs = begin(texts, classes, frequency, steps, rate), 0
    tasks = max(8, int(math.sqrt(frequency.sum()) / 500))  # times classes: what they send grows as the tokens do
    for number in range(rounds):
        own = texts.where(F.pmod(F.xxhash64("text"), F.lit(rounds)) == number).coalesce(tasks)
        pairs += one_round(own, classes, learner, number, rate * (1 - number / rounds))
    return learner.model, pairs


def log_normalisers(spark: SparkSession, model: LogBilinear, block: int = 256) -> np.ndarray:
    """ln of the sum over all targets of each context, by tasks for blocks of contexts."""
    n = len(model.contexts)
    sent = spark.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            for at in batch.column("id").to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), pa.array([sent.value.normalisers(at * block, at * block + block).tobytes()], pa.binary())], ["id", "z"])

    out, blocks = np.empty(n), -(-n // block)
    for row in spark.range(0, blocks, 1, max(1, min(blocks // 8, blocks, 1024))).mapInArrow(run, "id long, z binary").toLocalIterator():
        out[row["id"] * block : (row["id"] + 1) * block] = np.frombuffer(row["z"], np.float64)
    return out


@dataclass
class Trained:
    """What workers need: it grows as the square root of the training tokens."""

    classes: Classes
    model: LogBilinear
    normalisers: np.ndarray
    trained_pairs: int
    head: pa.Array
    head_counts: np.ndarray
    shape_total: np.ndarray
    shape_discount: np.ndarray
    shape_unknown: np.ndarray
    total: int
    distinct: int
    ends: int

    def log10_in_shape(self, counts: np.ndarray, shape: np.ndarray) -> np.ndarray:
        """log10 P(word | shape) of a word of that count; 0 is unknown."""
        share = (counts - self.shape_discount[shape]) / np.maximum(self.shape_total[shape], 1)
        return np.log10(np.where(counts > 0, share, self.shape_unknown[shape]))


def own_classes(tokens: int) -> int:
    """How many words get a class of their own: classes squared, the work of normalisers, grow as the tokens do."""
    return max(OWN_CLASS, int(OWN_GROWTH * math.sqrt(tokens)))


def learn(texts: DataFrame, head: int = HEAD, own_class: int | None = None, steps: int = STEPS) -> tuple[Trained, DataFrame]:
    """What is learnt from a column `text`, and the table of counts that grows with it."""
    bounded_batches(texts.sparkSession)
    texts = texts.select(F.coalesce("text", F.lit("")).alias("text"))
    counts = count_words(texts)
    sums = counts.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v")).first()
    ends = texts.count()
    tokens = int(sums["n"] or 0) + ends
    if own_class is None:
        own_class = own_classes(tokens)
        head = max(head, own_class)
    top = most_frequent(counts, head).toArrow().sort_by([("n", "descending"), ("word", "ascending")])  # `head` rows at most
    words = top.column("word").cast(pa.large_string()).combine_chunks()
    classes = Classes(words.slice(0, own_class))
    # the words with a class of their own aren't part of their shape
    total, types, once, twice = (np.zeros(SHAPES) for _ in range(4))
    for r in counts.groupBy("shape").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v"), F.count_if(F.col("n") == 1).alias("a"), F.count_if(F.col("n") == 2).alias("b")).collect():
        total[r["shape"]], types[r["shape"]], once[r["shape"]], twice[r["shape"]] = r["n"], r["v"], r["a"], r["b"]
    for shape, n in zip(top.column("shape").to_pylist()[:own_class], top.column("n").to_pylist()[:own_class], strict=True):
        total[shape] -= n
        types[shape] -= 1
        once[shape] -= n == 1
        twice[shape] -= n == 2
    discount = np.clip(np.where(once > 0, once / np.maximum(once + 2 * twice, 1), 0.75), 0.1, 0.95)
    unknown = np.where(total > 0, discount * types / np.maximum(total, 1), 1.0)
    model, pairs = train(texts, classes, np.concatenate([top.column("n").to_numpy()[: len(classes.own)], total, [ends]]), steps)
    return Trained(classes, model, log_normalisers(texts.sparkSession, model), pairs, words, top.column("n").to_numpy(), total, discount, unknown, tokens, int(sums["v"] or 0) + (ends > 0), ends), counts


def score(docs: DataFrame, trained: Trained, counts: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """keep's columns with n_tokens, n_known, base_score, score (log10)."""
    bounded_batches(docs.sparkSession)
    keep = giving_way(keep, ["n_tokens", "n_known", "base_score", "score"])
    sent = docs.sparkSession.sparkContext.broadcast(trained)
    numbers = task_numbers
    source = docs.select(*[F.col(f"`{c}`") for c in keep], F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("\1text"))
    schema = docs.select(*[F.col(f"`{c}`") for c in keep]).schema
    for name, kind in (("\1row", "long"), ("\1n", "long"), ("\1known", "long"), ("\1base", "double"), ("\1model", "double"), ("\1rest", REST)):
        schema = schema.add(name, kind)

    def run(batches):
        own = sent.value
        scale = np.log10(own.total + own.distinct + 1)
        number = numbers()
        for whole in batches:
            for batch in chunks(whole, "\1text"):
                words = find_words(batch.column("\1text"), PLAIN_LOWER)
                contexts, targets, offsets = own.classes.stream(words)
                n = np.diff(words.offsets)
                token = own.model.of_pairs(contexts, targets, own.normalisers) / np.log(10)
                model = np.add.reduceat(token, offsets[:-1]) if len(n) else np.zeros(0)
                lexicon = words.lexicon.cast(pa.large_string())
                at = pc.fill_null(pc.index_in(lexicon, value_set=own.head), -1).to_numpy(zero_copy_only=False).astype(np.int64)
                held = at >= 0
                known = np.where(held, own.head_counts[at] if len(own.head_counts) else 0, 0)
                shape = shapes(words.lexicon)
                inside = np.where(held & (at >= len(own.classes.own)), own.log10_in_shape(known, shape), 0.0) if len(at) else np.zeros(0)
                sums = lambda x: np.diff(np.append(0, np.cumsum(x[words.codes]))[words.offsets])  # noqa: B023, E731
                base = sums(np.where(held, np.log10(known + 1) - scale, 0.0)) + np.log10(own.ends + 1) - scale
                places = np.flatnonzero(~held[words.codes])
                owner = np.searchsorted(words.offsets, places, "right") - 1
                width = len(lexicon) + 1
                pairs, times = np.unique(owner * width + words.codes[places], return_counts=True)
                rest = pa.StructArray.from_arrays([lexicon.take(pa.array(pairs % width)).cast(pa.string()), pa.array(shape[pairs % width].astype(np.int32)), pa.array(times)], ["word", "shape", "n"])
                lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(pairs // width, np.arange(len(n) + 1)), pa.int32()), rest)
                new = [pa.array([next(number) for _ in range(len(n))], pa.int64()), pa.array(n + 1), pa.array(sums(held.astype(np.int64)) + (own.ends > 0)), pa.array(base), pa.array(model + sums(inside)), lists]
                yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], *new], schema.names)

    rows = written(source.mapInArrow(run, schema), "scored")
    spread = rows.select("\1row", F.explode("\1rest").alias("r")).select("\1row", F.col("r.word").alias("word"), F.col("r.shape").alias("shape"), F.col("r.n").alias("times"))
    # of fixed size: one row for each shape
    shape = F.broadcast(docs.sparkSession.createDataFrame([(i, float(t), float(d), float(u)) for i, (t, d, u) in enumerate(zip(trained.shape_total, trained.shape_discount, trained.shape_unknown, strict=True))], "shape int, total double, discount double, unknown double"))
    met = spread.join(counts.select("word", "n"), "word", "left").join(shape, "shape")
    c = F.coalesce("n", F.lit(0))
    base = F.col("times") * (F.log10(c + 1) - float(np.log10(trained.total + trained.distinct + 1)))
    inside = F.col("times") * F.log10(F.when(c > 0, (c - F.col("discount")) / F.greatest("total", F.lit(1.0))).otherwise(F.col("unknown")))
    sums = met.groupBy("\1row").agg(F.sum(F.when(c > 0, F.col("times")).otherwise(0)).alias("\1a"), F.sum(base).alias("\1b"), F.sum(inside).alias("\1m"))
    zero = F.lit(0.0)
    return rows.drop("\1rest").join(sums, "\1row", "left").select(*[F.col(f"`{x}`") for x in keep], F.col("\1n").alias("n_tokens"), (F.col("\1known") + F.coalesce("\1a", F.lit(0))).alias("n_known"), (F.col("\1base") + F.coalesce("\1b", zero)).alias("base_score"), (F.col("\1model") + F.coalesce("\1m", zero)).alias("score"))
