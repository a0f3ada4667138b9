"""Quality classifier from weak labels.

1. Vote: heuristic labellers look at every document and vote bad or stay silent; one of them by marker words, in any
   language, that go with abuse in labelled documents.  Labellers overlap and err.  There are two questions: is it well
   made (`quality`), is it abusive (`toxic`).  The table of labels covers some documents and is taken at its word, but for
   a share of LABEL_ERROR.
2. Estimate: expectation-maximisation (Dawid and Skene, 1979) over the counts of all vote patterns, of which there are
   2^heuristics * 3 at most whatever the corpus, estimates how often each heuristic votes bad on good documents and on each
   kind of bad ones, and so each pattern's posterior.  There is one kind for each heuristic, so labellers that look for
   different things needn't agree.  A heuristic looks at every document, so its silence is evidence too; a missing label is
   none.  A heuristic that would vote bad more often on good documents than on bad ones is no evidence at all.
3. Train: the posteriors of a bounded sample of documents (SAMPLE, those of least hash, labelled ones first) are the soft
   targets of a linear scorer over hashed features: words, their beginnings and ends, and steps of shares.
4. Score: one pass over all documents.

Scale: two passes that tokenise, one over labelled documents and one that picks the sample; the only shuffles are of votes
(a few bytes a document) to meet the labels, and of pattern counts.  The scorer is trained in one task, on the sample's
features read back from the shared folder; the driver holds votes, targets and weights, never texts or features.  Sent to
workers: the sample's keys, the markers and 2 * 2^BITS weights, all of fixed size.

Defined results: null and empty texts get the verdict `bad` by the labeller of length, and are scored like any other;
labels are averaged for each doc_id, ties and null labels say nothing; repeated rows get equal scores; without any labels
the heuristics alone decide, and what none of them finds is good; without documents there is nothing; extra columns aren't
read, and a column to keep that has the name of a result gives way to it.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lanework.llm.store import bounded_batches, giving_way, written
from lanework.llm.words import PLAIN, Words, byte_table, chunks, find_words, lexicon_bytes, mix

BITS = 18
#: The sample's bound, in documents.
SAMPLE = 8000
GOOD, NONE, BAD = 1, 0, -1
#: Words that begin the list of abuse, in four languages; labelled documents add their own in any language.
ABUSE = (
    "bastard", "dumb", "fool", "idiot", "imbecile", "moron", "scum", "stupid", "worthless",
    "abschaum", "blödmann", "depp", "dreckskerl", "dumm", "trottel", "widerlich",
    "abruti", "crétin", "débile", "imbécile", "ordure", "salaud", "stupide",
    "asqueroso", "basura", "escoria", "estúpido", "idiota", "imbécil", "tonto",
)
QUALITY_VOTES = ("symbols", "capitals", "fragments", "repetition", "diversity", "length")
TOXIC_VOTES = ("abuse", "abuse_share", "marked")
#: How surely a word goes with abuse (a log-likelihood ratio), and in how many labelled documents, to be a marker.
SURE, LEAST = 15.0, 3
#: How many times as much a rather bad document counts: abuse is rarer, and harder to tell.
RARE = {"quality": 2.0, "toxic": 4.0}
#: How often the table of labels errs.
LABEL_ERROR = 0.001
#: Votes (bad, silent) that each heuristic begins with: on good documents, on badness of other kinds, on its own kind.
PRIOR_VOTES = np.array([[0.1, 9.9], [0.2, 1.8], [4.0, 1.0]])
#: Documents to begin with: good ones, bad ones.
PRIOR_DOCUMENTS = np.array([4.0, 1.0])
_EDGE = np.zeros(256, bool)
_EDGE[list(b".,;:!?$#*%&()[]{}<>|\"'-_/\\")] = True
_LOWER = byte_table(b"", True)
_WORDY = np.zeros(256, bool)
_WORDY[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
BEGINNINGS = (4, 5, 6, 7, 8)


class Lexicon:
    """Flags and hashed features of distinct words, worked out on their bytes, all words at once."""

    def __init__(self, lexicon: pa.Array, bits: int = BITS):
        self.n = len(lexicon)
        self.bits = bits
        if not self.n:
            lexicon = pa.array([b"x"], pa.large_binary())
        data, offsets = lexicon_bytes(lexicon)
        starts, ends = offsets[:-1], offsets[1:]
        at = np.arange(len(data))
        edge = _EDGE[data]
        first = np.minimum.reduceat(np.where(edge, len(data), at), starts)
        last = np.maximum.reduceat(np.where(edge, -1, at), starts) + 1
        first, last = np.minimum(first, ends), np.maximum(last, np.minimum(first, ends))  # of the bare word
        low = _LOWER[data].astype(np.uint64)
        place = at - np.repeat(first, ends - starts)
        inside = (place >= 0) & (at < np.repeat(last, ends - starts))
        powers = np.multiply.accumulate(np.full(int((ends - starts).max()) + 1, 0x9E3779B97F4A7C15, np.uint64))
        self.hash = mix(np.add.reduceat(np.where(inside, (low + np.uint64(1)) * powers[np.where(inside, place, 0)], np.uint64(0)), starts))
        size = last - first

        def window(begin: np.ndarray, length: np.ndarray, width: int, source: np.ndarray) -> np.ndarray:
            out = np.zeros(len(begin), np.uint64)
            for i in range(width):
                out |= np.where(i < length, source[np.minimum(begin + i, len(data) - 1)].astype(np.uint64) << np.uint64(8 * i), np.uint64(0))
            return out

        eight, none = window(first, size, 8, low), 1 << bits
        tail = window(np.maximum(ends - 3, starts), np.minimum(ends - starts, 3), 3, data)
        slot = lambda x, salt: (mix(x + np.uint64(salt)) & np.uint64((1 << bits) - 1)).astype(np.int64)
        columns = [slot(self.hash, 1), slot(tail, 2 << 32)]
        for k in BEGINNINGS:
            columns.append(np.where(size >= k, slot(eight & np.uint64((1 << 8 * k) - 1), k << 40), none))
        #: A column for each feature of a word; 1 << bits where it has none.
        self.features = np.stack(columns, 1)[: self.n]
        count = lambda flag: np.add.reduceat(flag.astype(np.int64), starts)
        big, small = count((data >= 65) & (data <= 90)), count((data >= 97) & (data <= 122))
        doubled = (ends - starts > 2) & (data[ends - 1] == data[np.maximum(ends - 2, 0)]) & _EDGE[data[ends - 1]]
        self.flags = np.stack([doubled, (big > 0) & (small == 0) & (ends - starts > 1), count(_WORDY[data]) == 0, np.isin(self.hash, abuse_hashes())], 1)[: self.n].astype(np.float64)


@lru_cache(maxsize=1)
def abuse_hashes() -> np.ndarray:
    powers = np.multiply.accumulate(np.full(64, 0x9E3779B97F4A7C15, np.uint64))
    words = [np.frombuffer(w.encode(), np.uint8).astype(np.uint64) for w in ABUSE]
    return mix(np.array([((w + np.uint64(1)) * powers[: len(w)]).sum() for w in words], np.uint64))


class Shares:
    """What the labellers look at, for each text.  marks: sorted hashes of marker words."""

    def __init__(self, words: Words, marks: np.ndarray | None = None, bits: int = BITS):
        n = np.diff(words.offsets)
        self.n = n
        self.lexicon = Lexicon(words.lexicon, bits)
        each = self.lexicon.flags[words.codes]
        same = np.zeros(words.n)
        if words.n > 1:
            same[1:] = words.codes[1:] == words.codes[:-1]
            same[words.offsets[:-1][n > 0]] = 0
        sums = lambda x: np.diff(np.append(0, np.cumsum(x))[words.offsets])
        some = np.maximum(n, 1)
        self.symbols, self.capitals, self.fragments = (sums(each[:, i]) / some for i in range(3))
        self.abuse, self.repetition = sums(each[:, 3]), sums(same) / some
        self.owner, self.code = distinct(words)
        self.diversity = np.bincount(self.owner, minlength=len(n)) / some
        known = np.isin(self.lexicon.hash[: self.lexicon.n], np.zeros(0, np.uint64) if marks is None else marks)
        #: Distinct marker words of each text, and distinct words of abuse of either list.
        self.marked = np.bincount(self.owner, known[self.code], len(n))
        self.listed = np.bincount(self.owner, (known | (self.lexicon.flags[:, 3] > 0))[self.code], len(n))

    def votes(self) -> np.ndarray:
        """A column for each of QUALITY_VOTES, then of TOXIC_VOTES."""
        bad = [self.symbols > 0.2, self.capitals > 0.5, self.fragments > 0.15, self.repetition > 0.25, (self.n >= 30) & (self.diversity < 0.3), self.n < 3]
        bad += [self.abuse > 0, self.abuse > 0.005 * self.n]
        bad.append(self.marked >= 2)
        out = [np.where(x, BAD, NONE) for x in bad]
        return np.stack(out, 1).astype(np.int8)


def markers(documents: list[np.ndarray], abusive: np.ndarray) -> np.ndarray:
    """Sorted hashes of the words, in any language, that go with abuse in labelled documents (their distinct words' hashes)."""
    if not abusive.any() or abusive.all():
        return np.zeros(0, np.uint64)
    known, code = np.unique(np.concatenate(documents), return_inverse=True)
    owner = np.repeat(np.arange(len(documents)), [len(d) for d in documents])
    a = np.bincount(code[abusive[owner]], minlength=len(known)).astype(np.float64)
    n = np.bincount(code, minlength=len(known)).astype(np.float64)
    share, total = abusive.mean(), len(documents)
    cell = lambda seen, asked: np.where(seen > 0, seen * np.log(np.maximum(seen, 1) / np.maximum(asked, 1e-12)), 0.0)
    bad, left = abusive.sum(), total - n
    ratio = 2 * (cell(a, n * share) + cell(n - a, n * (1 - share)) + cell(bad - a, left * share) + cell(left - bad + a, left * (1 - share)))
    return known[(a >= LEAST) & (ratio >= SURE) & (a > n * (1 + share) / 2)]


def distinct(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """(text, word code) of the distinct words of each text."""
    width = len(words.lexicon) + 1
    pairs = np.unique(np.repeat(np.arange(len(words.offsets) - 1), np.diff(words.offsets)) * width + words.codes)
    return pairs // width, pairs % width


def step_features(shares: Shares, bits: int = BITS) -> np.ndarray:
    """Hashed features of the steps that a text's shares are on; a column for each."""
    out = []
    for name in ("symbols", "capitals", "fragments", "repetition", "diversity"):
        steps = np.digitize(getattr(shares, name), [0.02, 0.05, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.8])
        known = np.array([xxhash.xxh32_intdigest(f"{name}{i}".encode()) & ((1 << bits) - 1) for i in range(10)])
        out.append(known[steps])
    for least in (1, 2, 4):
        known = np.array([xxhash.xxh32_intdigest(f"listed{least}{x}".encode()) & ((1 << bits) - 1) for x in ("no", "yes")])
        out.append(known[(shares.listed >= least).astype(int)])
    size = np.digitize(shares.n, [1, 3, 10, 30, 100, 300, 1000, 3000])
    out.append(np.array([xxhash.xxh32_intdigest(f"size{i}".encode()) & ((1 << bits) - 1) for i in range(9)])[size])
    return np.stack(out, 1)


def estimate(patterns: np.ndarray, counts: np.ndarray, rounds: int = 3000) -> tuple[np.ndarray, np.ndarray]:
    """The posterior of `good` of each vote pattern, whose last column is the label; and each heuristic's rates of bad votes.

    Latent classes: good, and one kind of badness for each heuristic, the kind it looks for.  So that one heuristic is silent
    says nothing against a kind that another one finds.  rates[0]: on bad documents of any kind; rates[1]: on good ones.
    """
    fired, label = (patterns[:, :-1] == BAD).astype(np.float64), patterns[:, -1]
    n = fired.shape[1]
    told = np.where(label == GOOD, 1 - LABEL_ERROR, LABEL_ERROR)
    good = np.where(label != NONE, told, np.where(fired.any(1), 0.1, 0.95))
    begun = np.repeat(PRIOR_VOTES[[0, 1]], [1, n], 0)[:, None, :] * np.ones((1, n, 1))  # of each class and heuristic: bad, silent
    begun[np.arange(n) + 1, np.arange(n)] = PRIOR_VOTES[2]
    kinds = (fired + 0.01) / (fired + 0.01).sum(1, keepdims=True) * (1 - good)[:, None]
    held = np.column_stack([good, kinds])
    documents = np.repeat(PRIOR_DOCUMENTS / [1, n], [1, n])
    for _ in range(rounds):
        weight = counts[:, None] * held
        share = (weight.sum(0) + documents) / (weight.sum() + documents.sum())
        votes, seen = weight.T @ fired + begun[:, :, 0], weight.sum(0)[:, None] + begun.sum(2)
        rates = votes / seen
        own = np.arange(n)
        wrong = rates[own + 1, own] < rates[0, own]  # bad votes that go with good documents are no evidence of badness
        rates[own[wrong] + 1, own[wrong]] = rates[0, own[wrong]]
        logs = np.log(share) + fired @ np.log(rates).T + (1 - fired) @ np.log1p(-rates).T
        now = np.exp(logs - logs.max(1, keepdims=True))
        now /= now.sum(1, keepdims=True)
        bad = np.maximum(now[:, 1:].sum(1), 1e-300)
        now = np.where((label != NONE)[:, None], np.column_stack([told, now[:, 1:] * ((1 - told) / bad)[:, None]]), now)
        done = np.abs(now - held).max(initial=0) < 1e-7
        held = now
        if done:
            break
    weight = counts @ held
    return held[:, 0], np.stack([(weight[1:, None] * rates[1:]).sum(0) / max(weight[1:].sum(), 1e-300), rates[0]])


def train(features: list[tuple[np.ndarray, np.ndarray]], targets: np.ndarray, voted: np.ndarray | None = None, bits: int = BITS, epochs: int = 30, rate: float = 0.3, decay: float = 3e-3, rare: float = 2.0, least: int = LEAST, seed: int = 9) -> tuple[np.ndarray, float]:
    """Weights and bias of a logistic scorer of (distinct features, values), by AdaGrad; a feature of fewer than `least` documents with votes has no weight.

    A document counts by how sure its target is, and one that is rather bad (the rarer kind) `rare` times as much.
    Those that no labeller voted on count a tenth.
    """
    weights, squares, bias, square = np.zeros(1 << bits), np.full(1 << bits, 1e-8), 0.0, 1e-8
    if not len(features):
        return weights, bias
    often = np.zeros(1 << bits, np.int64)
    for i, (f, _) in enumerate(features):
        if voted is None or voted[i]:
            often[f] += 1
    held = often >= least
    # in two large arrays, which go back to the system afterwards: small ones would stay with the worker
    ends = np.cumsum([0, *[int(held[f].sum()) for f, _ in features]])
    codes, values = np.empty(ends[-1], np.int32), np.empty(ends[-1], np.float32)
    for (f, v), a, b in zip(features, ends[:-1], ends[1:], strict=True):
        codes[a:b], values[a:b] = f[held[f]], v[held[f]]
    random = np.random.default_rng(seed)
    sure = (2 * targets - 1) ** 2 * np.where(targets < 0.5, rare, 1.0) * (1.0 if voted is None else np.where(voted, 1.0, 0.1))
    mean, mean_bias = np.zeros(1 << bits), 0.0
    for epoch in range(epochs):
        order = random.permutation(len(features))
        for at in range(0, len(order), 64):
            batch = order[at : at + 64]
            owner = np.repeat(np.arange(len(batch)), ends[batch + 1] - ends[batch])
            f, v = (np.concatenate([x[ends[i] : ends[i + 1]] for i in batch]) for x in (codes, values))
            margin = np.bincount(owner, weights[f] * v, len(batch)) + bias
            off = sure[batch] * (1 / (1 + np.exp(-np.clip(margin, -500, 500))) - targets[batch])
            own, place = np.unique(f, return_inverse=True)
            grad = np.bincount(place, off[owner] * v) / len(batch) + decay * weights[own]
            squares[own] += grad**2
            weights[own] -= rate * grad / np.sqrt(squares[own])
            square += off.mean() ** 2
            bias -= rate * off.mean() / np.sqrt(square)
        if epoch >= epochs // 2:  # the mean of the later epochs, as single ones differ
            mean += weights / (epochs - epochs // 2)
            mean_bias += bias / (epochs - epochs // 2)
    return mean, float(mean_bias)


def features_of(texts: pa.Array, marks: np.ndarray | None = None, bits: int = BITS) -> list[tuple[np.ndarray, np.ndarray]]:
    """The distinct hashed features of each text, and how many of its distinct words have them."""
    shares = Shares(find_words(texts, PLAIN), marks, bits)
    steps = step_features(shares, bits)
    at = np.searchsorted(shares.owner, np.arange(len(shares.n) + 1))
    out = []
    for i, (a, b) in enumerate(zip(at[:-1], at[1:], strict=True)):
        own = shares.lexicon.features[shares.code[a:b]].ravel()
        own, n = np.unique(np.concatenate([steps[i], own[own < 1 << bits]]), return_counts=True)
        out.append((own.astype(np.int32), n.astype(np.float32)))
    return out


def margins(texts: pa.Array, models: list[tuple[np.ndarray, float]], marks: np.ndarray | None = None, bits: int = BITS) -> np.ndarray:
    """A column of margins for each model."""
    shares = Shares(find_words(texts, PLAIN), marks, bits)
    steps = step_features(shares, bits)
    out = []
    for weights, bias in models:  # linear: a word stands for the sum of its features' weights
        each = np.append(weights, 0)[shares.lexicon.features].sum(1, dtype=np.float64)
        out.append(np.bincount(shares.owner, each[shares.code], len(shares.n)) + weights[steps].sum(1, dtype=np.float64) + bias)
    return np.stack(out, 1)


def votes(docs: DataFrame, text: str, keep: list[str], marks: np.ndarray | None = None) -> DataFrame:
    """keep's columns and the votes of all heuristic labellers.  marks: sorted hashes of marker words."""
    names = [*QUALITY_VOTES, *TOXIC_VOTES]

    def run(batches):
        for whole in batches:
            for batch in chunks(whole, "\1text"):
                got = Shares(find_words(batch.column("\1text"), PLAIN), marks).votes()
                yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], *[pa.array(got[:, i].astype(np.int32)) for i in range(len(names))]], [*keep, *names])

    schema = docs.select(*keep).schema
    for name in names:
        schema = schema.add(name, "integer")
    return docs.select(*keep, F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("\1text")).mapInArrow(run, schema)


def learnt_markers(keyed: DataFrame, said: DataFrame, sample: int = SAMPLE) -> np.ndarray:
    """Markers from documents that are labelled abusive or not, those of least hash, `sample` at most."""
    told = keyed.select("k", "doc_id").join(said.where("labelled_toxic <> 0"), "doc_id").groupBy("k").agg(F.min("labelled_toxic").alias("labelled_toxic"))
    picked = told.orderBy(F.xxhash64("k"), "k").limit(sample).collect()  # bounded by `sample`; texts stay where they are
    chosen = keyed.sparkSession.createDataFrame([tuple(r) for r in picked], "k long, labelled_toxic int")

    def run(batches):
        for whole in batches:
            for batch in chunks(whole, "text"):
                shares = Shares(find_words(batch.column("text"), PLAIN))
                at = np.searchsorted(shares.owner, np.arange(len(shares.n) + 1))
                found = [np.unique(shares.lexicon.hash[shares.code[a:b]]).tobytes() for a, b in zip(at[:-1], at[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("k"), batch.column("labelled_toxic"), pa.array(found, pa.binary())], ["k", "said", "words"])

    rows = keyed.join(F.broadcast(chosen), "k").select("k", F.coalesce("text", F.lit("")).alias("text"), "labelled_toxic").mapInArrow(run, "k long, said int, words binary").dropDuplicates(["k"])
    got = sorted(((r["k"], r["said"] == BAD, np.frombuffer(r["words"], np.uint64)) for r in rows.toLocalIterator()), key=lambda r: r[0])  # bounded by `sample`
    return markers([w for _, _, w in got], np.array([b for _, b, _ in got], bool))


@dataclass
class Models:
    """Of each question (`quality`: of good, `toxic`: of clean) the weights and bias; the marker words' hashes."""

    linear: dict[str, tuple[np.ndarray, float]]
    marks: np.ndarray


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", sample: int = SAMPLE, bits: int = BITS) -> Models:
    key = F.xxhash64(F.coalesce(F.col(f"`{text}`"), F.lit("")), F.col(f"`{doc_id}`"))
    keyed = docs.select(key.alias("k"), F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    said = labels.where("doc_id is not null").groupBy("doc_id").agg(F.signum(F.avg("quality") - 0.5).cast("int").alias("labelled_quality"), F.signum(0.5 - F.avg("toxic")).cast("int").alias("labelled_toxic"))
    marks = learnt_markers(keyed, said, sample)
    voted = votes(keyed, "text", ["k", "doc_id"], marks).join(said, "doc_id", "left").na.fill(NONE, ["labelled_quality", "labelled_toxic"])
    labelled = F.when((F.col("labelled_quality") != NONE) | (F.col("labelled_toxic") != NONE), 0).otherwise(1)
    columns = {"quality": [*QUALITY_VOTES, "labelled_quality"], "toxic": [*TOXIC_VOTES, "labelled_toxic"]}
    every = [*columns["quality"], *columns["toxic"]]
    light = written(voted.select("k", labelled.alias("late"), *every), "votes")
    counted = light.groupBy(*every).agg(F.count(F.lit(1)).alias("n")).collect()  # 2^9 * 3^2 rows at most
    picked = light.dropDuplicates(["k"]).orderBy("late", F.xxhash64("k"), "k").limit(sample).collect()  # bounded by `sample`
    posterior = {}
    for name, own in columns.items():
        known: dict[tuple, int] = {}
        for row in counted:
            p = tuple(row[c] for c in own)
            known[p] = known.get(p, 0) + row["n"]
        good, _ = estimate(np.array(list(known), np.int8).reshape(-1, len(own)), np.array(list(known.values()), np.float64))
        posterior[name] = dict(zip(known, good.tolist(), strict=True))
    votes_of = lambda row, own: tuple(row[c] for c in own)
    targets = [(r["k"], *[x for name, own in columns.items() for x in (posterior[name][votes_of(r, own)], any(votes_of(r, own)))]) for r in picked]
    names = [f"{name}_{what}" for name in columns for what in ("target", "voted")]
    chosen = docs.sparkSession.createDataFrame(targets, "k long, " + ", ".join(f"{n} {'double' if n.endswith('target') else 'boolean'}" for n in names))

    def features(batches):
        for whole in batches:
            for batch in chunks(whole, "text"):
                found = features_of(batch.column("text"), marks, bits)
                yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("k", *names)], *[pa.array([x[j].tobytes() for x in found], pa.binary()) for j in range(2)]], ["k", *names, "f", "v"])

    def trained(batches):  # in one task; bounded by `sample`
        held: dict[int, tuple] = {}
        for batch in batches:
            told = zip(*[batch.column(n).to_pylist() for n in names], strict=True)
            for k, f, v, own in zip(batch.column("k").to_pylist(), batch.column("f"), batch.column("v"), told, strict=True):
                held.setdefault(k, (np.frombuffer(f.as_buffer(), np.int32), np.frombuffer(v.as_buffer(), np.float32), own))  # no copies
        order = sorted(held)
        told = np.array([held[k][2] for k in order], np.float64).reshape(-1, len(columns), 2)
        own = [held[k][:2] for k in order]
        for i, name in enumerate(columns):
            weights, bias = train(own, told[:, i, 0], told[:, i, 1] > 0, bits, rare=RARE[name])
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([weights.astype(np.float32).tobytes()], pa.binary()), pa.array([bias])], ["name", "weights", "bias"])

    schema = chosen.schema.add("f", "binary").add("v", "binary")
    rows = keyed.join(F.broadcast(chosen), "k").select("k", F.coalesce("text", F.lit("")).alias("text"), *names).mapInArrow(features, schema)
    got = written(rows, "features").coalesce(1).mapInArrow(trained, "name string, weights binary, bias double").collect()  # a row for each question
    linear = {r["name"]: (np.frombuffer(r["weights"], np.float32), r["bias"]) for r in got}
    return Models({name: linear.get(name, (np.zeros(1 << bits, np.float32), 0.0)) for name in columns}, marks)


def score(docs: DataFrame, models: Models, text: str = "text", keep: list[str] | None = None, bits: int = BITS) -> DataFrame:
    """keep's columns (else all) with quality_score, toxic_score (probabilities) and keep_document."""
    bounded_batches(docs.sparkSession)
    names = giving_way(list(docs.columns if keep is None else keep), ["quality_score", "toxic_score", "keep_document"])
    sent = docs.sparkSession.sparkContext.broadcast(([models.linear["quality"], models.linear["toxic"]], models.marks))
    source = docs.select(*[F.col(f"`{c}`") for c in names], F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("\1text"))
    schema = docs.select(*[F.col(f"`{c}`") for c in names]).schema.add("quality_score", "double").add("toxic_score", "double").add("keep_document", "boolean")

    def run(batches):
        linear, marks = sent.value
        for whole in batches:
            for batch in chunks(whole, "\1text"):
                m = margins(batch.column("\1text"), linear, marks, bits)
                good, clean = (1 / (1 + np.exp(-np.clip(m[:, i], -500, 500))) for i in range(2))
                kept = (good >= 0.5) & (clean >= 0.5)
                yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], pa.array(good), pa.array(1 - clean), pa.array(kept)], schema.names)

    return source.mapInArrow(run, schema)
