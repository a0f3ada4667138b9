"""The operators' own interfaces: clashing names, formats, properties."""

import dataclasses
import gzip
import struct
import time
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from lanework.llm import bpe, decontaminate, graph, lm, media, neardup, quality, shards, substring, token_counts, url_rules, words

from . import plain
from .conftest import SCHEMA, prose

# media


def png(w=2, h=2):
    chunk = lambda n, d: struct.pack(">I", len(d)) + n + d + struct.pack(">I", zlib.crc32(n + d))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"\0" * (w + 1) * h)) + chunk(b"IEND", b"")


def wav(data):
    return b"RIFF" + struct.pack("<I", 36 + len(data)) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, 8000, 8000, 1, 8) + b"data" + struct.pack("<I", len(data)) + data


SAMPLES = {
    "image/png": png(),
    "image/gif": b"GIF89a" + struct.pack("<HHBBB", 1, 1, 0x80, 0, 0) + b"\0" * 6 + b"\x2c" + struct.pack("<HHHHB", 0, 0, 1, 1, 0) + b"\x02\x02\x44\x01\x00\x3b",
    "image/bmp": b"BM" + struct.pack("<IHHI", 58, 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, 1, 1, 1, 24, 0, 4, 0, 0, 0, 0) + b"\0\0\0\0",
    "image/jpeg": b"\xff\xd8\xff\xc0\x00\x08\x08\x00\x01\x00\x01\x00\xff\xda\x00\x02ab\xff\x00c\xff\xd9",
    "audio/wav": wav(b"abcd"),
    "audio/basic": b".snd" + struct.pack(">IIIII", 24, 4, 1, 8000, 1) + b"abcd",
    "application/gzip": gzip.compress(b"hello"),
    "application/pdf": b"%PDF-1.4\nxx\nstartxref\n0\n%%EOF",
    "video/mp4": struct.pack(">I", 16) + b"ftypisom\0\0\0\0" + struct.pack(">I", 8) + b"moov",
    "audio/ogg": b"OggS\0\x06" + b"\0" * 20 + b"\x01\x03abc",
}


@pytest.mark.parametrize("kind", sorted(SAMPLES))
def test_formats(kind):
    data = SAMPLES[kind]
    assert media.objects(data) == [(kind, 0, len(data))]
    assert media.objects(b"junk" + data + b"more") == [(kind, 4, len(data))]
    assert media.objects(data[:-1]) == [] or kind == "application/pdf"


def test_broken_structure_is_no_object():
    broken = bytearray(SAMPLES["image/png"])
    broken[20] ^= 1
    assert media.objects(bytes(broken)) == []
    assert media.objects(b"BM and GIF89a and RIFF are just words") == []


@pytest.mark.parametrize("header", [b"%PDF-1.4 ", b"%PDF-1.4 startxref ", b"\x1f\x8b\x08\x08aaaaaaaa", b"\x1f\x8b\x08\x00aaaaaa", b"\0\0\0\x08ftyp", b"OggS\0\2" + b"\0" * 21, png()[:33], b"RIFF\0\0\1\0WAVEfmt ", b"\xff\xd8\xff\xfe\0\4ab\xff\xfe\0\4ab", b"GIF89a\1\0\1\0\0\0\0!ab"])
def test_values_full_of_headers_take_time_in_proportion(header):
    def seconds(n):
        data = (header * (n // len(header) + 1))[:n]
        began = time.process_time()
        media.objects(data)
        return time.process_time() - began

    assert seconds(800_000) < 8 * max(min(seconds(200_000) for _ in range(2)), 0.03)


def test_gzip_is_checked_to_its_end():
    data = gzip.compress(b"x" * 5_000_000)
    assert media.objects(data) == [("application/gzip", 0, len(data))]
    named = b"\x1f\x8b\x08\x18" + b"\0" * 6 + b"name\0comment\0" + gzip.compress(b"hello")[10:]
    assert media.objects(b"1" + named + b"2") == [("application/gzip", 1, len(named))]
    assert media.objects(data[:-3] + b"abc") == []


def test_features_are_sums_over_samples():
    assert media.feature_of("audio/wav", bytes([0, 255, 3, 200])) == "audio/wav;frames=4;sum=458;square=105034;low=0;high=255;crossings=3"
    assert media.feature_of("audio/wav", b"") == "audio/wav;frames=0"


def test_embedded_are_carved(spark):
    inner = SAMPLES["image/png"]
    df = spark.createDataFrame([(1, wav(b"xx" + inner), "image/gif"), (2, None, "a/b"), (3, b"", None)], "id int, media binary, declared_type string")
    got = {r["id"]: r for r in media.sniff(df).collect()}
    assert (got[1]["media_type"], got[1]["valid"], got[1]["payload"]) == ("audio/wav", True, b"xx" + inner)
    assert (got[2]["media_type"], got[2]["valid"], got[3]["media_type"]) == ("a/b", False, None)
    assert media.carve(media.sniff(df)).select("object").collect()[0][0] == inner


def test_store_pads_odd_payloads(spark):
    df = spark.range(1).select(media.store(F.lit(b"abc")).alias("media"))
    assert media.sniff(df, declared=None).select("media_type", "payload").collect()[0] == ("audio/wav", b"abc")


# words


@given(st.lists(st.one_of(st.none(), st.text(max_size=40)), max_size=8))
@settings(max_examples=60, deadline=None)
def test_words_are_the_patterns(texts):
    texts = [t if t is None else t.encode("utf-8", "ignore").decode() for t in texts]
    for kind, pattern, fold in ((words.PLAIN, plain.PLAIN, str), (words.PLAIN_LOWER, plain.PLAIN, plain.low), (words.ALNUM_LOWER, plain.ALNUM, plain.low)):
        got = words.find_words(pa.array(texts, pa.string()), kind)
        said = [w.decode() for w in got.lexicon.take(pa.array(got.codes)).to_pylist()]
        want = [pattern.findall(fold(t or "")) for t in texts]
        assert [said[a:b] for a, b in zip(got.offsets[:-1], got.offsets[1:], strict=True)] == want


def test_window_hashes_tell_windows_apart():
    x = np.random.default_rng(1).integers(0, 5, 400).astype(np.uint64)
    h = words.window_hashes(x, 3)
    by = {}
    for i in range(len(h)):
        by.setdefault(tuple(x[i : i + 3]), set()).add(h[i])
    assert all(len(s) == 1 for s in by.values()) and len({next(iter(s)) for s in by.values()}) == len(by)


def test_anchors_hang_on_content_only():
    r = np.random.default_rng(2)
    one = r.integers(0, 3, 50).astype(np.uint64)
    for pad in range(5):
        x = np.concatenate([r.integers(0, 3, pad).astype(np.uint64), one])
        assert words.sliding_argmin(x, 24)[pad] - pad == words.sliding_argmin(one, 24)[0]


# decontamination


def test_phrases_and_near_words():
    own = decontaminate.Segment.of(pa.array(["a b c d e f", None, "c b a", "x c y b z a"]))
    found = decontaminate.Phrases([7, None], pa.array(["b c d", "x"]), 3)
    assert {(found.phrases[p], tuple(own.document_of(b))) for p, b in found.search(own)} == {(found.phrases[0], (0,)), (found.phrases[1], (3,))}
    places = own.lookup(pa.array([b"a", b"b", b"c"], pa.large_binary()))
    assert decontaminate.near(own, places, 3) == [(0, 0, 3), (2, 0, 3)]
    assert (3, 1, 6) in decontaminate.near(own, places, 5)


def test_blocks_of_items_give_the_same(spark, odd):
    items = spark.createDataFrame([(i, prose(3, 200)[i * 40 : i * 40 + 90]) for i in range(8)], "item_id long, text string")
    index = decontaminate.build_index(odd.select("doc_id", "text"))
    one = decontaminate.find_exact(index, items)
    many = decontaminate.find_exact(index, items, block_bytes=1)
    cols = ["seg", "at", "n_words", "spans", "n_items", "items"]
    assert sorted(one.select(cols).collect()) == sorted(many.select(cols).collect()) and one.where("n_items > 0").count()


def test_near_words_beside_the_plain_search(spark):
    r = np.random.default_rng(3)
    rows = [(i, " ".join(r.choice(list("abcdefg"), int(r.integers(0, 40))))) for i in range(60)] + [(60, None), (61, "A a B")]
    phrases = ["a b", "c d e", "a a f g", "x y", ""]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    index = decontaminate.build_index(docs)
    found = decontaminate.with_columns(index, decontaminate.find_near(index, phrases, slack=2), docs.schema, ["doc_id"])
    want = [(d, p, a, b) for d, t in rows for p in phrases for a, b in plain.near(t, p, 2)]
    assert sorted(tuple(x) for x in found.select("doc_id", "phrase", "begin", "end").collect()) == sorted(want) and want


# substring dedup


@given(st.lists(st.lists(st.sampled_from("abc"), max_size=60), min_size=1, max_size=5))
@settings(max_examples=40, deadline=None)
def test_seed_and_extend_find_all_repeats(docs):
    window, seed = 6, 3
    rows = [(i, " ".join(d)) for i, d in enumerate(docs)]
    found = substring.Runs(words.find_words(pa.array([t for _, t in rows], pa.string()), words.PLAIN), window, seed)
    values, several = found.distinct()
    hot = set(values[several].tolist())
    seen = {}
    for i, w in enumerate(docs):
        for s in range(len(w) - window + 1):
            seen.setdefault(tuple(w[s : s + window]), []).append((i, s))
    place = {(i, s): found.words.offsets[i] + s for i, w in enumerate(docs) for s in range(len(w) - window + 1)}
    anchors = dict(zip(found.begins.tolist(), found.anchor.tolist(), strict=True))
    for spots in seen.values():
        if len(spots) > 1:
            own = {anchors[int(place[s])] for s in spots}
            # equal windows share their anchor; a window that overlaps itself can share the very place
            assert len(own) == 1 and (own <= hot or len({int(found.at[np.searchsorted(found.begins, place[s])]) for s in spots}) == 1)


def test_periodic_text(spark):
    rows = [(1, "a b " * 40), (2, "a " * 36), (3, "a " * 35)]
    got = substring.repeats(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(tuple(r) for r in got.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256)).collect()) == sorted(plain.without_repeats(rows))


# near duplicates and graph


def test_prefixes_are_shortened_to_the_recall():
    for target in (0.5, 0.9, 0.99, 0.999):
        d = neardup.least_depth(0.8, target)
        assert neardup.met(0.8, d) >= target
        assert d == neardup.DEPTH or neardup.met(0.8, d + 1) < target
    least = neardup.least_depth()
    assert least < neardup.DEPTH
    none = [0.0] * (neardup.DEPTH - least + 2)
    assert neardup.depth_for(none) == least  # nothing known: as pairs at the threshold ask for
    close = neardup.weighed(np.full(50_000, 0.95), neardup.DEPTH, least).sum(0).tolist()
    assert neardup.depth_for(close) == neardup.DEPTH  # all pairs are found at full depth
    assert least <= neardup.depth_for(neardup.weighed(np.full(50_000, 0.81), neardup.DEPTH, least).sum(0).tolist()) < neardup.DEPTH


@pytest.mark.parametrize("parts", [1, 7])
def test_ties_make_up_the_tries(spark, parts):
    """Ties of a level or more connect just the texts that share so many values in some tree."""
    r = np.random.default_rng(parts)
    trees, depth, least, n = 3, 4, 2, 300
    labels = r.integers(0, 4, (n, trees, depth)).astype(">u2")
    texts = spark.createDataFrame([(i, 1, bytearray(labels[i].tobytes())) for i in range(n)], "id long, n long, labels binary")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    got = [tuple(x) for x in neardup.ties(texts, trees, depth, least).collect()]
    spark.conf.set("spark.sql.shuffle.partitions", before)
    spark.conf.set("spark.sql.adaptive.enabled", "true")

    def groups(pairs):
        root = list(range(n))

        def find(x):
            while root[x] != x:
                x = root[x]
            return x

        for x, y in pairs:
            x, y = find(x), find(y)
            root[max(x, y)] = min(x, y)
        return [find(x) for x in range(n)]

    for d in range(least, depth + 1):
        shared = {}
        for i in range(n):
            for t in range(trees):
                shared.setdefault((t, labels[i, t, :d].tobytes()), []).append(i)
        assert groups((u, v) for u, v, level in got if level >= d) == groups((s[0], x) for s in shared.values() for x in s[1:])


def test_recall_at_the_threshold(spark):
    """Pairs just at and above the threshold, planted among other texts, beside brute force."""
    r, rows = np.random.default_rng(7), []
    for i in range(150):
        w = [f"w{i}x{j}" for j in range(200)]
        other = list(w)
        for at in range(10, 10 + int(r.integers(1, 5)) * 45, 45):  # each change takes five n-grams out of 196
            other[at] = "changed"
        rows += [(2 * i, " ".join(w)), (2 * i + 1, " ".join(other))]
    want = {d: n for d, _, n, _ in plain.similar(rows)}
    got = {x["doc_id"]: x["n_links"] for x in neardup.similar_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert sum(want.values()) == 300
    assert all(got[d] <= n for d, n in want.items()) and sum(got.values()) >= 0.99 * sum(want.values())


def test_little_similarity_hardly_meets():
    assert neardup.met(0.5, neardup.DEPTH) < 0.12 and neardup.met(0.3, neardup.DEPTH) < 0.003


@pytest.mark.parametrize("size", [1, 50, neardup.NEAR, 3 * neardup.NEAR + 5])
def test_signatures_are_least_hashes(size):
    text = " ".join(f"a{i}" for i in range(size + 4))
    n, got = neardup.signatures(pa.array(["x y", text, None, text + " more"]), trees=2, depth=2)
    grams, offsets = neardup.ngrams(pa.array([text]))
    want = [int(neardup.mix((neardup.mix(grams) * f).min()[None])[0] >> np.uint64(48)) for f in neardup._multipliers(4)]
    assert n.tolist() == [1, size, 0, size + 1] and got[1].tolist() == want and not got[2].any()


def test_blocks_against_blocks(spark):
    base = prose(11, 120).split()
    rows = []
    for i in range(40):
        w = list(base)
        w[(i * 7) % 120] = f"new{i}"
        rows.append((i, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    small, whole = (neardup.similar_groups(df, block_bytes=b).select("doc_id", "n_links", "n_text_links", "group_id") for b in (7000, 1 << 21))
    assert sorted(small.collect()) == sorted(whole.collect()) == sorted((d, n, n, g) for d, _, n, g in plain.similar(rows))


@given(st.lists(st.tuples(st.integers(0, 15), st.integers(0, 15)), max_size=20))
@settings(max_examples=5, deadline=None)
def test_components(spark, edges):
    root = {i: i for e in edges for i in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    met = {x for a, b in edges if a != b for x in (a, b)}
    got = graph.components(spark.createDataFrame(edges, "u long, v long"))
    assert {tuple(r) for r in got.collect()} == {(x, find(x)) for x in met}


# byte-level BPE


@given(st.text(max_size=80))
@settings(max_examples=200, deadline=None)
def test_backtracking_is_merging(text):
    own = bpe.codec(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    data = text.encode("utf-8", "ignore")
    assert own.encode_word(data) == ([own.ranks[data]] if data in own.ranks else own.merged(data))
    assert own.decode(np.array(own.encode_word(data), "<u4").tobytes()) == data


def test_encode_then_decode(spark, odd):
    path, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    got = bpe.decode(bpe.encode(odd, path, pattern), path, pattern)
    assert got.where(F.coalesce("text", F.lit("")).cast("binary") != F.col("decoded")).count() == 0
    with pytest.raises(KeyError):
        bpe.codec(path, pattern).decode(np.array([10**6], "<u4").tobytes())


# token counts


def test_pieces_add_up():
    text = prose(5, 4000) + " <|endoftext|>  x\n\n y " + "z" * 5000 + " end"
    path = public_tokenizers.path("byte_bpe_50k.json")
    assert "".join(token_counts.pieces(text, 100)) == text
    assert token_counts.counts([text, None, ""], path, most=100) == [token_counts.lengths([text], path)[0], 0, 0]


def test_batches_are_of_equal_bytes(monkeypatch):
    batches = []
    monkeypatch.setattr(token_counts, "lengths", lambda texts, path: batches.append(sum(len(t.encode()) for t in texts)) or [1] * len(texts))
    monkeypatch.setattr(token_counts, "cuttable", lambda path: False)
    assert token_counts.counts(["a" * 400, "😀" * 100] * 20, "x", batch_bytes=2000) == [1] * 40
    assert len(batches) == 8 and max(batches) == 2000


def test_truncation_and_padding_are_off(tmp_path):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    own = Tokenizer.from_file(path)
    own.enable_truncation(3)
    own.enable_padding(length=64)
    own.save(str(tmp_path / "cut.json"))
    text = "one two three four five six"
    assert token_counts.lengths([text, "one"], str(tmp_path / "cut.json")) == token_counts.lengths([text, "one"], path)


def test_sentence_pieces():
    path = public_tokenizers.path("piece_bpe_32k.model")
    assert not token_counts.cuttable(path)
    assert token_counts.counts(["hello world", None], path)[0] == token_counts.lengths(["hello world"], path)[0]


# language model


def test_probabilities_add_up(spark):
    texts = spark.createDataFrame([(prose(i, 300),) for i in range(30)], "text string")
    trained, counts = lm.learn(texts, head=50, own_class=20, steps=300)
    p = np.exp(trained.model.log_probabilities().astype(np.float64))
    assert np.allclose(p.sum(1), 1, atol=1e-4)
    inside = np.zeros(lm.SHAPES)
    own = set(trained.classes.own.to_pylist())
    for r in counts.collect():
        if r["word"] not in own:
            inside[r["shape"]] += 10 ** trained.log10_in_shape(np.array([r["n"]]), np.array([r["shape"]]))[0]
    assert np.allclose(inside + trained.shape_unknown, 1)
    assert set(trained.head.to_pylist()) <= {r["word"] for r in counts.collect()} and len(trained.head) <= 50


def test_classes_and_training_grow_with_the_tokens(spark):
    small, large = lm.own_classes(100_000), lm.own_classes(400_000)
    assert abs(large - 2 * small) <= 1 and small > lm.OWN_CLASS
    texts = spark.createDataFrame([(" ".join(f"w{(i * 37 + j * j) % 2500}" for j in range(400)),) for i in range(200)], "text string")
    trained, _ = lm.learn(texts, steps=20)
    assert len(trained.classes.own) == lm.own_classes(trained.total) > lm.OWN_CLASS
    assert trained.trained_pairs == trained.total == 200 * 401  # each pair once, however few the steps on a sample
    assert np.allclose(trained.normalisers, [trained.model.normalisers(i, i + 1)[0] for i in range(trained.classes.n)], atol=1e-4)


def test_scores_are_the_plain_ones(spark, odd):
    """Each text's score beside one worked out a token at a time, with words in the head, out of it, and unknown."""
    texts = spark.createDataFrame([(f"{prose(i, 80)} once{i} é{i}",) for i in range(40)], "text string")
    trained, counts = lm.learn(texts, head=30, own_class=10, steps=50)
    said = {r["word"]: r["n"] for r in counts.collect()}
    own = trained.classes.own.to_pylist()
    got = {r["doc_id"]: r["score"] for r in lm.score(odd.where("doc_id < 15 and doc_id <> 3"), trained, counts, ["doc_id"]).collect()}
    rows = [(r["doc_id"], r["text"]) for r in odd.where("doc_id < 15 and doc_id <> 3").collect()]
    m = trained.model
    for doc_id, text in rows:
        want, context = 0.0, trained.classes.end
        for word in [*plain.PLAIN.findall(plain.low(text or "")), None]:
            if word is None:
                target, inside = trained.classes.end, 0.0
            elif word in own:
                target, inside = own.index(word), 0.0
            else:
                shape = plain.shape(word)
                target, n = len(own) + shape, said.get(word, 0)
                share = (n - trained.shape_discount[shape]) / trained.shape_total[shape] if n else trained.shape_unknown[shape]
                inside = np.log10(share)
            scores = (m.targets.astype(float) @ m.contexts[context].astype(float)) + m.bias
            want += (scores[target] - np.log(np.exp(scores).sum())) / np.log(10) + inside
            context = target
        assert abs(got[doc_id] - want) < 1e-3 * max(1, abs(want)), doc_id


def test_better_than_single_words(spark, sf_dir):
    """On documents it hasn't seen, beside the same classes and discounts without any context."""
    docs = spark.read.parquet(f"{sf_dir.replace('0.001', '0.01')}/documents.parquet").select("doc_id", "text")
    hidden = F.col("doc_id") % 5 == 0
    trained, counts = lm.learn(docs.where(~hidden).select("text"))
    n = np.concatenate([trained.head_counts[: len(trained.classes.own)], trained.shape_total, [trained.ends]]) + 0.5
    none = np.zeros((len(n), 2), np.float32)
    alone = dataclasses.replace(trained, model=lm.LogBilinear(none, none, np.log(n / n.sum()).astype(np.float32)), normalisers=np.zeros(len(n)))
    total = lambda t: lm.score(docs.where(hidden), t, counts, ["doc_id"]).agg(F.sum("score"), F.sum("n_tokens")).first()
    (with_context, tokens), (without, _) = total(trained), total(alone)
    assert with_context / tokens > without / tokens + 0.1


def test_all_pairs_are_learnt(spark):
    """Words follow each other in pairs; the sample alone, of one step, knows nothing of them."""
    texts = spark.createDataFrame([(" ".join(f"{w} {w}x" for w in (f"w{(i * 7 + j) % 40}" for j in range(200))),) for i in range(300)], "text string").repartition(4)
    trained, _ = lm.learn(texts, steps=1)
    at = {w: i for i, w in enumerate(trained.classes.own.to_pylist())}
    p = np.exp(trained.model.log_probabilities())
    assert np.mean([p[at[f"w{i}"], at[f"w{i}x"]] for i in range(40)]) > 0.3


# sharding


def test_the_curve_visits_each_cell_once_and_next_to_the_last():
    for n, bits in ((2, 3), (3, 2)):
        cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * n, indexing="ij"), -1).reshape(-1, n)
        order = np.argsort(at := shards.hilbert(cells, bits))
        assert sorted(at.tolist()) == list(range(len(cells)))
        assert (np.abs(np.diff(cells[order], axis=0)).sum(1) == 1).all()


def test_sizes_near_equal(spark, odd):
    size = F.octet_length(F.coalesce("text", F.lit(""))) + 1
    got = shards.assign(odd, {"size": size}, size, F.col("text"), [F.col("doc_id")], {"doc_id": F.col("doc_id"), "n": size}, shards=3, law="bytes")
    rows = got.collect()
    sums = {s: sum(r["n"] for r in rows if r["shard"] == s) for s in range(3)}
    assert max(sums.values()) - min(sums.values()) <= 2 * max(r["n"] for r in rows)
    for s in range(3):
        slots = sorted(r["slot"] for r in rows if r["shard"] == s)
        assert slots == list(range(len(slots)))


@pytest.mark.parametrize("rows_a_part", [20_000, 7])
def test_equal_texts_stay_together(spark, rows_a_part):
    """Copies of a text differ in source and language; only the ends of runs split a group, or its size."""
    r = np.random.default_rng(5)
    texts = [f"text {i}" for i in range(300) for _ in range(int(r.integers(1, 6)))] + ["hot"] * 200
    rows = [(i, t, str(r.choice(["en", "de", "fr"])), f"https://example.org/{int(r.integers(0, 9))}") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = shards.assign(df, {"source": F.col("source"), "lang": F.col("lang")}, F.length("text"), F.col("text"), [F.col("doc_id")], {"doc_id": F.col("doc_id"), "text": F.col("text")}, rows_a_part=rows_a_part).collect()
    sizes = [sum(x["shard"] == i for x in got) for i in range(16)]
    assert max(sizes) - min(sizes) <= 1
    where, place = {}, {}
    for x in got:
        where.setdefault(x["text"], set()).add(x["shard"])
        place.setdefault(x["text"], []).append(sum(sizes[: x["shard"]]) + x["slot"])
    assert sum(len(s) > 1 for s in where.values()) <= 15
    assert all(max(p) - min(p) == len(p) - 1 for p in place.values())  # next to each other, across a run's end too


def test_texts_are_cut_by_whole_strings(spark):
    values = [f"https://example.org/{i:03d}" for i in range(100) for _ in range(1 + 3 * (i == 50))]
    df = spark.createDataFrame([(v, None if i % 9 else "x") for i, v in enumerate(values)], "a string, b string")
    cuts = shards.quantiles(df, {"a": F.col("a"), "b": F.col("b")}, 4)
    assert len(cuts["a"]) == 3 and cuts.get("b", []) == []
    parts = [sum((c < v) for c in cuts["a"]) for v in values]
    assert max(parts.count(i) for i in range(4)) - min(parts.count(i) for i in range(4)) <= 4
    assert shards.quantiles(df.where("false"), {"a": F.col("a")}, 4).get("a", []) == []


def test_files_are_pruned_in_every_dimension(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir.replace('0.001', '0.01')}/documents.parquet").select("doc_id", "text", "lang", "source", (F.octet_length("text") + 1).alias("size"))
    keep = {c: F.col(c) for c in ("doc_id", "lang", "source", "size")}
    placed = shards.assign(docs, {"size": F.log2("size"), "source": F.col("source"), "lang": F.col("lang")}, F.col("size"), F.col("text"), [F.col("doc_id")], keep)
    told = shards.write(placed, str(tmp_path / "hilbert"), ["lang", "source", "size"], rows_a_file=16)
    plain_order = shards.write(placed.withColumn("slot", F.floor(F.col("doc_id") / 16)).withColumn("shard", F.pmod("doc_id", F.lit(16)).cast("int")), str(tmp_path / "hash"), ["lang", "source", "size"], rows_a_file=16)
    every, asked = told.count(), {"lang": ("de", "de"), "source": ("src3", "src5"), "size": (1, 700)}
    files = {(r["shard"], r["file"]) for r in shards.pruned(told, **asked).collect()}
    assert len(files) < every / 4 < shards.pruned(plain_order, **asked).count()
    for one in asked:  # each dimension alone prunes too
        assert shards.pruned(told, **{one: asked[one]}).count() < 0.8 * every
    back = spark.read.parquet(str(tmp_path / "hilbert" / "rows"))
    assert back.count() == docs.count()
    needed = back.where("lang = 'de' and source between 'src3' and 'src5' and size <= 700").select("shard", "file").distinct().collect()
    assert needed and {tuple(r) for r in needed} <= files


# url rules


def test_nested_rules_and_salts(spark):
    rules = [("h", "/", "allow"), ("h", "/a/", "block"), ("h", "/a/b/", "allow"), ("x.h", "/a/", "allow"), ("h", "/a/", "block")]
    urls = [f"s://{h}/{p}" for h in ("h", "x.h", "y.x.h", "hh") for p in ("", "a", "a/", "a/b/c", "a/c", "b")] * 3
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    frame = url_rules.rules_frame(spark, rules)
    got = url_rules.judge(pages, frame, default="none")
    for r in got.collect():
        fit = [(len(h + p), len(h), h + p, v) for h, p, v in rules if (r["host"] == h or r["host"].endswith("." + h)) and r["path"].startswith(p)]
        best = max(fit, key=lambda f: (f[0], f[1]), default=(0, 0, None, "none"))
        assert (r["rule"], r["verdict"]) == best[2:]
    keys = got.select("host", "path").distinct()
    assert sorted(url_rules.judge_keys(keys, frame, rows_a_salt=1).collect()) == sorted(url_rules.judge_keys(keys, frame).collect())
    assert url_rules.judge(pages, url_rules.rules_frame(spark, [])).where("rule is not null").count() == 0


def test_stacks_are_the_rules_that_hold_a_rule(spark):
    r = np.random.default_rng(6)
    rules = {("h" if i % 3 else "g", "/" + "".join(r.choice(list("ab"), int(r.integers(0, 7))))) for i in range(120)}
    frame = url_rules.rules_frame(spark, [(h, p, "block") for h, p in sorted(rules)])
    got = {(x["rule_host"], x["rule_path"]): [s["path"] for s in x["stack"]] for x in url_rules._stacked(frame).collect()}
    assert got == {(h, p): sorted((q for g, q in rules if g == h and p.startswith(q)), key=len) for h, p in rules}


# quality


def one_sided(n, kinds, alarms, labelled, seed=4):
    """Votes of heuristics on documents, a fifth of which are bad, of one kind each: (votes and label, good).

    kinds[k][h]: how often heuristic h votes on badness of kind k; alarms[h]: how often on good documents.
    """
    r = np.random.default_rng(seed)
    good = r.random(n) < 0.8
    kind = r.integers(0, len(kinds), n)
    rate = np.where(good[:, None], np.array(alarms), np.array(kinds)[kind])
    votes = np.where(r.random(rate.shape) < rate, quality.BAD, quality.NONE)
    label = np.where(r.random(n) < labelled, np.where(good, quality.GOOD, quality.BAD), quality.NONE)
    return np.column_stack([votes, label]), good


def estimated(votes):
    patterns, place, counts = np.unique(votes, axis=0, return_inverse=True, return_counts=True)
    good, rates = quality.estimate(patterns, counts.astype(float))
    return good[place.ravel()], rates, patterns, counts


def test_rates_of_one_sided_labellers_are_recovered():
    kinds, alarms = [[0.9, 0.1, 0.0], [0.0, 0.7, 0.2], [0.1, 0.0, 0.8]], [0.01, 0.03, 0.0]
    votes, good = one_sided(40_000, kinds, alarms, 0.1)
    posterior, rates, _, _ = estimated(votes)
    assert np.allclose(rates[0], np.mean(kinds, 0), atol=0.05) and np.allclose(rates[1], alarms, atol=0.01)
    like = lambda r: np.prod(np.where(votes[:, :-1] == quality.BAD, r, 1 - np.array(r)), 1)
    known = 0.8 * like(alarms) > 0.2 * np.mean([like(k) for k in kinds], 0)  # by the rates that the votes were drawn with
    silent = votes[:, -1] == quality.NONE
    assert ((posterior > 0.5) == good)[silent].mean() > (known == good)[silent].mean() - 0.005
    one, good = one_sided(40_000, [[0.9]], [0.0], 0.05)
    posterior, rates, _, _ = estimated(one)
    assert abs(rates[0, 0] - 0.9) < 0.05 and rates[1, 0] < 0.01
    assert (posterior[(one == 0).all(1)] > 0.9).all()


def test_labels_are_kept_and_wrong_heuristics_are_not_believed():
    votes, good = one_sided(20_000, [[0.5, 0.5]], [0.3, 0.0], 0.1)
    votes[:, 1] = np.where(good & (np.arange(len(good)) % 9 == 0), quality.BAD, quality.NONE)  # votes on good documents only
    posterior, rates, _, _ = estimated(votes)
    assert (posterior[votes[:, -1] == quality.GOOD] > 0.99).all() and (posterior[votes[:, -1] == quality.BAD] < 0.01).all()
    assert (posterior[(votes[:, 0] == 0) & (votes[:, 1] == quality.BAD) & (votes[:, -1] == 0)] > 0.5).all()


def test_without_labels_what_no_heuristic_finds_is_good():
    votes, good = one_sided(20_000, [[0.9, 0.2], [0.1, 0.8]], [0.01, 0.01], 0.0)
    posterior, _, _, _ = estimated(votes)
    assert (posterior[(votes == 0).all(1)] > 0.9).all() and (posterior[(votes < 0).any(1)] < 0.5).all()


def test_estimate_is_the_plain_one():
    votes, _ = one_sided(3_000, [[0.8, 0.2], [0.1, 0.7]], [0.02, 0.05], 0.2)
    _, _, patterns, counts = estimated(votes)
    good, _ = quality.estimate(patterns, counts.astype(float), rounds=40)
    prior = quality.PRIOR_VOTES.tolist(), quality.PRIOR_DOCUMENTS.tolist(), quality.LABEL_ERROR
    assert np.allclose(good, plain.posteriors(patterns.tolist(), counts.tolist(), 40, *prior), atol=1e-6)


def test_held_out_accuracy(spark, sf_dir):
    """On the table with some four thousand labels, a third of them hidden from the classifier."""
    docs, labels = (spark.read.parquet(f"{sf_dir.replace('0.001', '0.1')}/{t}.parquet") for t in ("documents", "labels"))
    hidden = F.pmod(F.xxhash64("doc_id"), F.lit(3)) == 0
    got = quality.score(docs, quality.fit(docs, labels.where(~hidden)), keep=["doc_id"]).join(labels.where(hidden), "doc_id").collect()
    share = lambda rows, right: sum(map(right, rows)) / len(rows)
    kept = lambda r: r["keep_document"]
    assert share(got, lambda r: (r["quality_score"] >= 0.5) == (r["quality"] == 1)) > 0.99
    assert share([r for r in got if r["quality"] == 1 and r["toxic"] == 0], kept) > 0.99
    assert share([r for r in got if r["toxic"] == 1], kept) < 0.1


def test_rare_words_of_labelled_documents_count():
    """A word of 18 of 8,000 documents, all of them abusive, decides, however many documents have no vote."""
    features = [(np.array([1, 2], np.int32) if i < 18 else np.array([2], np.int32), np.ones(2 if i < 18 else 1, np.float32)) for i in range(8000)]
    targets = np.where(np.arange(8000) < 18, 0.01, 0.99)
    weights, bias = quality.train(features, targets, np.arange(8000) < 3000, bits=4, rare=4.0)
    assert weights[1] < 0 and weights[1] + weights[2] + bias < 0 < weights[2] + bias


def test_markers_in_any_language(spark):
    r = np.random.default_rng(8)
    abusive = np.arange(600) % 8 == 0
    texts = [" ".join([*(f"mot{x}" for x in r.integers(0, 50, 30)), *(["achkeiter", "réeuxçois"] if bad and i % 3 else [])]) for i, bad in enumerate(abusive.tolist())]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    said = spark.createDataFrame([(i, -1 if bad else 1) for i, bad in enumerate(abusive.tolist())], "doc_id long, labelled_toxic int")
    marks = quality.learnt_markers(docs.withColumn("k", F.col("doc_id")), said)
    found = quality.find_words(pa.array(["achkeiter", "réeuxçois", "mot7"]), quality.PLAIN)
    lexicon = quality.Lexicon(found.lexicon)
    assert sorted(w.decode() if isinstance(w, bytes) else w for w, h in zip(found.lexicon.to_pylist(), lexicon.hash, strict=False) if h in marks) == ["achkeiter", "réeuxçois"]
    assert quality.Shares(quality.find_words(pa.array(["achkeiter réeuxçois mot7", "mot7 mot8 achkeiter"]), quality.PLAIN), marks).votes()[:, -1].tolist() == [quality.BAD, quality.NONE]


def test_labels_are_not_needed(spark, odd, sf_dir):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality.score(odd, quality.fit(odd, none)).count() == odd.count()
    docs, labels = (spark.read.parquet(f"{sf_dir.replace('0.001', '0.01')}/{t}.parquet") for t in ("documents", "labels"))
    got = quality.score(docs, quality.fit(docs, none), keep=["doc_id"]).join(labels, "doc_id").collect()
    clean = [r["keep_document"] for r in got if r["quality"] == 1 and r["toxic"] == 0]
    bad = [r["keep_document"] for r in got if r["quality"] == 0]
    assert sum(clean) > 0.95 * len(clean) and sum(bad) < 0.5 * len(bad)


# names that clash, and the pipeline


def test_clashing_columns(spark, clashing, odd_rows):
    n = len(odd_rows)
    path, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    binary = clashing.withColumn("media", F.col("text").cast("binary"))
    index = decontaminate.build_index(clashing)
    items = spark.createDataFrame([(1, prose(3, 15))], "item_id long, text string")
    results = [
        media.sniff(binary, declared=None),
        decontaminate.with_columns(index, decontaminate.find_exact(index, items), clashing.schema, [c for c in clashing.columns if c != "text"]),
        substring.repeats(clashing),
        bpe.encode(clashing, path, pattern, with_decoded=True),
        neardup.similar_groups(clashing),
        quality.score(clashing, quality.fit(clashing, spark.createDataFrame([], "doc_id long, quality int, toxic int"))),
        token_counts.count_tokens(clashing, public_tokenizers.path("byte_bpe_50k.json"), keep=("doc_id", "n_tokens")),
        shards.assign(clashing, {"n": F.col("n_chars")}, F.col("n_chars"), F.col("text"), [F.col("doc_id")], {"doc_id": F.col("doc_id"), "shard": F.col("source")}),
        lm.score(clashing, *lm.learn(clashing.select("text"), steps=20), ["doc_id", "score", "rest"]),
        url_rules.judge(clashing.withColumn("url", F.col("text")), url_rules.rules_frame(spark, [("a", "/", "allow")]), keep=("doc_id", "host", "score")),
    ]
    for got in results:
        assert len(set(got.columns)) == len(got.columns) and len(got.collect()) == n


def stages(spark, docs, path):
    from lanework.llm.store import written

    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, written(stage(spark, docs, path), "test")
        yield name, before, docs


def test_pipeline_on_odd_rows(spark, clashing, odd_dir):
    for _, before, after in stages(spark, clashing, odd_dir):
        last = "ids" in after.columns and after.schema["ids"].dataType.simpleString() == "binary"
        assert last or after.columns == before.columns


def test_pipeline_on_nothing(spark, empty_dir):
    assert corpus_pipeline.run(spark, empty_dir).collect() == []


def test_pipeline_stage_by_stage(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    for (name, before, after), want in zip(stages(spark, docs, sf_dir), ["kept", "one", "cut", "clean", "ids"], strict=True):
        b, a = ([r.asDict() for r in x.collect()] for x in (before, after))
        if want == "kept":
            assert {repr(r) for r in a} <= {repr(r) for r in b} and len(a) > len(b) / 2
        elif want == "one":
            groups = {d: g for d, _, _, g in plain.similar([(r["doc_id"], r["text"]) for r in b])}
            assert sorted(groups[r["doc_id"]] for r in a) == sorted(set(groups.values()))
        elif want == "cut":
            expected = {d: (gone, n, sha) for d, n, gone, sha in plain.without_repeats([(r["doc_id"], r["text"]) for r in b])}
            texts = {r["doc_id"]: r["text"] for r in b}
            assert {r["doc_id"] for r in a} == {d for d, (gone, n, _) in expected.items() if not n or gone < n}
            assert all(plain.sha(r["text"]) == expected[r["doc_id"]][2] if expected[r["doc_id"]][0] else r["text"] == texts[r["doc_id"]] for r in a)
        elif want == "clean":
            hit = {d: bad for d, *_, bad in plain.decontaminated([(r["doc_id"], r["text"]) for r in b], items)}
            assert {r["doc_id"] for r in a} == {d for d, bad in hit.items() if not bad}
        else:
            own = bpe.codec(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
            texts = {r["doc_id"]: r["text"] for r in b}
            assert len(a) == len(b) and all(own.decode(bytes(r["ids"])).decode() == texts[r["doc_id"]] for r in a), name


def test_schema_helper():
    assert SCHEMA.startswith("doc_id")
