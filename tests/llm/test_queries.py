"""Each query over odd, empty and real small tables, beside plain versions, libraries and SQL."""

import hashlib
import struct
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pytest

from lanework.llm import queries as Q

from . import plain


@pytest.fixture(params=["odd_dir", "sf_dir"])
def tables(request):
    return request.getfixturevalue(request.param)


def documents(spark, path):
    return [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{path}/documents.parquet").collect()]


def same(got, want):
    assert sorted(map(repr, got)) == sorted(map(repr, want))


def test_media(spark, tables):
    got = Q.op1_media_sniffing(spark, tables).collect()
    want = []
    for doc_id, text in documents(spark, tables):
        data = (text or "").encode()
        payload = data + b"\0" * (max(1, -(-len(data) // 64)) * 64 - len(data))
        stored = b"RIFF" + struct.pack("<I", 36 + len(payload)) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, 8000, 8000, 1, 8) + b"data" + struct.pack("<I", len(payload)) + payload
        up = [x > 127 for x in payload]
        feature = f"audio/wav;frames={len(payload)};sum={sum(payload)};square={sum(x * x for x in payload)};low={min(payload)};high={max(payload)};crossings={sum(a != b for a, b in zip(up, up[1:], strict=False))}"
        want.append((doc_id, len(data), len(payload), plain.sha(payload), zlib.crc32(payload[-64:]), len(stored), plain.sha(stored), feature))
    same([tuple(r)[:8] for r in got], want)
    assert all(r["valid"] and r["media_type"] == "audio/wav" for r in got)


def test_decontamination(spark, tables):
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{tables}/benchmark.parquet").collect()]
    got = [tuple(r) for r in Q.op2_benchmark_decontamination(spark, tables).collect()]
    same(got, plain.decontaminated(documents(spark, tables), items))
    assert any(r[-1] for r in got)


def test_language_model(spark, tables):
    got = Q.op3_lm_scoring(spark, tables).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score").collect()
    want = list(plain.base_scores(documents(spark, tables)))
    same([tuple(r)[:5] for r in got], [w[:5] for w in want])
    assert np.allclose(sorted(r["base_score"] for r in got), sorted(w[5] for w in want))
    assert all(np.isfinite(r["score"]) and r["score"] < 0 for r in got)
    if len(got) > 50:  # on documents it hasn't seen, the model is better than the base
        held = [r for r in got if r["held_out"]]
        assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_url_rules(spark, tables):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS FROM '{tables}/pages.parquet{'/*.parquet' if 'odd' in tables else ''}'")
    same([tuple(r) for r in Q.op4_url_rules(spark, tables).select("page_id", "host", "path", "rule", "verdict").collect()], con.execute(Q.OP4_SQL).fetchall())


def test_substring_dedup(spark, tables):
    same([tuple(r) for r in Q.op5_substring_dedup(spark, tables).collect()], plain.without_repeats(documents(spark, tables)))


def test_byte_bpe(spark, tables):
    import tiktoken

    from lanework.llm.bpe import read_ranks

    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")), special_tokens={})
    want = []
    for doc_id, text in documents(spark, tables):
        ids = library.encode_ordinary(text or "")
        want.append((doc_id, len(ids), plain.sha(np.array(ids, "<u4").tobytes()), plain.sha(text or "")))
    same([tuple(r) for r in Q.op6_byte_bpe(spark, tables).collect()], want)


def test_jaccard_join(spark, tables):
    got = Q.op7_ngram_jaccard_join(spark, tables).select("doc_id", "class_id", "n_links", "group_id").collect()
    same([tuple(r) for r in got], plain.similar(documents(spark, tables)))


def test_shards(spark, tables):
    got = Q.op8_hilbert_shards(spark, tables).collect()
    rows = documents(spark, tables)
    same([(r["doc_id"], r["size"], r["text_crc32"]) for r in got], [(d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t in rows])
    sizes = Counter(r["shard"] for r in got)
    assert set(sizes) <= set(range(16)) and max(sizes.values()) - min(sizes.get(i, 0) for i in range(16)) <= 1
    slots = defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    by_shard = defaultdict(list)
    for r in got:
        by_shard[r["shard"]].append(r["curve"])
    order = sorted(by_shard)
    assert all(max(by_shard[a]) <= min(by_shard[b]) for a, b in zip(order, order[1:], strict=False))
    text = {d: t or "" for d, t in rows if d is not None}
    where = defaultdict(set)
    for r in got:
        if r["doc_id"] is not None:
            where[text[r["doc_id"]]].add(r["shard"])
    assert sum(len(s) > 1 for s in where.values()) <= 15  # groups of equal texts are split by the ends of runs only


def test_quality(spark, tables):
    got = Q.op9_quality_classifier(spark, tables).collect()
    same([r["doc_id"] for r in got], [d for d, _ in documents(spark, tables)])
    assert all(0 <= r["quality_score"] <= 1 and 0 <= r["toxic_score"] <= 1 for r in got)


def test_token_counts(spark, tables):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = []
    for doc_id, text in documents(spark, tables):
        n = len(library.encode(text or "", add_special_tokens=False).ids)
        want.append((doc_id, len((text or "").encode()), n, n > 512))
    same([tuple(r) for r in Q.op10_token_counts(spark, tables).collect()], want)


@pytest.mark.parametrize("name", sorted(Q.ORACLES))
def test_sql_says_the_same(spark, tables, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "pages"):
        con.execute(f"CREATE VIEW {t} AS FROM '{tables}/{t}.parquet{'/*.parquet' if 'odd' in tables else ''}'")
    said = con.execute(Q.ORACLES[name])
    columns = [d[0] for d in said.description]
    got = Q.QUERIES[name](spark, tables)
    assert sorted(got.columns) == sorted(columns)
    same([tuple(r) for r in got.select(*columns).collect()], said.fetchall())


@pytest.mark.parametrize("name", sorted(Q.QUERIES))
def test_empty_tables(spark, empty_dir, name):
    got = Q.QUERIES[name](spark, empty_dir)
    assert got.collect() == [] and "doc_id" in got.columns or "page_id" in got.columns


def test_digest_helper():
    assert plain.sha("") == hashlib.sha256(b"").hexdigest()
