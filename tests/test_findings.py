"""Registered queries on tables with what larger copies have: long keys, many lists; and what their plans cost."""

import cProfile
import pstats

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from lanework.llm import lm
from lanework.plans import texts
from lanework.plans.parsers import resultlist, startlist
from lanework.plans.registry import ORACLES


def test_keys_of_seven_digits_are_as_in_the_sql(spark, tmp_path):
    keys = [5, 999_999, 1_000_000, 1_234_567]
    pq.write_table(pa.table({"p_partkey": pa.array(keys, pa.int64()), "p_brand": ["Brand#1"] * 4, "p_size": pa.array([1, 50, 9, 7], pa.int32())}), tmp_path / "part.parquet")
    db = duckdb.connect()
    db.execute(f"CREATE VIEW part AS FROM '{tmp_path}/part.parquet'")
    got = texts.distance_from_text(spark, str(tmp_path)).select("p_partkey", "distance", "splits", "key")
    assert sorted(map(tuple, got.collect())) == sorted(db.execute(ORACLES["distance_from_text"]).fetchall())


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_start_lists_are_read_once(spark):
    text = "\n".join(["Yarış 3", "", "", "", "", "Erkekler, 50m Serbest", "Seri 1 / 1", "1 Ada LANE", "", "", "", "2 Can POOL", "09"])
    docs = spark.createDataFrame([(1, text), (2, None)], "doc long, text string")
    got = startlist.described_entries(docs, "doc", "text")
    assert [(r["line_no"], r["name"], r["year_of_birth"], r["event_name"], r["style"]) for r in got.orderBy("line_no").collect()] == [(8, "Ada LANE", None, "Yarış 3, Erkekler, 50m Serbest", "Serbest"), (12, "Can POOL", "09", "Yarış 3, Erkekler, 50m Serbest", "Serbest")]
    plan = plan_of(got)
    assert "Join" not in plan and plan.count("Generate") == 1


def test_times_take_few_patterns(spark, sf_dir):
    plan = plan_of(texts.time_normalise(spark, sf_dir))
    assert plan.count("regexp_replace") + plan.count("regexp_extract") < 30


def test_headers_are_made_row_by_row(spark):
    text = "Winter Meet - SPLASH Meet Manager 11\nANKARA, Havuz\nYarış 1\nErkekler, 50m Serbest\n3.4.2025"
    docs = spark.createDataFrame([(1, text), (1, text), (2, None)], "doc long, text string")
    got = startlist.header(docs, "doc", "text")
    assert [tuple(r) for r in got.collect()] == [(1, "Winter Meet", "3.4.2025", "ANKARA", "Yarış 1", "Erkekler", "50m", "Serbest")] * 2
    plan = plan_of(got)
    assert not any(x in plan for x in ("Window", "Aggregate", "Sort", "Generate"))


@pytest.mark.parametrize("block", [["7.", "Ada LANE", "09", "Club a", "1:20.{0:02d}", "5{0:02d}"], ["disk.", "Ada LANE", "09", "Club b", "SW 4.4", "(Zaman: 15:{0:02d})", "td.", "(Td) Can POOL 11", "Club c", "1:20.{0:02d} 5{0:02d}"]])
def test_what_lines_say_is_worked_out_once(block):
    """Calls of functions a line: 64 and 53 before lines' fields were held."""
    lines = ["Yarış 1, Erkekler; 50m Serbest", *[x.format(i % 100) for i in range(200) for x in block]]
    run = next(c for c in (getattr(resultlist, "parse_unlabelled", None), resultlist.parse) if c)
    run("\n".join(lines))
    profile = cProfile.Profile()
    got = profile.runcall(run, "\n".join(lines))
    assert len(got["records"]) + len(got["special_records"]) == (200 if block[0] == "7." else 400)
    assert pstats.Stats(profile).total_calls / len(lines) < 30


def test_a_training_step_is_the_plain_one():
    """The steps' sums by row, classes beyond 16 bits too, and a step beside one that is written out."""
    random = np.random.default_rng(1)
    at = random.choice([0, 3, 70_000, 65_536, 140_000], 200)
    g = random.normal(size=(200, 5)).astype(np.float32)
    own, sums = lm._sums_of(at, g)
    assert own.tolist() == sorted(set(at.tolist()))
    assert np.allclose(sums, [g[at == i].sum(0) for i in own], atol=1e-5)
    learner = lm.Learner.begun(np.arange(1, 60))
    plain = learner.copied()
    learner.start(np.random.default_rng(2))
    plain.start(np.random.default_rng(2))
    context, target = random.integers(0, 59, 64), random.integers(0, 59, 64)
    learner.step(context, target, 0.1)
    m, fake = plain.model, np.searchsorted(plain.upto, plain.random.random(lm.NOISE) * plain.upto[-1], "right")
    chance = lambda r, c: 1 / (1 + np.exp(-(m.contexts[r] @ m.targets[c].T + m.bias[c] - plain.shift[c])))
    grad = np.zeros_like(m.contexts)
    for r, c in zip(context, target, strict=True):
        grad[r] += (chance(r, c) - 1) * m.targets[c] + chance(r, fake) @ m.targets[fake]
    squares = plain.squares[0] + (grad**2).mean(1)
    assert np.allclose(learner.model.contexts, m.contexts - 0.1 * grad / np.sqrt(squares)[:, None], atol=1e-4)
