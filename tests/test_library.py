"""Functions and operators on small inputs, quirks included."""

import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lanework.functions import numbers, text
from lanework.operators import dedupe, joins, match, quality, reads, upsert, windows
from lanework.sources import files, html, sinks
from lanework.streaming import incremental


def values(spark, column, rows):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, x string")
    return [r[0] for r in df.orderBy("i").select(column(F.col("x"))).collect()]


@pytest.mark.parametrize(
    ("column", "given_", "want"),
    [
        (text.collapse, [" a  \t b ", None], ["a b", None]),
        (text.fold_key, ["İŞIĞ Ünal-Öz", "Crème Brûlée 1", None, " "], ["isigunaloz", "cremebrulee1", "", ""]),
        (text.slug, [" İzmir Cup! ", "--"], ["i-zmir-cup", ""]),
        (text.safe_pdf_name, ['a<b>:"c".PDF', None, " . "], ["a_b_c_.pdf", "document.pdf", "document.pdf"]),
        (text.safe_slug, ["Şehir: 1", "", "__"], ["Şehir_1", "event", "event"]),
        (text.strip_html, ["<b>a</b>&nbsp;&amp;lt;<i>c"], ["a &lt; c"]),
        (text.corrected_line, ["yaris  3 kucukler", "Yarışma"], ["Yarış 3 Küçükler", "Yarışma"]),
        (text.clean_club, ['Kulüb7 "x", (Fd)', "(Tk)", None], ["Kulüb x", None, None]),
        (text.clean_name, ["(td) Ada,  LANE"], ["Ada LANE"]),
        (text.gender, [" KIZ ", "erkekler", "mixed"], ["Kadınlar", "Erkekler", "mixed"]),
        (text.name_from_url, ["http://x/a/CS-12/?q", "http://x/a/cs12", "http://x/"], ["CS-12", None, None]),
        (text.title_of_path, ["r/Cup - SPLASH Meet Manager 11/startlists/a.pdf", "r/startlists/Cup/a.pdf"], ["Cup", "Cup"]),
        (text.list_number, ["StartList_12.pdf", "resultlist_3", "x"], ["12", "3", None]),
        (text.strip_fence, ["```csv\na;b\n```", "a"], ["a;b", "a"]),
        (text.is_name_continuation, ["LANE", "Lane", "A B C D", "A1", ""], [True, False, False, False, False]),
        (text.is_status_line, ["BARAJ GEÇTİ", "Baraj", "DQ 1"], [True, False, False]),
        (text.is_probable_swimmer, ["Ada LANE", "Deniz Spor", "Arda Efe", "Sira", "ada lane", None], [True, False, True, False, False, False]),
        (text.name_prefix, ["Ada Can LANE Deniz Spor", "Ada LANE Spor", "x y z"], ["Ada Can LANE", "Ada LANE", None]),
        (numbers.parse_int, [" 12 ", "3.0", "", None, "x", "99999999999"], [12, 0, 0, 0, 0, 0]),
        (numbers.parse_distance, ["4x50m", "50 m", "50", "x"], [200, 50, 50, 0]),
        (numbers.distance_in_text, ["1OO m", "50m", "5m", None], [100, 50, None, None]),
        (numbers.normal_time, ["1-02,3", "28,45", "1213.36", "01:02.03", "NT", None], ["1:02.03", "28.45", "12:13.36", "1:02.03", "NT", None]),
        (lambda x: numbers.normal_time(x, False), ["1213.36"], ["1213.36"]),
        (numbers.seed_of, ["1-02-03", "nt", "x", None], ["1:02:03", "NT", None, None]),
        (lambda x: numbers.time_parts(x)["left"], ["Club28.45 512", "none"], ["Club", ""]),
        (lambda x: numbers.total_and_points(x, True)["time"], ["a 1:02.03 5", "28.45", "3234"], ["1:02.03", None, "32.34"]),
        (lambda x: numbers.total_and_points(x, False)["rest"], ["Club 28.45 512 .", "28.45 abc 9", "x"], ["Club", "abc", "x"]),
    ],
)
def test_columns(spark, column, given_, want):
    assert values(spark, column, given_) == want


def test_columns_are_the_parsers_functions(spark):
    from lanework.plans.parsers import lines as L

    rows = ["Club 28.45 1512", "1:02.03", "2:15,33 610 x", "3234", "abc", "1-02.03 5/6", "Ada 12.30 xyz 4"]
    for long in (True, False):
        got = [tuple(r) for r in values(spark, lambda x, long=long: numbers.total_and_points(x, long), rows)]
        assert got == [L.total_of(r, long) for r in rows]
        steps = numbers.with_total_and_points(spark.createDataFrame(list(enumerate(rows)), "i int, x string"), F.col("x"), long).orderBy("i")
        assert [tuple(r) for r in steps.select("time", "points", "rest").collect()] == got


@given(st.text(alphabet="ıİşŞğĞüÜöÖçÇéÀñaZ09 -_ﬁ", max_size=20))
@settings(max_examples=60, deadline=None)
def test_fold_key_exact(value):
    assert text.fold_key_python(value).isascii()


def test_first_filled_trims_after_the_choice(spark):
    df = spark.createDataFrame([(" ", "b"), ("", " b "), (None, None)], "x string, y string")
    assert [r[0] for r in df.select(text.first_filled(F.col("x"), F.col("y"))).collect()] == ["", "b", ""]


def test_optional_filters(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "n int, s string")
    assert reads.optionally(df, n="x", s="").count() == 2 and reads.optionally(df, n=" 1 ", s=None).count() == 1


def test_ordered_dedupe(spark):
    df = spark.createDataFrame([("k", 2, None, "r2"), ("k", 1, "t1", None), ("k", 3, "t3", "r3")], "k string, o int, t string, r string")
    assert dedupe.first_wins(df, ["k"], "o", t=F.col("t"), r=F.col("r")).collect() == [("k", "t1", "r2")]
    assert dedupe.last_wins(df, ["k"], "o", t=F.col("t"), r=F.col("r")).collect() == [("k", "t3", "r3")]
    assert dedupe.keep_first(df, ["k"], ["o"]).select("o").collect() == [(1,)]
    lines = spark.createDataFrame([(1, i, x) for i, x in enumerate(["a a", "x", "a a", "b b", "", "", "b b"])], "d int, n int, l string")
    assert [r["l"] for r in dedupe.without_repeats(lines, "d", "n", "l").orderBy("n").collect()] == ["a a", "b b", "", "b b"]


def test_lookup_fails_the_whole_batch(spark):
    parents = spark.createDataFrame([(1, "a"), (2, "b")], "id long, name string")
    rows = spark.createDataFrame([(1, None), (0, "b")], "i long, n string")
    assert sorted(r["parent_id"] for r in joins.checked_lookup(rows, parents, ("i", "id"), ("n", "name")).collect()) == [1, 2]
    bad = rows.unionByName(spark.createDataFrame([(9, "a")], "i long, n string"))
    assert joins.misses(bad, parents, ("i", "id"), ("n", "name")).count() == 1
    with pytest.raises(Exception, match="no such parent"):
        joins.checked_lookup(bad, parents, ("i", "id"), ("n", "name")).collect()


def test_small_sides_only_are_hinted(spark):
    df = spark.range(10)
    assert joins.small(df, 1) is df and joins.small(df) is not df


# matching


def people(spark, rows):
    return spark.createDataFrame(rows, "list int, ord int, name string, club string, time string, rank string")


def test_exact_then_fuzzy(spark):
    starts = people(spark, [(1, 1, "adalane", "deniz", None, None), (1, 2, "canpool", "x", None, None), (1, 3, "adalanne", "", None, None), (1, 4, "", "deniz", None, None), (2, 1, "adalane", "deniz", None, None)])
    records = people(spark, [(1, 1, "adalane", "deniz", "28.45", None), (1, 2, "adalane", "deniz", "29.00", "7"), (1, 3, "canpool", "other", "30.00", "2")])
    got = {(r["list"], r["ord"]): (r["time"], r["rank"], r["how"]) for r in match.matched(starts, records, ["list"]).collect()}
    assert got[1, 1] == ("28.45", "7", "exact")  # the rank comes from another record than the time
    assert got[1, 2] == ("30.00", "2", "exact")  # the name alone, across clubs
    assert got[1, 3] == ("28.45", None, "fuzzy")  # exact matches don't use candidates up
    assert got[1, 4][0] is None and got[2, 1][0] is None
    used = {(r["list"], r["ord"]): r["how"] for r in match.matched(starts, records, ["list"], consume_exact=True).collect()}
    assert used[1, 3] is None


@given(st.lists(st.text(alphabet="abc", min_size=3, max_size=7), max_size=8), st.lists(st.text(alphabet="abc", min_size=3, max_size=7), max_size=8))
@settings(max_examples=100, deadline=None)
def test_greedy_is_one_to_one_and_first_on_ties(names, others):
    import pandas as pd

    found = match.greedy(pd.DataFrame({"name": names, "club": ""}, dtype=object), pd.DataFrame({"name": others, "club": ""}, dtype=object))
    places = [p for p, _ in found if p >= 0]
    assert len(places) == len(set(places))
    free = list(range(len(others)))
    for name, (p, s) in zip(names, found, strict=True):
        scores = {i: match.ratio(name, others[i]) for i in free}
        best = max((v for v in scores.values() if v >= 0.9), default=None)
        assert (p, s) == ((min(i for i in free if scores[i] == best), best) if best else (-1, 0.0))
        free = [i for i in free if i != p]


def test_tiers(spark):
    sources = spark.createDataFrame([("a", 1), ("b", 2), ("c", 9)], "f string, n int")
    rows = spark.createDataFrame([("a", 5, ""), ("a", 2, "x"), ("z", 2, "")], "link string, n int, result string")
    got = joins.tiered_targets(sources, rows, "f", "link", "n", F.col("result") == "")
    assert {tuple(r) for r in got.collect()} == {("a", 2, 1), ("b", 2, 2), ("c", -2, 3)}


def test_rows_of_tiers(spark):
    sources = spark.createDataFrame([("a", 1), ("b", 2), ("c", 9), ("d", 8)], "f string, n int")
    rows = spark.createDataFrame([("a", 5, ""), ("a", 2, "x"), ("z", 2, ""), ("z", 7, None)], "link string, n int, result string")
    got = joins.tiered_rows(sources, rows, "f", "link", "n", F.coalesce("result", F.lit("")) == "")
    assert sorted((r["f"] or "", r["tier"], r["target"]["link"], r["target"]["n"]) for r in got.collect()) == [
        ("", 3, "a", 5), ("", 3, "z", 2), ("", 3, "z", 7), ("a", 1, "a", 2), ("a", 1, "a", 5), ("b", 2, "a", 2), ("b", 2, "z", 2),
    ]
    assert joins.tiered_rows(sources.where("f < 'c'"), rows, "f", "link", "n", F.lit(True)).where("tier = 3").count() == 0
    counts = joins.tiered_targets(sources, rows, "f", "link", "n", F.lit(True))
    assert {tuple(r) for r in counts.collect()} == {("a", 2, 1), ("b", 2, 2), ("c", -4, 3), ("d", -4, 3)}
    assert joins.tiered_targets(sources, rows.where("false"), "f", "link", "n", F.lit(True)).where("n = 0 and tier = 3").count() == 4


# upserts


def test_got_or_created(spark):
    table = spark.createDataFrame([("x", "1"), ("x", "1"), (None, "2")], "title string, date string")
    rows = spark.createDataFrame([("x", "1", 5), ("x", "1", 3), ("y", "1", 1), (None, "2", 9)], "title string, date string, ord int")
    got = upsert.got_or_created(table, rows, ["title", "date"], "ord")
    assert {tuple(r) for r in got.collect()} == {("x", "1", 3, 2, "kept"), ("y", "1", 1, 1, "created"), (None, "2", 9, 1, "kept")}


def test_patch_keeps_what_is_not_there(spark):
    table = spark.createDataFrame([("k1", "a", 5), ("k2", "b", 6)], "key string, result string, lane int")
    rows = spark.createDataFrame([("k1", 1, "new", None, True, False), ("k1", 2, None, 9, False, True), ("k3", 3, "c", 1, True, True)], "key string, o int, result string, lane int, p1 boolean, p2 boolean")
    changes = upsert.patches(rows, ["key"], "o", ["result", "lane"], {"result": F.col("p1"), "lane": F.col("p2")})
    after = upsert.merged(table, changes, ["key"], ["result", "lane"])
    assert {tuple(r) for r in after.collect()} == {("k1", "new", 9, "updated"), ("k2", "b", 6, "kept"), ("k3", "c", 1, "created")}
    again = upsert.merged(after.drop("action"), changes, ["key"], ["result", "lane"])
    assert {tuple(r)[:3] for r in again.collect()} == {tuple(r)[:3] for r in after.collect()}
    said = upsert.summary(rows, F.col("result").isNotNull(), "key", after).collect()[0]
    assert tuple(said) == (3, 2, 2, 1, 1)


def test_a_key_that_is_there_with_null_is_there(spark):
    df = spark.createDataFrame([('[{"result": null}]',), ('{"rows": [{"x": "1"}]}',), ("[]",)], "b string")
    got = [r[0] for r in df.select(F.transform(files.body_rows(F.col("b")), lambda r: files.has_key(r, "result", "time"))).collect()]
    assert got == [[True], [False], []]


def test_natural_upsert_erases_with_blanks(spark):
    table = spark.createDataFrame([("k", "28.45")], "key string, result string")
    rows = spark.createDataFrame([("k", 1, "29"), ("k", 2, "")], "key string, o int, result string")
    assert upsert.natural_upsert(table, rows, ["key"], "o", ["result"]).collect() == [("k", "", "updated")]


def test_keys_go_on_from_the_largest(spark):
    old = spark.createDataFrame([("e", "e-000007"), ("e", "e-x"), ("f", "other")], "g string, key string")
    new = spark.createDataFrame([("e", 1), ("e", 2), ("f", 1), ("h", 1)], "g string, o int")
    assert {r["key"] for r in windows.allocated_keys(new, old, "g", "o", "key").collect()} == {"e-000008", "e-000009", "f-000001", "h-000001"}


def test_names_avoid_those_taken(spark):
    rows = spark.createDataFrame([(1, "cup"), (2, "cup"), (3, "cup"), (4, "x" * 100), (5, "x" * 100)], "o int, base string")
    taken = spark.createDataFrame([("cup",), ("cup-3",)], "name string")
    got = {r["o"]: r["name"] for r in upsert.allocated_names(rows, taken, "base", "o", "name").collect()}
    assert (got[1], got[2], got[3]) == ("cup-2", "cup-4", "cup-5")
    assert got[4] == "x" * 100 and got[5] == "x" * 98 + "-2"


# quality


def test_total_sums_the_lists_distinct_counts(spark):
    starts = spark.createDataFrame([(1,), (1,), (2,)], "l int")
    records = spark.createDataFrame([(1, "a", True), (1, "a", True), (2, "a", True), (2, "b", False)], "l int, name string, timed boolean")
    got = {r["list"]: tuple(r)[1:] for r in quality.coverage(starts, records, starts.where("l = 1"), "l", F.col("timed"), ["name"]).collect()}
    assert got == {"1": (2, 2, 1, 2), "2": (1, 1, 1, 0), "TOTAL": (3, 3, 2, 2)}


# sources and sinks


PAGE = """<title>Cup &amp; more</title><a href="a.PDF">one</a><h2>Day <b>1</b></h2><a href='/b.pdf?x=1'> two
 lines </a><h3>never closed<a href="c.html">c</a><div id="header"><table><td> Cup </td><td>x</td><td>Ankara&nbsp;</td><td>1.2.2025</td></table></div>"""


def test_links_and_headings():
    got = [x for x in html.links_in(PAGE, "http://h/d/e") if html.is_pdf(x[0])]
    assert got == [("http://h/d/a.PDF", "one", "Cup & more"), ("http://h/b.pdf?x=1", "two lines", "Day 1")]
    assert html.links_in(None, None) == []


def test_header_and_keywords(spark):
    df = spark.createDataFrame([(1, PAGE), (2, "<div id=header><td>a</td></div>"), (3, None)], "i int, h string")
    assert [tuple(r[0]) for r in df.orderBy("i").select(html.header_fields(F.col("h"))).collect()] == [("Cup", "1.2.2025", "Ankara"), (None, None, None), (None, None, None)]
    links = spark.createDataFrame([("p", "Start List"), ("p", "other"), ("q", "x"), ("q", "y")], "page string, t string")
    assert {tuple(r)[:2] for r in html.chosen_links(links, "page", [F.col("t")], list(html.START_KEYWORDS)).collect()} == {("p", "Start List"), ("q", "x"), ("q", "y")}


def test_discovery(spark, tmp_path):
    for p in ("Cup/startlists/StartList_10.txt", "Cup/startlists/StartList_9.txt", "startlists/Old/StartList_1.txt", "Cup/results/ResultList_9.txt"):
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_text("﻿x")
    got = files.discovered(spark, str(tmp_path), "startlists", numeric=True).orderBy("place").collect()
    assert [(r["title"], r["list_number"]) for r in got] == [("Cup", "9"), ("Cup", "10"), ("Old", "1")]
    assert files.discovered(spark, str(tmp_path), "nothing").count() == 0
    assert files.texts(spark, str(tmp_path / "Cup/results")).select("text").collect() == [("x",)]


def test_csv_and_json(spark, tmp_path):
    df = spark.createDataFrame([("a", 'q"u,o\nte', None)], "x string, y string, z string")
    sinks.write_csv(df, str(tmp_path / "c"), ["y", "x", "w"])
    sinks.write_csv(df, str(tmp_path / "c"), ["y", "x", "w"], append=True)
    assert files.read_csv(spark, str(tmp_path / "c"), ["y", "x", "w"]).collect() == [('q"u,o\nte', "a", "")] * 2
    (tmp_path / "l.jsonl").write_text('{"a": 1}\n\nbroken\n{"a": 2}\n')
    assert sorted(r["a"] for r in files.read_json_lines(spark, str(tmp_path / "l.jsonl"), "a int").collect()) == [1, 2]


def test_swap_leaves_one_version(spark, tmp_path):
    path = str(tmp_path / "t")
    for n in (3, 5):
        sinks.swap(spark, spark.range(n), path)
        assert spark.read.parquet(path).count() == n
    assert [p.name for p in tmp_path.iterdir()] == ["t"]


def test_fan_out():
    calls = []

    def send(url, body):
        calls.append((url, json.loads(body)))
        if "bad" in url:
            raise OSError("down")
        return 200

    urls = sinks.targets_of("http://a/", "http://bad", "http://a", "")
    assert urls == ["http://a", "http://bad"]
    assert sinks.fan_out([{"x": "ş"}], urls, send)["http://a"] == 200 and len(calls) == 2
    with pytest.raises(OSError):
        sinks.fan_out([], ["http://bad"], send)


def test_recognised_text(spark):
    native, words = '{"d": [{"text_lines": [{"text": "a"}, {"text": null}]}]}', '{"pages": [{"blocks": [{"lines": [{"words": [{"value": "x"}, {"value": "y"}]}]}]}]}'
    df = spark.createDataFrame([(native, words)], "n string, w string")
    assert tuple(df.select(files.recognised_lines(F.col("n")), files.nested_words(F.col("w"))).collect()[0]) == (["a"], ["x y"])
    assert files.any_lines({"bbox": {"text": "no"}, "a": [{"text": " yes "}, {"b": {"value": "too"}}]}) == [" yes ", "too"]
    pages = spark.createDataFrame([("d", 1, " x "), ("e", 1, "y" * 300), ("e", 9, "z")], "d string, p int, t string")
    assert {tuple(r) for r in files.needs_ocr(pages, "d", "p", "t").collect()} == {("d", True), ("e", False)}
    assert spark.range(1).select(files.as_pages(F.array(F.lit("a "), F.lit(" "), F.lit("b")))).collect()[0][0] == "--- Page 1 ---\na\n\n--- Page 3 ---\nb\n"


# streaming


def test_files_are_read_once(spark, tmp_path):
    source, target, checkpoint = (str(tmp_path / n) for n in ("in", "out", "cp"))
    go = lambda: incremental.ingest_files(spark, source, target, checkpoint, spark.range(1).schema, lambda b: b, files_a_batch=1)
    spark.range(3).coalesce(1).write.parquet(source)
    go()
    go()
    assert spark.read.parquet(target).count() == 3
    spark.range(10, 12).coalesce(1).write.mode("append").parquet(source)
    seen = []
    incremental.ingest_files(spark, source, target, checkpoint, spark.range(1).schema, lambda b: b, on_batch=lambda b, n: seen.append(b.count()))
    assert spark.read.parquet(target).count() == 5 and seen == [2]


def test_failures_wait_for_new_content(spark):
    make = lambda *rows: spark.createDataFrame(list(rows), "path string, signature string")
    none = make()
    done, read, failed = incremental.polled(make(("a", "1"), ("b", "1")), none, none, F.col("path") == "a")
    assert [r["path"] for r in read.collect()] == ["a"] and failed.collect() == [("b", "1")]
    assert incremental.pending(make(("a", "2"), ("b", "1")), read, failed).count() == 0
    done, read, failed = incremental.polled(make(("b", "2")), read, failed, F.lit(True))
    assert done.count() == 1 and failed.count() == 0 and read.count() == 2


def test_polls_keep_their_state(spark, tmp_path):
    path = str(tmp_path / "state")
    files = lambda *rows: spark.createDataFrame(list(rows), "path string, signature string")
    assert incremental.load_state(spark, path).polls == 0
    assert [r["path"] for r in incremental.poll(spark, path, files(("a", "1"), ("b", "1")), F.col("path") == "a").collect()] == ["a"]
    assert incremental.poll(spark, path, files(("a", "2"), ("b", "1")), F.lit(True)).count() == 0  # read, or failed just so
    assert [r["path"] for r in incremental.poll(spark, path, files(("b", "2")), F.lit(True)).collect()] == ["b"]
    state = incremental.load_state(spark, path)
    assert (state.polls, state.failed.count(), sorted(r["path"] for r in state.read.collect())) == (3, 0, ["a", "b"])
    assert sorted(p.name for p in (tmp_path / "state").iterdir()) == ["000000002", "000000003", "done"]
    for part in (tmp_path / "state" / "000000003" / "read").glob("*.parquet"):
        part.write_bytes(b"no table")
    assert incremental.load_state(spark, path).read.count() == 0


def test_the_loop_pushes_after_good_runs(spark):
    done, slept = [], []
    outcomes = iter([True, False, True])
    run = lambda: done.append("run") or next(outcomes)
    push = [lambda: done.append("push") or False, lambda: done.append("again") or True]
    assert incremental.repeated(run, push, 5, most=3, sleep=slept.append) == 3
    assert done == ["run", "push", "again", "run", "run", "push", "again"] and slept == [5, 5]
    done.clear()
    assert incremental.repeated(lambda: done.append("run") or True, push, 5, most=9, begun=4, stop_on_error=True, sleep=slept.append) == 5
    assert done == ["run", "push"]
    assert incremental.repeated(lambda: False, push, 5, most=4, begun=4, sleep=slept.append) == 4
    with pytest.raises(ValueError):
        incremental.repeated(run, every=0)


def test_calls_carry_token_and_trial():
    plain = sinks.call("http://a.test/x", sinks.payload([{"name": "Şule"}]))
    assert plain.data == '{"rows": [{"name": "Şule"}]}'.encode() and plain.get_method() == "POST" and not plain.has_header("X-ingest-token")
    trial = sinks.call("http://a.test/x", b"a,b\n1,2\n", sinks.CSV, "secret", True)
    assert trial.full_url == "http://a.test/x?dry_run=1" and trial.get_header("X-ingest-token") == "secret" and trial.get_header("Content-type").startswith("text/csv")


def test_page_texts_by_backend(spark):
    documents = spark.createDataFrame([("scan",), ("text",)], "path string")
    files.backend("native-test", lambda d: d.select("path", F.lit(1).alias("page"), F.when(F.col("path") == "text", F.repeat(F.lit("7. Ada LANE 28.45 "), F.lit(20))).otherwise("").alias("text")))
    files.backend("model-test", lambda d: d.select("path", F.lit(1).alias("page"), F.lit("recognised").alias("text")))
    got = {r["path"]: r["text"][:10] for r in files.page_texts(documents, "native-test", "model-test").collect()}
    assert got == {"scan": "recognised", "text": "7. Ada LAN"}
    assert {r["text"] for r in files.page_texts(documents, "native-test", "model-test", force=True).collect()} == {"recognised"}
    with pytest.raises(LookupError):
        files.page_texts(documents, "native-test", "unknown")
    pages = files.BACKENDS["native-test"](documents)
    assert {tuple(r) for r in files.needs_ocr(pages, "path", "page", "text").collect()} == {("scan", True), ("text", False)}
    assert {tuple(r) for r in files.result_pages(pages, "path", "page", "text").collect()} == {("scan", 0), ("text", 1)}


def test_newest_and_made_once(spark, tmp_path):
    import os

    for i, name in enumerate(("b.json", "a.json", "c.txt")):
        (tmp_path / name).write_text("{}")
        os.utime(tmp_path / name, (1000 + i, 1000 + i))
    assert files.newest(spark, str(tmp_path), "*.json").endswith("a.json")
    made = []
    make = lambda: made.append(1) or spark.range(len(made))
    path = str(tmp_path / "cache")
    assert [files.made_once(spark, path, make, forced=f).count() for f in (False, False, True)] == [1, 1, 2] and len(made) == 2


def test_document_payloads(spark, tmp_path):
    rows = spark.createDataFrame([("x", "b", 2), ("x", "a", 1), ("y", "c", 3)], "doc string, name string, rank int")
    path = str(tmp_path / "payload")
    sinks.document_payload(rows, path, "doc", backend="lines")
    got = {r["doc"]: r for r in spark.read.json(path).collect()}
    assert got["x"]["row_count"] == 2 and [r["name"] for r in got["x"]["rows"]] == ["a", "b"] and got["y"]["backend"] == "lines"
    assert got["x"]["processed_at_utc"].endswith("+00:00") and "T" in got["x"]["processed_at_utc"]


def test_meet_keys_of_urls(spark):
    assert values(spark, text.meet_key_of_url, ["https://x.test/CS-12/live", " https://x.test/a/cs-7 ", "https://x.test/cs-7x", None]) == ["cs-12", "cs-7", None, None]
