"""Read queries, aggregates, joins, dedupe and windows on the star schema.

An order stands for a meet, a line item for a result in it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lanework.operators import dedupe, joins, quality, reads, windows
from lanework.plans.registry import query
from lanework.session import table

CATEGORY = ["l_linenumber", "l_returnflag", "l_linestatus"]


@query("""SELECT l_linenumber, l_returnflag, l_linestatus, count(*) AS result_count, count(*) FILTER (WHERE l_discount > 0) AS non_empty_result_count,
  max(l_quantity) AS max_seri_no FROM lineitem GROUP BY ALL""")
def event_category_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = reads.category_summary(table(spark, sf_dir, "lineitem"), CATEGORY, F.col("l_discount") > 0, "l_quantity")
    return got.orderBy("l_linenumber", "l_returnflag", "l_linestatus")


@query("""SELECT count(*) AS groups, CAST(sum(n) AS BIGINT) AS total_result_count, CAST(sum(m) AS BIGINT) AS total_non_empty_result_count FROM
  (SELECT count(*) AS n, count(*) FILTER (WHERE l_discount > 0) AS m FROM lineitem GROUP BY l_linenumber, l_returnflag, l_linestatus)""")
def event_category_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = reads.category_summary(table(spark, sf_dir, "lineitem"), CATEGORY, F.col("l_discount") > 0, "l_quantity")
    return reads.totals(got, ["result_count", "non_empty_result_count"])


@query("SELECT (SELECT count(*) FROM orders) AS events, (SELECT count(*) FROM lineitem) AS results")
def home_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reads.row_counts(events=table(spark, sf_dir, "orders"), results=table(spark, sf_dir, "lineitem"))


_EVENT = "o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS event_date, o_orderpriority AS title"


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("event_date"), F.col("o_orderpriority").alias("title"))


@query(f"SELECT {_EVENT} FROM orders ORDER BY event_date DESC, title, o_orderkey LIMIT 5")
def latest_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reads.latest(_events(spark, sf_dir), [F.desc("event_date"), F.asc("title"), F.asc("o_orderkey")], 5)


@query(f"SELECT {_EVENT} FROM orders")
def event_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir).orderBy(F.desc("event_date"), "title")


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity FROM lineitem
  WHERE l_linenumber = 1 AND l_returnflag = 'A' AND l_linestatus = 'F'""")
def selected_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = reads.equal_to(table(spark, sf_dir, "lineitem"), l_linenumber=1, l_returnflag="A", l_linestatus="F")
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity").orderBy("l_quantity", "l_suppkey", "l_partkey", "l_orderkey")


@query("""SELECT l_orderkey, l_linenumber, l_quantity, o_orderpriority AS title, o_orderstatus FROM lineitem JOIN orders ON l_orderkey = o_orderkey
  WHERE l_returnflag = 'R' AND o_orderstatus = 'O'""")
def optional_filter_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    results = reads.optionally(table(spark, sf_dir, "lineitem"), l_returnflag="R", l_linenumber="", l_suppkey="any")
    events = reads.optionally(table(spark, sf_dir, "orders"), o_orderstatus=" O ", o_custkey=None)
    met = results.join(events, results["l_orderkey"] == events["o_orderkey"])
    return met.select("l_orderkey", "l_linenumber", "l_quantity", F.col("o_orderpriority").alias("title"), "o_orderstatus").orderBy("l_orderkey", "l_linenumber", "l_quantity")


@query("SELECT DISTINCT p_name FROM part WHERE p_name IS NOT NULL AND p_name <> ''")
def distinct_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reads.distinct_sorted(table(spark, sf_dir, "part"), "p_name")


@query("SELECT count(*) AS event_count FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_suppkey = 7)")
def club_event_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    results = table(spark, sf_dir, "lineitem").where("l_suppkey = 7")
    return reads.parents_of(table(spark, sf_dir, "orders"), results, "o_orderkey", "l_orderkey").agg(F.count(F.lit(1)).alias("event_count"))


@query("""SELECT strftime(o_orderdate, '%Y-%m-%d') AS event_date, o_orderpriority AS title, l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_suppkey = 7
  ORDER BY event_date DESC, title, l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice LIMIT 50""")
def club_latest_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    results = table(spark, sf_dir, "lineitem").where("l_suppkey = 7")
    met = results.join(_events(spark, sf_dir), F.col("l_orderkey") == F.col("o_orderkey"))
    rest = ["title", "l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice"]
    return reads.latest(met.select("event_date", *rest), [F.desc("event_date"), *map(F.asc, rest)], 50)


@query("""WITH a AS (SELECT o_orderpriority AS k, count(*) AS start_rows FROM orders GROUP BY 1),
  r AS (SELECT o_orderpriority AS k, l_partkey, l_suppkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_discount > 0),
  b AS (SELECT k, count(*) AS timed_records FROM r GROUP BY 1),
  b2 AS (SELECT k, count(*) AS distinct_records FROM (SELECT DISTINCT k, l_partkey, l_suppkey FROM r) GROUP BY 1),
  c AS (SELECT o_orderpriority AS k, count(*) AS matched_rows FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_discount > 0) GROUP BY 1),
  t AS (SELECT k AS list, start_rows, timed_records, distinct_records, matched_rows FROM a JOIN b USING (k) JOIN b2 USING (k) JOIN c USING (k))
  SELECT * FROM t UNION ALL SELECT 'TOTAL', CAST(sum(start_rows) AS BIGINT), CAST(sum(timed_records) AS BIGINT), CAST(sum(distinct_records) AS BIGINT), CAST(sum(matched_rows) AS BIGINT) FROM t""")
def coverage_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, items = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority"), table(spark, sf_dir, "lineitem")
    records = items.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    matches = reads.parents_of(orders, items.where("l_discount > 0"), "o_orderkey", "l_orderkey")
    return quality.coverage(orders, records, matches, "o_orderpriority", F.col("l_discount") > 0, ["l_partkey", "l_suppkey"])


@query("""SELECT count(*) AS rows, count(*) FILTER (WHERE quality IS NULL) AS missing_quality, count(*) FILTER (WHERE toxic IS NULL) AS missing_toxic,
  count(*) FILTER (WHERE coalesce(trim(lang), '') = '') AS missing_lang, count(*) FILTER (WHERE coalesce(trim(source), '') = '') AS missing_source
  FROM documents LEFT JOIN labels USING (doc_id)""")
def missing_field_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    met = table(spark, sf_dir, "documents").select("doc_id", "lang", "source").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return quality.missing_counts(met, ["quality", "toxic", "lang", "source"])


@query("""WITH t AS (SELECT user_id, count(*) AS rows, count(*) FILTER (WHERE event_type = 'purchase') AS times, count(*) FILTER (WHERE event_type = 'click') AS points,
  count(*) FILTER (WHERE event_type = 'view') AS names FROM events GROUP BY 1)
  SELECT user_id, rows, 5 * times + 2 * points + names AS score, rows > 0 AND (times > 0 OR points > 0) AS success, round(100.0::DOUBLE * times / rows, 6) AS rate FROM t""")
def quality_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lanework.functions.numbers import percent
    from lanework.functions.numbers import quality_score as weighted

    of = lambda kind: F.count_if(F.col("event_type") == kind)
    got = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("rows"), of("purchase").alias("t"), of("click").alias("p"), of("view").alias("n"))
    return got.select("user_id", "rows", weighted(F.col("t"), F.col("p"), F.col("n")).alias("score"), ((F.col("rows") > 0) & ((F.col("t") > 0) | (F.col("p") > 0))).alias("success"), F.round(percent(F.col("t"), F.col("rows")), 6).alias("rate"))


@query("""WITH t AS (SELECT user_id, count(*) FILTER (WHERE event_type <> 'error') AS success, count(*) FILTER (WHERE event_type = 'error') AS failure FROM events GROUP BY 1)
  SELECT user_id, success, failure, row_number() OVER (ORDER BY (success + 1)::DOUBLE / (success + failure + 2) DESC, success DESC, user_id) AS place FROM t""")
def backend_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql.window import Window

    stats = quality.backends(table(spark, sf_dir, "events"), "user_id", F.col("event_type") != "error")
    # a ranking over backends, of which there are few: one row for each, after the aggregation
    return stats.select("user_id", "success", "failure", F.row_number().over(Window.orderBy(*quality.preference(F.col("user_id")))).cast("bigint").alias("place"))


@query("""SELECT user_id, arg_min(value, event_id) FILTER (WHERE value > 10) AS first_time, arg_min(event_id, event_id) FILTER (WHERE event_type = 'purchase') AS first_rank
  FROM events GROUP BY 1""")
def first_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    return dedupe.first_wins(events, ["user_id"], "event_id", first_time=F.when(F.col("value") > 10, F.col("value")), first_rank=F.when(F.col("event_type") == "purchase", F.col("event_id")))


@query("SELECT user_id, arg_max(event_type, event_id) AS event_type, arg_max(value, event_id) AS value FROM events GROUP BY 1")
def last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedupe.last_wins(table(spark, sf_dir, "events"), ["user_id"], "event_id", event_type=F.col("event_type"), value=F.col("value"))


@query("SELECT sha256(text) AS digest, min(doc_id) AS doc_id, arg_min(source, doc_id) AS source FROM documents GROUP BY 1")
def ordered_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.sha2("text", 256).alias("digest"), "doc_id", "source")
    return dedupe.keep_first_by_key(docs, ["digest"], "doc_id")


_LINES = "SELECT doc_id, i AS line_no, string_split(replace(text, chr(13) || chr(10), chr(10)), chr(10))[i] AS line FROM documents, generate_series(1, len(string_split(replace(text, chr(13) || chr(10), chr(10)), chr(10)))) AS g(i)"


@query(f"""WITH l AS ({_LINES}), k AS (SELECT * FROM l WHERE length(line) <> 1),
  p AS (SELECT *, lag(line) OVER (PARTITION BY doc_id ORDER BY line_no) AS before FROM k)
  SELECT doc_id, count(*) AS kept_lines, CAST(sum(line_no) AS BIGINT) AS line_sum FROM p WHERE before IS NULL OR before <> line GROUP BY 1""")
def consecutive_line_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = windows.lines_of(table(spark, sf_dir, "documents").select("doc_id", "text"))
    kept = dedupe.without_repeats(lines, "doc_id", "line_no", "line")
    return kept.groupBy("doc_id").agg(F.count(F.lit(1)).alias("kept_lines"), F.sum("line_no").alias("line_sum"))


@query("SELECT user_id FROM events WHERE event_type = 'click' UNION SELECT user_id FROM events WHERE event_type = 'view' UNION SELECT o_custkey FROM orders WHERE o_orderstatus = 'F'")
def union_parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    of = lambda kind: events.where(F.col("event_type") == kind).select("user_id")
    return dedupe.union_distinct(of("click"), of("view"), table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("user_id")))


@query("SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')")
def new_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return dedupe.not_seen(table(spark, sf_dir, "orders").select("o_orderkey"), seen, "o_orderkey")


@query("""SELECT d.doc_id, strlen(text)::VARCHAR || ':' || sha1(text) AS signature FROM documents d LEFT JOIN labels l USING (doc_id)
  WHERE NOT coalesce(l.quality = 1, false)""")
def retry_changed(spark: SparkSession, sf_dir: str) -> DataFrame:
    # stored: what was seen before, the same for documents of good quality, another text for the others
    docs = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.octet_length("text").cast("string"), F.lit(":"), F.sha1(F.col("text").cast("binary"))).alias("signature"))
    stored = docs.join(table(spark, sf_dir, "labels"), "doc_id").select("doc_id", F.when(F.col("quality") == 1, F.col("signature")).otherwise("0:").alias("stored"))
    return dedupe.changed_or_new(docs, stored, "doc_id", "signature", "stored")


_K = "CAST(regexp_extract(props, '([0-9]+)', 1) AS INT)"


@query(f"""WITH e AS (SELECT *, {_K} AS k FROM events), rec AS (SELECT * FROM e WHERE event_type = 'purchase'),
  m1 AS (SELECT user_id, k, arg_min(value, event_id) FILTER (WHERE value IS NOT NULL) AS t, arg_min(event_id, event_id) FILTER (WHERE value > 10) AS r FROM rec GROUP BY ALL),
  m2 AS (SELECT user_id, arg_min(value, event_id) FILTER (WHERE value IS NOT NULL) AS t, arg_min(event_id, event_id) FILTER (WHERE value > 10) AS r FROM rec GROUP BY ALL)
  SELECT e.event_id, e.user_id, e.k, coalesce(m1.t, m2.t) AS time, CASE WHEN m1.t IS NOT NULL THEN m1.r ELSE m2.r END AS rank
  FROM e LEFT JOIN m1 ON e.user_id = m1.user_id AND e.k = m1.k LEFT JOIN m2 ON e.user_id = m2.user_id WHERE e.event_type = 'click'""")
def exact_match_two_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").withColumn("k", F.regexp_extract("props", r"([0-9]+)", 1).cast("int"))
    rows = events.where("event_type = 'click'").select("event_id", "user_id", "k")
    got = joins.exact_two_levels(rows, events.where("event_type = 'purchase'"), "user_id", "k", "event_id", F.col("value"), F.when(F.col("value") > 10, F.col("event_id")))
    return got.select("event_id", "user_id", "k", "time", "rank")


@query()
def fuzzy_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lanework.functions.text import fold_key
    from lanework.operators.match import fuzzy_match as match

    parts = table(spark, sf_dir, "part")
    rows = parts.select("p_brand", "p_size", F.col("p_partkey").alias("ord"), fold_key(F.col("p_name")).alias("name"), fold_key(F.col("p_type")).alias("club"))
    words = F.split("p_name", " ")
    candidates = parts.select("p_brand", "p_size", F.col("p_partkey").alias("ord"), fold_key(F.concat_ws("", F.get(words, F.lit(0)), F.lit("x"), F.get(words, F.lit(1)))).alias("name"), fold_key(F.col("p_type")).alias("club"))
    got = match(rows, candidates, ["p_brand", "p_size"])
    return got.withColumn("score", F.round("score", 9))


@query("""WITH s AS (SELECT o_orderkey, o_custkey FROM orders), l AS (SELECT l_orderkey, l_suppkey FROM lineitem WHERE l_returnflag = 'R'),
  one AS (SELECT o_orderkey, count(*) AS n FROM s JOIN l ON l_orderkey = o_orderkey GROUP BY 1),
  two AS (SELECT o_orderkey, count(*) AS n FROM s JOIN l ON l_suppkey = o_custkey WHERE o_orderkey NOT IN (SELECT o_orderkey FROM one) GROUP BY 1)
  SELECT o_orderkey, n, 1 AS tier FROM one UNION ALL SELECT o_orderkey, n, 2 FROM two UNION ALL
  SELECT o_orderkey, -(SELECT count(*) FROM lineitem WHERE l_returnflag = 'R' AND l_discount = 0), 3 FROM s WHERE o_orderkey NOT IN (SELECT o_orderkey FROM one) AND o_orderkey NOT IN (SELECT o_orderkey FROM two)""")
def tiered_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    sources = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("number"))
    rows = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select("l_orderkey", F.col("l_suppkey").alias("number"), "l_discount")
    return joins.tiered_targets(sources, rows, "o_orderkey", "l_orderkey", "number", F.col("l_discount") == 0)


@query("""SELECT n_nationkey, n_name, arg_max(c_name, c_custkey) AS name, arg_max(c_mktsegment, c_custkey) AS segment
  FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY 1, 2""")
def last_wins_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = table(spark, sf_dir, "customer").withColumnRenamed("c_nationkey", "n_nationkey")
    return joins.last_wins_lookup(table(spark, sf_dir, "nation").select("n_nationkey", "n_name"), customers, "n_nationkey", "c_custkey", name=F.col("c_name"), segment=F.col("c_mktsegment"))


_LIST = "regexp_extract(url, '/(\\d+)', 1)"


@query(f"""WITH p AS (SELECT page_id, url, {_LIST} AS list_no, regexp_extract(url, '://[^/]*/([a-z]+)/', 1) AS kind FROM pages),
  r AS (SELECT list_no, min(url) AS r FROM p WHERE kind = 'fr' GROUP BY 1)
  SELECT page_id, p.list_no, coalesce(r, replace(url, '/en/', '/fr/')) AS link FROM p LEFT JOIN r USING (list_no) WHERE kind = 'en'""")
def file_pair_link(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", F.regexp_extract("url", r"/(\d+)", 1).alias("list_no"), F.regexp_extract("url", "://[^/]*/([a-z]+)/", 1).alias("kind"))
    starts, results = pages.where("kind = 'en'").select("page_id", "url", "list_no"), pages.where("kind = 'fr'").select("list_no", F.col("url").alias("link"))
    return joins.linked_pairs(starts, results, ["list_no"], "url", "link", [("/en/", "/fr/")]).select("page_id", "list_no", "link")


@query("""WITH p AS (SELECT page_id, url, regexp_extract(url, '://([^/?#]*)', 1) AS host, contains(lower(url), 'page=') OR contains(lower(url), '/es/') AS hit FROM pages)
  SELECT page_id, host, hit FROM (SELECT *, max(CAST(hit AS INT)) OVER (PARTITION BY host) AS any_hit FROM p) WHERE hit OR any_hit = 0""")
def keyword_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lanework.sources.html import chosen_links

    pages = table(spark, sf_dir, "pages").select("page_id", "url", F.regexp_extract("url", "://([^/?#]*)", 1).alias("host"))
    return chosen_links(pages, "host", [F.col("url")], ["page=", "/es/"]).select("page_id", "host", "hit")


@query("SELECT l_orderkey, o_custkey AS parent_id FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def checked_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).select("l_orderkey", F.when(F.col("l_returnflag") == "A", F.col("o_custkey")).otherwise(0).alias("event_id"), F.format_string("Customer#%09d", F.col("o_custkey")).alias("event_name"))
    return joins.checked_lookup(rows, table(spark, sf_dir, "customer"), ("event_id", "c_custkey"), ("event_name", "c_name")).select("l_orderkey", "parent_id")


@query("""SELECT l_orderkey, l_linenumber, l_suppkey FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey WHERE l_discount = 0 AND coalesce(trim(o_orderpriority), '') <> ''""")
def unresolved_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem").where("l_discount = 0")
    met = items.join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"), "left")
    return met.where(reads.present("o_orderpriority")).select("l_orderkey", "l_linenumber", "l_suppkey")


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def table_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation")


@query("""SELECT event_id, user_id, max(CASE WHEN event_type = 'signup' THEN event_id END) OVER (PARTITION BY user_id ORDER BY event_id) AS current FROM events""")
def carry_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    return events.select("event_id", "user_id", windows.carried(F.when(F.col("event_type") == "signup", F.col("event_id")), "user_id", "event_id").alias("current"))


@query("""SELECT conv_id, turn, lead(role, 1) OVER w AS role_1, lead(role, 2) OVER w AS role_2,
  first_value(nullif(CASE WHEN role = 'user' THEN '' ELSE role END, '') IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS next_filled
  FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)""")
def look_ahead(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    role = F.when(F.col("role") == "user", "").otherwise(F.col("role"))
    return turns.select("conv_id", "turn", *[windows.ahead(F.col("role"), "conv_id", "turn", i).alias(f"role_{i}") for i in (1, 2)], windows.next_filled(role, "conv_id", "turn").alias("next_filled"))


@query("SELECT event_id, user_id, printf('%d-%06d', user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id)) AS key FROM events")
def running_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lanework.functions.numbers import format_key

    return windows.numbered(table(spark, sf_dir, "events"), "user_id", ["event_id"]).select("event_id", "user_id", format_key(F.col("user_id").cast("string"), F.col("n")).alias("key"))


@query("""WITH old AS (SELECT o_custkey, max(o_orderkey) AS most FROM orders WHERE o_orderstatus = 'F' GROUP BY 1)
  SELECT o_orderkey, printf('%d-%06d', o_custkey, coalesce(most, 0) + row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey)) AS key
  FROM orders LEFT JOIN old USING (o_custkey) WHERE o_orderstatus = 'O'""")
def key_allocation(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    old = orders.where("o_orderstatus = 'F'").select("o_custkey", F.concat(F.col("o_custkey").cast("string"), F.lit("-"), F.format_string("%06d", "o_orderkey")).alias("key"))
    return windows.allocated_keys(orders.where("o_orderstatus = 'O'").select("o_orderkey", "o_custkey"), old, "o_custkey", "o_orderkey", "key").select("o_orderkey", "key")


@query("""SELECT l_orderkey, count(*) AS row_count, string_agg(l_linenumber::VARCHAR || ':' || l_partkey::VARCHAR || ':' || l_suppkey::VARCHAR || ':' || CAST(l_quantity AS BIGINT)::VARCHAR, ','
  ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS rows FROM lineitem GROUP BY 1""")
def nested_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lanework.sources.sinks import nested

    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_quantity").cast("bigint").alias("q"))
    got = nested(items, ["l_orderkey"], ["l_linenumber", "l_partkey", "l_suppkey", "q"])
    return got.select("l_orderkey", "row_count", F.array_join(F.transform("rows", lambda r: F.concat_ws(":", r["l_linenumber"].cast("string"), r["l_partkey"].cast("string"), r["l_suppkey"].cast("string"), r["q"].cast("string"))), ",").alias("rows"))


@query("""SELECT user_id, event_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events WHERE event_type <> 'error') WHERE i = 1""")
def attempt_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.first_success(table(spark, sf_dir, "events"), "user_id", "event_id", F.col("event_type") != "error", "event_type", "value")


@query("SELECT p_partkey, p_size FROM part ORDER BY p_size DESC, p_partkey LIMIT 8")
def numeric_text_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_size", F.col("p_size").cast("string").alias("digits"))
    return reads.latest(parts, [F.col("digits").cast("int").desc(), F.asc("p_partkey")], 8).drop("digits")


@query("""WITH c AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL)
  SELECT user_id, string_agg(event_type || '=' || n::VARCHAR, ',' ORDER BY event_type) AS counters FROM c GROUP BY 1""")
def counter_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))
    held = F.array_sort(F.collect_list(F.struct("event_type", "n")))  # a row for each type, of which there are few
    return counts.groupBy("user_id").agg(F.array_join(F.transform(held, lambda r: F.concat(r["event_type"], F.lit("="), r["n"].cast("string"))), ",").alias("counters"))


@query("""WITH old AS (SELECT user_id, count(*) FILTER (WHERE event_type <> 'error') AS s, count(*) FILTER (WHERE event_type = 'error') AS f FROM events GROUP BY 1)
  SELECT user_id, CAST(2 * s AS BIGINT) AS success, CAST(2 * f AS BIGINT) AS failure FROM old""")
def counter_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = quality.backends(table(spark, sf_dir, "events"), "user_id", F.col("event_type") != "error")
    return quality.merged_counts(stats, stats, "user_id", ["success", "failure"])
