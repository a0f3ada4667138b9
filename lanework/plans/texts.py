"""Text functions, sources, sinks and upserts on the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lanework.functions import numbers, text
from lanework.operators import upsert, windows
from lanework.operators.reads import present
from lanework.plans.registry import query
from lanework.session import scratch, table
from lanework.sources import files, html, sinks


@query("""SELECT doc_id, length(k) AS size, md5(k) AS digest FROM (SELECT doc_id, regexp_replace(lower(strip_accents(translate(text, 'ıİşŞğĞüÜöÖçÇ', 'iissgguuoocc'))), '[^a-z0-9]', '', 'g') AS k FROM documents)""")
def fold_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = table(spark, sf_dir, "documents").select("doc_id", text.fold_key(F.col("text")).alias("k"))
    return k.select("doc_id", F.char_length("k").cast("bigint").alias("size"), F.md5("k").alias("digest"))


@query("""SELECT p_partkey, trim(regexp_replace(lower(trim(p_name || ' / ' || p_type || ' #' || p_size)), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM part""")
def slug(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", text.slug(F.concat("p_name", F.lit(" / "), "p_type", F.lit(" #"), F.col("p_size").cast("string"))).alias("slug"))


_SLUG = "trim(regexp_replace(lower(trim({})), '[^a-z0-9]+', '-', 'g'), '-')"


@query(f"""SELECT o_orderkey, substr('parsed-' || substr({_SLUG.format("o_orderpriority")}, 1, 36) || '-' || substr({_SLUG.format("o_orderstatus")}, 1, 20) || '-' ||
  substr(sha1(o_orderpriority || '|' || strftime(o_orderdate, '%Y-%m-%d') || '|' || o_orderstatus), 1, 8), 1, 100) AS name FROM orders""")
def default_unique_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", text.default_unique_name(F.col("o_orderpriority"), F.date_format("o_orderdate", "yyyy-MM-dd"), F.col("o_orderstatus")).alias("name"))


@query(r"""SELECT page_id, substr(trim(regexp_replace(trim(regexp_replace(url, '\s+', ' ', 'g')), '[<>:"/\\|?*]+', '_', 'g'), ' .'), 1, 120) AS name FROM pages""")
def safe_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", text.safe_file_name(F.col("url"), most=120).alias("name"))


@query(r"""SELECT p_partkey, trim(regexp_replace(p_name, '[<>:"/\\|?*]+', '_', 'g'), ' .') || '.pdf' AS pdf, trim(regexp_replace(regexp_replace(p_type || ' ' || p_brand, '[^A-Za-z0-9_-]', '_', 'g'), '_+', '_', 'g'), '_') AS slug FROM part""")
def safe_file_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", text.safe_pdf_name(F.concat("p_name", F.lit(".PDF"))).alias("pdf"), text.safe_slug(F.concat_ws(" ", "p_type", "p_brand")).alias("slug"))


@query("SELECT p_partkey, p_size AS size, CAST(0 AS INT) AS none FROM part")
def parse_int(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", numbers.parse_int(F.concat(F.lit(" "), F.col("p_size").cast("string"), F.lit(" "))).alias("size"), numbers.parse_int(F.col("p_name")).alias("none"))


@query("SELECT p_partkey, p_size * 50 AS relay, p_size AS plain FROM part")
def parse_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.col("p_size").cast("string")
    return table(spark, sf_dir, "part").select("p_partkey", numbers.parse_distance(F.concat(size, F.lit(" x 50m"))).alias("relay"), numbers.parse_distance(F.concat(size, F.lit("m"))).alias("plain"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, q::VARCHAR || ':' || lpad(s::VARCHAR, 2, '0') || '.' || lpad(h::VARCHAR, 2, '0') AS long, s::VARCHAR || '.' || lpad(h::VARCHAR, 2, '0') AS short,
  q::VARCHAR || ':' || lpad(s::VARCHAR, 2, '0') || '.' || lpad(h::VARCHAR, 2, '0') AS compact, q::VARCHAR || ':' || lpad(s::VARCHAR, 2, '0') || '.' || lpad(h::VARCHAR, 2, '0') AS total, (100 + h)::VARCHAR AS points, 'Club' AS rest
  FROM (SELECT *, CAST(l_quantity AS BIGINT) AS q, l_suppkey % 60 AS s, l_partkey % 100 AS h FROM lineitem)""")
def time_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    q, s, h = F.col("l_quantity").cast("bigint"), F.col("l_suppkey") % 60, F.col("l_partkey") % 100
    line = F.concat(F.lit("Club "), F.format_string("%d:%02d,%02d ", q, s, h), (h + 100).cast("string"))
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    given = {"long": F.format_string("%d-%02d,%02d", q, s, h), "short": F.format_string("%d,%d", s, h), "compact": F.format_string("%d%02d.%02d", q, s, h)}
    times = numbers.with_normal_times(items, given)
    return numbers.with_total_and_points(times, line, True, "total").select("l_orderkey", "l_linenumber", "l_partkey", *given, "total", "points", "rest")


@query("""SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 'Erkekler' ELSE 'Kadınlar' END AS gender, '4x' || p_size::VARCHAR || 'm' AS distance, p_type AS style,
  'Yarış ' || p_partkey::VARCHAR || ', ' || p_brand || '; ' || p_type AS name, p_brand AS category, p_type AS distance_style, 'Final' AS level FROM part""")
def event_descriptor(spark: SparkSession, sf_dir: str) -> DataFrame:
    gender = F.when(F.col("p_size") % 2 == 0, "erkek").otherwise("KIZLAR")
    got = text.event_descriptor(F.concat(F.lit("Yarış "), F.col("p_partkey").cast("string"), F.lit(", "), gender, F.lit(", 4 x "), F.col("p_size").cast("string"), F.lit("m "), F.col("p_type")))
    parts = text.event_components(F.concat_ws("; ", "p_brand", "p_type"), F.lit("Final"))
    return table(spark, sf_dir, "part").select("p_partkey", got["gender"].alias("gender"), got["distance"].alias("distance"), got["style"].alias("style"), text.event_name(F.col("p_partkey").cast("string"), F.col("p_brand"), F.col("p_type")).alias("name"), parts["category"].alias("category"), parts["distance_style"].alias("distance_style"), parts["level"].alias("level"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS INT) AS k, json_exists(props, '$.k') AS has_k, json_exists(props, '$.missing') AS has_missing FROM events")
def props_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    row = F.from_json("props", "map<string,string>")
    return table(spark, sf_dir, "events").select("event_id", row["k"].cast("int").alias("k"), files.has_key(row, "k").alias("has_k"), files.has_key(row, "missing").alias("has_missing"))


@query(r"""WITH l AS (SELECT conv_id, turn, i AS line_no, trim(string_split(text, chr(10))[i]) AS line FROM conversations, generate_series(1, len(string_split(text, chr(10)))) AS g(i)),
  n AS (SELECT *, lead(line) OVER (PARTITION BY conv_id ORDER BY turn, line_no) AS after FROM l)
  SELECT conv_id, turn, line_no, length(line) AS size, length(after) AS after_size FROM n WHERE regexp_matches(line, '^[A-Z]\S+ \S+')""")
def transcript_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql.window import Window

    lines = windows.lines_of(table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")).withColumn("line", F.trim("line"))
    after = F.lead("line").over(Window.partitionBy("conv_id").orderBy("turn", "line_no"))
    return lines.withColumn("after", after).where(F.col("line").rlike(r"^[A-Z]\S+ \S+")).select("conv_id", "turn", F.col("line_no").cast("bigint").alias("line_no"), F.char_length("line").cast("bigint").alias("size"), F.char_length("after").cast("bigint").alias("after_size"))


@query("""WITH new AS (SELECT o_orderpriority AS title, strftime(o_orderdate, '%Y-%m-%d') AS date, o_orderstatus AS location, min(o_orderkey) AS ord, count(*) AS n FROM orders GROUP BY ALL),
  old AS (SELECT DISTINCT o_orderpriority AS title, strftime(o_orderdate, '%Y-%m-%d') AS date, o_orderstatus AS location FROM orders WHERE o_totalprice > 300000)
  SELECT title, date, location, new.ord, new.n, CASE WHEN old.title IS NULL THEN 'created' ELSE 'kept' END AS action FROM new LEFT JOIN old USING (title, date, location)""")
def event_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = ["title", "date", "location"]
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", F.col("o_orderpriority").alias("title"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("date"), F.col("o_orderstatus").alias("location"))
    return upsert.got_or_created(orders.where("o_totalprice > 300000"), orders.withColumnRenamed("o_orderkey", "ord"), keys, "ord")


_RESULTS = """old AS (SELECT l_orderkey AS e, l_linenumber AS lane, arg_max(l_quantity, o) AS result, arg_max(l_tax, o) AS seed, 1 AS there FROM items WHERE l_returnflag = 'N' GROUP BY ALL),
  new AS (SELECT l_orderkey AS e, l_linenumber AS lane, arg_max(l_quantity, o) AS result, max(l_discount > 0.02) AS has_seed, arg_max(l_tax, o) FILTER (WHERE l_discount > 0.02) AS seed, 1 AS there FROM items WHERE l_returnflag = 'A' GROUP BY ALL),
  merged AS (SELECT e, lane, CASE WHEN new.there = 1 THEN new.result ELSE old.result END AS result, CASE WHEN coalesce(has_seed, false) THEN new.seed ELSE old.seed END AS seed,
    CASE WHEN old.there IS NULL THEN 'created' WHEN new.there IS NULL THEN 'kept' ELSE 'updated' END AS action FROM old FULL JOIN new USING (e, lane))"""
_ITEMS = "items AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax) AS o FROM lineitem)"


def _results(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    from pyspark.sql.window import Window

    w = Window.partitionBy("l_orderkey", "l_linenumber").orderBy("l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax")
    items = table(spark, sf_dir, "lineitem").withColumn("o", F.row_number().over(w))
    rows = items.select("l_returnflag", "l_discount", "o", F.col("l_orderkey").alias("e"), F.col("l_linenumber").alias("lane"), F.col("l_quantity").alias("result"), F.col("l_tax").alias("seed"))
    fields, keys = ["result", "seed"], ["e", "lane"]
    always = {"result": F.lit(True), "seed": F.lit(True)}
    old = upsert.patches(rows.where("l_returnflag = 'N'"), keys, "o", fields, always)
    changes = upsert.patches(rows.where("l_returnflag = 'A'"), keys, "o", fields, {"result": F.lit(True), "seed": F.col("l_discount") > 0.02})
    return rows, upsert.merged(old, changes, keys, fields)


@query(f"WITH {_ITEMS}, {_RESULTS} SELECT e, lane, result, seed, action FROM merged")
def result_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _results(spark, sf_dir)[1].select("e", "lane", "result", "seed", "action")


@query(f"""WITH {_ITEMS}, {_RESULTS} SELECT (SELECT count(*) FROM lineitem WHERE l_returnflag = 'A') AS rows_seen, (SELECT count(*) FROM lineitem WHERE l_returnflag = 'A' AND l_quantity > 10) AS rows_with_result,
  (SELECT count(DISTINCT l_orderkey) FROM lineitem WHERE l_returnflag = 'A') AS events_seen, count(*) FILTER (WHERE action = 'created') AS created, count(*) FILTER (WHERE action = 'updated') AS updated FROM merged""")
def ingest_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, after = _results(spark, sf_dir)
    return upsert.summary(rows.where("l_returnflag = 'A'"), F.col("result") > 10, "e", after)


@query("""SELECT event_id, 'meet-' || user_id::VARCHAR AS event_unique_name, event_type AS name, coalesce(nullif(json_extract_string(props, '$.missing'), ''), nullif(CAST(value AS BIGINT)::VARCHAR, ''), '') AS result,
  CAST(json_extract_string(props, '$.k') AS INT) AS rank FROM (SELECT * REPLACE (floor(value) AS value) FROM events) WHERE trim(event_type) <> ''""")
def ingest_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    row = F.from_json("props", "map<string,string>")
    named = sinks.enriched(table(spark, sf_dir, "events"), event_unique_name=F.concat(F.lit("meet-"), F.col("user_id").cast("string")))
    return named.where(present("event_type")).select("event_id", "event_unique_name", text.first_filled(row["swimmer"], F.col("event_type")).alias("name"), text.first_filled(row["missing"], F.floor("value").cast("string")).alias("result"), numbers.parse_int(row["k"]).alias("rank"))


_DOC_LINES = "l AS (SELECT doc_id, i AS line_no, trim(string_split(text, chr(10))[i]) AS line FROM documents, generate_series(1, len(string_split(text, chr(10)))) AS g(i))"


@query(rf"""WITH {_DOC_LINES}, c AS (SELECT doc_id, CASE WHEN line = '' THEN 'empty' WHEN regexp_matches(line, '^[0-9]{{1,3}}\s*\.?\s*$') THEN 'rank'
  WHEN regexp_matches(line, '^[0-9]{{1,2}}[:.][0-9]{{2}}$') THEN 'time' WHEN regexp_matches(line, '^[A-Z]+!!') THEN 'shout' ELSE 'unmatched' END AS label FROM l)
  SELECT label, count(*) AS n, count(DISTINCT doc_id) AS docs, bool_and(label <> 'unmatched') AS structured FROM c GROUP BY 1""")
def line_label_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = windows.lines_of(table(spark, sf_dir, "documents").select("doc_id", "text")).withColumn("line", F.trim("line"))
    line = F.col("line")
    label = F.when(line == "", "empty").when(line.rlike(r"^[0-9]{1,3}\s*\.?\s*$"), "rank").when(line.rlike("^[0-9]{1,2}[:.][0-9]{2}$"), "time").when(line.rlike("^[A-Z]+!!"), "shout").otherwise("unmatched")
    return lines.groupBy(label.alias("label")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("doc_id").alias("docs")).withColumn("structured", F.col("label") != "unmatched")


@query("""WITH t AS (SELECT doc_id, list_filter(string_split_regex(trim(regexp_replace(text, '\\s+', ' ', 'g')), ' '), lambda x: x <> '') AS t FROM documents)
  SELECT doc_id, len(t) AS n, t[1] AS first, t[len(t)] AS last, len(list_filter(t, lambda x: regexp_matches(x, '[0-9]'))) > 0 AS any_digit, len(list_filter(t, lambda x: NOT regexp_matches(x, '^[A-Za-z]+[.,]?$'))) = 0 AS all_plain FROM t""")
def token_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.filter(F.split(F.trim(F.regexp_replace("text", r"\s+", " ")), " "), lambda x: x != "")
    docs = table(spark, sf_dir, "documents").select("doc_id", t.alias("t"))
    return docs.select("doc_id", F.size("t").cast("bigint").alias("n"), F.get("t", F.lit(0)).alias("first"), F.try_element_at("t", F.lit(-1)).alias("last"), F.exists("t", lambda x: x.rlike("[0-9]")).alias("any_digit"), F.forall("t", lambda x: x.rlike("^[A-Za-z]+[.,]?$")).alias("all_plain"))


@query(r"""SELECT doc_id, length(x) AS size, md5(x) AS digest FROM (SELECT doc_id, regexp_replace(trim(regexp_replace(replace(text, chr(160), ' '), '[\s]+', ' ', 'g')),
  '([^\pL\pN\pM_]|^)the([^\pL\pN\pM_]|$)', '\1a\2', 'gi') AS x FROM documents)""")
def rules_replace(spark: SparkSession, sf_dir: str) -> DataFrame:
    # the words' borders are spelled out, as the SQL must
    got = text.corrected_line(F.col("text"), [(r"([^\p{L}\p{N}\p{M}_]|^)the([^\p{L}\p{N}\p{M}_]|$)", "$1a$2")])
    return table(spark, sf_dir, "documents").select("doc_id", got.alias("x")).select("doc_id", F.char_length("x").cast("bigint").alias("size"), F.md5("x").alias("digest"))


@query("""SELECT p_partkey, p_name || ' kulup' AS club, p_name AS name FROM part""")
def clean_club(spark: SparkSession, sf_dir: str) -> DataFrame:
    club = text.clean_club(F.concat(F.lit('"'), F.col("p_name"), F.lit(',  kulup7 (Tk}"')))
    name = text.clean_name(F.concat(F.lit("(fd) "), F.replace(F.col("p_name"), F.lit(" "), F.lit(" ,  "))))
    return table(spark, sf_dir, "part").select("p_partkey", club.alias("club"), name.alias("name"))


@query(r"""SELECT page_id, nullif(regexp_extract(path, '([0-9]+)', 1), '') AS number, regexp_extract(path, '([^/]*)$', 1) AS file, string_split(path, '/')[-2] AS parent,
  'list-' || nullif(regexp_extract(path, '([0-9]+)', 1), '') AS name FROM (SELECT page_id, regexp_extract(url, '^[^:]+://[^/?#]*([^?#]*)', 1) AS path FROM pages)""")
def path_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", F.regexp_extract("url", "^[^:]+://[^/?#]*([^?#]*)", 1).alias("path"))
    number = text.first_number(F.col("path"))
    return pages.select("page_id", number.alias("number"), text.file_of_url(F.col("url")).alias("file"), F.try_element_at(F.split("path", "/"), F.lit(-2)).alias("parent"), text.name_from_url(F.concat(F.lit("http://x/"), F.lit("list-"), number, F.lit("/?a=1"))).alias("name"))


@query(r"""SELECT doc_id, nullif(regexp_extract(text, '(?i)Version\s+([0-9]+(?:\.[0-9]+)+)', 1), '') AS version, '11.83565' AS meet_version, contains(lower(text), 'license') AS hit FROM documents""")
def version_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.concat(F.lit("SPLASH  Meet Manager, 11.83565 Registered "), F.col("source"))
    return table(spark, sf_dir, "documents").select("doc_id", F.nullif(F.regexp_extract("text", r"(?i)Version\s+([0-9]+(?:\.[0-9]+)+)", 1), F.lit("")).alias("version"), text.version_of(line).alias("meet_version"), F.contains(F.lower("text"), F.lit("license")).alias("hit"))


@query("SELECT doc_id, contains(lower(text), 'license') OR contains(lower(text), 'http') AS hit FROM documents")
def keyword_hit(spark: SparkSession, sf_dir: str) -> DataFrame:
    low = F.lower("text")
    return table(spark, sf_dir, "documents").select("doc_id", (F.contains(low, F.lit("license")) | F.contains(low, F.lit("http"))).alias("hit"))


@query(r"""WITH l AS (SELECT doc_id, i AS line_no, trim(string_split(text, chr(10))[i]) AS line FROM documents, generate_series(1, len(string_split(text, chr(10)))) AS g(i)),
  p AS (SELECT doc_id, regexp_matches(line, '^[A-Za-z]+(\s+[A-Za-z]+){0,2}$') AND line = upper(line) AS name_more, regexp_matches(line, '^[0-9]{1,2}[-:.][0-9]{2}([-:.][0-9]{2})?$') AS pure_time,
    regexp_matches(line, '^[0-9]{3,4}[-:.][0-9]{2}$') AS compact, NOT regexp_matches(line, '[0-9]') AND line = upper(line) AND regexp_matches(line, 'KATILIM|BARAJ|GECTI|DISK|DQ') AS status FROM l)
  SELECT doc_id, count(*) AS lines, count(*) FILTER (WHERE name_more) AS name_more, count(*) FILTER (WHERE pure_time) AS pure_time, count(*) FILTER (WHERE compact) AS compact, count(*) FILTER (WHERE status) AS status FROM p GROUP BY 1""")
def line_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = windows.lines_of(table(spark, sf_dir, "documents").select("doc_id", "text"))
    x = F.col("line")
    return lines.groupBy("doc_id").agg(F.count(F.lit(1)).alias("lines"), F.count_if(text.is_name_continuation(x)).alias("name_more"), F.count_if(numbers.is_pure_time(x)).alias("pure_time"), F.count_if(numbers.is_compact_split(x)).alias("compact"), F.count_if(text.is_status_line(x)).alias("status"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, 'Ortaokul ' || (10 + l_suppkey % 50)::VARCHAR || '.' || lpad((l_partkey % 100)::VARCHAR, 2, '0') || ' Kulub' AS glued,
  'Club ' || (10 + l_suppkey % 50)::VARCHAR || '.55' AS left_part, (100 + l_partkey % 800)::VARCHAR AS right_part FROM lineitem""")
def split_glued(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("l_suppkey") % 50 + 10
    glued = text.split_glued(F.concat(F.lit("Ortaokul"), F.format_string("%d.%02d", s, F.col("l_partkey") % 100), F.lit("Kulub")))
    parts = text.split_record(F.concat(F.lit("Club "), s.cast("string"), F.lit(".55 x "), (F.col("l_partkey") % 800 + 100).cast("string")), "Club")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", glued.alias("glued"), F.get(parts, F.lit(0)).alias("left_part"), F.get(parts, F.lit(1)).alias("right_part"))


@query("""SELECT c_custkey, 'Ada LANE' AS name, '09' AS birth_year, 'Club ' || c_mktsegment AS club, '1:02.33' AS time, '512' AS points FROM customer""")
def repair_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = text.repaired_record(F.lit("(Fd) 12. Ada LANE 09"), F.concat(F.lit("Club "), F.col("c_mktsegment"), F.lit(" 1:02.33 512")), F.lit(""), F.lit(None).cast("string"))
    return table(spark, sf_dir, "customer").select("c_custkey", got.alias("g")).select("c_custkey", "g.*")


@query("""SELECT o_orderkey, strftime(o_orderdate, '%-d.%-m.%Y') AS date, strftime(o_orderdate, '%-d.%-m.%Y') || ' - 9:30' AS moment, CASE WHEN o_orderstatus = 'F' THEN 'NT' WHEN o_orderstatus = 'O' THEN '1:02.03' END AS seed FROM orders""")
def date_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.date_format("o_orderdate", "d.M.yyyy")
    seed = F.when(F.col("o_orderstatus") == "F", "nt").when(F.col("o_orderstatus") == "O", "1-02.03").otherwise("x")
    return table(spark, sf_dir, "orders").select("o_orderkey", numbers.date_in_text(F.concat(F.lit("on "), day, F.lit(" it"))).alias("date"), numbers.moment_in_text(F.concat(F.lit("printed "), day, F.lit(" - 9:30"))).alias("moment"), numbers.seed_of(seed).alias("seed"))


@query("""SELECT p_partkey, (p_size + 50) AS distance, CASE WHEN p_size + 50 >= 100 THEN (p_size + 50) // 50 ELSE 0 END AS splits, p_brand || '-' || lpad(p_partkey::VARCHAR, 6, '0') AS key FROM part""")
def distance_from_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = numbers.distance_in_text(F.concat(F.lit("Yarış; "), F.translate((F.col("p_size") + 50).cast("string"), "0", "O"), F.lit(" m Serbest")))
    return table(spark, sf_dir, "part").select("p_partkey", d.alias("distance"), numbers.expected_splits(d).alias("splits"), numbers.fixed_key(F.col("p_brand"), F.col("p_partkey")).alias("key"))


@query("""SELECT p_partkey, regexp_replace(lower(p_name), '[^a-z0-9]', '', 'g') AS name, regexp_replace(lower(p_type), '[^a-z0-9]', '', 'g') AS club, '' AS no_club FROM part""")
def match_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    one, two = text.match_keys(F.col("p_name"), F.col("p_type"))
    return table(spark, sf_dir, "part").select("p_partkey", one.alias("a"), two.alias("b")).select("p_partkey", "a.name", "a.club", F.col("b.club").alias("no_club"))


@query("""SELECT p_partkey, CASE WHEN i = 1 THEN base ELSE base || '-' || i::VARCHAR END AS unique_name FROM
  (SELECT p_partkey, p_name AS base, row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) AS i FROM part)""")
def name_allocation(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("base"))
    none = parts.where("p_partkey < 0").select(F.col("base").alias("unique_name"))
    return upsert.allocated_names(parts, none, "base", "p_partkey", "unique_name").select("p_partkey", "unique_name")


@query("SELECT l_orderkey::VARCHAR AS l_orderkey, l_linenumber::VARCHAR AS l_linenumber, l_partkey::VARCHAR AS l_partkey, l_returnflag || ',\"' || l_linestatus AS flags, '' AS missing FROM lineitem")
def csv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields, path = ["l_orderkey", "l_linenumber", "l_partkey", "flags", "missing"], scratch(spark, "csv")
    rows = table(spark, sf_dir, "lineitem").withColumn("flags", F.concat("l_returnflag", F.lit(',"'), "l_linestatus"))
    sinks.write_csv(rows, path, fields)
    return files.read_csv(spark, path, fields)


@query("SELECT l_orderkey, count(*) AS row_count, CAST(sum(l_linenumber) AS BIGINT) AS lane_sum, CAST(sum(l_partkey) AS BIGINT) AS part_sum FROM lineitem GROUP BY 1")
def jsonl_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "jsonl")
    payload = sinks.nested(table(spark, sf_dir, "lineitem"), ["l_orderkey"], ["l_linenumber", "l_partkey"])
    sinks.write_json(payload, path)
    back = files.read_json_lines(spark, path, payload.schema)
    return back.select("l_orderkey", "row_count", F.explode("rows").alias("r")).groupBy("l_orderkey", "row_count").agg(F.sum("r.l_linenumber").alias("lane_sum"), F.sum("r.l_partkey").alias("part_sum"))


@query("SELECT event_id, CASE WHEN event_type IN ('click', 'view', 'error') THEN 'json' ELSE 'csv' END AS format, CASE WHEN event_type IN ('click', 'view', 'error') THEN 1 END AS n, CASE WHEN event_type IN ('click', 'view', 'error') THEN json_extract_string(props, '$.k') END AS k FROM events")
def payload_sniff(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    body = F.when(kind == "click", F.concat(F.lit("﻿ ["), F.col("props"), F.lit("]"))).when(kind.isin("view", "error"), F.concat(F.lit('{"rows": ['), F.col("props"), F.lit("]}"))).otherwise("k,v\n1,2")
    rows = table(spark, sf_dir, "events").select("event_id", body.alias("body"), files.body_format(body).alias("format"))
    got = F.when(F.col("format") == "json", files.body_rows(F.col("body")))
    return rows.select("event_id", "format", F.when(F.col("format") == "json", F.size(got)).alias("n"), F.get(got, F.lit(0))["k"].alias("k"))


@query("SELECT doc_id, 2 AS n, lang AS first, source AS last, ';' AS delimiter, lang AS cell FROM documents")
def json_nested_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    said = F.to_json(F.create_map(F.lit("doc"), F.array(F.struct(F.array(F.struct(F.col("lang").alias("text")), F.struct(F.col("source").alias("text"))).alias("text_lines")))))
    csv = F.concat(F.lit("```csv\na;b\n"), F.col("lang"), F.lit(";"), F.col("source"), F.lit("\n```"))
    rows = docs.select("doc_id", files.recognised_lines(said).alias("t"), csv.alias("csv"))
    cells = files.fenced_csv(rows, "csv", ["doc_id"]).where("row_no = 1").select("doc_id", F.get("cells", F.lit(0)).alias("cell"))
    return rows.join(cells, "doc_id").select("doc_id", F.size("t").alias("n"), F.get("t", F.lit(0)).alias("first"), F.get("t", F.lit(1)).alias("last"), files.delimiter_of(text.strip_fence(F.col("csv"))).alias("delimiter"), "cell")


@query(r"""SELECT page_id, nullif(trim(regexp_replace(replace(replace(replace(replace(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '<[^>]+>', ' ', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;', '&'), '\s+', ' ', 'g')), '') AS title FROM pages""")
def page_header(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", html.page_title(F.col("html")).alias("title"))


@query()
def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.page_links(table(spark, sf_dir, "pages"))


@query("""SELECT p_partkey, p_type AS title, p_size::VARCHAR AS list, p_name AS name, p_brand AS brand FROM part""")
def path_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind, size = F.col("p_type"), F.col("p_size").cast("string")
    new = F.concat(F.lit("/r/"), kind, F.lit(" - SPLASH Meet Manager 11/startlists/StartList_"), size, F.lit(".pdf"))
    old = F.concat(F.lit("/r/results/"), kind, F.lit("/resultlist_"), size, F.lit(".pdf"))
    path = F.when(F.col("p_partkey") % 2 == 0, new).otherwise(old)
    name, brand = text.strip_entry_tag(F.concat(F.lit("(tk) "), "p_name")), text.strip_product(F.concat("p_brand", F.lit(" - Splash  Meet Manager 11")))
    return table(spark, sf_dir, "part").select("p_partkey", text.title_of_path(path).alias("title"), text.list_number(path).alias("list"), name.alias("name"), brand.alias("brand"))


@query("""SELECT s_suppkey, CASE WHEN s_suppkey % 5 > 0 THEN s_name || ' & Cup' END AS title, CASE WHEN s_suppkey % 5 > 0 THEN (s_suppkey % 28 + 1)::VARCHAR || '.1.2026' END AS date,
  CASE WHEN s_suppkey % 5 > 0 THEN 'CITY (' || s_nationkey::VARCHAR || ')' END AS location FROM supplier""")
def event_page_header(spark: SparkSession, sf_dir: str) -> DataFrame:
    suppliers = table(spark, sf_dir, "supplier")
    date = F.when(F.col("s_suppkey") % 5 > 0, F.concat((F.col("s_suppkey") % 28 + 1).cast("string"), F.lit(".1.2026"))).otherwise("&nbsp;")
    page = F.concat(F.lit('<body><DIV class=a id="header"><table><tr><td>'), "s_name", F.lit(" &amp; <b>Cup</b></td><td>50m</td></tr>\n<tr><td>CITY ("), F.col("s_nationkey").cast("string"), F.lit(")</td><td>"), date, F.lit("</td></tr></table></div><td>x</td>"))
    return suppliers.select("s_suppkey", html.header_fields(page).alias("h")).select("s_suppkey", "h.*")


@query("SELECT p_partkey, p_partkey % 4 = 0 AS swimmer FROM part")
def swimmer_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = F.upper(F.get(F.split("p_name", " "), F.lit(0)))
    kinds = [F.concat(F.lit("Ada "), first), F.col("p_name"), F.concat(F.lit("Ada "), first, F.lit(" 12")), F.concat(F.lit("Ada "), first, F.lit(" Spor"))]
    line = F.get(F.array(*kinds), (F.col("p_partkey") % 4).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", text.is_probable_swimmer(line).alias("swimmer"))
