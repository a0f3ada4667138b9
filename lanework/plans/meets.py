"""Document parsers on lists that are made from the driver's tables: an order is a meet, its line items are results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lanework.plans.parsers import registry, startlist
from lanework.plans.registry import query
from lanework.session import table


def _lists(items: DataFrame, head: str, row) -> DataFrame:
    """(l_orderkey, text): a text for each order, a block of lines for each item."""
    block = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", row.alias("block"))
    rows = items.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(block)).alias("r"))  # items of one order
    return rows.select("l_orderkey", F.concat(F.format_string(head, "l_orderkey"), F.array_join(F.transform("r", lambda x: x["block"]), "\n")).alias("text"))


@query("""SELECT l_orderkey, count(*) AS entries, CAST(sum(l_linenumber) AS BIGINT) AS lanes, max('Club ' || l_suppkey::VARCHAR) AS club, min(l_orderkey::VARCHAR) AS event_no, 'Erkekler' AS gender, '50m' AS distance,
  min('1:' || lpad((CAST(l_quantity AS BIGINT))::VARCHAR, 2, '0') || '.00') AS seed FROM lineitem GROUP BY 1""")
def start_list_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem")
    row = F.concat(F.col("l_linenumber").cast("string"), F.lit(" (Fd) Ada LANE\n09\nClub "), F.col("l_suppkey").cast("string"), F.format_string("\n1-%02d-00", F.col("l_quantity").cast("bigint")))
    docs = _lists(items, "Yarış %d\nErkekler, 50m Serbest\nSeri 1 / 2\n", row)
    got = startlist.described_entries(docs, "l_orderkey", "text").withColumn("seed", F.regexp_replace("seed", r":(\d\d)$", r".$1"))
    return got.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("entries"), F.sum("lane").alias("lanes"), F.max("club").alias("club"), F.min("event_no").alias("event_no"), F.min("gender").alias("gender"), F.min("distance").alias("distance"), F.min("seed").alias("seed"))


@query("""SELECT l_orderkey::VARCHAR AS doc, count(*) AS records, max('Club ' || chr(CAST(97 + l_suppkey % 26 AS INT))) AS club, min('1:' || lpad(CAST(l_quantity AS BIGINT)::VARCHAR, 2, '0') || '.' || lpad((l_partkey % 100)::VARCHAR, 2, '0')) AS time,
  CAST(sum(200 + l_partkey % 700) AS BIGINT) AS points FROM lineitem GROUP BY 1""")
def result_list_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem")
    club = F.concat(F.lit("Club "), F.char((F.col("l_suppkey") % 26 + 97).cast("int")))
    row = F.concat(F.lit("7.\nAda LANE\n09\n"), club, F.format_string("\n1:%02d.%02d\n%d", F.col("l_quantity").cast("bigint"), F.col("l_partkey") % 100, F.col("l_partkey") % 700 + 200))
    docs = _lists(items, "Yarış %d, Erkekler; 50m Serbest\n", row).withColumnRenamed("l_orderkey", "doc")
    got = registry.result_rows(docs).where("kind = 'record'")
    return got.groupBy("doc").agg(F.count(F.lit(1)).alias("records"), F.max("club").alias("club"), F.min("time").alias("time"), F.sum(F.col("points").cast("bigint")).alias("points"))


@query("""SELECT o_orderkey, o_orderpriority || ' Meet' AS event_title, strftime(o_orderdate, '%d.%m.%Y') AS event_date, 'ANKARA' AS event_location, 'Yarış ' || o_orderkey::VARCHAR AS event_name, 'Erkekler' AS gender, '50m' AS distance,
  'Serbest ' || o_orderstatus AS style FROM orders""")
def start_list_header(spark: SparkSession, sf_dir: str) -> DataFrame:
    head = F.concat(F.lit("Splash Meet Manager, 11.83565\nRegistered to x\n"), "o_orderpriority", F.lit(" Meet - SPLASH Meet Manager 11\nANKARA, 1. - 2.1.2026\n"))
    event = F.concat(F.lit("Yarış "), F.col("o_orderkey").cast("string"), F.lit("\nErkekler, 50m  Serbest "), "o_orderstatus", F.date_format("o_orderdate", "'\n'dd.MM.yyyy' - 9:50\nSeri 1 of 2'"))
    docs = table(spark, sf_dir, "orders").select("o_orderkey", F.concat(head, event).alias("text"))
    return startlist.header(docs, "o_orderkey", "text")


@query("""SELECT l_orderkey::VARCHAR AS doc, CAST(count_if(l_linenumber % 2 = 1) AS BIGINT) AS disks, CAST(count_if(l_linenumber % 2 = 0) AS BIGINT) AS tds, max(CASE WHEN l_linenumber % 2 = 1 THEN 'SW 4.' || (l_partkey % 9 + 1)::VARCHAR END) AS rule,
  max(CASE WHEN l_linenumber % 2 = 1 THEN '15:1' || (l_suppkey % 10)::VARCHAR END) AS note_time, max(CASE WHEN l_linenumber % 2 = 1 THEN 'DQ' END) AS status,
  max(CASE WHEN l_linenumber % 2 = 0 THEN '1:' || lpad(CAST(l_quantity AS BIGINT)::VARCHAR, 2, '0') || '.' || lpad((l_partkey % 100)::VARCHAR, 2, '0') END) AS time,
  CAST(sum(CASE WHEN l_linenumber % 2 = 0 THEN 200 + l_partkey % 700 END) AS BIGINT) AS points, max('Club ' || chr(CAST(97 + l_suppkey % 26 AS INT))) AS club FROM lineitem GROUP BY 1""")
def result_list_specials(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem")
    club = F.concat(F.lit("Club "), F.char((F.col("l_suppkey") % 26 + 97).cast("int")))
    disk = F.concat(F.lit("disk.\nAda LANE\n09\n"), club, F.format_string("\nSW 4.%d\n(Zaman: 15:1%d)", F.col("l_partkey") % 9 + 1, F.col("l_suppkey") % 10))
    td = F.concat(F.lit("td.\n(Td) Can POOL 11\n"), club, F.format_string("\n1:%02d.%02d %d", F.col("l_quantity").cast("bigint"), F.col("l_partkey") % 100, F.col("l_partkey") % 700 + 200))
    docs = _lists(items, "Yarış %d, Erkekler; 50m Serbest\n", F.when(F.col("l_linenumber") % 2 == 1, disk).otherwise(td)).withColumnRenamed("l_orderkey", "doc")
    got = registry.result_rows(docs).where("kind = 'special'")
    of = lambda kind: F.col("special_type") == kind
    return got.groupBy("doc").agg(
        F.count_if(of("disk")).alias("disks"), F.count_if(of("td")).alias("tds"), F.max("rule").alias("rule"), F.max("note_time").alias("note_time"), F.max("status").alias("status"),
        F.max("time").alias("time"), F.sum(F.col("points").cast("bigint")).alias("points"), F.max("club").alias("club"),
    )
