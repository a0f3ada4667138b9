"""Streaming on the driver's tables: each ends by itself, and gives its final state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lanework.plans.registry import query
from lanework.session import scratch, table
from lanework.streaming import incremental


@query("SELECT user_id, event_type, count(*) AS n, max(event_id) AS last_event FROM events GROUP BY ALL")
def stream_incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    target, checkpoint = scratch(spark, "stream"), scratch(spark, "stream-checkpoint")
    schema = table(spark, sf_dir, "events").schema

    def reduced(batch: DataFrame) -> DataFrame:
        return batch.groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"), F.max("event_id").alias("last_event"))

    incremental.ingest_files(spark, sf_dir, target, checkpoint, schema, reduced, glob="events.parquet")
    return spark.read.parquet(target).groupBy("user_id", "event_type").agg(F.sum("n").alias("n"), F.max("last_event").alias("last_event"))


@query("""WITH f AS (SELECT doc_id::VARCHAR AS path, strlen(text)::VARCHAR || ':' || sha1(text) AS a, strlen(text || source)::VARCHAR || ':' || sha1(text || source) AS b, n_chars, lang FROM documents)
  SELECT path, CASE WHEN n_chars > 1000 THEN 'first' WHEN lang <> 'en' THEN 'second' ELSE 'failed' END AS state, CASE WHEN n_chars <= 1000 AND lang = 'en' THEN b END AS signature FROM f""")
def stream_retry_failed(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("path"), "text", "source", "lang", "n_chars")
    first = docs.withColumn("signature", incremental.signature(F.col("text")))
    again = docs.withColumn("signature", incremental.signature(F.concat("text", "source")))
    nothing = spark.createDataFrame([], incremental.FAILED)
    _, read, failed = incremental.polled(first, nothing, nothing, F.col("n_chars") > 1000)
    # the same content is not tried again, changed content is
    _, read_same, failed = incremental.polled(first, read, failed, F.lit(True))
    done, _, failed = incremental.polled(again, read_same, failed, F.col("lang") != "en")
    none = F.lit(None).cast("string")
    states = read_same.select("path", F.lit("first").alias("state"), none.alias("signature"))
    states = states.unionByName(done.select("path", F.lit("second").alias("state"), none.alias("signature")))
    return states.unionByName(failed.select("path", F.lit("failed").alias("state"), "signature"))


@query("""WITH t AS (SELECT *, coalesce(max(CAST(event_type <> 'error' AS INT)) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS won FROM events)
  SELECT user_id, count(*) AS attempts, max(event_id) AS last_event FROM t WHERE won = 0 GROUP BY 1""")
def stream_attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = incremental.attempts_in_order(table(spark, sf_dir, "events"), "user_id", "event_id", F.col("event_type") != "error")
    return made.groupBy("user_id").agg(F.count(F.lit(1)).alias("attempts"), F.max("event_id").alias("last_event"))


@query("""WITH r AS (SELECT l_orderkey, max(l_returnflag) AS flag FROM lineitem GROUP BY 1)
  SELECT o_orderkey, coalesce(nullif(flag, ''), o_orderstatus) AS o_orderstatus FROM orders LEFT JOIN r ON l_orderkey = o_orderkey""")
def stream_refresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    results = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.max("l_returnflag").alias("o_orderstatus"))
    return incremental.refreshed(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus"), results, ["o_orderkey"], ["o_orderstatus"])
