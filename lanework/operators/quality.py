"""Counts and scores about how well something was read."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lanework.functions.numbers import success_ratio
from lanework.operators.reads import present


def filled_counts(df: DataFrame, columns: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """rows, and for each column how many aren't blank."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"), *[F.count_if(present(c)).alias(f"filled_{c}") for c in columns])


def missing_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("rows"), *[F.count_if(~present(c)).alias(f"missing_{c}") for c in columns])


def coverage(starts: DataFrame, records: DataFrame, matches: DataFrame, key: str, timed: Column, identity: Sequence[str]) -> DataFrame:
    """For each list: start rows, timed records, distinct timed identities, matches; and a TOTAL that sums the lists (the
    distinct ones too: an identity in two lists counts twice)."""
    a = starts.groupBy(key).agg(F.count(F.lit(1)).alias("start_rows"))
    b = records.where(timed).groupBy(key).agg(F.count(F.lit(1)).alias("timed_records"), F.count_distinct(F.struct(*identity)).alias("distinct_records"))
    c = matches.groupBy(key).agg(F.count(F.lit(1)).alias("matched_rows"))
    names = ["start_rows", "timed_records", "distinct_records", "matched_rows"]
    lists = a.join(b, key, "full_outer").join(c, key, "full_outer").na.fill(0, names).select(F.col(key).cast("string").alias("list"), *names)
    return lists.unionByName(lists.agg(F.lit("TOTAL").alias("list"), *[F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in names]))


def backends(attempts: DataFrame, backend: str, success: Column) -> DataFrame:
    """success, failure, ratio of each backend."""
    got = attempts.groupBy(backend).agg(F.count_if(success).alias("success"), F.count_if(~success).alias("failure"))
    return got.withColumn("ratio", success_ratio(F.col("success"), F.col("failure")))


def preference(position: Column) -> list[Column]:
    """The order of backends to try: by ratio, by successes, then as they stood."""
    return [F.desc("ratio"), F.desc("success"), position.asc()]


def first_success(attempts: DataFrame, group: str, order: str, success: Column, *values: str) -> DataFrame:
    """The first attempt of each group that succeeded, or no row."""
    return attempts.where(success).groupBy(group).agg(F.min_by(F.struct(order, *values), F.col(order)).alias("__row")).select(group, "__row.*")


def merged_counts(stats: DataFrame, more: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Counters of two tables, added."""
    return stats.select(key, *columns).unionByName(more.select(key, *columns)).groupBy(key).agg(*[F.sum(c).alias(c) for c in columns])
