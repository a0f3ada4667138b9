"""Joins: lookups, pairs of files, two levels of exact keys, tiers of targets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lanework.operators.dedupe import first_wins, last_wins

#: A side is broadcast only if Spark knows from its files' statistics that it is no larger than this.
BROADCAST_BYTES = 10 << 20


def small(df: DataFrame, most: int = BROADCAST_BYTES) -> DataFrame:
    """A broadcast hint, if the optimizer's size estimate of the side is within the bound; else the side as it is."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return F.broadcast(df) if size <= most else df


def checked_lookup(rows: DataFrame, parents: DataFrame, by_id: tuple[str, str], by_name: tuple[str, str]) -> DataFrame:
    """rows with their parent's `id`: by id if it is above 0, else by name.  One miss fails the whole batch.

    by_id, by_name: (column of rows, column of parents).
    """
    ids = parents.select(F.col(by_id[1]).alias("__i"), F.col(by_id[1]).alias("__id_a"))
    names = parents.groupBy(F.col(by_name[1]).alias("__n")).agg(F.min(by_id[1]).alias("__id_b"))
    asked = F.col(by_id[0]) > 0
    met = rows.join(ids, asked & (F.col(by_id[0]) == F.col("__i")), "left").join(names, F.col(by_name[0]) == F.col("__n"), "left")
    found = F.when(asked, F.col("__id_a")).otherwise(F.col("__id_b"))
    return met.withColumn("parent_id", F.coalesce(found, F.raise_error(F.lit("no such parent")).cast("bigint"))).drop("__i", "__id_a", "__n", "__id_b")


def misses(rows: DataFrame, parents: DataFrame, by_id: tuple[str, str], by_name: tuple[str, str]) -> DataFrame:
    """The rows that checked_lookup would fail on."""
    asked = rows.where(F.col(by_id[0]) > 0).join(parents, F.col(by_id[0]) == parents[by_id[1]], "left_anti")
    return asked.unionByName(rows.where(F.coalesce(F.col(by_id[0]) <= 0, F.lit(True))).join(parents, F.col(by_name[0]) == parents[by_name[1]], "left_anti"))


def last_wins_lookup(rows: DataFrame, entries: DataFrame, key: str, order: str, **values: Column) -> DataFrame:
    """rows with the values of the last entry of their key; nulls without one."""
    return rows.join(last_wins(entries, [key], order, **values), key, "left")


def linked_pairs(starts: DataFrame, results: DataFrame, keys: list[str], path: str, linked: str, rewrites: list[tuple[str, str]]) -> DataFrame:
    """Empty links are the file of the same keys, else the path rewritten."""
    have = results.groupBy(*keys).agg(F.min(linked).alias("__r"))
    fallback = F.col(path)
    for old, new in rewrites:
        fallback = F.regexp_replace(fallback, old, new)
    return starts.join(have, keys, "left").withColumn(linked, F.coalesce("__r", fallback)).drop("__r")


def exact_two_levels(rows: DataFrame, records: DataFrame, name: str, club: str, order: str, time: Column, rank: Column) -> DataFrame:
    """rows with time and rank by (name, club), else by name alone among all records.

    In each map the first time wins, and the first rank that isn't null wins by itself.  The rank is taken from the level
    the time came from.
    """
    timed = records.where(time.isNotNull())
    one = first_wins(timed, [name, club], order, __t1=time, __r1=rank)
    two = first_wins(timed, [name], order, __t2=time, __r2=rank)
    met = rows.join(one, [name, club], "left").join(two, [name], "left")
    first = F.col("__t1").isNotNull()
    return met.withColumn("time", F.coalesce("__t1", "__t2")).withColumn("rank", F.when(first, F.col("__r1")).otherwise(F.col("__r2"))).drop("__t1", "__r1", "__t2", "__r2")


def tiered_targets(sources: DataFrame, rows: DataFrame, source: str, link: str, number: str, unresolved: Column) -> DataFrame:
    """(source, n, tier): how many rows link to the source; if none, how many have its number; if none, the number of all
    unresolved rows, below zero.  Rows are counted by key before any join, so nothing is multiplied."""
    by_link = rows.groupBy(F.col(link).alias(source)).agg(F.count(F.lit(1)).alias("__one"))
    by_number = rows.groupBy(number).agg(F.count(F.lit(1)).alias("__two"))
    met = sources.join(by_link, source, "left").join(by_number, number, "left")
    counts = met.groupBy(source).agg(F.sum("__one").alias("__one"), F.sum("__two").alias("__two"))
    tier = F.when(F.col("__one").isNotNull(), 1).when(F.col("__two").isNotNull(), 2).otherwise(3)
    open_rows = F.broadcast(rows.agg(F.count_if(unresolved).alias("__open")).withColumn("tier", F.lit(3)))  # one row
    counts = counts.withColumn("tier", tier).join(open_rows, "tier", "left")
    return counts.select(source, F.when(F.col("tier") == 1, F.col("__one")).when(F.col("tier") == 2, F.col("__two")).otherwise(-F.col("__open")).alias("n"), "tier")


def tiered_rows(sources: DataFrame, rows: DataFrame, source: str, link: str, number: str, unresolved: Column) -> DataFrame:
    """(source, tier, target): the target rows themselves, each as a struct of all its columns.

    The rows of tier 3 are the same for all sources that have no others: they are given once, with a null source, if there
    is any such source.  Rows that several sources share in tiers 1 and 2 are given to each of them.
    """
    tiers = tiered_targets(sources, rows, source, link, number, unresolved).select(source, "tier")
    asked = sources.select(source, number).distinct().join(tiers, source)
    target = F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("target")
    held = rows.select(F.col(link).alias("__link"), F.col(number).alias("__number"), unresolved.alias("__open"), target)
    one = asked.where("tier = 1").select(source, "tier").distinct().join(held, F.col(source) == F.col("__link")).select(source, "tier", "target")
    two = asked.where("tier = 2").join(held, F.col(number) == F.col("__number")).select(source, "tier", "target")
    any_third = F.broadcast(asked.where("tier = 3").select("tier").limit(1))  # one row, or none
    three = held.where("__open").withColumn("tier", F.lit(3)).join(any_third, "tier").select(F.lit(None).cast(sources.schema[source].dataType).alias(source), "tier", "target")
    return one.unionByName(two).unionByName(three)
