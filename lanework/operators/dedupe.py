"""Ordered deduplication.  The order is a column, never the order of files or of a shuffle."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def first_wins(df: DataFrame, keys: Sequence[str], order: str, **values: Column) -> DataFrame:
    """For each key, each value by itself from the first row where it isn't null."""
    return df.groupBy(*keys).agg(*[F.min_by(v, F.when(v.isNotNull(), F.col(order))).alias(n) for n, v in values.items()])


def last_wins(df: DataFrame, keys: Sequence[str], order: str, **values: Column) -> DataFrame:
    """For each key, the values of its last row, nulls too."""
    row = F.max_by(F.struct(*[v.alias(n) for n, v in values.items()]), F.col(order)).alias("__row")
    return df.groupBy(*keys).agg(row).select(*keys, "__row.*")


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first row of each key, nulls being equal."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def keep_first_by_key(df: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """As keep_first, by an aggregation: rows are reduced before the shuffle, so large groups cost little."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.col(order)).alias("__row")).select(*keys, "__row.*")


def without_repeats(lines: DataFrame, doc: str, order: str, line: str) -> DataFrame:
    """Lines of one character go; of the rest, those equal to the line kept before go."""
    w = Window.partitionBy(doc).orderBy(order)
    long = lines.where(F.char_length(line) != 1)
    return long.withColumn("__p", F.lag(line).over(w)).where(F.col("__p").isNull() | (F.col("__p") != F.col(line))).drop("__p")


def union_distinct(*frames: DataFrame) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out.distinct()


def not_seen(df: DataFrame, seen: DataFrame, key: str) -> DataFrame:
    return df.join(seen.select(key), key, "left_anti")


def changed_or_new(df: DataFrame, stored: DataFrame, key: str, signature: str, stored_signature: str) -> DataFrame:
    """Rows but those whose signature is known, not empty, and as stored."""
    known = stored.select(key, stored_signature)
    met = df.join(known, key, "left")
    same = F.coalesce((F.col(signature) != "") & (F.col(signature) == F.col(stored_signature)), F.lit(False))
    return met.where(~same).drop(stored_signature)
