"""Read queries: filters, groups, distinct values, top rows.

Filters and column choices are declared before any join or sort, so they reach the Parquet scan.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def present(c: str | Column) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce(F.trim(c.cast("string")) != "", F.lit(False))


def category_summary(df: DataFrame, keys: Sequence[str], filled: Column, largest: str, prefix: tuple[str, str, str] = ("result_count", "non_empty_result_count", "max_seri_no")) -> DataFrame:
    """Groups with a count, a filtered count and a maximum."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias(prefix[0]), F.count_if(filled).alias(prefix[1]), F.max(largest).alias(prefix[2]))


def one_row(*rows: DataFrame) -> DataFrame:
    """Frames of one row of numbers each, side by side, by a union and a sum: no join."""
    names = [c for r in rows for c in r.columns]
    wide = [r.select(*[F.col(n) if n in r.columns else F.lit(None).cast("bigint").alias(n) for n in names]) for r in rows]
    out = wide[0]
    for r in wide[1:]:
        out = out.unionByName(r)
    return out.agg(*[F.sum(n).alias(n) for n in names])


def row_counts(**frames: DataFrame) -> DataFrame:
    return one_row(*[f.agg(F.count(F.lit(1)).alias(n)) for n, f in frames.items()])


def totals(groups: DataFrame, sums: Sequence[str]) -> DataFrame:
    """How many groups, and sums over them: one row."""
    return groups.agg(F.count(F.lit(1)).alias("groups"), *[F.coalesce(F.sum(c), F.lit(0)).alias(f"total_{c}") for c in sums])


def equal_to(df: DataFrame, **values: Any) -> DataFrame:
    """All given columns equal to all given values."""
    for name, value in values.items():
        df = df.where(F.col(name) == value)
    return df


def optionally(df: DataFrame, **values: Any) -> DataFrame:
    """As equal_to, but values that are null, empty or not the number they should be are no filter."""
    kinds = dict(df.dtypes)
    for name, value in values.items():
        if value is None or str(value).strip() == "":
            continue
        if kinds[name] in ("int", "bigint", "smallint", "tinyint") and not str(value).strip().isdigit():
            continue
        df = df.where(F.col(name) == F.lit(str(value).strip()).cast(kinds[name]))
    return df


def distinct_sorted(df: DataFrame, column: str) -> DataFrame:
    return df.where(F.col(column).isNotNull() & (F.col(column) != "")).select(column).distinct().orderBy(column)


def parents_of(parents: DataFrame, children: DataFrame, key: str, child_key: str) -> DataFrame:
    """Parents that have a child: a semi join, no distinct."""
    return parents.join(children.select(F.col(child_key).alias(key)), key, "left_semi")


def latest(df: DataFrame, order: Sequence[Column], n: int) -> DataFrame:
    """The first n of an order; Spark keeps n rows a task and never sorts the whole."""
    return df.orderBy(*order).limit(n)
