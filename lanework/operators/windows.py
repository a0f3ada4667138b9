"""State carried along ordered lines, as window functions partitioned by document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def carried(value: Column, doc: str, order: str) -> Column:
    """The last value that isn't null, this row's included."""
    return F.last(value, ignorenulls=True).over(Window.partitionBy(doc).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))


def ahead(value: Column, doc: str, order: str, n: int) -> Column:
    return F.lead(value, n).over(Window.partitionBy(doc).orderBy(order))


def next_filled(line: Column, doc: str, order: str) -> Column:
    return F.first(F.nullif(line, F.lit("")), ignorenulls=True).over(Window.partitionBy(doc).orderBy(order).rowsBetween(1, Window.unboundedFollowing))


def previous_filled(line: Column, doc: str, order: str) -> Column:
    return F.last(F.nullif(line, F.lit("")), ignorenulls=True).over(Window.partitionBy(doc).orderBy(order).rowsBetween(Window.unboundedPreceding, -1))


def numbered(df: DataFrame, group: str, order: list[str | Column], name: str = "n") -> DataFrame:
    """1, 2, ... in each group."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(group).orderBy(*order)))


def lines_of(df: DataFrame, text: str = "text", line_no: str = "line_no", line: str = "line") -> DataFrame:
    """One row for each line of each text, from 1; blank ones too, as look-ahead counts them."""
    parts = F.split(F.replace(F.col(text), F.lit("\r\n"), F.lit("\n")), "\n")
    return df.select(*[c for c in df.columns if c != text], F.posexplode(parts).alias("__p", line)).withColumn(line_no, F.col("__p") + 1).drop("__p")


def allocated_keys(new: DataFrame, existing: DataFrame, group: str, order: str, key: str, pattern: str = r"-(\d+)$") -> DataFrame:
    """New rows with `{group}-{n:06d}`, n from one more than the largest number among the group's keys."""
    number = F.max(F.nullif(F.regexp_extract(key, pattern, 1), F.lit("")).try_cast("bigint")).alias("__most")
    most = existing.groupBy(group).agg(number)
    n = F.coalesce("__most", F.lit(0)) + F.row_number().over(Window.partitionBy(group).orderBy(order))
    return new.join(most, group, "left").withColumn(key, F.concat(F.col(group).cast("string"), F.lit("-"), F.format_string("%06d", n))).drop("__most")
