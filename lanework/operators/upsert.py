"""Keyed upserts as set operations.

Plain Parquet has no MERGE, so an upsert makes the new version of a table; `sources.sinks.swap` puts it in place.  Rows of
one batch that hit the same target are folded in their order first, then met with the table in one join.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lanework.operators.reads import one_row


def patches(rows: DataFrame, keys: Sequence[str], order: str, fields: Sequence[str], present: dict[str, Column]) -> DataFrame:
    """One row for each key: each field's value in the last row where it is present, and has_{field}."""
    out = []
    for f in fields:
        at = F.when(present[f], F.col(order))
        out += [F.max_by(F.col(f), at).alias(f), F.max(present[f]).alias(f"has_{f}")]
    return rows.groupBy(*keys).agg(*out, F.count(F.lit(1)).alias("n_rows"), F.min(order).alias("first_order"))


def merged(table: DataFrame, changes: DataFrame, keys: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """The table's next version, with `action`: created, updated or kept.  Only fields that a change has are overwritten."""
    both = table.select(*keys, *[F.col(f).alias(f"old_{f}") for f in fields], F.lit(True).alias("__old")).join(changes.select(*keys, *fields, *[f"has_{f}" for f in fields], F.lit(True).alias("__new")), list(keys), "full_outer")
    action = F.when(F.col("__old").isNull(), "created").when(F.col("__new").isNull(), "kept").otherwise("updated")
    return both.select(*keys, *[F.when(F.coalesce(f"has_{f}", F.lit(False)), F.col(f)).otherwise(F.col(f"old_{f}")).alias(f) for f in fields], action.alias("action"))


def natural_upsert(table: DataFrame, rows: DataFrame, keys: Sequence[str], order: str, fields: Sequence[str]) -> DataFrame:
    """As merged, where each change overwrites all fields, blanks too, and the last of a batch wins."""
    last = F.max_by(F.struct(*fields), F.col(order)).alias("__row")
    changes = rows.groupBy(*keys).agg(last).select(*keys, "__row.*", *[F.lit(True).alias(f"has_{f}") for f in fields])
    return merged(table, changes, keys, fields)


def got_or_created(table: DataFrame, rows: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """One row for each key of the batch: its first `order`, how many rows have it (n), and `action`: created or kept.

    Rows of one key are counted before they meet the table, of which only the keys are read; nulls are equal to nulls.
    """
    new = rows.groupBy(*keys).agg(F.min(order).alias(order), F.count(F.lit(1)).alias("n")).alias("new")
    old = table.select(*keys).distinct().withColumn("__old", F.lit(True)).alias("old")
    same = F.lit(True)
    for k in keys:
        same = same & F.col(f"new.{k}").eqNullSafe(F.col(f"old.{k}"))
    action = F.when(F.col("__old").isNotNull(), "kept").otherwise("created").alias("action")
    return new.join(old, same, "left").select("new.*", action)


def summary(rows: DataFrame, result: Column, event: str, next_version: DataFrame) -> DataFrame:
    """rows_seen, rows_with_result, events_seen, created, updated: one row."""
    seen = rows.agg(F.count(F.lit(1)).alias("rows_seen"), F.count_if(result).alias("rows_with_result"), F.count_distinct(event).alias("events_seen"))
    done = next_version.agg(F.count_if(F.col("action") == "created").alias("created"), F.count_if(F.col("action") == "updated").alias("updated"))
    return one_row(seen, done)


def allocated_names(rows: DataFrame, taken: DataFrame, base: str, order: str, name: str, most: int = 100) -> DataFrame:
    """Distinct names: the base if it is free, else base-2, base-3, ..., the base cut so that the whole fits.

    A suffix is taken if `taken` holds the name; the n-th new row of a base gets the n-th free suffix.  Each base's free
    suffixes are the numbers up to its rows and taken names together, which is enough for all.
    """
    numbered = rows.withColumn("__i", F.row_number().over(Window.partitionBy(base).orderBy(order)))
    suffix = F.when(F.col("__k") == 1, "").otherwise(F.concat(F.lit("-"), F.col("__k").cast("string")))
    made = F.concat(F.substr(F.col(base), F.lit(1), F.lit(most) - F.char_length(suffix)), suffix)
    used = taken.select(F.col(name).alias("__used")).distinct()
    stem = F.regexp_replace("__used", r"-\d+$", "")
    near = used.groupBy(F.substr(stem, F.lit(1), F.lit(most - 5)).alias("__stem")).agg(F.count(F.lit(1)).alias("__t"))
    whole = used.groupBy(F.substr("__used", F.lit(1), F.lit(most - 5)).alias("__stem2")).agg(F.count(F.lit(1)).alias("__t2"))
    sizes = numbered.groupBy(base).agg(F.max("__i").alias("__m")).withColumn("__stem", F.substr(base, F.lit(1), F.lit(most - 5)))
    sizes = sizes.join(near, "__stem", "left").join(whole, F.col("__stem") == F.col("__stem2"), "left")
    options = sizes.select(base, F.explode(F.sequence(F.lit(1), F.col("__m") + F.coalesce("__t", F.lit(0)) + F.coalesce("__t2", F.lit(0)))).alias("__k")).withColumn("__name", made)
    free = options.join(used, F.col("__name") == F.col("__used"), "left_anti")
    free = free.withColumn("__i", F.row_number().over(Window.partitionBy(base).orderBy("__k")))
    return numbered.join(free.select(base, "__i", F.col("__name").alias(name)), [base, "__i"]).drop("__i")
