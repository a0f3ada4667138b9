"""Sharding along a Hilbert curve.

Several metadata dimensions (by default the size, the source, the language) are quantised at quantiles of the whole table
into 2^BITS steps each; texts are cut by the order of whole strings.  A row's cell is a point on a Hilbert curve through all
cells, and rows are ordered by it: rows near each other on the curve are near in every dimension, so each shard covers a
small box in all of them and its files' minima and maxima prune.  The order is cut into runs; `write` lays out a folder of
files for each, `pruned` tells by their statistics which ones a filter needs.

Rows of one group (equal `group`, by default equal texts) take the least place on the curve that any of them has, and lie
next to each other: a group is split only where the end of a run falls inside it, or if it is larger than a run.

law `rows`: the runs' counts are at most one apart.  law `bytes`: the runs' sums of size are as near to equal as whole
rows allow: a row belongs to the run in which its middle byte lies.

Scale: nothing is sorted as a whole.  Groups of several rows are counted and meet their rows in one join of a few numbers.
Rows are counted by part: a cell has as many parts as its count asks for, and a group of more than ROWS_A_PART has parts of
its own; the running sums of this small table, some rows for each ROWS_A_PART, give each part its first place; inside a
part, rows are numbered by a window of bounded size.  So neither a hot source nor a large group of equal texts makes a
large task.  The curve is worked out for cells, of which there are 2^(BITS * dimensions) at most, whatever the rows.

Defined results: null texts have size 1 (0 bytes plus 1) and no bytes' checksum, that of the empty text, and are a group with
empty ones; null dimensions sort first; equal rows each get a place of their own; an empty table gives an empty table; other
columns aren't read, and a column to keep that has the name of a result gives way to it.  Groups are told apart by 64 bits;
a clash puts two groups side by side, no more.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lanework.llm.store import giving_way, written

BITS = 4
ROWS_A_PART = 20_000
SHARDS = 16
ROWS_A_FILE = 1_000_000


def hilbert(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Index on the curve of points in [0, 2^bits)^n (Skilling's transform, 2004)."""
    x = points.astype(np.int64).T.copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            on = (x[i] & q) != 0
            t = np.where(on, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(on, x[0] ^ p, x[0] ^ t)
            x[i] ^= t
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t = np.where((x[n - 1] & q) != 0, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    out = np.zeros_like(x[0])
    for b in reversed(range(bits)):
        for i in range(n):
            out = (out << 1) | ((x[i] >> b) & 1)
    return out


def quantiles(df: DataFrame, dims: dict[str, Column], steps: int) -> dict[str, list]:
    """At most steps - 1 ascending cuts of each dimension's values, from all rows."""
    kinds = dict(df.select(*[c.alias(n) for n, c in dims.items()]).dtypes)
    asked = [i / steps for i in range(1, steps)]
    numbers = {n: c for n, c in dims.items() if kinds[n] != "string"}
    found = df.agg(*[F.percentile_approx(c, asked, 10_000).alias(n) for n, c in numbers.items()]).first() if numbers else {}
    cuts = {n: sorted(set(found[n] or [])) for n in numbers}
    texts = [n for n in dims if n not in numbers]
    # the distinct values of all texts, counted in one pass
    values = df.select(F.explode(F.array(*[F.struct(F.lit(n).alias("dim"), dims[n].alias("x")) for n in texts])).alias("v")).select("v.*") if texts else None
    return cuts | (text_cuts(values, steps) if texts else {})


def text_cuts(values: DataFrame, steps: int) -> dict[str, list[str]]:
    """For each `dim`, at most steps - 1 strings that cut its values `x` into parts of near equal counts.

    Distinct values are counted, so a hot one is one row, and sorted by range; parts' sums give each part its first rank.
    """
    counted = values.where("x is not null").groupBy("dim", "x").agg(F.count(F.lit(1)).alias("n"))
    counted = written(counted.repartitionByRange("dim", "x").withColumn("part", F.spark_partition_id()), "values")
    sums = Window.partitionBy("dim").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = counted.groupBy("dim", "part").agg(F.sum("n").alias("s"))  # a row for each task
    parts = parts.withColumn("before", F.coalesce(F.sum("s").over(sums), F.lit(0))).withColumn("total", F.sum("s").over(Window.partitionBy("dim")))
    inside = Window.partitionBy("dim", "part").orderBy("x").rowsBetween(Window.unboundedPreceding, 0)
    ranked = counted.join(parts, ["dim", "part"]).withColumn("upto", F.col("before") + F.sum("n").over(inside))
    holds = F.floor(F.col("upto") * steps / F.col("total")) > F.floor((F.col("upto") - F.col("n")) * steps / F.col("total"))
    found: dict[str, list[str]] = {}
    for r in ranked.where(holds & (F.col("upto") < F.col("total"))).select("dim", "x").collect():  # steps - 1 for each dimension
        found.setdefault(r["dim"], []).append(r["x"])
    return {d: sorted(x) for d, x in found.items()}


def quantised(x: Column, cuts: list) -> Column:
    """How many cuts lie below the value; null is 0."""
    return F.coalesce(F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c < x)), F.lit(0)) if cuts else F.lit(0)


def assign(df: DataFrame, dims: dict[str, Column], size: Column, group: Column, tie: list[Column], keep: dict[str, Column], shards: int = SHARDS, law: str = "rows", bits: int = BITS, rows_a_part: int = ROWS_A_PART) -> DataFrame:
    """keep's columns, law, shard, slot (0, 1, ... in each shard), curve (the index of the row's cell).

    group: rows with equal values stay together; tie: what orders them among each other.
    """
    keep = {n: keep[n] for n in giving_way(list(keep), ["law", "shard", "slot", "curve"])}
    if law not in ("rows", "bytes"):
        raise ValueError("law is rows or bytes")
    spark = df.sparkSession
    steps = 1 << bits
    cuts = quantiles(df, dims, steps)
    names = [f"__q{i}" for i in range(len(dims))]
    points = [quantised(c, cuts.get(n, [])).cast("int").alias(q) for q, (n, c) in zip(names, dims.items(), strict=True)]
    every = np.stack(np.meshgrid(*[np.arange(steps)] * len(names), indexing="ij"), -1).reshape(-1, len(names))
    # bounded: 2^(bits * dimensions) rows
    cells = spark.createDataFrame([(*map(int, p), int(h)) for p, h in zip(every, hilbert(every, bits), strict=True)], ", ".join([*[f"{n} int" for n in names], "curve long"]))
    # texts are read once; what follows works on a few numbers a row
    rows = written(df.select(*[c.alias(n) for n, c in keep.items()], *points, size.cast("long").alias("__size"), F.xxhash64(group).alias("__group"), F.xxhash64(*tie).alias("__tie")), "points")
    rows = rows.join(F.broadcast(cells), names).drop(*names)
    groups = rows.groupBy("__group").agg(F.count(F.lit(1)).alias("__rows"), F.min("curve").alias("__place")).where("__rows > 1")
    rows = rows.join(groups, "__group", "left").withColumn("curve", F.coalesce("__place", "curve"))
    large = F.col("__rows") > rows_a_part  # null for groups of one row
    rows = rows.withColumn("__large", F.when(large, F.col("__group")).otherwise(F.lit(0)))
    rows = rows.withColumn("__sub", F.when(large, F.pmod("__tie", F.ceil(F.col("__rows") / rows_a_part).cast("long"))).otherwise(0).cast("int")).drop("__rows", "__place")
    counted = rows.groupBy("curve").agg(F.ceil(F.count(F.lit(1)) / rows_a_part).cast("int").alias("__parts"))  # bounded as the cells are
    rows = written(rows.join(F.broadcast(counted), "curve").withColumn("__part", F.pmod("__group", "__parts").cast("int")).drop("__parts"), "places")
    part = ["curve", "__part", "__large", "__sub"]
    running = Window.orderBy(*part).rowsBetween(Window.unboundedPreceding, -1)
    parts = rows.groupBy(*part).agg(F.count(F.lit(1)).alias("n"), F.sum("__size").alias("s"))
    parts = parts.select(*part, F.coalesce(F.sum("n").over(running), F.lit(0)).alias("__before"), F.coalesce(F.sum("s").over(running), F.lit(0)).alias("__bytes"))
    totals = rows.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("__size"), F.lit(0)).alias("s")).first()
    inside = Window.partitionBy(*part).orderBy("__group", "__tie", *keep)
    sums = inside.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.join(parts, part)
    rank = F.col("__before") + F.row_number().over(inside) - 1
    if law == "rows":
        placed = rows.withColumn("__rank", rank)
        placed = placed.withColumn("shard", F.expr(f"cast((__rank * {shards}) div {max(int(totals['n']), 1)} as int)"))
        first = F.expr(f"(shard * {int(totals['n'])}L + {shards - 1}) div {shards}")
    else:
        begin = F.col("__bytes") + F.coalesce(F.sum("__size").over(sums), F.lit(0))
        placed = rows.withColumn("__rank", rank).withColumn("__begin", begin)
        placed = placed.withColumn("shard", F.expr(f"cast(least({shards - 1}, ((2 * __begin + __size) * {shards}) div {max(2 * int(totals['s']), 1)}) as int)"))
        starts = placed.groupBy("shard").agg(F.min("__rank").alias("__first"))
        placed, first = placed.join(F.broadcast(starts), "shard"), F.col("__first")
    return placed.select(*keep, F.lit(law).alias("law"), "shard", (F.col("__rank") - first).alias("slot"), "curve")


def write(placed: DataFrame, path: str, dims: list[str], rows_a_file: int = ROWS_A_FILE) -> DataFrame:
    """Writes each shard into a folder `shard=i` of Parquet files, in the curve's order, and returns what `pruned` reads.

    dims: columns of `placed`.  (shard, file, rows, and for each dimension its least and greatest value), kept beside the
    files; a file holds up to `rows_a_file` neighbouring rows, so no shard is one task's work.
    """
    piece = F.floor(F.col("slot") / rows_a_file)
    dealt = placed.withColumn("file", piece.cast("int"))
    dealt.repartition("shard", "file").sortWithinPartitions("shard", "file", "slot").write.partitionBy("shard", "file").parquet(f"{path}/rows")
    told = dealt.groupBy("shard", "file").agg(F.count(F.lit(1)).alias("rows"), *[f(d).alias(f"{n}_{d}") for d in dims for n, f in (("least", F.min), ("greatest", F.max))])
    told.write.parquet(f"{path}/statistics")
    return placed.sparkSession.read.schema(told.schema).parquet(f"{path}/statistics")


def pruned(statistics: DataFrame, **ranges: tuple) -> DataFrame:
    """(shard, file) that can hold rows with all dimensions within [least, greatest], by the files' statistics alone."""
    held = F.lit(True)
    for d, (low, high) in ranges.items():
        held = held & (F.col(f"greatest_{d}") >= F.lit(low)) & (F.col(f"least_{d}") <= F.lit(high))
    return statistics.where(held).select("shard", "file")
