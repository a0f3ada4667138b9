"""Writers: fixed projections, nested JSON, fan-out to several targets, a swap of table versions."""

from __future__ import annotations

import json
import urllib.request
from collections.abc import Callable, Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def projected(df: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Just these fields, as text: unknown columns go, missing ones and nulls are empty."""
    return df.select(*[(F.coalesce(F.col(c).cast("string"), F.lit("")) if c in df.columns else F.lit("")).alias(c) for c in fields])


def write_csv(df: DataFrame, path: str, fields: Sequence[str], append: bool = False) -> None:
    """Each part file has a header; quotes are doubled."""
    projected(df, fields).write.mode("append" if append else "overwrite").option("header", True).option("escape", '"').option("emptyValue", "").csv(path)


def nested(df: DataFrame, keys: Sequence[str], fields: Sequence[str], name: str = "rows") -> DataFrame:
    """keys, row_count, rows: an array of structs, sorted by its fields from the first on."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("row_count"), F.array_sort(F.collect_list(F.struct(*fields))).alias(name))


def write_json(df: DataFrame, path: str, append: bool = True) -> None:
    """A line for each row; letters outside ASCII stay as they are."""
    df.write.mode("append" if append else "overwrite").option("ignoreNullFields", False).json(path)


def _place(spark: SparkSession, path: str) -> tuple:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def exists(spark: SparkSession, path: str) -> bool:
    system, at = _place(spark, path)
    return system.exists(at)


def names_in(spark: SparkSession, path: str) -> list[str]:
    """Names of what lies in a folder, in order; none if it isn't there."""
    system, at = _place(spark, path)
    return sorted(s.getPath().getName() for s in system.listStatus(at)) if system.exists(at) else []


def remove(spark: SparkSession, path: str) -> None:
    system, at = _place(spark, path)
    system.delete(at, True)


def swap(spark: SparkSession, df: DataFrame, path: str) -> None:
    """The next version of a table in place of the last: written beside it first, so a failed job leaves the old one.

    A single writer is assumed.
    """
    fs = spark._jvm.org.apache.hadoop.fs
    at, new, old = (fs.Path(p) for p in (path, f"{path}.new", f"{path}.old"))
    system = at.getFileSystem(spark._jsc.hadoopConfiguration())
    df.write.mode("overwrite").parquet(f"{path}.new")
    system.delete(old, True)
    if system.exists(at):
        system.rename(at, old)
    system.rename(new, at)
    system.delete(old, True)


def targets_of(*urls: str) -> list[str]:
    """Base addresses without a slash at the end, each once, in their order."""
    return list(dict.fromkeys(u.strip().rstrip("/") for u in urls if u and u.strip()))


#: The header of the token, and what asks for a trial run.
TOKEN, TRIAL = "X-Ingest-Token", "?dry_run=1"
JSON, CSV = "application/json; charset=utf-8", "text/csv; charset=utf-8"


def call(url: str, body: bytes, kind: str = JSON, token: str | None = None, dry_run: bool = False) -> urllib.request.Request:
    """A POST of the body; the server changes nothing on a dry run."""
    headers = {"Content-Type": kind} | ({TOKEN: token} if token else {})
    return urllib.request.Request(url + (TRIAL if dry_run else ""), body, headers, method="POST")


def payload(rows: list[dict]) -> bytes:
    return json.dumps({"rows": rows}, ensure_ascii=False).encode("utf-8")


def fan_out(rows: list[dict] | bytes, urls: Iterable[str], send: Callable[[str, bytes], int] | None = None, token: str | None = None, dry_run: bool = False) -> dict[str, int | str]:
    """{"rows": [...]}, or CSV given as bytes, to each target.  Fails only if all do."""
    body, kind = (rows, CSV) if isinstance(rows, bytes) else (payload(rows), JSON)
    said: dict[str, int | str] = {}
    for url in urls:
        try:
            said[url] = send(url, body) if send else _post(call(url, body, kind, token, dry_run))
        except OSError as e:
            said[url] = str(e)
    if said and not any(isinstance(x, int) for x in said.values()):
        raise OSError(f"no target took the rows: {said}")
    return said


def _post(request: urllib.request.Request) -> int:
    with urllib.request.urlopen(request, timeout=120) as got:
        return got.status


def push(df: DataFrame, urls: Sequence[str], rows_a_call: int = 500, send: Callable[[str, bytes], int] | None = None, token: str | None = None, dry_run: bool = False) -> None:
    """Each partition posts its own rows, so nothing is gathered on the driver."""

    def run(rows) -> None:
        held = []
        for row in rows:
            held.append(row.asDict(True))
            if len(held) == rows_a_call:
                fan_out(held, urls, send, token, dry_run)
                held = []
        if held:
            fan_out(held, urls, send, token, dry_run)

    df.foreachPartition(run)


def document_payload(rows: DataFrame, path: str, doc: str, **said: Column | str | int) -> None:
    """Appends one JSON line for each document: when it was processed, what is said of it, its row count and its rows."""
    from lanework.functions.numbers import now_utc

    one = rows.groupBy(doc).agg(F.count(F.lit(1)).alias("row_count"), F.array_sort(F.collect_list(F.struct(*[c for c in rows.columns if c != doc]))).alias("rows"))
    write_json(enriched(one, **said).withColumn("processed_at_utc", now_utc()), path)


def summary_line(counts: dict[str, int]) -> str:
    return ", ".join(f"{k}={v}" for k, v in counts.items())


def created(table: DataFrame, rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Get-or-create: the rows whose key the table lacks."""
    return rows.join(table.select(*keys), list(keys), "left_anti")


def enriched(df: DataFrame, **constants: Column | str | int) -> DataFrame:
    for name, value in constants.items():
        df = df.withColumn(name, value if isinstance(value, Column) else F.lit(value))
    return df
