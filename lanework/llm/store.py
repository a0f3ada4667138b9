"""Tables in the folder all executors share, and segments: rows packed into bounded Arrow blobs.

A segment is a handful of whole rows (about 4 MB of text, or one longer row) as one zstd-compressed Arrow stream.  It is
written once, so what is derived from it is the same whenever a lost task runs again, and it moves through a shuffle as
one small binary value, with any columns of any type and name.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from lanework.llm.words import CHUNK_BYTES
from lanework.session import scratch


def written(df: DataFrame, name: str) -> DataFrame:
    """The table, written to the shared folder and read again: lineage ends here, and lost executors lose nothing."""
    return stored(df, name)[0]


def stored(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """As written, and where: `removed` takes it away once nothing reads it any more."""
    path = scratch(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def removed(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def stored_and_told(df: DataFrame, name: str, **asked: Column) -> tuple[DataFrame, str, dict]:
    """As stored, and sums over all rows that the writing job works out by the way."""
    told = Observation()
    return *stored(df.observe(told, *[c.alias(n) for n, c in asked.items()]), name), told.get


def bounded_batches(spark: SparkSession) -> None:
    """Arrow batches bounded by bytes as well as by rows, so that long texts don't add up in a Python worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))


def task_numbers() -> Iterator[int]:
    """Numbers no other task of the same stage gives out."""
    at = TaskContext.get().partitionId() << 32
    while True:
        yield at
        at += 1


def pack(batch: pa.RecordBatch | pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=3))) as out:
        out.write(batch)
    return sink.getvalue().to_pybytes()


def unpack(blob: bytes | pa.Buffer) -> pa.Table:
    with pa.ipc.open_stream(pa.py_buffer(blob)) as found:
        return found.read_all().combine_chunks()


def gathered(batches: Iterator[pa.RecordBatch], column: str, most: int = CHUNK_BYTES) -> Iterator[pa.Table]:
    """Whole rows in tables of about `most` bytes of the text column, across batch borders."""
    held, size = [], 0
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
        first = 0
        for i, n in enumerate(sizes):
            if size and size + n > most:
                held.append(batch.slice(first, i - first))
                yield pa.Table.from_batches(held).combine_chunks()
                held, size, first = [], 0, i
            size += n + 16
        if first < len(sizes):
            held.append(batch.slice(first))
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def segments(df: DataFrame, text: str, name: str, most: int = CHUNK_BYTES) -> DataFrame:
    """(seg, blob): all rows and columns of df as segments of about `most` bytes of text, in the shared folder."""

    def run(batches):
        for seg, table in zip(numbered(), gathered(batches, text, most), strict=False):
            yield pa.RecordBatch.from_arrays([pa.array([seg], pa.int64()), pa.array([pack(table)], pa.binary())], ["seg", "blob"])

    numbered = task_numbers
    return written(df.mapInArrow(run, "seg long, blob binary"), name)


#: Whole rows as one struct, beside the text an operator works on: no column's name can clash with the operator's.
ROW = "\1row"


def wrapped(df: DataFrame, text: str = "text", with_text: bool = True) -> DataFrame:
    """The rows, with the text or without it, and the text."""
    held = [F.col(f"`{c}`") for c in df.columns if with_text or c != text]
    return df.select(F.struct(*held, F.lit(None).cast("byte").alias("\1")).alias(ROW), F.col(f"`{text}`").alias(text))


def unwrapped(df: DataFrame, columns: list[str], **new: Column) -> DataFrame:
    """The rows' columns in this order; those of `new` as they are given."""
    return df.select(*[(new[c] if c in new else F.col(f"`{ROW}`")[c]).alias(c) for c in columns])


def giving_way(names: list[str], outputs: list[str]) -> list[str]:
    """Columns to pass on: one that has an output's name gives way to the output."""
    taken = {o.lower() for o in outputs}
    return [n for n in names if n.lower() not in taken]
