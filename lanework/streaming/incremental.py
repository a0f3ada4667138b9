"""Incremental ingestion: a file source with a checkpoint, failures that are tried again once their content changes.

A file under a known path counts as read once it was read well.  A file that failed is kept in a table with the signature of
its content, and is offered again only with another signature.  The checkpoint commits a batch at a time, and batches are
written under their number, so a batch that runs again replaces itself.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lanework.operators.dedupe import union_distinct
from lanework.sources.sinks import exists, names_in, remove

READ, FAILED = "path string", "path string, signature string"
STATS = "backend string, success long, failure long"


def signature(content: Column) -> Column:
    """Length and SHA-1 of the content."""
    return F.concat(F.octet_length(content).cast("string"), F.lit(":"), F.sha1(content.cast("binary")))


def pending(files: DataFrame, read: DataFrame, failed: DataFrame) -> DataFrame:
    """Files (path, signature, ...) that weren't read well yet, but those that failed with this very signature."""
    new = files.join(read.select("path"), "path", "left_anti")
    return new.join(failed.select("path", "signature"), ["path", "signature"], "left_anti")


def polled(files: DataFrame, read: DataFrame, failed: DataFrame, good: Column) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows read well, all paths read, failures now) after trying what is pending.  good: whether a file can be read."""
    tried = pending(files, read, failed).withColumn("__good", F.coalesce(good, F.lit(False)))
    done = tried.where("__good").drop("__good")
    read_now = union_distinct(read.select("path"), done.select("path"))
    fresh = tried.where("not __good").select("path", "signature")
    # a newer failure replaces an older one of its path; what was read well is no failure any more
    left = failed.select("path", "signature").join(tried.select("path"), "path", "left_anti").unionByName(fresh)
    return done, read_now, left


@dataclass
class State:
    """What outlives a poll: files read well, failures with their content's signature, backends' successes, polls so far."""

    read: DataFrame
    failed: DataFrame
    stats: DataFrame
    polls: int = 0


def load_state(spark: SparkSession, path: str) -> State:
    """The last state that was saved whole under `path`; what is missing or can't be read is empty."""
    whole = [n for n in names_in(spark, path) if n.isdigit() and exists(spark, f"{path}/{n}/polls/_SUCCESS")]
    base = f"{path}/{whole[-1]}" if whole else path

    def of(name: str, schema: str) -> DataFrame:
        try:
            found = spark.read.schema(schema).parquet(f"{base}/{name}")
            found.limit(1).collect()
            return found
        except Exception:  # missing or corrupt: begin anew
            return spark.createDataFrame([], schema)

    return State(of("read", READ), of("failed", FAILED), of("stats", STATS), int(whole[-1]) if whole else 0)


def save_state(spark: SparkSession, path: str, state: State) -> None:
    """A version of its own for each poll, its number last; the one before it stays, older ones go."""
    base = f"{path}/{state.polls:09d}"
    parts = {"read": state.read, "failed": state.failed, "stats": state.stats, "polls": spark.createDataFrame([(state.polls,)], "polls int")}
    for name, rows in parts.items():
        rows.write.mode("overwrite").parquet(f"{base}/{name}")
    for old in [n for n in names_in(spark, path) if n.isdigit() and int(n) < state.polls - 1]:
        remove(spark, f"{path}/{old}")


def poll(spark: SparkSession, path: str, files: DataFrame, good: Column) -> DataFrame:
    """One poll with its state under `path`: the rows of files read well; reads and failures are saved."""
    state = load_state(spark, path)
    done, read, failed = polled(files, state.read, state.failed, good)
    kept = f"{path}/done"
    done.write.mode("overwrite").parquet(kept)
    save_state(spark, path, State(read, failed, state.stats, state.polls + 1))
    return spark.read.schema(done.schema).parquet(kept)


def repeated(run: Callable[[], bool], push: Sequence[Callable[[], bool]] = (), every: float = 30.0, most: int = 0, begun: int = 0, stop_on_error: bool = False, sleep: Callable[[float], None] = time.sleep) -> int:
    """Runs, pushes if the run went well, sleeps, and again; the number of polls, those before (`begun`) included.

    run and each push tell whether they went well; an exception counts as an error.  most: as many polls in all, 0 for ever.
    After an error it goes on, or with `stop_on_error` it stops.
    """

    def well(f: Callable[[], bool]) -> bool:
        try:
            return bool(f())
        except Exception:
            if stop_on_error:
                raise
            return False

    if every <= 0:
        raise ValueError("the interval is above 0")
    polls = begun
    while not most or polls < most:
        polls += 1
        for step in (run, *push):
            if not well(step):
                if stop_on_error:
                    return polls
                if step is run:  # pushes go on after one that failed, but not after a run that did
                    break
        if not most or polls < most:
            sleep(every)
    return polls


def ingest_files(spark: SparkSession, source: str, target: str, checkpoint: str, schema: T.StructType, transform: Callable[[DataFrame], DataFrame], glob: str | None = None, files_a_batch: int | None = None, file_format: str = "parquet", on_batch: Callable[[DataFrame, int], None] | None = None) -> None:
    """Reads what is new under `source`, transforms and writes it under `target`, and returns when there is no more.

    on_batch: called with each batch's rows after they are written, such as a push to other places.
    """
    stream = spark.readStream.schema(schema)
    if glob:
        stream = stream.option("pathGlobFilter", glob)
    if files_a_batch:
        stream = stream.option("maxFilesPerTrigger", files_a_batch)

    def write(batch: DataFrame, number: int) -> None:
        rows = transform(batch)
        rows.write.mode("overwrite").parquet(f"{target}/batch={number:09d}")
        if on_batch:
            on_batch(spark.read.parquet(f"{target}/batch={number:09d}"), number)

    query = stream.format(file_format).load(source).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def watch(spark: SparkSession, source: str, target: str, checkpoint: str, schema: T.StructType, transform: Callable[[DataFrame], DataFrame], every: str = "30 seconds", glob: str | None = None, on_batch: Callable[[DataFrame, int], None] | None = None):
    """As ingest_files, again and again until the query it returns is stopped."""
    stream = spark.readStream.schema(schema)
    stream = stream.option("pathGlobFilter", glob) if glob else stream

    def write(batch: DataFrame, number: int) -> None:
        transform(batch).write.mode("overwrite").parquet(f"{target}/batch={number:09d}")
        if on_batch:
            on_batch(spark.read.parquet(f"{target}/batch={number:09d}"), number)

    return stream.parquet(source).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()


def attempts_in_order(attempts: DataFrame, group: str, position: str, success: Column) -> DataFrame:
    """Attempts up to and with the first success of each group: those that would have been made."""
    from pyspark.sql.window import Window

    before = Window.partitionBy(group).orderBy(position).rowsBetween(Window.unboundedPreceding, -1)
    return attempts.withColumn("__won", F.coalesce(F.max(success.cast("int")).over(before), F.lit(0))).where("__won = 0").drop("__won")


def refreshed(starts: DataFrame, results: DataFrame, key: list[str], fields: list[str]) -> DataFrame:
    """Start rows with the fields of new results, where these have any; the others keep theirs."""
    new = results.select(*key, *[F.col(f).alias(f"__{f}") for f in fields])
    met = starts.join(new, key, "left")
    for f in fields:
        met = met.withColumn(f, F.coalesce(F.nullif(F.col(f"__{f}").cast("string"), F.lit("")), F.col(f).cast("string"))).drop(f"__{f}")
    return met
