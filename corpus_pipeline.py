"""The corpus pipeline: documents in, token ids out.

Each stage calls one operator of lanework.llm on all that the stage before kept, and all but the last return the columns of
documents.  No SQL is given for the whole: a trained classifier and merge-exact tokens can't be said in SQL; tests hold
each stage to a plain version instead.

Defined results: a null text counts as empty; repeated rows are copies, of which one stays; an empty table gives an empty
table; null ids stay with their text; other columns pass through unchanged, except n_chars, which follows the text.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lanework.llm import bpe, decontaminate, neardup, quality, substring
from lanework.llm.store import ROW, removed, stored, unwrapped, wrapped

ORACLE_SQL = None


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects, as badly made or as abusive, go."""
    models = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return unwrapped(quality.score(wrapped(docs), models, keep=[ROW]).where("keep_document"), docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays; groups are components of links, so it can stand for one it is like by a chain only."""
    return neardup.one_of_each(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated passages are taken out of the texts; a document that was nothing else goes."""
    rows = substring.repeats(wrapped(docs, with_text=False)).where("n_words = 0 or n_removed < n_words")
    changed, new = F.col("n_removed") > 0, {"text": F.when(F.col("n_removed") > 0, F.col("kept")).otherwise(F.col("text"))}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(changed, F.char_length("kept").cast(docs.schema["n_chars"].dataType)).otherwise(F.col(f"`{ROW}`")["n_chars"])
    return unwrapped(rows, docs.columns, **new)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of the benchmark go."""
    rows = wrapped(docs)
    index = decontaminate.build_index(rows)
    found = decontaminate.find_exact(index, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return unwrapped(decontaminate.with_columns(index, found.where(F.size("spans") == 0), rows.schema, [ROW]), docs.columns)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids, as little-endian unsigned 32-bit integers, instead of the text."""
    rows = bpe.encode(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    return rows.drop("text")


STAGES = [
    ("quality classifier", quality_classifier),
    ("n-gram Jaccard join", near_duplicates),
    ("substring dedup", substring_dedup),
    ("benchmark decontamination", benchmark_decontamination),
    ("byte-level BPE", byte_bpe),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        docs, path = stored(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
        if before:
            removed(spark, before)  # what this stage read; its own table is whole
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
