"""Token counts: how many tokens a library gives for each whole text.

The library's own batch encoder runs inside Arrow functions that hand back lengths only; no ids reach Spark.  Texts are
encoded in batches of about equal bytes, so a batch of long texts holds no more than one of short texts.  A long text is
cut into pieces first, at safe boundaries only: before a single space between two non-space characters, where the
byte-level pattern always ends a match (no match runs from a non-space character into a space, and a special string
holds no space); so the pieces' counts add up to the text's.

Scale: one pass, no shuffle; a task holds one batch of BATCH_BYTES.  A text without any safe boundary (such as one endless
word) is encoded whole, as it must be.

Defined results: null and empty texts have 0 tokens; repeated rows each get their count; an empty table gives an empty
table; extra columns aren't read.
"""

from __future__ import annotations

import os
import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from lanework.llm.store import bounded_batches, giving_way

BATCH_BYTES = 256 << 10
PIECE_CHARS = 64 << 10
SAFE = re.compile(r"(?<=\S) (?=\S)")


@lru_cache(maxsize=4)
def library(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if path.endswith(".model"):
        import sentencepiece

        return sentencepiece.SentencePieceProcessor(model_file=path)
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(path)
    own.no_truncation()
    own.no_padding()
    return own


def cuttable(path: str) -> bool:
    """Pieces add up where spaces always begin a match: with this pre-tokenizer, and no normalizer that could join them."""
    if path.endswith(".model"):
        return False
    import json

    with open(path, encoding="utf-8") as f:
        said = json.load(f)
    before = said.get("pre_tokenizer") or {}
    return said.get("normalizer") is None and before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space") and not any(t["lstrip"] or t["rstrip"] or " " in t["content"] for t in said.get("added_tokens", []))


def pieces(text: str, most: int = PIECE_CHARS) -> list[str]:
    """The text in pieces of about `most` characters, cut at safe boundaries only."""
    if len(text) <= most:
        return [text]
    out, at = [], 0
    while len(text) - at > most:
        cut = SAFE.search(text, at + most)
        if not cut:
            break
        out.append(text[at : cut.start()])
        at = cut.start()
    return [*out, text[at:]]


def lengths(texts: list[str], path: str) -> list[int]:
    lib = library(path)
    if path.endswith(".model"):
        return [len(x) for x in lib.encode(texts, num_threads=1)]
    return [len(x) for x in lib.encode_batch_fast(texts, add_special_tokens=False)]


def counts(texts: list[str | None], path: str, batch_bytes: int = BATCH_BYTES, most: int = PIECE_CHARS) -> list[int]:
    split = cuttable(path)
    out = [0] * len(texts)
    held: list[str] = []
    owners: list[int] = []
    size = 0

    def flush() -> None:
        for i, n in zip(owners, lengths(held, path), strict=True):
            out[i] += n
        held.clear()
        owners.clear()

    for i, text in enumerate(texts):
        for piece in (pieces(text, most) if split else [text]) if text else []:
            n = len(piece) if piece.isascii() else len(piece.encode("utf-8", "surrogatepass"))
            if held and size + n > batch_bytes:
                flush()
                size = 0
            held.append(piece)
            owners.append(i)
            size += n
    if held:
        flush()
    return out


def token_count(path: str):
    """A column function of texts."""

    @arrow_udf("long")
    def n_tokens(texts: pa.Array) -> pa.Array:
        return pa.array(counts(texts.to_pylist(), path), pa.int64())

    return n_tokens


def count_tokens(df: DataFrame, path: str, text: str = "text", limit: int = 512, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep columns, n_bytes, n_tokens, over_limit; a column to keep that has the name of one of these gives way to it."""
    keep = tuple(giving_way(list(keep), ["n_bytes", "n_tokens", "over_limit"]))
    bounded_batches(df.sparkSession)
    whole = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    rows = df.select(*[F.col(f"`{c}`") for c in keep], F.octet_length(whole).cast("long").alias("n_bytes"), token_count(path)(whole).alias("n_tokens"))
    return rows.withColumn("over_limit", F.col("n_tokens") > limit)
