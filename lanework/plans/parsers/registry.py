"""Parsers by version, and the table function that runs them on documents.

A document never fails the job: what went wrong is in its `error` column.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lanework.plans.parsers import lines, resultlist, startlist

Parser = Callable[[str], dict]
#: The start-list layout is known by a name of its own, which no text names: it is asked for as the preferred version.
PARSERS: dict[str, Parser] = {"11.83565": resultlist.parse, "startlist_11.83565": startlist.parse_lanes}
#: Parsers that have a form without labelled lines.
UNLABELLED: dict[Parser, Parser] = {resultlist.parse: resultlist.parse_unlabelled}
#: Versions that share another one's layout.
ALIASES = {"11.83082": "11.83565"}

SCHEMA = "doc string, kind string, row_no int, event_no string, event_name string, swimmer_name string, birth_year string, club string, time string, rank string, points string, status string, special_type string, rule string, note_time string, error string"
ENTRY_SCHEMA = "doc string, kind string, row_no int, event_no string, event_name string, heat_no string, lane string, swimmer_name string, birth_year string, club string, seed_time string, page int, error string"


def register(version: str, parser: Parser) -> None:
    PARSERS[version] = parser


def detected(text: str) -> str:
    found = lines.VERSION.search(text)
    if not found:
        raise ValueError("the text names no version")
    return found[1]


def parser_for(version: str) -> Parser:
    known = PARSERS.get(ALIASES.get(version, version))
    if known is None:
        raise LookupError(f"no parser for version {version}")
    return known


def parse_any(text: str, preferred: str | None = None, labels: bool = True) -> dict:
    """By the preferred version; if that fails, by the version that the text names; if both fail, the first failure."""

    def parsed(version: str) -> dict:
        parser = parser_for(version)
        return (parser if labels else UNLABELLED.get(parser, parser))(text)

    try:
        return parsed(preferred or detected(text))
    except Exception:
        if not preferred:
            raise
        try:
            return parsed(detected(text))
        except Exception:
            pass
        raise


def rows_of(payload: dict) -> list[tuple[str, dict]]:
    """Records, then special records, each with its kind."""
    return [("record", r) for r in payload["records"]] + [("special", r) for r in payload["special_records"]]


def entries_of(payload: dict) -> list[tuple[str, dict]]:
    return [("entry", r) for r in payload["entries"]]


def result_rows(docs: DataFrame, doc: str = "doc", text: str = "text", preferred: str | None = "11.83565") -> DataFrame:
    """Flat rows of all result lists; a document that can't be parsed is one row with its error."""

    return _rows(docs, doc, text, preferred, rows_of, SCHEMA)


def entry_rows(docs: DataFrame, doc: str = "doc", text: str = "text", preferred: str = "startlist_11.83565") -> DataFrame:
    """Flat rows of all start lists whose lanes have each field on a line of its own; errors as in `result_rows`."""
    return _rows(docs, doc, text, preferred, entries_of, ENTRY_SCHEMA)


def _rows(docs: DataFrame, doc: str, text: str, preferred: str | None, rows: Callable[[dict], list[tuple[str, dict]]], schema: str) -> DataFrame:
    kinds = [f.split() for f in schema.split(", ")]
    fields = [name for name, _ in kinds if name not in ("doc", "kind", "row_no", "error")]

    def run(batches):
        for batch in batches:
            docs_, tags, numbers, errors = [], [], [], []
            columns: dict[str, list] = {f: [] for f in fields}
            for name, value in zip(batch.column("doc").to_pylist(), batch.column("text").to_pylist(), strict=True):
                try:
                    got, wrong = rows(parse_any(value or "", preferred, labels=False)), None
                except Exception as e:
                    got, wrong = [("error", {})], f"{type(e).__name__}: {e}"
                docs_ += [name] * len(got)
                tags += [kind for kind, _ in got]
                numbers += [None] if wrong else range(len(got))
                errors += [wrong] * len(got)
                for f, column in columns.items():
                    column += [r.get(f) for _, r in got]
            held = {"doc": docs_, "kind": tags, "row_no": numbers, "error": errors, **columns}
            made = [pa.array([v if v is None or type(v) is str else str(v) for v in held[n]], pa.string()) if kind == "string" else pa.array(held[n], pa.int32()) for n, kind in kinds]
            yield pa.RecordBatch.from_arrays(made, [n for n, _ in kinds])

    return docs.select(F.col(doc).cast("string").alias("doc"), F.col(text).alias("text")).mapInArrow(run, schema)
