"""The two tables of meets and results: reads, ingestion with upserts, and the calls of an ingest API.

Tables are Parquet; an ingestion makes the next version of a table and swaps it in, so it takes effect as a whole or not at
all.  A single writer is assumed.

Results of a batch are folded in order, meet by meet: a later row sees what an earlier one did.  A row with a start-list key
patches just the fields that it has, wherever the key's result is; one without overwrites a result of its natural key, blanks
too, or makes a new one under the meet's next key.  The rows of one meet, with the results there are, meet in one cogroup;
meets are independent tasks.  Rows of one start-list key, and its result, go to the meet of the key's first row.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lanework.functions import numbers, text
from lanework.operators import reads, upsert
from lanework.sources import files, html, sinks

EVENTS = "id long, unique_name string, title string, date string, location string"
RESULTS = (
    "id long, event_id long, startlist_unique_name string, event_order int, swimmer_name string, year_of_birth int, gender string, "
    "club string, swimming_style string, distance int, seri_no int, lane int, seed string, result string, rank int"
)
NATURAL = ["swimmer_name", "year_of_birth", "club", "swimming_style", "distance", "seri_no", "lane"]
OVERWRITTEN = ["event_order", "gender", "seed", "result", "rank"]
#: Which keys of a row, being there, stand for a field; and which of them make more than a minimal row.
SOURCES = {f: (f,) for f in [*NATURAL, *OVERWRITTEN]} | {"swimmer_name": ("swimmer_name", "name"), "result": ("result", "time")}
MORE_THAN_MINIMAL = ["year_of_birth", "gender", "swimming_style", "distance", "seri_no", "lane", "seed", "event_order"]
ROW = "map<string,string>"


class IngestError(ValueError):
    pass


def as_text(value: Any) -> str | None:
    """How a JSON value counts: what is false is nothing."""
    return None if value is None else "" if value is False or value == 0 and not isinstance(value, str) else str(value)


class MeetStore:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    # tables

    def _table(self, name: str, schema: str) -> DataFrame:
        try:
            return self.spark.read.schema(schema).parquet(f"{self.root}/{name}")
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], schema)

    @property
    def events(self) -> DataFrame:
        return self._table("events", EVENTS)

    @property
    def results(self) -> DataFrame:
        return self._table("results", RESULTS)

    def rows(self, rows: list[dict[str, Any]]) -> DataFrame:
        """(ord, row): rows of a request, numbered; a key whose value is null is there."""
        for i, row in enumerate(rows, 1):
            if not isinstance(row, dict):
                raise IngestError(f"row {i} must be an object")
        data = [(i, {str(k): as_text(v) for k, v in row.items()}) for i, row in enumerate(rows, 1)]
        return self.spark.createDataFrame(data, f"ord long, row {ROW}")

    # reads

    def home(self) -> tuple[int, int, DataFrame]:
        return self.events.count(), self.results.count(), reads.latest(self.events, [F.desc("date"), F.asc("title"), F.asc("id")], 5)

    def event_list(self) -> DataFrame:
        return self.events.orderBy(F.desc("date"), "title", "id")

    def event_detail(self, event_id: int) -> tuple[DataFrame, DataFrame]:
        """Groups, and one row of totals over them."""
        groups = reads.category_summary(self.results.where(F.col("event_id") == event_id), ["event_order", "swimming_style", "gender", "distance"], reads.present("result"), "seri_no")
        return groups.orderBy("event_order", "gender", "distance", "swimming_style"), reads.totals(groups, ["result_count", "non_empty_result_count"])

    def selected_results(self, event_id: int, style: str | None, gender: str | None, distance: str | None) -> DataFrame | None:
        """None if a choice is missing or the distance is no number."""
        style, gender, distance = ((x or "").strip() for x in (style, gender, distance))
        try:
            metres = int(distance)
        except ValueError:
            return None
        if not style or not gender:
            return None
        return reads.equal_to(self.results, event_id=event_id, swimming_style=style, gender=gender, distance=metres).orderBy("rank", "seri_no", "lane", "swimmer_name")

    def swimmer_results(self, event_id: str | None = None, swimmer: str | None = None) -> tuple[DataFrame, DataFrame]:
        """Names to choose from, and the chosen results with their meets."""
        of_event = reads.optionally(self.results, event_id=event_id)
        events = self.events.select(F.col("id").alias("event_id"), F.col("title").alias("event_title"), F.col("date").alias("event_date"))
        chosen = reads.optionally(of_event, swimmer_name=swimmer).join(events, "event_id")
        return reads.distinct_sorted(of_event, "swimmer_name"), chosen.orderBy("swimmer_name", "swimming_style", "distance", "seri_no", "lane")

    def clubs(self) -> DataFrame:
        return reads.distinct_sorted(self.results, "club")

    def club(self, name: str) -> tuple[int, int, DataFrame]:
        """How many results, how many meets, the latest 50 rows."""
        own = self.results.where(F.col("club") == name)
        events = self.events.select(F.col("id").alias("event_id"), F.col("title").alias("event_title"), F.col("date").alias("event_date"))
        order = [F.desc("event_date"), *map(F.asc, ("event_title", "swimmer_name", "swimming_style", "distance", "id"))]
        return own.count(), reads.parents_of(self.events, own, "id", "event_id").count(), reads.latest(own.join(events, "event_id"), order, 50)

    # meets

    def create_event(self, url: str, page: str) -> tuple[dict[str, Any], bool]:
        """Get or create by the name in the url; an existing meet isn't changed."""
        name = self.spark.range(1).select(text.name_from_url(F.lit(url))).first()[0]
        if not name:
            raise IngestError("the url names no meet")
        found = self.events.where(F.col("unique_name") == name).first()
        if found:
            return found.asDict(), False
        got = self.spark.range(1).select(html.header_fields(F.lit(page)).alias("h")).select("h.*").first()
        if not got["title"]:
            raise IngestError("the page has no header of a meet")
        row = {"id": self._next_id(self.events), "unique_name": name, **{k: got[k] for k in ("title", "date", "location")}}
        sinks.swap(self.spark, self.events.unionByName(self.spark.createDataFrame([row], EVENTS)), f"{self.root}/events")
        return row, True

    def _next_id(self, table: DataFrame) -> int:
        return (table.agg(F.max("id")).first()[0] or 0) + 1

    def ingest_events(self, rows: list[dict[str, Any]], dry_run: bool = False) -> dict[str, int]:
        """Get or create by title, date and place; the first row of each gives the wished name."""
        r = F.col("row")
        keys = ["title", "date", "location"]
        title = F.coalesce(F.nullif(text.first_filled(r["event_title_folder"], r["event_title"], r["title"]), F.lit("")), F.lit("Unknown Event"))
        named = self.rows(rows).select("ord", title.alias("title"), text.first_filled(r["event_date"], r["date"]).alias("date"), text.first_filled(r["event_location"], r["location"]).alias("location"), text.text_of(r["unique_name"]).alias("wish"))
        wanted = named.groupBy(*keys).agg(F.min_by("wish", "ord").alias("wish"), F.min("ord").alias("ord"))
        old = self.events
        new = sinks.created(old, wanted, keys)
        seen = wanted.count()
        said = {"rows_seen": len(rows), "events_seen": seen, "event_created": 0, "event_updated": 0}
        if dry_run:
            return said
        base = F.coalesce(F.nullif(text.unique_name(F.col("wish")), F.lit("")), text.default_unique_name(F.col("title"), F.col("date"), F.col("location")))
        made = upsert.allocated_names(new.withColumn("base", base), old, "base", "ord", "unique_name")
        rows_new = made.select((F.col("ord") + self._next_id(old) - 1).alias("id"), "unique_name", *keys)
        created = rows_new.count()
        if created:
            sinks.swap(self.spark, old.unionByName(rows_new), f"{self.root}/events")
        return said | {"event_created": created, "event_updated": seen - created}

    # results

    def _normal(self, rows: DataFrame) -> DataFrame:
        """Rows with their fields, has_{field} and event_id; the first row whose meet isn't there fails the whole batch."""
        r = F.col("row")
        number = lambda k: numbers.parse_int(r[k])
        said = rows.select(
            "ord", text.text_of(r["event_id"]).alias("id_text"), text.first_filled(r["event_unique_name"], r["unique_name"]).alias("event_name"),
            text.first_filled(r["startlist_unique_name"], r["startlist_key"], r["startlist_uid"]).alias("startlist_unique_name"),
            text.first_filled(r["name"], r["swimmer_name"]).alias("swimmer_name"), text.first_filled(r["result"], r["time"]).alias("result"),
            *[number(k).alias(k) for k in ("event_order", "year_of_birth", "seri_no", "lane", "rank")],
            *[text.text_of(r[k]).alias(k) for k in ("gender", "club", "swimming_style", "seed")], numbers.parse_distance(r["distance"]).alias("distance"),
            *[files.has_key(r, *k).alias(f"has_{f}") for f, k in SOURCES.items()],
        )
        events = self.events
        by_id = said.join(events.select(F.col("id").alias("i")), F.col("id_text").try_cast("long") == F.col("i"), "left")
        by_name = events.groupBy(F.col("unique_name").alias("u")).agg(F.min("id").alias("n"))
        met = by_id.join(by_name, F.col("event_name") == F.col("u"), "left")
        event = F.when(F.col("id_text") != "", F.col("i")).when(F.col("event_name") != "", F.col("n"))
        return met.withColumn("event_id", event).drop("i", "u", "n")

    def ingest_results(self, rows: list[dict[str, Any]], dry_run: bool = False) -> dict[str, int]:
        normal = self._normal(self.rows(rows))
        lost = normal.where("event_id is null").orderBy("ord").first()
        if lost:
            why = f"Event not found for event_id={lost['id_text']}" if lost["id_text"] else f"Event not found for event_unique_name={lost['event_name']}" if lost["event_name"] else "Each result row must include event_id or event_unique_name"
            raise IngestError(why)
        named = normal.where("swimmer_name <> ''")
        seen = named.agg(F.count(F.lit(1)).alias("r"), F.count_if(F.col("result") != "").alias("w")).first()
        events_seen = normal.select("event_id").distinct().count()
        said = {"events_seen": events_seen, "rows_seen": seen["r"], "rows_with_result": seen["w"], "event_created": 0, "event_updated": 0, "result_created": 0, "result_updated": 0}
        if dry_run:
            return said
        old = self.results
        after = self._folded(old, named).cache()
        try:
            failed = after.where("error is not null").orderBy("ord").first()
            if failed:
                raise IngestError(failed["error"])
            counts = after.agg(F.coalesce(F.sum("created"), F.lit(0)).alias("c"), F.coalesce(F.sum("updated"), F.lit(0)).alias("u")).first()
            touched = after.select("home").distinct()
            moved = after.where("id is not null").select("id")
            kept = old.join(moved, "id", "left_anti").join(touched.withColumnRenamed("home", "event_id"), "event_id", "left_anti")
            columns = old.columns
            sinks.swap(self.spark, kept.select(*columns).unionByName(after.where("id is not null").select(*columns)), f"{self.root}/results")
        finally:
            after.unpersist()
        return said | {"event_updated": events_seen, "result_created": counts["c"], "result_updated": counts["u"]}

    def _folded(self, old: DataFrame, rows: DataFrame) -> DataFrame:
        first = rows.where("startlist_unique_name <> ''").groupBy("startlist_unique_name").agg(F.min_by("event_id", "ord").alias("home"))
        homed = rows.join(first, "startlist_unique_name", "left").withColumn("home", F.coalesce("home", "event_id"))
        touched = homed.select("home").distinct()
        names = self.events.select(F.col("id").alias("event_id"), F.col("unique_name").alias("event_unique_name"))
        homed = homed.join(names, "event_id")
        held = old.join(first, "startlist_unique_name", "left").withColumn("home", F.coalesce("home", "event_id")).join(touched, "home", "left_semi")
        last = self._next_id(old) - 1
        schema = f"{RESULTS}, home long, ord long, created int, updated int, error string"
        return held.groupBy("home").cogroup(homed.groupBy("home")).applyInPandas(_fold(last), schema)


def _fold(last_id: int) -> Callable:
    def run(key: tuple, old: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        table = [{k: (None if pd.isna(v) else v) for k, v in r.items()} for r in old.sort_values("id").drop(columns="home").to_dict("records")]
        by_key = {r["startlist_unique_name"]: r for r in table if r["startlist_unique_name"]}
        natural = lambda r: (int(r["event_id"]), *[r[f] for f in NATURAL])
        numbers_of: dict[int, int] = {}
        created = updated = 0

        def next_key(event: int, name: str) -> str:
            if event not in numbers_of:
                tails = [k.removeprefix(f"{name}-") for k in by_key if k.startswith(f"{name}-") and int(by_key[k]["event_id"]) == event]
                numbers_of[event] = max((int(t) for t in tails if t.isdigit()), default=0)
            while True:
                numbers_of[event] += 1
                made = f"{name}-{numbers_of[event]:06d}"
                if made not in by_key:
                    return made

        for row in rows.sort_values("ord").to_dict("records"):
            start = row["startlist_unique_name"]
            fields = {f: row[f] for f in [*NATURAL, *OVERWRITTEN]}
            found = by_key.get(start) if start else next((r for r in table if natural(r) == natural(row)), None)
            if found is None:
                if start and not any(row[f"has_{f}"] for f in MORE_THAN_MINIMAL):
                    why = f"startlist_unique_name not found for minimal update: {start}"
                    return pd.DataFrame([dict.fromkeys(_COLUMNS) | {"home": key[0], "ord": row["ord"], "error": why}], dtype=object)
                found = {"id": last_id + row["ord"], "event_id": row["event_id"], "startlist_unique_name": start or next_key(row["event_id"], row["event_unique_name"]), **fields}
                table.append(found)
                created += 1
            else:
                if start:
                    found["event_id"] = row["event_id"]
                    found.update({f: v for f, v in fields.items() if row[f"has_{f}"]})
                else:
                    found.update({f: row[f] for f in OVERWRITTEN})
                    found["startlist_unique_name"] = found["startlist_unique_name"] or next_key(row["event_id"], row["event_unique_name"])
                updated += 1
            by_key[found["startlist_unique_name"]] = found
        out = pd.DataFrame(table, columns=[c for c in _COLUMNS if c not in ("home", "ord", "created", "updated", "error")])
        out["home"], out["ord"], out["error"] = key[0], None, None
        out["created"], out["updated"] = [created, *[0] * (len(out) - 1)][: len(out)], [updated, *[0] * (len(out) - 1)][: len(out)]
        return out[_COLUMNS]

    return run


_COLUMNS = [c.split()[0] for c in f"{RESULTS}, home long, ord long, created int, updated int, error string".split(", ")]


def rows_in(body: str, name: str = "", content_type: str = "") -> list[dict[str, Any]]:
    """Rows of a request's body: JSON, a list or {"rows": list}, or CSV with a header."""
    import csv
    import io

    body = body.removeprefix("﻿")
    if name.lower().endswith(".json") or "json" in content_type.lower() or body.lstrip()[:1] in ("[", "{"):
        said = json.loads(body)
        said = said.get("rows") if isinstance(said, dict) else said
        if not isinstance(said, list):
            raise IngestError("expected a list of rows")
        return said
    return list(csv.DictReader(io.StringIO(body)))


def call(store: MeetStore, path: str, method: str, body: str, token: str | None = None, expected: str | None = None, dry_run: bool = False, content_type: str = "") -> tuple[int, dict[str, Any]]:
    """(status, answer) of /api/ingest-events/ and /api/ingest-results/."""
    action = {"/api/ingest-events/": store.ingest_events, "/api/ingest-results/": store.ingest_results}.get(path)
    if action is None:
        return 404, {"error": "no such path"}
    if method != "POST":
        return 405, {"error": "POST only"}
    if expected and token != expected:
        return 403, {"error": "wrong token"}
    try:
        return 200, {"ok": True, "dry_run": dry_run, "summary": action(rows_in(body, content_type=content_type), dry_run)}
    except Exception as e:
        return 400, {"error": str(e)}
