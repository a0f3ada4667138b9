import io
import json
from email.message import Message

import pytest

from lanework.plans.meet_store import IngestError, MeetStore, call
from lanework.sources import web


@pytest.fixture
def store(spark, tmp_path):
    own = MeetStore(spark, str(tmp_path / "store"))
    own.ingest_events([{"title": "Winter Meet", "date": "13. - 14.12.2025", "location": "ANKARA", "unique_name": "CS-1"}, {"event_title": "Spring", "event_date": "1.3.2026"}])
    return own


FULL = {"event_unique_name": "cs-1", "name": "Ada LANE", "year_of_birth": "09", "club": "Deniz", "swimming_style": "Serbest", "distance": "4x50m", "seri_no": 2, "lane": 3, "seed": "30.00", "gender": "Kadınlar", "event_order": 5}


def one(store, **where):
    rows = store.results
    for k, v in where.items():
        rows = rows.where(rows[k] == v)
    return [r.asDict() for r in rows.orderBy("id").collect()]


def test_events_by_aliases_are_one(store):
    said = store.ingest_events([{"event_title_folder": "Winter Meet", "event_date": "13. - 14.12.2025", "event_location": "ANKARA"}, {"title": " Winter Meet ", "date": "13. - 14.12.2025", "location": "ANKARA"}, {}])
    assert said == {"rows_seen": 3, "events_seen": 2, "event_created": 1, "event_updated": 1}
    names = {r["title"]: r["unique_name"] for r in store.events.collect()}
    assert names["Winter Meet"] == "cs-1" and names["Spring"].startswith("parsed-spring-") and names["Unknown Event"].startswith("parsed-unknown-event-")


def test_dry_run_writes_nothing(store):
    assert store.ingest_events([{"title": "x"}], dry_run=True)["events_seen"] == 1 and store.events.count() == 2
    assert store.ingest_results([FULL], dry_run=True)["rows_seen"] == 1 and store.results.count() == 0


def test_keys_and_natural_upsert(store):
    said = store.ingest_results([FULL, {**FULL, "name": "Can POOL"}, {**FULL, "name": " "}])
    assert said == {"events_seen": 1, "rows_seen": 2, "rows_with_result": 0, "event_created": 0, "event_updated": 1, "result_created": 2, "result_updated": 0}
    assert [r["startlist_unique_name"] for r in one(store)] == ["cs-1-000001", "cs-1-000002"]
    first = one(store)[0]
    assert (first["distance"], first["year_of_birth"], first["rank"]) == (200, 9, 0)
    assert store.ingest_results([{**FULL, "time": "29.00", "rank": 1}])["result_updated"] == 1
    assert one(store)[0]["result"] == "29.00"
    store.ingest_results([FULL])  # by its natural key, a blank erases
    assert (one(store)[0]["result"], one(store)[0]["rank"]) == ("", 0)
    assert store.ingest_results([{**FULL, "name": "Eda REEF"}])["result_created"] == 1
    assert one(store)[2]["startlist_unique_name"] == "cs-1-000003" and len({r["id"] for r in one(store)}) == 3


def test_partial_patch_keeps_other_fields(store):
    store.ingest_results([FULL])
    before = one(store)[0]
    said = store.ingest_results([{"event_unique_name": "cs-1", "startlist_key": "cs-1-000001", "name": "Ada LANE", "result": "28.45", "rank": "2"}])
    after = one(store)[0]
    assert said["result_updated"] == 1 and after == before | {"result": "28.45", "rank": 2}
    store.ingest_results([{"event_unique_name": "cs-1", "startlist_key": "cs-1-000001", "name": "Ada LANE", "result": None}])
    assert one(store)[0]["result"] == ""  # there, with null


def test_errors_abort_the_batch(store):
    for bad, why in (({"name": "x"}, "must include"), ({"name": "x", "event_id": 99}, "event_id=99"), ({"name": "x", "event_unique_name": "no"}, "=no")):
        with pytest.raises(IngestError, match=why):
            store.ingest_results([FULL, bad])
    with pytest.raises(IngestError, match="minimal update"):
        store.ingest_results([FULL, {"event_unique_name": "cs-1", "startlist_key": "k", "name": "x", "result": "1"}])
    assert store.results.count() == 0


def test_later_rows_see_earlier_ones(store):
    said = store.ingest_results([FULL, {**FULL, "result": "1"}, {"event_id": 1, "startlist_uid": "cs-1-000001", "name": "Ada LANE", "rank": 3}, {**FULL, "startlist_uid": "own", "lane": 9}, {**FULL, "lane": 9, "result": "2"}])
    assert (said["result_created"], said["result_updated"]) == (2, 3)
    assert [(r["startlist_unique_name"], r["result"], r["rank"]) for r in one(store)] == [("cs-1-000001", "1", 3), ("own", "2", 0)]


def test_a_key_is_found_in_any_meet_and_moves(store):
    store.ingest_results([FULL])
    other = store.events.where("title = 'Spring'").first()["id"]
    store.ingest_results([{"event_id": other, "startlist_uid": "cs-1-000001", "name": "Ada LANE"}, {**FULL, "name": "Can POOL"}])
    assert [(r["event_id"] == other, r["swimmer_name"]) for r in one(store)] == [(True, "Ada LANE"), (False, "Can POOL")]


def test_reads(store):
    store.ingest_results([FULL, {**FULL, "name": "Can POOL", "result": "29.00", "rank": 1, "club": ""}])
    event = store.events.where("unique_name = 'cs-1'").first()["id"]
    assert store.home()[:2] == (2, 2) and [r["title"] for r in store.event_list().collect()] == ["Winter Meet", "Spring"]
    groups, totals = store.event_detail(event)
    assert tuple(groups.first())[4:] == (2, 1, 2) and tuple(totals.first()) == (1, 2, 1)
    assert [r["rank"] for r in store.selected_results(event, "Serbest", "Kadınlar", "200").collect()] == [0, 1]
    assert store.selected_results(event, "Serbest", "", "200") is None and store.selected_results(event, "a", "b", "x") is None
    names, rows = store.swimmer_results(str(event), "Ada LANE")
    assert [r[0] for r in names.collect()] == ["Ada LANE", "Can POOL"] and rows.count() == 1 and store.swimmer_results("x")[1].count() == 2
    assert [r[0] for r in store.clubs().collect()] == ["Deniz"] and store.club("Deniz")[:2] == (1, 1) and store.club("Deniz")[2].count() == 1


PAGE = "<div id='header'><table><td>Cup</td><td></td><td>Izmir</td><td>1.1.2026</td></table></div><a href='StartList_1.pdf'>Start list</a><a href='/x.pdf'>x</a><a href='StartList_1.pdf'>again start list</a>"


def test_create_event(store):
    row, created = store.create_event("https://h/meets/CS-12/", PAGE)
    assert created and (row["unique_name"], row["title"], row["location"], row["date"]) == ("CS-12", "Cup", "Izmir", "1.1.2026")
    assert store.create_event("https://h/meets/CS-12", "")[1] is False and store.events.count() == 3
    for url, page in (("https://h/meets/", PAGE), ("https://h/CS-13", "<p>")):
        with pytest.raises(IngestError):
            store.create_event(url, page)


def test_calls(store):
    path = "/api/ingest-results/"
    assert call(store, path, "GET", "")[0] == 405 and call(store, path, "POST", "[]", "a", "b")[0] == 403 and call(store, path, "POST", "{")[0] == 400
    status, said = call(store, path, "POST", "﻿" + json.dumps({"rows": [FULL]}), "t", "t")
    assert status == 200 and said["summary"]["result_created"] == 1
    csv = "event_unique_name,name,year_of_birth,club,swimming_style,distance,seri_no,lane\ncs-1,Ada LANE,09,Deniz,Serbest,4x50m,2,3\n"
    assert call(store, path, "POST", csv)[1]["summary"]["result_updated"] == 1
    assert call(store, path, "POST", json.dumps([{"name": "x"}])) == (400, {"error": "Each result row must include event_id or event_unique_name"})
    assert call(store, "/api/ingest-events/", "POST", '[{"title": "n"}]', dry_run=True)[1]["dry_run"] is True


def test_scrape(tmp_path):
    class Got(io.BytesIO):
        def __init__(self, data, kind):
            super().__init__(data)
            self.headers = Message()
            self.headers["Content-Type"] = kind

    asked = []

    def opener(request, timeout):
        asked.append(request.full_url)
        return Got(b"%PDF", "application/pdf") if ".pdf" in request.full_url else Got(PAGE.encode(), "text/html; charset=utf-8")

    got = web.scrape_start_lists("http://h/m/", tmp_path, opener=opener)
    assert [g["pdf_url"] for g in got] == ["http://h/m/StartList_1.pdf"] and (tmp_path / "untitled/startlists/StartList_1.pdf").read_bytes() == b"%PDF"
    assert len(web.scrape_results("http://h/m/", tmp_path, title="A:B", opener=opener)) == 2 and len(asked) == 5
    with pytest.raises(ValueError):
        web.fetch_html("http://h/x.pdf", opener=opener)
