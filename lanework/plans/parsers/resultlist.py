"""Result lists: text to ranked records, special records (disqualified, timed out of competition) and labelled lines.

The format is order-sensitive, with look-behind, so one document is one fold; documents are independent.
"""

from __future__ import annotations

from lanework.plans.parsers import lines as L

HEADS = {"rank_head": "header_rank", "year_head": "header_year", "time_head": "header_time_points", "registered": "footer_registered", "foot": "footer_page"}


class Fields:
    """What is known of one swimmer while lines come in."""

    def __init__(self, name: str | None = None, year: str | None = None):
        self.name, self.year, self.time, self.points = name, year, None, None
        self.club: list[str] = []
        self.splits: list[str] = []

    def any(self) -> bool:
        return bool(self.name or self.time or self.club or self.splits)

    def row(self) -> dict:
        return {"swimmer_name": L.swimmer_name(self.name), "birth_year": self.year, "club": L.result_club(" ".join(self.club)), "split_times": self.splits, "points": self.points}


class ResultList:
    def __init__(self, text: str):
        self.doc = L.Document(text)
        self.at = 1
        self.event: dict | None = None
        self.events: list[dict] = []
        self.records: list[dict] = []
        self.specials: list[dict] = []

    # cursor

    def more(self) -> bool:
        """On to the next line that isn't blank, if there is one."""
        looks, n = self.doc.looks, self.doc.n
        while self.at <= n and not looks[self.at].text:
            self.at += 1
        return self.at <= n

    def take(self, label: str) -> str:
        line = self.doc.looks[self.at].text
        self.doc.labels[self.at] = label
        self.at += 1
        return line

    def of_event(self) -> dict:
        return {"event_no": self.event["event_no"] if self.event else None, "event_name": self.event["event_name"] if self.event else None}

    # whole document

    def parse(self, labels: bool = True) -> dict:
        """labels: with the labelled lines and their counts."""
        while self.more():
            line = self.doc[self.at]
            if label := self.doc.fixed_label(self.at, HEADS):
                self.take(label)
            elif (kind := self.doc.looks[self.at].kind) == "disk":
                self.disqualified()
            elif kind == "td":
                self.out_of_competition()
            elif kind == "event":
                m = L.EVENT_LINE.match(line)
                parts = [p.strip() for p in m[2].split(";") if p.strip()]
                self.begin_event(m[1], "; ".join(parts[:2]) or None, parts[2] if len(parts) > 2 else None)
                self.take("event_header")
            elif kind == "event_number":
                self.event_in_lines(L.EVENT_NUMBER.match(line)[1])
            elif not self.record():
                self.at += 1
        got = {"metadata": self.doc.metadata, "events": self.events, "records": self.records, "special_records": self.specials}
        if not labels:
            return got
        notes = self.doc.annotations()
        return {**got, "line_annotations": notes, "line_count": len(notes), "structured_count": sum(n["structured"] for n in notes), "unmatched_count": sum(not n["structured"] for n in notes)}

    # events

    def begin_event(self, number: str, details: str | None, phase: str | None) -> None:
        self.event = {"event_no": number, "event_name": L.event_name(number, details, phase), "page": self.doc.pages[self.at - 1], **L.event_parts(details, phase)}
        self.events.append(self.event)

    def event_in_lines(self, number: str) -> None:
        """The number, then a line of parts, then a phase; the last two optional, and next to each other."""
        first = self.at
        details = self.doc[first + 1]
        details = details if details and (";" in details or "," in details) else None
        phase = self.doc[first + (2 if details else 1)]
        phase = phase if phase and phase.lower() in L.PHASES else None
        self.begin_event(number, details, phase)
        self.take("event_header")
        # labels go by position: a phase without details stands where details would
        for label in ("event_header_detail", "event_header_level")[: bool(details) + bool(phase)]:
            self.take(label)

    # special records

    def in_special(self) -> bool:
        """A special block ends at headings, events, footers and markers."""
        return self.more() and not self.doc.look(self.at).kind

    def special(self, kind: str, fields: Fields, start: int, end: int, marker: str, page: int | None, **more) -> dict:
        base = {"status": None, "rule": None, "note_time": None, "notes": [], **more}
        return {**self.of_event(), "page": page, "special_type": kind, **fields.row(), "time": fields.time, **base, "marker_text": marker, "line_start": start, "line_end": end}

    def disqualified(self) -> None:
        start, marker = self.at, self.take("special_marker")
        page = self.doc.pages[start - 1]
        f, notes, rule, status, note_time = Fields(), [], None, "DQ", None
        while self.in_special():
            own = self.doc.looks[self.at]
            line = own.text
            if f.name is None and not own.year:
                f.name = L.swimmer_name(self.take("special_swimmer_name"))
                self.name_goes_on(f, "special_swimmer_name_continuation")
            elif f.year is None and own.year:
                f.year = self.take("special_birth_year")
            elif rule is None and own.rule:
                rule = self.take("special_rule")
            elif own.note_time is not None:
                note_time = own.note_time
                notes.append(self.take("special_note_time"))
            elif own.status_mark:
                status = self.take("special_status").upper()
            elif f.time is None and L.around_time(line)[0]:
                f.time, left, right = L.around_time(self.take("special_time_line"))
                f.club += [x for x in (left, "" if L.look(right).points else right) if x]
                if self.at <= len(self.doc) and self.doc.look(self.at).points:
                    f.points = self.take("special_points_line")
            elif f.points is None and f.time is not None and own.points:
                f.points = self.take("special_points_line")
            else:
                said = self.take("special_note_or_club")
                notes.append(said)
                f.club.append(said)
        self.specials.append(self.special("disk", f, start, self.at - 1, marker, page, status=status, rule=rule, note_time=note_time, notes=notes))

    def out_of_competition(self) -> None:
        page, marker = self.doc.pages[self.at - 1], self.take("special_marker")
        entries: list[list[tuple[int, L.Line]]] = []
        timed = False
        while self.in_special():
            i, line = self.at, self.doc.looks[self.at]
            self.take("special_td_line")
            if not entries or (timed and line.opens_td):
                entries.append([])
                timed = False
            entries[-1].append((i, line))
            timed = timed or line.timed
        for entry in entries:
            self.specials.append(self.entry(entry, marker, page))

    def entry(self, entry: list[tuple[int, L.Line]], marker: str, page: int | None) -> dict:
        f, notes = Fields(), []
        for _, line in entry:
            said = line.said_td
            own = L.look(said)
            if not said:
                notes.append(line.text)
            elif f.name is None and own.year:
                f.year = said
            elif f.name is None and own.named and not own.timed:
                f.name, f.year = L.swimmer_name(own.named[0]), own.named[1]
            elif f.name is None:
                f.name = L.swimmer_name(said)
            elif f.year is None and own.year:
                f.year = said
            elif own.pure:
                f.splits.append(L.clock(said))
            elif f.time is None and (total := L.total_of(said, True))[0]:
                f.time, points, rest = total
                f.points = f.points or points
                f.club += [rest] if rest else []
            elif f.points is None and own.points:
                f.points = said
            else:
                f.club.append(said)
                notes.append(line.text)
        f.time = L.clock(f.time) if f.time else None
        return self.special("td", f, entry[0][0], entry[-1][0], marker, page, notes=notes)

    def name_goes_on(self, f: Fields, label: str) -> None:
        while self.at <= len(self.doc) and self.doc[self.at] and self.doc.look(self.at).more_name:
            f.name = L.swimmer_name(f"{f.name} {self.take(label)}")

    # ranked records

    def record(self) -> bool:
        """A record that begins or, by its rank, ends at this line; False if the line is neither."""
        first = self.at
        if ahead := self.name_first():
            year, rank_at, rank = ahead
            for i, label in ((first, "swimmer_name"), (year, "birth_year"), (rank_at, "rank_line")):
                self.doc.label(i, label)
            self.at = rank_at + 1
            self.body(rank, Fields(L.swimmer_name(self.doc[first]), self.doc[year]), first)
            return True
        rank, name = self.doc.rank(first), None
        if rank is None:
            rank, name = self.doc.look(first).ranked or (None, None)
        if rank is None:
            return False
        if not self.rank_last(rank):
            self.take("rank_line")
            self.body(rank, Fields(L.swimmer_name(name)), first)
        return True

    def name_first(self) -> tuple[int, int, int] | None:
        """Name, year, rank in three lines: (line of the year, of the rank, the rank)."""
        if not self.doc.look(self.at).swimmer:
            return None
        year = self.doc.after[self.at]
        rank_at = self.doc.after[year] if year and self.doc.look(year).year else None
        rank = self.doc.rank(rank_at) if rank_at else None
        return (year, rank_at, rank) if rank is not None else None

    def rank_last(self, rank: int) -> bool:
        """Name, year, [club], time, rank, points: seen from the rank, behind a line with a time and before points."""
        doc, at = self.doc, self.at
        points, timed = doc.after[at], doc.before[at]
        if not points or not timed or not doc.look(points).points or not doc.look(timed).timed:
            return False
        for club in (None, doc.before[timed]):
            year = doc.before[club or timed]
            name = doc.before[year] if year else None
            if name and doc.look(year).year and doc.look(name).swimmer:
                break
        else:
            return False
        time, _, rest = L.total_of(doc[timed], (L.metres(self.event) or 0) >= 100)
        if not time:
            return False
        f = Fields(L.swimmer_name(doc[name]), doc[year])
        f.club, f.points = [x for x in (doc[club], rest) if x], doc[points]
        for i, label in ((name, "swimmer_name"), (year, "birth_year"), (club, "club_line"), (timed, "time_line"), (at, "rank_line"), (points, "points_line")):
            if i:
                doc.label(i, label)
        self.add(rank, f, L.clock(time), name, points)
        self.at = points + 1
        return True

    def add(self, rank: int, f: Fields, time: str | None, start: int, end: int) -> None:
        self.records.append({**self.of_event(), "page": self.doc.pages[start - 1], "rank": rank, **f.row(), "time": time, "line_start": start, "line_end": end})

    def ends_body(self, f: Fields) -> bool:
        own = self.doc.looks[self.at]
        if own.kind in L.ENDS:
            return True
        if own.numbers and f.any() and (own.ranked or self.doc.rank(self.at) is not None):
            return True
        if (f.time is None and f.points is None and not f.splits) or not own.swimmer:
            return False
        return self.doc.look(self.doc.after[self.at]).year

    def body(self, rank: int, f: Fields, start: int) -> None:
        """Lines after the rank, up to what begins something else."""
        distance = L.metres(self.event) or 0
        expected, long = (distance // 50, True) if distance >= 100 else (0, False)
        while self.more() and not self.ends_body(f):
            own = self.doc.looks[self.at]
            open_splits = len(f.splits) < expected
            if f.name is None and not own.year:
                f.name = L.swimmer_name(self.take("swimmer_name"))
                self.name_goes_on(f, "swimmer_name_continuation")
            elif f.year is None and own.year:
                f.year = self.take("birth_year")
            elif open_splits and own.pure and self.is_total(f):
                f.time = L.clock(self.take("time_line"))
                self.more()
                self.points(f)
            elif open_splits and ((own.pure and (f.time is not None or not self.next_begins())) or own.glued):
                f.splits.append(L.clock(self.take("split_time_line")))
            elif f.time is None and (total := L.total_of(own.text, long))[0]:
                self.take("time_line")
                f.time, points, rest = total
                f.club += [rest] if rest else []
                f.points = f.points or points
                self.points(f)
            elif f.points is None and (f.time is not None or f.splits) and own.points:
                f.points = self.take("points_line")
            elif own.status:
                self.take("status_note")
            else:
                f.club.append(self.take("club_line"))
        self.add(rank, f, L.clock(f.time) if f.time else None, start, self.at - 1)

    def points(self, f: Fields) -> None:
        if f.points is None and self.at <= len(self.doc) and self.doc.look(self.at).points:
            f.points = self.take("points_line")

    def is_total(self, f: Fields) -> bool:
        """A lone time where splits are expected is the total if points follow, and behind them the end, another time,
        or something that can't belong to this record."""
        points = self.doc.after[self.at]
        if f.time is not None or not points or not self.doc.look(points).points:
            return False
        then = self.doc.after[points]
        return then is None or self.begins(then) or bool(self.doc.look(then).pure or self.doc.look(then).glued) or self.doc.look(then).kind in L.ENDS

    def begins(self, i: int) -> bool:
        return self.doc.rank(i) is not None or self.doc.look(i).swimmer or self.doc.look(i).ranked is not None

    def next_begins(self) -> bool:
        """Whether the next line begins a record; its rank is judged by the lines around the line after this one."""
        then = self.doc.after[self.at]
        if then is None:
            return False
        near = self.at + 1
        rank = L.rank_of(self.doc[then], self.doc[self.doc.before[near]], self.doc[self.doc.after[near]])
        return rank is not None or self.doc.look(then).ranked is not None or self.doc.look(then).swimmer


def parse(text: str) -> dict:
    return {"version": "11.83565", **ResultList(text).parse()}


def parse_unlabelled(text: str) -> dict:
    """As `parse`, without the labelled lines: for tables of rows."""
    return {"version": "11.83565", **ResultList(text).parse(labels=False)}
