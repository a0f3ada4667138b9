"""Links, headers and keywords of HTML pages that are already in a table."""

from __future__ import annotations

from html.parser import HTMLParser
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lanework.functions.text import strip_html

# Fixed values.
START_KEYWORDS = ("start list", "start listesi", "startlist", "entry list", "entries", "seeding", "program")
RESULT_KEYWORDS = ("result", "results", "sonuc", "sonuclar", "sonuç", "final", "timing")
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}


class _Links(HTMLParser):
    """Text of open tags of interest is collected into whatever is open; a heading or title counts once it is closed."""

    def __init__(self, base: str):
        super().__init__(convert_charrefs=True)
        self.base, self.found = base, []
        self.open: dict[str, list[str]] = {}
        self.href, self.title, self.heading = "", "", ""

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag == "a":
            self.href, self.open["a"] = dict(attrs).get("href") or "", []
        elif tag == "title" or (len(tag) == 2 and tag[0] == "h" and tag[1] in "123456"):
            self.open[tag] = []

    def handle_data(self, data: str) -> None:
        for parts in self.open.values():
            parts.append(data)

    def handle_endtag(self, tag: str) -> None:
        parts = self.open.pop(tag, None)
        if parts is None:
            return
        said = " ".join("".join(parts).split())
        if tag == "a":
            if self.href:
                self.found.append((urljoin(self.base, self.href), said, self.heading or self.title or "untitled"))
        elif tag == "title":
            self.title = said
        elif said:
            self.heading = said


def links_in(html: str | None, base: str | None) -> list[tuple[str, str, str]]:
    """(absolute url, text, title) of all anchors with a target, in order."""
    parser = _Links(base or "")
    parser.feed(html or "")
    parser.close()
    return parser.found


def is_pdf(url: str) -> bool:
    return url.lower().endswith(".pdf") or ".pdf?" in url.lower()


def page_links(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", only_pdf: bool = False) -> DataFrame:
    """(key, pos, url, text, title) of each page's links; a page whose HTML can't be read has none."""

    def run(batches):
        for batch in batches:
            out: list[tuple] = []
            for k, u, h in zip(*(batch.column(c).to_pylist() for c in (key, url, html)), strict=True):
                found = [x for x in links_in(h, u) if not only_pdf or is_pdf(x[0])]
                out += [(k, i, *x) for i, x in enumerate(found)]
            columns = list(zip(*out, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], batch.column(key).type), pa.array(columns[1], pa.int32()), *[pa.array(c, pa.string()) for c in columns[2:]]], [key, "pos", "url", "text", "title"])

    kind = dict(pages.dtypes)[key]
    return pages.select(key, url, html).mapInArrow(run, f"{key} {kind}, pos int, url string, text string, title string")


def chosen_links(links: DataFrame, page: str, said: list[Column], keywords: list[str]) -> DataFrame:
    """links with `hit`: those whose texts hold a keyword, or all of a page without any."""
    whole = F.lower(F.concat_ws(" ", *said))
    hit = F.lit(False)
    for word in keywords:
        hit = hit | F.contains(whole, F.lit(word))
    with_hit = links.withColumn("hit", hit)
    return with_hit.withColumn("__any", F.max("hit").over(Window.partitionBy(page))).where("hit or not __any").drop("__any")


def header_fields(html: Column) -> Column:
    """struct(title, date, location) of the cells of <div id=header>: the first, fourth and third; nulls if any is empty."""
    block = F.regexp_extract(html, r"""(?is)<div[^>]*id=["']?header["']?[^>]*>(.*?)</div>""", 1)
    cells = F.transform(F.regexp_extract_all(block, F.lit("(?is)<td[^>]*>(.*?)</td>"), 1), strip_html)
    title, location, date = (F.nullif(F.get(cells, F.lit(i)), F.lit("")) for i in (0, 2, 3))
    whole = title.isNotNull() & location.isNotNull() & date.isNotNull()
    return F.struct(F.when(whole, title).alias("title"), F.when(whole, date).alias("date"), F.when(whole, location).alias("location"))


def page_title(html: Column) -> Column:
    return F.nullif(strip_html(F.regexp_extract(html, "(?is)<title[^>]*>(.*?)</title>", 1)), F.lit(""))
