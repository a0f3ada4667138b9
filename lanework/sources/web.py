"""Pages and files over HTTP, on the driver: there are few, and what they bring is landed before Spark reads it."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from pathlib import Path
from urllib.parse import unquote, urlparse
from urllib.request import Request, urlopen

from lanework.sources import html

AGENT = "Mozilla/5.0 (X11; Linux x86_64) lanework"
Opener = Callable[..., object]


def fetch_html(url: str, timeout: int = 30, opener: Opener = urlopen) -> str:
    """The page as text, by its declared charset, else UTF-8; an error if it isn't text."""
    with opener(Request(url, headers={"User-Agent": AGENT}), timeout=timeout) as got:
        kind, charset, data = got.headers.get("Content-Type", ""), got.headers.get_content_charset() or "utf-8", got.read()
    if not re.search("text|html", kind, re.I):
        raise ValueError(f"not an HTML page: {url}")
    return data.decode(charset, errors="replace")


def download(url: str, to: Path, timeout: int = 60, opener: Opener = urlopen) -> None:
    to.parent.mkdir(parents=True, exist_ok=True)
    with opener(Request(url, headers={"User-Agent": AGENT}), timeout=timeout) as got:
        to.write_bytes(got.read())


def file_name(x: str, fallback: str, most: int = 120) -> str:
    clean = re.sub(r'[<>:"/\\|?*]+', "_", " ".join(x.split())).strip(" .")[:most].strip(" .")
    return clean or fallback


def pdf_name(x: str, fallback: str) -> str:
    stem = x[:-4] if x.lower().endswith(".pdf") else x
    return file_name(stem, fallback) + ".pdf"


def chosen(links: list[tuple[str, str, str]], keywords: Sequence[str]) -> list[tuple[str, str, str]]:
    """Links whose text, title or url holds a keyword; all of them if none does."""
    hit = [x for x in links if any(k in f"{x[1]} {x[2]} {x[0]}".lower() for k in keywords)]
    return hit or links


def scrape(url: str, root: str | Path, kind: str, keywords: Sequence[str], title: str | None = None, opener: Opener = urlopen) -> list[dict[str, str]]:
    """Downloads a page's PDF files to {root}/{title}/{kind}, each url once."""
    found = [x for x in html.links_in(fetch_html(url, opener=opener), url) if html.is_pdf(x[0])]
    out: dict[str, dict[str, str]] = {}
    for i, (at, text, heading) in enumerate(chosen(found, keywords), 1):
        if at not in out:
            folder = Path(root) / file_name(title or heading, "untitled_event") / kind
            to = folder / pdf_name(unquote(urlparse(at).path).rsplit("/", 1)[-1] or text, f"file_{i}")
            download(at, to, opener=opener)
            out[at] = {"event_title": folder.parent.name, "pdf_url": at, "link_text": text, "saved_to": str(to)}
    return list(out.values())


def scrape_start_lists(url: str, root: str | Path = "scraped", title: str | None = None, opener: Opener = urlopen) -> list[dict[str, str]]:
    return scrape(url, root, "startlists", html.START_KEYWORDS, title, opener)


def scrape_results(url: str, root: str | Path = "scraped", title: str | None = None, opener: Opener = urlopen) -> list[dict[str, str]]:
    return scrape(url, root, "results", html.RESULT_KEYWORDS, title, opener)
