r"""Text functions as columns: JVM expressions, inside whole-stage code generation.

Regular expressions are Java's.  Case-insensitive ones are `(?iu)`, white space and word borders are Unicode's `(?U)`, as
texts hold Turkish letters; `trim` means all white space.
"""

from __future__ import annotations

import unicodedata
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

# Fixed values.
TURKISH_FROM, TURKISH_TO = "ıİşŞğĞüÜöÖçÇ", "iissgguuoocc"
GENDERS = {
    "erkek": "Erkekler",
    "erkekler": "Erkekler",
    "kız": "Kadınlar",
    "kiz": "Kadınlar",
    "kızlar": "Kadınlar",
    "kizlar": "Kadınlar",
    "bayan": "Kadınlar",
    "bayanlar": "Kadınlar",
    "kadın": "Kadınlar",
    "kadin": "Kadınlar",
    "kadınlar": "Kadınlar",
    "kadinlar": "Kadınlar",
}
GENDERS_ASCII = {k: "Erkekler" if v == "Erkekler" else "Kadinlar" for k, v in GENDERS.items()}
# What text recognition makes of frequent words of lines, in this order.
LINE_RULES = [
    (r"\bOkul\s+Sporlani\b", "Okul Sporları"),
    (r"\bOkul\s+Sporlari\b", "Okul Sporları"),
    (r"\bKigdkler\b", "Küçükler"),
    (r"\bKiigukler\b", "Küçükler"),
    (r"\bKigukler\b", "Küçükler"),
    (r"\bKucukler\b", "Küçükler"),
    (r"\bYizme\b", "Yüzme"),
    (r"\bYiizme\b", "Yüzme"),
    (r"\bYuzme\b", "Yüzme"),
    (r"\bil\s+Birinciigi\b", "İl Birinciliği"),
    (r"\bil\s+Birinciligi\b", "İl Birinciliği"),
    (r"\bYaris\b", "Yarış"),
    (r"\bAgik\b", "Açık"),
    (r"\bAcik\b", "Açık"),
    (r"\bSonuglar\b", "Sonuçlar"),
    (r"\bSia\b", "Sıra"),
    (r"\bOzel\b", "Özel"),
    (r"\bSehit\b", "Şehit"),
    (r"\bCankaya\b", "Çankaya"),
    (r"\bGankaya\b", "Çankaya"),
    (r"\bOztiirk\b", "Öztürk"),
    (r"\bOzkan\b", "Özkan"),
    (r"\bIhsan\b", "İhsan"),
    (r"\bDogramaci\b", "Doğramacı"),
    (r"\bIIkokulu\b", "İlkokulu"),
    (r"\bllkokulu\b", "İlkokulu"),
    (r"\bIIkokul\b", "İlkokul"),
    (r"\bllkokul\b", "İlkokul"),
]
# The same for single fields.
FIELD_RULES = [
    (r"\bS[O0]m\b", "50m"),
    (r"\bKüçukler\b", "Küçükler"),
    (r"\bBirinciligi\b", "Birinciliği"),
    (r"\((Fd|Td|Tk)[\}\]]", "($1)"),
]
#: Corrections of names are data, and none are shipped.
NAME_RULES: list[tuple[str, str]] = []

#: Accented Latin letters with an ASCII base letter, from the Unicode decompositions.
_ACCENTED = {c: b for c in map(chr, [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]) if (b := unicodedata.normalize("NFKD", c)[0]) != c and b.isascii() and sum(not unicodedata.combining(x) for x in unicodedata.normalize("NFKD", c)) == 1}


def strip(x: Column) -> Column:
    return F.regexp_replace(x, r"(?U)^\s+|\s+$", "")


def collapse(x: Column) -> Column:
    """Runs of white space are one space, none at the ends."""
    return F.trim(F.regexp_replace(x, r"(?U)\s+", " "))


def text_of(x: Column) -> Column:
    """Null is empty; trimmed."""
    return F.coalesce(strip(x.cast("string")), F.lit(""))


def first_filled(*columns: Column) -> Column:
    """The first that is neither null nor empty, trimmed after the choice; else empty."""
    return text_of(F.coalesce(*[F.nullif(c.cast("string"), F.lit("")) for c in columns], F.lit("")))


def fold_key(x: Column) -> Column:
    """A key to match by: Turkish and accented Latin letters as ASCII, lower case, letters and digits only; null is empty."""
    ascii_ = F.translate(F.lower(F.translate(text_of(x), TURKISH_FROM, TURKISH_TO)), "".join(_ACCENTED), "".join(_ACCENTED.values()))
    return F.regexp_replace(ascii_, "[^a-z0-9]", "")


def fold_key_python(value: str | None) -> str:
    said = (value or "").strip().translate(str.maketrans(TURKISH_FROM, TURKISH_TO)).lower()
    return "".join(c for c in unicodedata.normalize("NFKD", said) if c.isascii() and (c.isdigit() or "a" <= c <= "z"))


def fold_key_exact():
    """fold_key with the whole of Unicode's decompositions (ligatures, wide forms), as an Arrow function."""

    @arrow_udf("string")
    def fold(x: pa.Array) -> pa.Array:
        return pa.array((fold_key_python(v) for v in x.to_pylist()), pa.string())

    return fold


def match_keys(name: Column, club: Column) -> tuple[Column, Column]:
    """By name and club, then by name alone."""
    n, c = fold_key(name), fold_key(club)
    return F.struct(n.alias("name"), c.alias("club")), F.struct(n.alias("name"), F.lit("").alias("club"))


def slug(x: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(text_of(x)), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def unique_name(x: Column, most: int = 100) -> Column:
    return F.substr(slug(x), F.lit(1), F.lit(most))


def default_unique_name(title: Column, date: Column, location: Column) -> Column:
    """parsed-{title}[-{location}]-{digest}, 100 characters at most."""
    t, p = F.substr(slug(title), F.lit(1), F.lit(36)), F.substr(slug(location), F.lit(1), F.lit(20))
    digest = F.substr(F.sha1(F.concat_ws("|", title, date, location).cast("binary")), F.lit(1), F.lit(8))
    parts = F.concat_ws("-", F.lit("parsed"), F.when(t == "", F.lit("event")).otherwise(t), F.when(p != "", p), digest)
    return F.substr(parts, F.lit(1), F.lit(100))


def safe_file_name(x: Column, fallback: str = "untitled", most: int | None = None) -> Column:
    clean = F.regexp_replace(F.regexp_replace(collapse(x), r'[<>:"/\\|?*]+', "_"), r"^[ .]+|[ .]+$", "")
    clean = F.coalesce(F.nullif(clean, F.lit("")), F.lit(fallback))
    return F.substr(clean, F.lit(1), F.lit(most)) if most else clean


def safe_pdf_name(x: Column) -> Column:
    name = F.coalesce(x, F.lit(""))
    stem = F.when(F.lower(name).endswith(".pdf"), F.substr(name, F.lit(1), F.char_length(name) - 4)).otherwise(name)
    return F.concat(safe_file_name(stem, "document"), F.lit(".pdf"))


def safe_slug(x: Column, fallback: str = "event") -> Column:
    """Letters and digits of any script, `_` and `-`; all else is one `_`."""
    clean = F.regexp_replace(F.regexp_replace(F.coalesce(x, F.lit("")), r"[^\p{L}\p{N}_-]", "_"), "_+", "_")
    return F.coalesce(F.nullif(F.regexp_replace(clean, "^_+|_+$", ""), F.lit("")), F.lit(fallback))


def strip_html(x: Column) -> Column:
    """Tags are spaces; the usual entities are characters."""
    plain = F.regexp_replace(x, r"(?s)<[^>]+>", " ")
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&#x27;", "'"), ("&amp;", "&")):
        plain = F.replace(plain, F.lit(entity), F.lit(char))
    return collapse(F.replace(plain, F.lit(" "), F.lit(" ")))


def replaced(x: Column, rules: list[tuple[str, str]]) -> Column:
    """Ordered, case-insensitive replacements."""
    return reduce(lambda c, r: F.regexp_replace(c, f"(?iuU){r[0]}", r[1]), rules, x)


def corrected_line(x: Column, rules: list[tuple[str, str]] | None = None) -> Column:
    return replaced(collapse(x), LINE_RULES if rules is None else rules)


def corrected_field(x: Column, rules: list[tuple[str, str]] | None = None) -> Column:
    return collapse(replaced(x, FIELD_RULES if rules is None else rules))


def clean_club(x: Column, tags: str = "Tk|Fd", misread: bool = True) -> Column:
    """Without tags, quotes, commas and digits read at words' ends; nothing left is null."""
    out = F.regexp_replace(corrected_field(x), rf"(?iu)\((?:{tags})\)", "")
    out = F.translate(out, '",', "")
    if misread:
        out = F.regexp_replace(out, r"(?iuU)\bKul[üu]b\d\b", "Kulüb")
        out = F.regexp_replace(out, r"(?U)\b([A-Za-zÇĞİÖŞÜçğıöşü]{2,})\d\b", "$1")
    return F.nullif(collapse(out), F.lit(""))


def clean_name(x: Column, tags: str = "Fd|Td", rules: list[tuple[str, str]] | None = None) -> Column:
    out = F.translate(F.regexp_replace(corrected_field(x), rf"(?iu)\((?:{tags})\)", ""), '",', "")
    return F.nullif(collapse(replaced(out, NAME_RULES if rules is None else rules)), F.lit(""))


def strip_entry_tag(x: Column) -> Column:
    return F.regexp_replace(x, r"(?iu)^\((?:Tk|Fd|Td)\)\s*", "")


def strip_product(x: Column) -> Column:
    return strip(F.regexp_replace(x, r"(?iuU)\s*-\s*SPLASH\s+Meet\s+Manager\s*\d*", ""))


def title_of_path(path: Column) -> Column:
    """.../{title}/startlists/x.pdf or .../startlists/{title}/x.pdf."""
    parts = F.split(path, "/")
    parent = F.try_element_at(parts, F.lit(-2))
    return strip_product(F.when(F.lower(parent).isin("startlists", "results"), F.try_element_at(parts, F.lit(-3))).otherwise(parent))


def list_number(x: Column) -> Column:
    return F.nullif(F.regexp_extract(x, r"(?i)(?:start|result)list_(\d+)", 1), F.lit(""))


def first_number(x: Column) -> Column:
    return F.nullif(F.regexp_extract(x, r"(\d+)", 1), F.lit(""))


def version_of(x: Column) -> Column:
    return F.nullif(F.regexp_extract(x, r"(?iu)Splash\s+Meet\s+Manager\s*,\s*([0-9]+(?:\.[0-9]+)+)", 1), F.lit(""))


def name_from_url(url: Column) -> Column:
    """The last path segment, if it is letters, a hyphen, digits; else null."""
    last = F.regexp_extract(F.regexp_extract(url, r"^[^:]+://[^/?#]*([^?#]*)", 1), r"([^/]+)/*$", 1)
    return F.when(last.rlike(r"(?i)^[a-z]{2,}-\d+$"), last)


def meet_key_of_url(url: Column) -> Column:
    """`cs-12` of a path segment, in lower case; else null."""
    return F.nullif(F.lower(F.regexp_extract(strip(url), r"(?i)/(cs-\d+)(?:/|$)", 1)), F.lit(""))


def file_of_url(url: Column) -> Column:
    return F.url_decode(F.regexp_extract(F.regexp_extract(url, r"^[^:]+://[^/?#]*([^?#]*)", 1), r"([^/]*)$", 1))


def gender(x: Column, known: dict[str, str] | None = None) -> Column:
    """By the dictionary; unknown ones pass."""
    known = GENDERS if known is None else known
    pairs = F.create_map(*[F.lit(v) for kv in known.items() for v in kv])
    trimmed = strip(x)
    return F.coalesce(F.try_element_at(pairs, F.lower(trimmed)), trimmed)


def distance_style(x: Column) -> Column:
    """struct(distance, style) of `50m Serbest` or `4x50m Karışık`; nulls if it isn't one."""
    pattern = r"(?iuU)^(\d+(?:\s*x\s*\d+)?m)\s+(.+)$"
    clean = collapse(x)
    found = clean.rlike(pattern)
    return F.struct(F.when(found, F.regexp_replace(F.regexp_extract(clean, pattern, 1), r"\s+", "")).alias("distance"), F.when(found, F.regexp_extract(clean, pattern, 2)).alias("style"))


def event_descriptor(x: Column) -> Column:
    """struct(gender, distance, style) of `Yarış 12, Erkekler, 50m Serbest`, prefix and gender optional."""
    bare = F.regexp_replace(collapse(x), r"(?iuU)^Yarış\s+\d+\s*,\s*", "")
    parts = F.filter(F.transform(F.split(bare, "[,;]"), strip), lambda p: p != "")
    first = F.get(parts, F.lit(0))
    known = F.lower(first).isin(*GENDERS)
    body = F.array_join(F.when(known, F.slice(parts, 2, F.greatest(F.size(parts), F.lit(1)))).otherwise(parts), ", ")
    one = distance_style(F.split(body, ",")[0])
    loose = r"(?iuU)(\d+(?:\s*x\s*\d+)?m)\s+([^,;]+)"
    two = F.nullif(F.regexp_extract(body, loose, 1), F.lit(""))
    return F.struct(F.when(known, gender(first)).alias("gender"), F.coalesce(one["distance"], F.regexp_replace(two, r"\s+", "")).alias("distance"), F.coalesce(one["style"], strip(F.nullif(F.regexp_extract(body, loose, 2), F.lit("")))).alias("style"))


def event_name(number: Column, details: Column, phase: Column) -> Column:
    """`Yarış N[, details[; phase]]`, corrected."""
    rest = F.concat_ws("; ", F.nullif(details, F.lit("")), F.nullif(phase, F.lit("")))
    return corrected_field(F.concat(F.lit("Yarış "), number, F.when(rest != "", F.concat(F.lit(", "), rest)).otherwise("")))


def event_components(details: Column, phase: Column) -> Column:
    """struct(category, distance_style, level): parts by `;`, else by `,`, else all is the distance and style."""
    by = F.when(F.contains(details, F.lit(";")), F.lit(";")).otherwise(",")
    parts = F.filter(F.transform(F.split(details, by), strip), lambda p: p != "")
    several = details.rlike("[;,]")
    style = F.when(several, F.get(parts, F.lit(1))).otherwise(details)
    level = F.coalesce(F.nullif(phase, F.lit("")), F.when(several, F.get(parts, F.lit(2))))
    inner = F.filter(F.transform(F.split(style, ","), strip), lambda p: p != "")
    late = F.try_element_at(inner, F.lit(-1))
    cut = F.contains(details, F.lit(";")) & level.isNull() & (F.size(inner) >= 2) & F.lower(late).isin("açık", "acik", "final", "seri")
    return F.struct(corrected_field(F.when(several, F.get(parts, F.lit(0)))).alias("category"), corrected_field(F.when(cut, F.get(inner, F.lit(0))).otherwise(style)).alias("distance_style"), corrected_field(F.when(cut, late).otherwise(level)).alias("level"))


def split_glued(x: Column) -> Column:
    """Spaces around times, and between letters and digits that text recognition ran together."""
    time = r"\d{1,2}[:.]\d{2}(?:[:.]\d{2})?"
    out = F.regexp_replace(x, rf"(?<=\p{{L}})({time})", " $1")
    out = F.regexp_replace(out, rf"(?<!\d)({time})(?=\p{{L}})", "$1 ")
    return collapse(F.regexp_replace(out, r"(?<=\p{L}{2})(\d{2,})(?!\S)", " $1"))


def strip_fence(x: Column) -> Column:
    """Text inside a Markdown code fence, without it."""
    return strip(F.regexp_replace(F.regexp_replace(strip(x), r"^```[A-Za-z]*\s*", ""), r"\s*```$", ""))


def without_bom(x: Column) -> Column:
    return F.regexp_replace(x, "^﻿", "")


def is_name_continuation(x: Column) -> Column:
    """One to three words of letters, all in capitals."""
    line = strip(x)
    return F.coalesce(line.rlike(r"^[A-Za-zÇĞİÖŞÜçğıöşü]+(?:\s+[A-Za-zÇĞİÖŞÜçğıöşü]+){0,2}$") & (line == F.upper(line)), F.lit(False))


def is_status_line(x: Column) -> Column:
    line = strip(x)
    return F.coalesce(line.rlike("KATILIM|BARAJ|GECTI|GEÇTİ|DISK|DQ") & ~line.rlike(r"\d") & (line == F.upper(line)), F.lit(False))


def is_probable_swimmer(x: Column) -> Column:
    """Two words or more, no digit, no heading, footer, marker or club; a word in capitals, or two that begin with one."""
    line = strip(x)
    low = F.lower(line)
    heading = line.rlike(r"(?iuU)^(---|Splash\s+Meet|Yarış\s+\d|Sira$|YB$|Zaman\s+\w+$|Registered\b|Sayfa\b|dis[kq]\s*\.?$|td\s*\.?$)")
    club = low.rlike("kulüb|kulub|spor|belediye|kolej|federasyon") | (low == "ferdi")
    tokens = F.split(F.coalesce(clean_name(line), F.lit("")), " ")
    capitals = F.exists(tokens, lambda t: t.rlike("^[A-ZÇĞİÖŞÜ]{2,}$"))
    begins = F.get(tokens, F.lit(0)).rlike(r"^\p{Lu}") & F.get(tokens, F.lit(1)).rlike(r"^\p{Lu}")
    return F.coalesce((line != "") & ~line.rlike(r"\d") & ~heading & ~club & (F.size(tokens) >= 2) & (capitals | begins), F.lit(False))


def tokens(x: Column) -> Column:
    return F.filter(F.split(collapse(x), " "), lambda t: t != "")


def name_prefix(x: Column, club_hint: str = "(?iu)kulüb|kulub|spor|belediye|kolej|okul|lise") -> Column:
    """A name that stands before a club: three or else two leading words without digits or hints of a club, the last
    beginning with a capital, and a word after them; null if there is none."""
    t = tokens(x)

    def good(n: int) -> Column:
        lead = F.slice(t, 1, n)
        return (F.size(t) > n) & F.forall(lead, lambda w: ~w.rlike(r"\d") & ~w.rlike(club_hint)) & F.try_element_at(lead, F.lit(-1)).rlike(r"^\p{Lu}")

    return F.when(good(3), F.array_join(F.slice(t, 1, 3), " ")).when(good(2), F.array_join(F.slice(t, 1, 2), " "))


def split_record(x: Column, club_hint: str = "(?iu)kulüb|kulub|spor|belediye|kolej|okul|lise") -> Column:
    """array: a line with just one time and a hint of a club before it is `left time` and the last digits after it."""
    time = r"\d{1,2}[:.]\d{2}(?:[:.]\d{2})?"
    found = F.regexp_extract_all(x, F.lit(f"({time})"), 1)
    left = F.regexp_extract(x, rf"^(.*?{time})", 1)
    digits = F.try_element_at(F.regexp_extract_all(F.regexp_replace(x, rf"^.*?{time}", ""), F.lit(r"(\d+)"), 1), F.lit(-1))
    one = (F.size(found) == 1) & left.rlike(club_hint) & digits.isNotNull()
    return F.when(one, F.array(strip(left), digits)).otherwise(F.array(x))


def repaired_record(name: Column, club: Column, time: Column, points: Column) -> Column:
    """struct(name, birth_year, club, time, points): tags, ranks and an embedded year leave the name; a time and points
    that stand in the club move to their fields if these are empty; a missing name is taken from the club's beginning."""
    time_re = r"\d{1,2}[:.]\d{2}(?:[:.]\d{2})?"
    bare = F.regexp_replace(F.regexp_replace(collapse(name), r"(?iu)^\((?:Tk|Fd|Td)\)\s*", ""), r"^\d{1,3}\.?\s+", "")
    year = F.nullif(F.regexp_extract(bare, r"^(.+?)\s+(\d{2})$", 2), F.lit(""))
    own = F.when(year.isNotNull(), F.regexp_extract(bare, r"^(.+?)\s+(\d{2})$", 1)).otherwise(bare)
    in_club = F.nullif(F.regexp_extract(club, time_re, 0), F.lit(""))
    after = F.nullif(F.regexp_extract(club, rf"{time_re}\D*(\d{{1,4}})", 1), F.lit(""))
    left = collapse(F.regexp_replace(club, rf"{time_re}.*$", ""))
    prefix = name_prefix(left)
    missing = F.coalesce(own, F.lit("")) == ""
    return F.struct(F.when(missing, prefix).otherwise(own).alias("name"), year.alias("birth_year"), F.when(missing & prefix.isNotNull(), strip(F.substr(left, F.char_length(prefix) + 1))).otherwise(left).alias("club"), F.coalesce(F.nullif(time, F.lit("")), in_club).alias("time"), F.coalesce(F.nullif(points, F.lit("")), after).alias("points"))
