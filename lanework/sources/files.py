"""Readers of files: discovery in two layouts, CSV, JSON lines, bodies whose format shows in their first character."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from lanework.functions.text import list_number, strip_fence, title_of_path, without_bom
from lanework.operators.dedupe import keep_first

LINES = T.ArrayType(T.StructType([T.StructField("text", T.StringType())]))


def discovered(spark: SparkSession, root: str, kind: str, glob: str = "*.txt", title: str | None = None, numeric: bool = False) -> DataFrame:
    """(path, title, list_number, place) of `{root}/*/{kind}/*` and then of `{root}/{kind}/*/*`, each path once."""
    found = None
    for rank, pattern in enumerate((f"{root}/{title or '*'}/{kind}", f"{root}/{kind}/{title or '*'}")):
        try:
            own = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(pattern).select("path", F.lit(rank).alias("layout"))
        except Exception as e:  # a layout that isn't there
            if "PATH_NOT_FOUND" not in str(e):
                raise
            continue
        found = own if found is None else found.unionByName(own)
    if found is None:
        found = spark.createDataFrame([], "path string, layout int")
    once = keep_first(found, ["path"], ["layout"]).withColumn("title", title_of_path(F.col("path"))).withColumn("list_number", list_number(F.col("path")))
    order = [F.col("layout"), F.col("title"), F.col("list_number").cast("int").asc_nulls_last() if numeric else F.col("path"), F.col("path")]
    # an order over file names, of which there are few
    return once.withColumn("place", F.row_number().over(Window.orderBy(*order))).drop("layout")


def texts(spark: SparkSession, path: str) -> DataFrame:
    """(path, text) of whole text files."""
    return spark.read.option("wholetext", True).text(path).select(F.col("_metadata.file_path").alias("path"), without_bom(F.col("value")).alias("text"))


def as_pages(texts: Column) -> Column:
    """Pages that aren't blank, each under its marker."""
    marked = F.transform(texts, lambda t, i: F.struct((i + 1).alias("n"), t.alias("t")))
    filled = F.filter(marked, lambda p: F.trim(F.coalesce(p["t"], F.lit(""))) != "")
    return F.array_join(F.transform(filled, lambda p: F.concat(F.lit("--- Page "), p["n"].cast("string"), F.lit(" ---\n"), F.rtrim(p["t"]), F.lit("\n"))), "\n")


#: Fixed value: a line that has a rank, words and a time.
RESULT_LINE = r"(?s)\b\d{1,3}\.\s+.+?(\d{1,2}:\d{2}\.\d{2}|\d{1,2}\.\d{2})\b"


def needs_ocr(pages: DataFrame, doc: str, page: str, text: str, sample: int = 5, least: int = 200) -> DataFrame:
    """(doc, needs): fewer than `least` characters on the first `sample` pages; a document without any page has no row.

    Lines like a result's change nothing: with enough characters none is needed either way.  `result_pages` counts them.
    """
    own = F.when(F.col(page) <= max(sample, 1), F.char_length(F.trim(text)))
    return pages.groupBy(doc).agg((F.coalesce(F.sum(own), F.lit(0)) < least).alias("needs"))


def result_pages(pages: DataFrame, doc: str, page: str, text: str, sample: int = 5) -> DataFrame:
    """(doc, result_pages): how many of the first `sample` pages have a line like a result's."""
    return pages.groupBy(doc).agg(F.count_if((F.col(page) <= max(sample, 1)) & F.col(text).rlike(RESULT_LINE)).alias("result_pages"))


#: Readers of page texts by name: a function of (documents, path of their content) that gives (path, page, text).
BACKENDS: dict[str, Callable[[DataFrame], DataFrame]] = {}


def backend(name: str, reader: Callable[[DataFrame], DataFrame]) -> None:
    """Makes a reader known, such as one for PDF files or a recognition model that this environment lacks."""
    BACKENDS[name] = reader


def page_texts(documents: DataFrame, native: str, recognised: str, doc: str = "path", force: bool = False) -> DataFrame:
    """(doc, page, text) by the native reader, and by the other one for documents that need recognition, or for all if forced."""
    for name in (native, recognised):
        if name not in BACKENDS:
            raise LookupError(f"no backend {name}; known: {sorted(BACKENDS)}")
    if force:
        return BACKENDS[recognised](documents)
    own = BACKENDS[native](documents)
    wanting = needs_ocr(own, doc, "page", "text").where("needs").select(doc)
    return own.join(wanting, doc, "left_anti").unionByName(BACKENDS[recognised](documents.join(wanting, doc, "left_semi")))


def newest(spark: SparkSession, path: str, glob: str = "*") -> str | None:
    """The path of the file last changed; of equally new ones the greatest path; None without files."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", True).load(path)
    return found.agg(F.max_by("path", F.struct("modificationTime", "path"))).first()[0]


def made_once(spark: SparkSession, path: str, make: Callable[[], DataFrame], forced: bool = False) -> DataFrame:
    """The table under `path`, made only if it is missing or forced; it is put in place whole."""
    from lanework.sources.sinks import exists, swap

    if forced or not exists(spark, path):
        swap(spark, make(), path)
    return spark.read.parquet(path)


def read_csv(spark: SparkSession, path: str, fields: Sequence[str]) -> DataFrame:
    """All text, with a header; quoted line breaks are part of their value."""
    return spark.read.schema(", ".join(f"`{f}` string" for f in fields)).csv(path, header=True, multiLine=True, escape='"').na.fill("")


def read_json_lines(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """Blank and malformed lines are left out."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def delimiter_of(x: Column) -> Column:
    """`;` if there are as many of it as of `,`."""
    count = lambda c: F.char_length(x) - F.char_length(F.replace(x, F.lit(c), F.lit("")))
    return F.when(count(";") >= count(","), ";").otherwise(",")


def fenced_csv(df: DataFrame, text: str, keep: Sequence[str]) -> DataFrame:
    """(keep, row_no, cells): CSV that may stand in a code fence, with a delimiter that each text shows; no quoted breaks."""
    bare = df.select(*keep, strip_fence(F.col(text)).alias("__t")).withColumn("__d", delimiter_of(F.col("__t")))
    rows = bare.select(*keep, "__d", F.posexplode(F.split("__t", r"\r?\n")).alias("row_no", "__l")).where(F.trim("__l") != "")
    semicolon = F.transform(F.split("__l", ";(?=(?:[^\"]*\"[^\"]*\")*[^\"]*$)"), _cell)
    comma = F.transform(F.split("__l", ",(?=(?:[^\"]*\"[^\"]*\")*[^\"]*$)"), _cell)
    return rows.select(*keep, "row_no", F.when(F.col("__d") == ";", semicolon).otherwise(comma).alias("cells"))


def _cell(c: Column) -> Column:
    bare = F.trim(c)
    return F.when(bare.rlike('(?s)^".*"$'), F.replace(F.substr(bare, F.lit(2), F.greatest(F.char_length(bare) - 2, F.lit(0))), F.lit('""'), F.lit('"'))).otherwise(bare)


def body_format(body: Column, name: Column | None = None, content_type: Column | None = None) -> Column:
    """json or csv, by name, content type or the first character."""
    first = F.substr(F.ltrim(without_bom(body)), F.lit(1), F.lit(1))
    told = first.isin("[", "{")
    if name is not None:
        told = told | F.coalesce(F.lower(name).endswith(".json"), F.lit(False))
    if content_type is not None:
        told = told | F.coalesce(F.contains(F.lower(content_type), F.lit("json")), F.lit(False))
    return F.when(told, "json").otherwise("csv")


def body_rows(body: Column) -> Column:
    """The rows of a JSON body, a list or {"rows": list}, each as a map of what is there: a key with null is there too."""
    kind = "array<map<string,string>>"
    plain = without_bom(body)
    listed = F.from_json(plain, kind)
    return F.when(F.ltrim(plain).startswith("["), listed).otherwise(F.from_json(plain, f"rows {kind}")["rows"])


def has_key(row: Column, *names: str) -> Column:
    out = F.lit(False)
    for name in names:
        out = out | F.map_contains_key(row, name)
    return out


def recognised_lines(json_text: Column) -> Column:
    """Texts of {document: [{"text_lines": [{"text"}]}]}, in order; null if the JSON hasn't that shape."""
    pages = F.from_json(json_text, "map<string,array<struct<text_lines:array<struct<text:string>>>>>")
    lines = F.flatten(F.transform(F.flatten(F.map_values(pages)), lambda p: F.coalesce(p["text_lines"], F.array().cast(LINES))))
    return F.filter(F.transform(lines, lambda x: x["text"]), lambda t: t.isNotNull())


# Keys of text, and of geometry, in recognised pages of any shape.
TEXT_KEYS = ("text", "value", "content", "line")
GEOMETRY_KEYS = ("bbox", "polygon", "confidence", "geometry", "image_bbox", "page")


def any_lines(value: object) -> list[str]:
    """Texts anywhere in parsed JSON, in order, geometry left out."""
    if isinstance(value, dict):
        out = []
        for k, v in value.items():
            if k in GEOMETRY_KEYS:
                continue
            out += [v] if isinstance(v, str) and k in TEXT_KEYS and v.strip() else any_lines(v) if isinstance(v, dict | list) else []
        return out
    return [x for v in value for x in any_lines(v)] if isinstance(value, list) else []


def nested_words(json_text: Column) -> Column:
    """Lines of pages[].blocks[].lines[].words[].value, words joined by a space."""
    word = "array<struct<value:string>>"
    pages = F.from_json(json_text, f"pages array<struct<blocks:array<struct<lines:array<struct<words:{word}>>>>>>")["pages"]
    lines = F.flatten(F.transform(F.flatten(F.transform(pages, lambda p: p["blocks"])), lambda b: b["lines"]))
    return F.filter(F.transform(lines, lambda x: F.array_join(F.transform(x["words"], lambda w: w["value"]), " ")), lambda t: F.trim(t) != "")
