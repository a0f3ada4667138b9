import random

import pytest

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + (str(r.randint(0, 40)) if r.random() < 0.7 else "") for _ in range(n))


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls in every column, empty, blank and very long texts, repeated rows, ties, odd characters."""
    passage = prose(1, 60)
    long = prose(2, 30_000)
    near = passage.split()
    near[30] = "changed"
    return [
        (1, prose(3, 200) + " " + passage, "en", "a", 7),
        (2, passage + "\n" + prose(4, 90), "en", "a", 7),
        (3, passage, "en", "b", 7),
        (3, passage, "en", "b", 7),
        (4, passage, None, None, None),
        (5, " ".join(near), "fr", "b", 7),
        (6, None, "en", "a", 7),
        (7, "", "en", "a", 7),
        (8, " \t\n ", "en", "a", 7),
        (None, prose(5, 80), "en", "a", 7),
        (None, None, None, None, None),
        (9, long, "en", "a", 7),
        (10, long + " end", "en", "a", 7),
        (11, "one two", "de", "c", 7),
        (12, "Éa été là\x00 😀 ÀB the THE", "fr", "c", 7),
        (13, "na " * 100, "en", "a", 7),
        (14, prose(6, 35), "en", "a", 7),
        (15, prose(6, 35), "en", "z", 7),
    ]


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    return spark.createDataFrame(odd_rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def clashing(spark, odd_rows):
    """The same with columns that have the names of results and of inner columns."""
    names = ["seg", "at", "spans", "items", "n_words", "kept", "repeats", "n_removed", "k", "h", "blob", "ids", "n_tokens", "decoded", "payload", "feature", "shard", "slot", "host", "score", "rest", "keep_document", "group_id", "size", "media"]
    schema = SCHEMA + "".join(f", {n} string" for n in names)
    return spark.createDataFrame([(*r, *["x"] * len(names)) for r in odd_rows], schema)


@pytest.fixture(scope="session")
def odd_dir(spark, odd, tmp_path_factory):
    """Tables like the driver's, made of the odd rows."""
    path = str(tmp_path_factory.mktemp("odd"))
    odd.write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, 1, 0), (2, 0, 1), (3, None, None), (None, 1, 0), (3, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    passage = prose(3, 200).split()[20:35]
    spark.createDataFrame([(1, " ".join(passage)), (2, None), (None, "one two"), (3, ""), (4, "absent words here")], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    urls = ["http://a.example.org/en/1", "HTTPS://A.B.Example.ORG/es/x?y#z", "http://example.org", "http://org/", "ftp://x.com/fr/1", "http://com/de/", "http://xcom/de/", None, "no scheme", "://", "http://example.org:80/es/", "http://..org/en/1", "http://a.example.org/en/1"]
    spark.createDataFrame([(i, u, "<p>") for i, u in enumerate(urls)] + [(None, None, None)], "page_id long, url string, html string").write.parquet(f"{path}/pages.parquet")
    return path


@pytest.fixture(scope="session")
def empty_dir(spark, none, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("empty"))
    none.coalesce(1).write.parquet(f"{path}/documents.parquet")
    for name, schema in (("labels", "doc_id long, quality int, toxic int"), ("benchmark", "item_id long, text string"), ("pages", "page_id long, url string, html string")):
        spark.createDataFrame([], schema).coalesce(1).write.parquet(f"{path}/{name}.parquet")
    return path
