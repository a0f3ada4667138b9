"""URL filters by a sort-merge range join, in DataFrame functions only.

A rule is a host and a path prefix; it fits the host and all its subdomains.  Keys are canonical: the host's labels
reversed (`example.org` is `org.example`), a byte that sorts below all others, then the path.  A rule's prefix is then an
interval of keys, and two rules' intervals are nested or apart.  An url stands once for each of its host's suffixes, as
long as the suffix is the host of any rule.  Rules and urls are sorted together; going through them in order, the rules
that are open form a stack.  A rule's stack (the rules of its host that hold it) is laid down beforehand, by joining beginnings of
its path with equal paths; a url takes the stack of the last rule before it and pops what does not hold it any more.

Scale: urls are reduced to distinct (host, path) before the sweep.  The sort is dealt by rule host, and hosts with many
urls by as many salts as their count asks for, the few rules of that host copied to each: no host, not even `com`, makes
one large task, and no row is left out.

Defined results: a null url or one without `://` has an empty host and path, fits no rule and gets the default verdict;
repeated rows each get their result; an empty table gives an empty result; extra columns are neither read nor changed.
Of rules that fit, the one with the longest `host + path` wins, of equally long ones the longest host, then the least
rule string, then the least verdict.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

#: About so many urls of one rule host are swept in one task.
ROWS_A_SALT = 50_000
CUT = "\x01"
RULES_SCHEMA = "host string, path string, verdict string"


def host_of(url: Column) -> Column:
    """Between the first `://` and `/`, `?`, `#` or the end, A-Z lowered; else empty."""
    rest = F.when(F.locate("://", url) > 0, F.substr(url, F.locate("://", url) + 3))
    return F.coalesce(F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    rest = F.when(F.locate("://", url) > 0, F.substr(url, F.locate("://", url) + 3))
    return F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def reversed_host(host: Column) -> Column:
    return F.array_join(F.reverse(F.split(host, r"\.", -1)), ".")


def rules_frame(spark: SparkSession, rules: Iterable[tuple[str, str, str]]) -> DataFrame:
    return spark.createDataFrame(list(rules), RULES_SCHEMA)


def _stacked(rules: DataFrame) -> DataFrame:
    """Each rule with the rules of its host that hold it, itself included, outermost first."""
    rules = rules.where("host is not null and path is not null").groupBy("host", "path").agg(F.min("verdict").alias("verdict"))
    # beginnings of a path, only of the sizes that paths of its host have, meet equal paths: no pair is tried in vain
    sizes = rules.groupBy("host").agg(F.collect_set(F.length("path")).alias("sizes"))
    inner = rules.join(sizes, "host").select("host", "path", F.explode(F.filter("sizes", lambda n: n <= F.length("path"))).alias("size"))
    inner = inner.select(F.col("host").alias("rule_host"), F.col("path").alias("rule_path"), F.expr("substring(path, 1, size)").alias("begun"))
    pairs = inner.join(rules, (F.col("rule_host") == F.col("host")) & (F.col("begun") == F.col("path")))
    return pairs.groupBy("rule_host", "rule_path").agg(F.array_sort(F.collect_list(F.struct(F.length("path").alias("size"), "path", "verdict"))).alias("stack"))


def judge_keys(keys: DataFrame, rules: DataFrame, rows_a_salt: int = ROWS_A_SALT) -> DataFrame:
    """Distinct (host, path) with (rule, verdict) of the rule that wins; those that no rule fits are left out."""
    stacks = _stacked(rules)
    hosts = rules.where("host is not null and path is not null").select(F.col("host").alias("rule_host")).distinct()
    deepest = hosts.agg(F.max(F.size(F.split("rule_host", r"\.", -1)))).first()[0] or 0
    labels = F.split("host", r"\.", -1)
    depths = F.sequence(F.lit(1), F.least(F.size(labels), F.lit(deepest)))
    suffixes = F.transform(depths, lambda d: F.array_join(F.slice(labels, -d, d), "."))
    probes = keys.where(F.lit(deepest > 0)).select("host", "path", F.explode(suffixes).alias("rule_host")).join(hosts, "rule_host", "left_semi")
    salts = probes.groupBy("rule_host").agg(F.ceil(F.count(F.lit(1)) / rows_a_salt).cast("int").alias("salts"))
    events = "rule_host, salt, at, is_url, host, path, stack"
    none = F.lit(None)
    urls = probes.join(salts, "rule_host").select("rule_host", F.pmod(F.xxhash64("host", "path"), F.col("salts")).cast("int").alias("salt"), _key("path").alias("at"), F.lit(1).alias("is_url"), "host", "path", none.cast(stacks.schema["stack"].dataType).alias("stack"))
    starts = stacks.join(salts, "rule_host").select("rule_host", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), _key("rule_path").alias("at"), F.lit(0).alias("is_url"), none.cast("string").alias("host"), none.cast("string").alias("path"), "stack")
    assert urls.columns == starts.columns == events.split(", ")
    swept = Window.partitionBy("rule_host", "salt").orderBy("at", "is_url").rowsBetween(Window.unboundedPreceding, 0)
    open_rules = F.filter(F.last("stack", ignorenulls=True).over(swept), lambda r: F.startswith(F.col("path"), r["path"]))
    hits = urls.unionByName(starts).withColumn("hit", F.try_element_at(open_rules, F.lit(-1))).where("is_url = 1 and hit is not null")
    rule = F.concat("rule_host", F.col("hit.path"))
    best = F.min(F.struct((-F.length(rule)).alias("a"), (-F.length("rule_host")).alias("b"), rule.alias("rule"), F.col("hit.verdict").alias("verdict")))
    return hits.groupBy("host", "path").agg(best.alias("best")).select("host", "path", "best.rule", "best.verdict")


def _key(path: str) -> Column:
    """Within a host, the canonical key sorts by the host, the cut, the path."""
    return F.concat(reversed_host(F.col("rule_host")), F.lit(CUT), F.col(path))


def judge(pages: DataFrame, rules: DataFrame, url: str = "url", keep: tuple[str, ...] = ("page_id",), default: str = "allow") -> DataFrame:
    """Every row with host, path, the rule that won (null if none fits) and its verdict, or the default.

    A column to keep that has the name of one of these gives way to it.
    """
    keep = tuple(c for c in keep if c.lower() not in ("host", "path", "rule", "verdict"))
    rows = pages.select(*[F.col(f"`{c}`") for c in keep], host_of(F.col(f"`{url}`")).alias("host"), path_of(F.col(f"`{url}`")).alias("path"))
    found = judge_keys(rows.select("host", "path").distinct(), rules)
    return rows.join(found, ["host", "path"], "left").select(*[F.col(f"`{c}`") for c in keep], "host", "path", "rule", F.coalesce("verdict", F.lit(default)).cast(T.StringType()).alias("verdict"))
