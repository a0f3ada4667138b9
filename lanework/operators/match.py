"""Fuzzy one-to-one matching, greedy in row order, inside a list.

A list is the unit of work: its rows and candidates meet in one cogroup, in the order of their order columns, and the set
of used candidates lives no longer than the group.  Ratios of a name with a candidate's name are worked out once a group,
and only where the lengths allow the threshold (2 * min / sum, an upper bound of the ratio).

Ties go to the earliest candidate.  Rows with an empty folded name match nothing.
"""

from __future__ import annotations

from difflib import SequenceMatcher
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NAME_LEAST, TOTAL_LEAST, TOTAL_LEAST_NO_CLUB, CLUB_WEIGHT = 0.84, 0.86, 0.90, 0.12


@lru_cache(maxsize=200_000)
def ratio(a: str, b: str) -> float:
    return SequenceMatcher(None, a, b).ratio()


def best_candidate(name: str, club: str, candidates: list[tuple[str, str]], used: list[bool], name_least: float = NAME_LEAST) -> tuple[int, float]:
    """(place, score) of the best candidate that isn't used and passes the thresholds; (-1, 0) if none does."""
    best, top = -1, 0.0
    for i, (other, other_club) in enumerate(candidates):
        if used[i] or not other or 2 * min(len(name), len(other)) < name_least * (len(name) + len(other)):
            continue
        score = ratio(name, other)
        if score < name_least:
            continue
        if club and other_club:
            score += CLUB_WEIGHT * ratio(club, other_club)
        if score >= (TOTAL_LEAST if club else TOTAL_LEAST_NO_CLUB) and score > top:
            best, top = i, score
    return best, top


def greedy(rows: pd.DataFrame, candidates: pd.DataFrame) -> list[tuple[int, float]]:
    """For each row, in order, the place of its candidate."""
    pool = list(zip(candidates["name"].fillna(""), candidates["club"].fillna(""), strict=True))
    used = [False] * len(pool)
    out = []
    for name, club in zip(rows["name"].fillna(""), rows["club"].fillna(""), strict=True):
        place, score = best_candidate(name, club, pool, used) if name else (-1, 0.0)
        if place >= 0:
            used[place] = True
        out.append((place, score))
    return out


def fuzzy_match(rows: DataFrame, candidates: DataFrame, group: list[str]) -> DataFrame:
    """rows (group, ord, name, club: folded) and candidates (the same): (group, ord, candidate_ord, score) of matches."""
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    schema = ", ".join([*[f"{g} {kinds[g]}" for g in group], f"ord {kinds['ord']}", f"candidate_ord {dict(candidates.dtypes)['ord']}", "score double"])

    def run(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        left, right = left.sort_values("ord", kind="stable").reset_index(drop=True), right.sort_values("ord", kind="stable").reset_index(drop=True)
        found = greedy(left, right)
        keep = [(left["ord"][i], right["ord"][p], s) for i, (p, s) in enumerate(found) if p >= 0]
        out = pd.DataFrame({g: [k] * len(keep) for g, k in zip(group, key, strict=True)})
        return out.assign(ord=[k[0] for k in keep], candidate_ord=[k[1] for k in keep], score=[float(k[2]) for k in keep])

    columns = [*group, "ord", "name", "club"]
    return rows.select(*columns).groupBy(*group).cogroup(candidates.select(*columns).groupBy(*group)).applyInPandas(run, schema)


def matched(rows: DataFrame, records: DataFrame, group: list[str], consume_exact: bool = False) -> DataFrame:
    """Exact matching at two levels, then fuzzy matching of the rest: rows with time, rank, how (exact, fuzzy or null).

    rows: group, ord, name, club; records: group, ord, name, club, time, rank.  All names and clubs are folded.  Exact
    matches don't use candidates up, unless asked to.
    """
    from lanework.operators.dedupe import keep_first, first_wins

    timed = records.where(F.coalesce(F.trim("time"), F.lit("")) != "").where("name <> ''")
    one = first_wins(timed, [*group, "name", "club"], "ord", t1=F.col("time"), r1=F.col("rank"))
    two = first_wins(timed, [*group, "name"], "ord", t2=F.col("time"), r2=F.col("rank"))
    met = rows.drop("time", "rank").join(one, [*group, "name", "club"], "left").join(two, [*group, "name"], "left")
    met = met.withColumn("time", F.when(F.col("name") != "", F.coalesce("t1", "t2"))).withColumn("rank", F.when(F.col("t1").isNotNull(), F.col("r1")).otherwise(F.col("r2")))
    exact = met.where("time is not null").drop("t1", "r1", "t2", "r2").withColumn("how", F.lit("exact"))
    rest = met.where("time is null").drop("t1", "r1", "t2", "r2", "time", "rank")
    pool = keep_first(timed, [*group, "name", "club", "time", "rank"], ["ord"])
    if consume_exact:
        pool = pool.join(exact.select(*group, "name", "club"), [*group, "name", "club"], "left_anti")
    pairs = fuzzy_match(rest, pool, group)
    found = pairs.join(pool.select(*group, F.col("ord").alias("candidate_ord"), "time", "rank"), [*group, "candidate_ord"])
    fuzzy = rest.join(found.select(*group, "ord", "time", "rank", F.lit("fuzzy").alias("how")), [*group, "ord"], "left")
    return exact.unionByName(fuzzy)
