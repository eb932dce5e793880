"""A synthetic tournament of 48 teams, made from rules: fixture, bracket, third-place assignment, rates."""

from __future__ import annotations

import math
from itertools import combinations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pitchloom.functions.columns import advance_probability
from pitchloom.operators.goals import with_outcomes

GROUPS = "ABCDEFGHIJKL"


def fixture_rows() -> list[tuple]:
    rows, n = [], 1
    for g in GROUPS:
        teams = [f"team-{g.lower()}{i}" for i in range(1, 5)]
        for a, b in ((0, 1), (2, 3), (0, 2), (3, 1), (3, 0), (1, 2)):
            rows.append((f"{n:03d}", "group", g, None, None, teams[a], teams[b]))
            n += 1
    third = {g: "3" + "".join(x for x in GROUPS if x != g) for g in GROUPS}
    first_round = [(f"1{g}", third[g]) for g in "ABCDEFGH"] + [("1I", "2J"), ("1J", "2I"), ("1K", "2L"), ("1L", "2K")] + [("2A", "2B"), ("2C", "2D"), ("2E", "2F"), ("2G", "2H")]
    order = [0, 12, 1, 8, 2, 13, 3, 9, 4, 14, 5, 10, 6, 15, 7, 11]
    at = n
    for i in order:
        rows.append((f"{n:03d}", "r32", None, *first_round[i], None, None))
        n += 1
    for stage, games in (("r16", 8), ("qf", 4), ("sf", 2)):
        start, at = at, n
        for k in range(games):
            rows.append((f"{n:03d}", stage, None, f"W{start + 2 * k:03d}", f"W{start + 2 * k + 1:03d}", None, None))
            n += 1
    rows.append((f"{n:03d}", "third", None, f"L{at:03d}", f"L{at + 1:03d}", None, None))
    rows.append((f"{n + 1:03d}", "final", None, f"W{at:03d}", f"W{at + 1:03d}", None, None))
    return rows


def fixture(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(fixture_rows(), "match_id string, stage string, group string, home_slot string, away_slot string, home_team_id string, away_team_id string")


def mapping_rows() -> list[tuple[str, str, str]]:
    """For each of the 495 combinations of eight groups: the first assignment of thirds to winners in order of letters."""
    slots = [(r[0], r[4][1:]) for r in fixture_rows() if r[4] and r[4][0] == "3"]
    out = []

    def place(left: list[str], i: int, chosen: list[str]) -> list[str] | None:
        if i == len(slots):
            return chosen
        for g in left:
            if g in slots[i][1] and (found := place([x for x in left if x != g], i + 1, [*chosen, g])):
                return found
        return None

    for c in combinations(GROUPS, 8):
        out += [("".join(c), m, g) for (m, _), g in zip(slots, place(list(c), 0, []), strict=True)]
    return out


def mapping(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(mapping_rows(), "combination string, match_id string, group string")


def teams() -> list[str]:
    return [f"team-{g.lower()}{i}" for g in GROUPS for i in range(1, 5)]


def strength(i: int) -> float:
    return 0.45 * math.cos(i * 2.399963)


def rates(spark: SparkSession, form: list[tuple[float, float]] | None = None, mean: float = 1.3) -> DataFrame:
    """Goal rates and the home side's chance to advance for every ordered pair.

    form: goals for and against per match, dealt to the teams in turn; without it they come from a rule.
    """
    if form is None:
        form = [(mean * math.exp(strength(i)), mean * math.exp(-strength(i + 7))) for i in range(len(teams()))]
    rated = [(t, *form[i % len(form)]) for i, t in enumerate(teams())]
    pairs = [(a, b, x * v / mean, u * y / mean) for a, x, y in rated for b, u, v in rated if a != b]
    table = spark.createDataFrame(pairs, "home_team_id string, away_team_id string, rate_home double, rate_away double")
    return with_outcomes(table).select("home_team_id", "away_team_id", "rate_home", "rate_away", advance_probability(F.col("p_home"), F.col("p_draw"), F.col("p_away")).alias("p_advance"))
