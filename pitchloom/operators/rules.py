"""Tournament rules: standings, tie-break cascade, best thirds, slots, third-place assignment."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pitchloom.operators.matches import perspectives


def standings(matches: DataFrame, by: list[str]) -> DataFrame:
    """Points, goal difference, goals for and against of each team in each group of matches."""
    sides = perspectives(matches)
    return sides.groupBy(*by, "team_id").agg(
        F.count("*").alias("played"),
        F.sum("points").alias("points"),
        F.sum(F.col("scored") - F.col("conceded")).alias("goal_difference"),
        F.sum("scored").alias("goals_for"),
        F.sum("conceded").alias("goals_against"),
    )


def ranked(table: DataFrame, by: list[str]) -> DataFrame:
    """position by points, goal difference, goals for, then team_id."""
    order = Window.partitionBy(*by).orderBy(F.desc("points"), F.desc("goal_difference"), F.desc("goals_for"), "team_id")
    return table.withColumn("position", F.row_number().over(order))


def best_of_position(table: DataFrame, position: int, take: int, by: list[str], group: str) -> DataFrame:
    """The teams at a position of all groups, ordered across groups; the first ``take`` qualify."""
    order = [F.desc("points"), F.desc("goal_difference"), F.desc("goals_for"), F.col(group)]
    w = Window.partitionBy(*by).orderBy(*order) if by else Window.partitionBy(F.lit(0)).orderBy(*order)
    return table.where(F.col("position") == position).withColumn("order", F.row_number().over(w)).withColumn("qualified", F.col("order") <= take)


def best_thirds(thirds: DataFrame, take: int, by: list[str]) -> DataFrame:
    """Third-placed teams in order across groups, with order, tied and qualified: points, goal difference, goals, conduct (0 if
    unknown), then ranking editions from the newest on (places: array; unknown ones last). thirds: by, team_id, points, goal_difference, goals_for, conduct, places.
    """
    keys = [F.desc("points"), F.desc("goal_difference"), F.desc("goals_for"), F.desc(F.coalesce("conduct", F.lit(0))), F.asc_nulls_last("places")]
    whole = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    ranks = thirds.withColumn("__rank", F.rank().over(whole.orderBy(*keys)))
    same = Window.partitionBy(*by, "__rank")
    placed = ranks.withColumn("tied", F.count("*").over(same) > 1).withColumn("order", F.row_number().over(whole.orderBy("__rank", "team_id"))).drop("__rank")
    return placed.withColumn("qualified", F.col("order") <= take)


def state_errors(results: DataFrame, fixture: DataFrame) -> DataFrame:
    """(match_id, rule) of each played result that breaks a rule of the tournament's state; empty if all hold.

    results: match_id, team_a, team_b, goals_a, goals_b, advanced_team. fixture: match_id, stage, home_team_id, away_team_id (null while open).
    Rules: repeated (match_id), unknown_match, unknown_team, wrong_teams, advanced_in_group, drawn_knockout (without advanced_team).
    """
    f = fixture.select("match_id", "stage", "home_team_id", "away_team_id")
    teams = f.where("home_team_id is not null and away_team_id is not null").select(F.explode(F.array("home_team_id", "away_team_id")).alias("__team")).distinct()
    n = F.count("*").over(Window.partitionBy("match_id"))
    sides = results.withColumn("__n", n).join(f, "match_id", "left")
    for c in ("team_a", "team_b"):
        sides = sides.join(teams.withColumnRenamed("__team", f"__{c}"), F.col(c) == F.col(f"__{c}"), "left")
    pair = lambda a, b: F.array_sort(F.array(a, b))
    rules = {
        "repeated": F.col("__n") > 1,
        "unknown_match": F.col("stage").isNull(),
        "unknown_team": F.col("__team_a").isNull() | F.col("__team_b").isNull(),
        "wrong_teams": F.col("home_team_id").isNotNull() & F.col("away_team_id").isNotNull() & (pair("team_a", "team_b") != pair("home_team_id", "away_team_id")),
        "advanced_in_group": (F.col("stage") == "group") & F.col("advanced_team").isNotNull(),
        "drawn_knockout": (F.col("stage") != "group") & (F.col("goals_a") == F.col("goals_b")) & F.col("advanced_team").isNull(),
    }
    broken = F.filter(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in rules.items()]), lambda r: r.isNotNull())
    return sides.select("match_id", F.explode(broken).alias("rule")).distinct()


def head_to_head(matches: DataFrame, blocks: DataFrame, by: list[str]) -> DataFrame:
    """Standings over the matches among teams of one block (blocks: by, team_id, block)."""
    home = blocks.select(*by, F.col("team_id").alias("home_team_id"), F.col("block").alias("__h"))
    away = blocks.select(*by, F.col("team_id").alias("away_team_id"), F.col("block").alias("__a"))
    inner = matches.join(home, [*by, "home_team_id"]).join(away, [*by, "away_team_id"]).where("__h = __a")
    return standings(inner, by).select(*by, "team_id", F.col("points").alias("h_points"), F.col("goal_difference").alias("h_difference"), F.col("goals_for").alias("h_goals"))


def cascade(matches: DataFrame, by: list[str], conduct: DataFrame | None = None, editions: DataFrame | None = None, rounds: int | None = None, overall_first: bool = True) -> DataFrame:
    """Final order in each group: by, team_id, the overall columns, position, and tied (a tie that no rule broke).

    Overall points, goal difference and goals split teams into blocks (points alone if not ``overall_first``); blocks are then split by the standings of
    the matches among themselves, again and again while that separates (``rounds`` times; else as often as the largest block of ties needs); then by conduct
    score, then by ranking editions from the newest on. conduct: team_id, conduct; editions: team_id, places (array, newest first).
    """
    matches = matches.select(*by, "home_team_id", "away_team_id", "home_score", "away_score").persist()  # read once for each round
    table = standings(matches, by)
    first = [F.desc("points"), F.desc("goal_difference"), F.desc("goals_for")]
    whole = Window.partitionBy(*by)
    now = table.withColumn("block", F.rank().over(whole.orderBy(*(first if overall_first else first[:1])))).persist()

    def split(df, *order):
        """Blocks refined: the number of a block is the place of its first team."""
        inside = F.rank().over(Window.partitionBy(*by, "block").orderBy(*order)) - 1
        return df.withColumn("block", F.col("block") + inside)

    if rounds is None:
        rounds = (now.groupBy(*by, "block").count().agg(F.max("count")).first()[0] or 1) - 1
    for _ in range(rounds):
        ties = F.count("*").over(Window.partitionBy(*by, "block"))
        mini = head_to_head(matches, now.withColumn("ties", ties).where("ties > 1").select(*by, "team_id", "block"), by)
        now = split(now.join(mini, [*by, "team_id"], "left"), F.desc("h_points"), F.desc("h_difference"), F.desc("h_goals")).drop("h_points", "h_difference", "h_goals").persist()
    if not overall_first:
        now = split(now, *first)
    if conduct is not None:
        now = split(now.join(conduct.select("team_id", "conduct"), "team_id", "left"), F.desc(F.coalesce("conduct", F.lit(0)))).drop("conduct")
    if editions is not None:
        now = split(now.join(editions.select("team_id", "places"), "team_id", "left"), F.asc_nulls_last("places")).drop("places")
    tied = F.count("*").over(Window.partitionBy(*by, "block")) > 1
    position = F.row_number().over(whole.orderBy("block", "team_id"))
    return now.withColumn("tied", tied).withColumn("position", position).drop("block")


def slots(df: DataFrame, column: str) -> DataFrame:
    """Slot tokens parsed: kind (group, third, winner, loser), place and reference. Any other token raises.

    1A is the first of group A, 3ABCD a third of one of these groups, W74 and L101 the winner and loser of a match.
    """
    token = F.col(column)
    kind = F.when(token.rlike("^[12][A-L]$"), "group").when(token.rlike("^3[A-L]{2,}$"), "third").when(token.rlike("^W[0-9]+$"), "winner").when(token.rlike("^L[0-9]+$"), "loser")
    bad = F.raise_error(F.concat(F.lit("unsupported slot "), token)).cast("string")
    return df.withColumn("slot_kind", F.when(token.isNull(), None).otherwise(F.coalesce(kind, bad))).withColumn("slot_place", F.when(token.rlike("^[123]"), F.substring(token, 1, 1).cast("int"))).withColumn("slot_reference", F.substring(token, 2, 100))


def combination(thirds: DataFrame, by: list[str], group: str) -> DataFrame:
    """The sorted letters of the qualified groups, as one key."""
    return thirds.where("qualified").groupBy(*by).agg(F.array_join(F.array_sort(F.collect_list(group)), "").alias("combination"))


def assignment_errors(mapping: DataFrame, size: int = 8) -> DataFrame:
    """Combinations whose slots are not ``size`` distinct admissible groups that make up the combination (combination, slot, group)."""
    groups = F.array_sort(F.collect_set("group"))
    admissible = F.every(F.contains(F.substring("slot", 2, 100), F.col("group")))
    return mapping.groupBy("combination").agg(F.count_distinct("slot").alias("slots"), F.array_join(groups, "").alias("groups"), admissible.alias("admissible")).where((F.col("slots") != size) | (F.col("groups") != F.col("combination")) | ~F.col("admissible"))
