"""Live results in the shape of history: canonical rows, the training set of both, and the audit of a written match table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pitchloom.functions.columns import outcome
from pitchloom.operators.ratings import k_factors

DAY = 86_400_000_000
CANONICAL = ("match_id", "date", "home_team_id", "away_team_id", "home_team_source_name", "away_team_source_name", "home_score", "away_score", "neutral", "shootout_winner_team_id", "result_after_extra_time", "city", "country", "tournament", "source", "source_version")


def canonical_errors(results: DataFrame, fixture: DataFrame) -> DataFrame:
    """(match_id, rule) of each live result that has no place in history; empty if all have one.

    Rules: outside_fixture; no_score; wrong_margin (decided in 90 minutes, but another team advanced); repeated (match_id). A null match_id
    is outside of the fixture.
    """
    known = fixture.select("match_id", F.lit(True).alias("__known")).dropDuplicates(["match_id"])
    ahead = F.when(F.col("goals_a") > F.col("goals_b"), F.col("team_a")).when(F.col("goals_a") < F.col("goals_b"), F.col("team_b"))
    rules = {
        "outside_fixture": F.col("__known").isNull(),
        "no_score": F.col("goals_a").isNull() | F.col("goals_b").isNull(),
        "wrong_margin": F.col("advanced_team") != ahead,
    }
    broken = F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in rules.items()]))
    found = results.join(known, "match_id", "left").select("match_id", F.explode(broken).alias("rule")).distinct()
    repeated = results.groupBy("match_id").count().where("count > 1").select("match_id", F.lit("repeated").alias("rule"))
    return found.unionByName(repeated)


def canonical(results: DataFrame, fixture: DataFrame, as_of: Column, source_version: str, tournament: str, source: str = "live") -> DataFrame:
    """Live results (match_id, team_a, team_b, goals_a, goals_b of 90 minutes, advanced_team) as rows of history, on neutral ground.

    The fixture (match_id, and where it has them kickoff, host_city, host_country) gives date and place; a missing kickoff becomes the day
    as_of, a missing place an empty text. Team names are those of the results, who won a shoot-out is not known. A draw with a team that advanced went on after 90 minutes. A result that breaks a rule of
    ``canonical_errors`` raises; an empty table gives an empty one.
    """
    errors = canonical_errors(results, fixture).orderBy("match_id", "rule").limit(5).collect()  # five for the message
    if errors:
        raise ValueError("live results: " + ", ".join(f"{r['match_id']} {r['rule']}" for r in errors))
    place = lambda c: F.col(c).cast("string") if c in fixture.columns else F.lit(None).cast("string")
    kickoff = F.col("kickoff") if "kickoff" in fixture.columns else F.lit(None).cast("timestamp")
    facts = fixture.select("match_id", kickoff.alias("__kickoff"), place("host_city").alias("__city"), place("host_country").alias("__country")).dropDuplicates(["match_id"])
    day = F.date_from_unix_date(F.floor(F.unix_micros("__kickoff") / DAY).cast("int"))  # of UTC, whatever the session's zone
    return results.join(facts, "match_id").select(
        "match_id", F.coalesce(day, as_of).alias("date"), F.col("team_a").alias("home_team_id"), F.col("team_b").alias("away_team_id"),
        F.col("team_a").alias("home_team_source_name"), F.col("team_b").alias("away_team_source_name"),
        F.col("goals_a").cast("int").alias("home_score"), F.col("goals_b").cast("int").alias("away_score"), F.lit(True).alias("neutral"), F.lit(None).cast("string").alias("shootout_winner_team_id"),
        (F.col("advanced_team").isNotNull() & (F.col("goals_a") == F.col("goals_b"))).alias("result_after_extra_time"),
        F.coalesce("__city", F.lit("")).alias("city"), F.coalesce("__country", F.lit("")).alias("country"),
        F.lit(tournament).alias("tournament"), F.lit(source).alias("source"), F.lit(source_version).alias("source_version"),
    )


def training_set(history: DataFrame, live: DataFrame) -> DataFrame:
    """History and live rows in one table, with the columns of CANONICAL; a match_id in both raises.

    The rows are in no order: ``ratings.history`` and ``sinks.write_once`` order or digest them on their own.
    """
    both = history.join(live.select("match_id"), "match_id", "left_semi").select("match_id").limit(5).collect()
    if both:
        raise ValueError(f"live matches that history has already: {sorted(r['match_id'] for r in both)}")
    return history.select(*CANONICAL).unionByName(live.select(*CANONICAL))


def trainable(training: DataFrame, factors: DataFrame) -> DataFrame:
    """A training set with k_factor (``ratings.k_factors`` of its tournaments), after_extra_time and outcome, as ``ratings.history`` and ``goals.fit`` take it.

    A match with a shoot-out winner went beyond 90 minutes too; an unknown flag means that it did not.
    """
    beyond = F.coalesce("result_after_extra_time", F.lit(False)) | F.col("shootout_winner_team_id").isNotNull()
    rows = k_factors(training, factors).withColumn("after_extra_time", beyond)
    return rows.withColumn("outcome", outcome(F.col("home_score"), F.col("away_score"), F.col("after_extra_time")))


def audit(table: DataFrame, raw: DataFrame, names: DataFrame, source: str) -> DataFrame:
    """One row that holds a written match table against what it was made from.

    table: source, source_version. raw: home_team, away_team, home_score, away_score, as scanned. names: source_name, the known ones.
    Returns rows, completed and unplayed (raw), one_sided (raw rows with one score), versions (distinct, a null or empty one is none),
    unversioned, other_sources, teams (distinct raw names), unresolved (those not known), and passed: rows as many as completed, one
    version on every row, one source, no row with one score, no unresolved name. Empty tables give zeros that don't pass.
    """
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("long")
    scores = F.col("home_score").isNotNull().cast("int") + F.col("away_score").isNotNull().cast("int")
    version = F.nullif(F.col("source_version"), F.lit(""))
    used = raw.select(F.explode(F.array("home_team", "away_team")).alias("name")).where("name is not null").distinct()
    known = names.select(F.col("source_name").alias("__known")).distinct()
    used = used.join(known, F.col("name") == F.col("__known"), "left")
    parts = [
        table.select(F.lit(1).alias("rows"), version.alias("version"), flag(version.isNull()).alias("unversioned"), flag(~F.col("source").eqNullSafe(F.lit(source))).alias("other_sources")),
        raw.select(flag(scores == 2).alias("completed"), flag(scores == 0).alias("unplayed"), flag(scores == 1).alias("one_sided")),
        used.select(F.lit(1).alias("teams"), flag(F.col("__known").isNull()).alias("unresolved")),
    ]
    facts = parts[0].unionByName(parts[1], allowMissingColumns=True).unionByName(parts[2], allowMissingColumns=True)
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c)
    sums = [total(c) for c in ("rows", "completed", "unplayed", "one_sided", "unversioned", "other_sources", "teams", "unresolved")]
    counted = facts.agg(*sums, F.count_distinct("version").alias("versions"))
    return counted.withColumn("passed", F.expr("rows = completed and versions = 1 and unversioned + other_sources + one_sided + unresolved = 0"))
