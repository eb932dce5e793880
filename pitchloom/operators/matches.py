"""Match tables: perspectives, cutoffs, holdouts, shoot-outs, upcoming and due matches."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pitchloom.functions.columns import decay, points


def perspectives(matches: DataFrame) -> DataFrame:
    """Two rows per match, one for each team."""

    def side(own, other, home):
        return F.struct(
            F.col(f"{own}_team_id").alias("team_id"),
            F.col(f"{other}_team_id").alias("opponent_id"),
            F.col(f"{own}_score").alias("scored"),
            F.col(f"{other}_score").alias("conceded"),
            F.lit(home).alias("is_home"),
        )

    rest = [c for c in matches.columns if c not in ("home_team_id", "away_team_id", "home_score", "away_score")]
    return matches.select(*rest, F.explode(F.array(side("home", "away", True), side("away", "home", False))).alias("s")).select(*rest, "s.*").withColumn("points", points(F.col("scored"), F.col("conceded")))


def weighted(matches: DataFrame, cutoff: Column, xi: float, least: float = 1e-4) -> DataFrame:
    """Rows strictly before the cutoff with their decay weight, without those below ``least``.

    The truncation is stated as a date bound as well, which the parquet scan can use.
    """
    horizon = int(math.log(1 / least) / xi) + 1
    rows = matches.where((F.col("date") < cutoff) & (F.col("date") >= F.date_sub(cutoff, horizon)))
    return rows.withColumn("weight", decay(F.datediff(cutoff, F.col("date")), xi)).where(F.col("weight") >= least)


def holdout(matches: DataFrame, year: int, predicate: Column, expected: int | None = None) -> DataFrame:
    """Rows of one calendar year that meet the predicate; another number of rows than expected raises."""
    rows = matches.where((F.year("date") == year) & predicate)
    if expected is not None and (n := rows.count()) != expected:
        raise ValueError(f"holdout of {year}: {n} rows, {expected} expected")
    return rows


def with_shootouts(results: DataFrame, shootouts: DataFrame) -> DataFrame:
    """Results with the shoot-out winner; a match with two shoot-out rows raises."""
    keys = ["date", "home_team_id", "away_team_id"]
    if not shootouts.groupBy(*keys).count().where("count > 1").isEmpty():
        raise ValueError("shoot-outs: several rows for one match")
    joined = results.join(shootouts.select(*keys, F.col("winner").alias("shootout_winner_team_id")), keys, "left")
    return joined.withColumn("after_extra_time", F.col("shootout_winner_team_id").isNotNull())


def half_played(results: DataFrame) -> DataFrame:
    """Rows with exactly one score."""
    return results.where(F.col("home_score").isNull() != F.col("away_score").isNull())


def upcoming(fixture: DataFrame, played: DataFrame) -> DataFrame:
    """Group matches with both teams assigned that are not played."""
    return fixture.where("stage = 'group' and home_team_id is not null and away_team_id is not null").join(played.select("match_id"), "match_id", "left_anti")


def overdue(fixture: DataFrame, played: DataFrame, as_of: Column, excused: list[str] | None = None) -> DataFrame:
    """Matches whose kickoff has passed, without a result and not excused."""
    rows = fixture.where(F.col("kickoff") <= as_of)
    if excused:
        rows = rows.where(~F.col("match_id").isin(excused))
    return rows.join(played.select("match_id"), "match_id", "left_anti")


def kickoff_boundary(fixture: DataFrame, played: DataFrame, now: Column) -> DataFrame:
    """One instant: the next open kickoff, else the last open one, else the last one at all."""
    rows = fixture.join(played.select("match_id", F.lit(True).alias("__played")), "match_id", "left")
    still_open = F.col("__played").isNull()
    return rows.agg(F.coalesce(F.min(F.when(still_open & (F.col("kickoff") > now), F.col("kickoff"))), F.max(F.when(still_open, F.col("kickoff"))), F.max("kickoff")).alias("boundary"))


def latest_fraction(rows: DataFrame, fraction: float, order: list[str]) -> DataFrame:
    """rows with ``recent``: the last share of them by order, at least one, leaving at least one.

    Counts by the first order column (a date: few values) find the date at which the share begins; only the rows of that date are sorted.
    """
    n = rows.count()
    k = max(1, min(n - 1, round(n * fraction)))
    counts = rows.groupBy(order[0]).agg(F.count("*").alias("c"))
    upto = F.sum("c").over(Window.partitionBy(F.lit(0)).orderBy(F.desc(order[0])))
    found = counts.withColumn("upto", upto).where((F.col("upto") >= k) & (F.col("upto") - F.col("c") < k)).first()
    if found is None:
        return rows.withColumn("recent", F.lit(False))
    own = rows.where(F.col(order[0]).eqNullSafe(F.lit(found[order[0]]))).select(F.struct(*order).alias("o"))
    bound = own.orderBy(F.desc("o")).limit(k - (found["upto"] - found["c"])).agg(F.min("o").alias("bound"))  # rows of one date
    return rows.join(F.broadcast(bound), how="cross").withColumn("recent", F.struct(*order) >= F.col("bound")).drop("bound")  # one row


def rolling_form(sides: DataFrame, last: int = 5, enough: int = 5) -> DataFrame:
    """Per team and match, over strictly prior rows: mean points, goals for, against and difference of the last five, prior matches,
    whether there are enough, and days of rest (null at first)."""
    order = Window.partitionBy("team_id").orderBy("date", "match_id")
    near = order.rowsBetween(-last, -1)
    mean = lambda c: F.coalesce(F.avg(c).over(near), F.lit(0.0))
    prior = F.count("*").over(order.rowsBetween(Window.unboundedPreceding, -1))
    return sides.select(
        "match_id", "date", "team_id", "is_home",
        mean("points").alias("form_points"), mean("scored").alias("form_scored"), mean("conceded").alias("form_conceded"), mean(F.col("scored") - F.col("conceded")).alias("form_difference"),
        prior.alias("n_prior"), (prior >= enough).alias("eligible"), F.datediff("date", F.lag("date").over(order)).alias("rest_days"),
    )


def as_of(events: DataFrame, history: DataFrame, key: str, at: str, value: str, default: float) -> DataFrame:
    """events with the last value of their key strictly before their time.

    One union, one shuffle by key, one running window: no row pairs are formed, so a hot key costs its rows alone.
    """
    left = events.select(F.struct(*events.columns).alias("e"), F.col(key).alias("k"), F.col(at).alias("t"), F.lit(0).alias("side"), F.lit(None).cast("double").alias("v"))
    right = history.select(F.lit(None).cast(left.schema["e"].dataType).alias("e"), F.col(key).alias("k"), F.col(at).alias("t"), F.lit(1).alias("side"), F.col(value).cast("double").alias("v"))
    last = F.last("v", ignorenulls=True).over(Window.partitionBy("k").orderBy("t", "side").rowsBetween(Window.unboundedPreceding, -1))
    return left.unionByName(right).withColumn("found", last).where("side = 0").select("e.*", F.coalesce("found", F.lit(default)).alias(value))
