"""Sequential team ratings, by relaxation over blocks of time.

A rating depends on all earlier matches of both teams, so a pool of teams is one chain. It is cut into blocks of about BLOCK_ROWS
matches in order. In a turn every block runs through its matches in its own task, from the ratings that the blocks before had left in
the turn before (START_RATING at first); what a block leaves goes to the next block in which a team plays, by one window over
(team, block). Blocks whose start has not moved are right and drop out, the first ones at once. Ratings forget where they began, a few
hundred matches of a team later nothing is left of it, so a few turns are enough where blocks are long; where they are short there are never more turns
than blocks. No task holds more than a block, whatever the pool.
"""

from __future__ import annotations

import math

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from pitchloom.functions.columns import HOME_BONUS, SPREAD, START_RATING
from pitchloom.operators.matches import as_of
from pitchloom.sources.work import written

#: Categories of tournaments and their K-factors.
K_CATEGORIES = {"wc": 60, "continental": 50, "qualifier_major": 40, "other": 30, "friendly": 20}
#: Matches of a block, about.
BLOCK_ROWS = 25_000
#: A start that moved by no more than this has not moved.
SAME = 1e-11
STATES = "block int, pool string, team_id string, began double, rating double"
#: What a rating takes of a match.
PLAYED = ("pool", "home_team_id", "away_team_id", "home_score", "away_score", "k_factor", "neutral", "after_extra_time")
HISTORY = "pool string, match_id string, date date, team_id string, opponent_id string, rating_pre double, rating_post double, k_factor int"


def change(elo_home: float, elo_away: float, home: int, away: int, k: int, neutral: bool, drawn: bool) -> float:
    """What the home team gains and the away team loses. The home bonus counts for what is expected, not for the margin."""
    gap = elo_home - elo_away
    expected = 1 / (10 ** (-(gap + (0.0 if neutral else HOME_BONUS)) / SPREAD) + 1)
    margin = 0 if drawn else home - away
    result = 0.5 if margin == 0 else float(margin > 0)
    factor = 1.0 if margin == 0 else math.log(abs(margin) + 1) * 2.2 / ((gap if margin > 0 else -gap) * 0.001 + 2.2)
    return k * factor * (result - expected)


def play(rows: pa.Table, now: dict[tuple, float]) -> tuple[list[float], list[float], list[float]]:
    """Ratings of both sides before each match of a block, in order, and the gain; now, the ratings by (pool, team), follows."""
    homes, aways, gains = [], [], []
    for pool, home, away, scored, conceded, k, neutral, drawn in zip(*(rows[c].to_pylist() for c in PLAYED), strict=True):
        a, b = now.get((pool, home), START_RATING), now.get((pool, away), START_RATING)
        gain = change(a, b, scored, conceded, k, neutral, bool(drawn))
        now[pool, home], now[pool, away] = a + gain, b - gain
        homes.append(a)
        aways.append(b)
        gains.append(gain)
    return homes, aways, gains


def _begin(states: pa.Table) -> dict[tuple, float]:
    return dict(zip(zip(states["pool"].to_pylist(), states["team_id"].to_pylist(), strict=True), states["began"].to_pylist(), strict=True))


def _leave(rows: pa.Table, states: pa.Table) -> pa.Table:
    """The ratings that a block begins with and leaves, for the teams that play in it."""
    began = _begin(states)
    after = dict(began)
    play(rows.sort_by("place"), after)
    teams = sorted(after) if len(rows) else []
    block = rows["block"][0].as_py() if teams else None
    table = [[block] * len(teams), [p for p, _ in teams], [t for _, t in teams], [began.get(t, START_RATING) for t in teams], [after[t] for t in teams]]
    kinds = (pa.int32(), pa.string(), pa.string(), pa.float64(), pa.float64())
    return pa.table([pa.array(c, k) for c, k in zip(table, kinds, strict=True)], names=[c.split()[0] for c in STATES.split(", ")])


def _tell(rows: pa.Table, states: pa.Table) -> pa.Table:
    """Two rows for each match of a block."""
    rows = rows.sort_by("place")
    homes, aways, gains = (pa.array(x, pa.float64()) for x in play(rows, _begin(states)))
    names = [c.split()[0] for c in HISTORY.split(", ")]

    def side(own: str, other: str, before: pa.Array, after: pa.Array) -> pa.Table:
        return pa.table([rows["pool"], rows["match_id"], rows["date"], rows[f"{own}_team_id"], rows[f"{other}_team_id"], before, after, rows["k_factor"]], names=names)

    return pa.concat_tables([side("home", "away", homes, pc.add(homes, gains)), side("away", "home", aways, pc.subtract(aways, gains))])


def relaxed(blocks: DataFrame) -> DataFrame:
    """block, pool, team_id and ``began``, the rating that the team brings into the block, for all blocks in which it plays."""
    spark = blocks.sparkSession
    blocks = blocks.select("block", "place", *PLAYED)  # a turn takes no more
    starts, states, running = spark.createDataFrame([], STATES), None, blocks
    before = F.lag("rating").over(Window.partitionBy("pool", "team_id").orderBy("block"))
    while True:
        fresh = running.groupBy("block").cogroup(starts.groupBy("block")).applyInArrow(_leave, STATES)
        if states is not None:
            fresh = fresh.unionByName(states.join(moved, "block", "left_anti"))
        states = written(fresh, "states")
        now = written(states.withColumn("next", F.coalesce(before, F.lit(START_RATING))), "starts")
        moved = now.where(F.abs(F.col("next") - F.col("began")) > SAME).select("block").distinct()
        starts = now.select("block", "pool", "team_id", F.col("next").alias("began"), "rating")
        if moved.isEmpty():
            return starts
        running = blocks.join(moved, "block", "left_semi")
        starts = starts.join(moved, "block", "left_semi")


def _blocked(matches: DataFrame, pool: str | None, block_rows: int, own: list[str]) -> tuple[DataFrame, DataFrame]:
    """Blocks of matches with PLAYED, place and their own columns ``own`` as ``row``, and the ratings that teams bring into each block."""
    key = F.col(pool).cast("string") if pool else F.lit("all")
    row = F.struct(*[F.col(f"`{c}`") for c in own]) if own else F.lit(None).cast("int")
    columns = [F.col(c) for c in ("home_team_id", "away_team_id", "home_score", "away_score")] + [F.col("k_factor").cast("int").alias("k_factor"), F.col("neutral"), F.col("after_extra_time")]
    rows = written(matches.select(key.alias("pool"), "match_id", "date", *columns, row.alias("row")), "rated")
    parts = -(-rows.count() // block_rows)
    if parts <= 1:
        blocks = rows.withColumns({"block": F.lit(0), "place": F.struct("pool", "date", "match_id")})
        blocks = blocks.withColumn("place", F.row_number().over(Window.partitionBy("block").orderBy("place")))  # one block
        return blocks, rows.sparkSession.createDataFrame([], STATES)
    order = ["pool", "date", "match_id"]
    dealt = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    blocks = written(dealt.withColumns({"block": F.spark_partition_id(), "place": F.monotonically_increasing_id()}), "blocks")
    return blocks, relaxed(blocks)


def history(matches: DataFrame, pool: str | None = None, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Two rows per match with the ratings before and after it, in order of (date, match_id) from START_RATING on."""
    blocks, starts = _blocked(matches, pool, block_rows, [])
    return blocks.drop("row").groupBy("block").cogroup(starts.groupBy("block")).applyInArrow(_tell, HISTORY)


def rated(matches: DataFrame, pool: str | None = None, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``with_ratings`` of matches and their own history, without a join: a block gives back its matches, each with what both sides had before it."""
    blocks, starts = _blocked(matches, pool, block_rows, matches.columns)
    names = ("home_rating", "away_rating")

    def tell(rows: pa.Table, states: pa.Table) -> pa.Table:
        rows = rows.sort_by("place")
        homes, aways, _ = play(rows, _begin(states))
        return pa.table([rows["row"], pa.array(homes, pa.float64()), pa.array(aways, pa.float64())], names=["row", *names])

    schema = StructType([blocks.schema["row"], *[StructField(n, DoubleType()) for n in names]])
    found = blocks.select("block", "place", *PLAYED, "row").groupBy("block").cogroup(starts.groupBy("block")).applyInArrow(tell, schema)
    return _with_difference(found.select("row.*", *names))


def latest(matches: DataFrame, pool: str | None = None, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """pool, team_id and rating after its last match of every team, from what the blocks leave: no row for each match."""
    blocks, starts = _blocked(matches, pool, block_rows, [])
    left = blocks.select("block", "place", *PLAYED).groupBy("block").cogroup(starts.select("block", "pool", "team_id", "began", "rating").groupBy("block")).applyInArrow(_leave, STATES)
    return left.groupBy("pool", "team_id").agg(F.max_by("rating", "block").alias("rating"))


def leaderboard(rated: DataFrame) -> DataFrame:
    """Last rating of each team and its dense rank; the rank runs over one row per team."""
    return ranked(rated.groupBy("team_id").agg(F.max_by("rating_post", F.struct("date", "match_id")).alias("rating")))


def ranked(last: DataFrame) -> DataFrame:
    """team_id and rating, one row per team, with its dense rank."""
    return last.select("team_id", "rating").withColumn("rank", F.dense_rank().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("rating"))))


def before(rated: DataFrame, days: DataFrame, day: str) -> DataFrame:
    """days (team_id and a date column) with each team's last rating strictly before the day, START_RATING if there is none."""
    last = rated.groupBy("team_id", "date").agg(F.max_by("rating_post", "match_id").alias("rating"))
    events = days.withColumn("__at", F.col(day))
    return as_of(events, last.withColumnRenamed("date", "__at"), "team_id", "__at", "rating", START_RATING).drop("__at")


def k_factors(matches: DataFrame, table: DataFrame) -> DataFrame:
    """matches with k_factor, by the exact name of their tournament. table (tournament, k_category, k_factor) is a reviewed list, one row
    per name; an unknown category, a factor that is not its category's, a repeated name or a match without an entry raises."""
    known = F.create_map(*[F.lit(x) for pair in K_CATEGORIES.items() for x in pair])
    bad = table.where(F.coalesce(known[F.col("k_category")] != F.col("k_factor"), F.lit(True)))
    if not bad.isEmpty() or not table.groupBy("tournament").count().where("count > 1").isEmpty():
        raise ValueError("K-factor table: unknown categories, factors that differ from their category, or repeated names")
    joined = matches.drop("k_factor").join(table.select("tournament", F.col("k_factor").cast("int").alias("__k")), "tournament", "left")
    missing = F.raise_error(F.concat(F.lit("no K-factor for tournament "), F.coalesce("tournament", F.lit("null")))).cast("int")
    return joined.withColumn("k_factor", F.coalesce("__k", missing)).drop("__k")


def with_ratings(matches: DataFrame, rated: DataFrame) -> DataFrame:
    """Matches with both pre-match ratings and their difference (home bonus unless neutral); nulls where a rating is missing."""
    side = lambda p: rated.select("match_id", F.col("team_id").alias(f"{p}_team_id"), F.col("rating_pre").alias(f"{p}_rating"))
    joined = matches.join(side("home"), ["match_id", "home_team_id"], "left").join(side("away"), ["match_id", "away_team_id"], "left")
    return _with_difference(joined)


def _with_difference(rows: DataFrame) -> DataFrame:
    return rows.withColumn("rating_difference", F.col("home_rating") + F.when(F.col("neutral"), 0.0).otherwise(HOME_BONUS) - F.col("away_rating"))
