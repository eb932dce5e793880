"""Bookmaker markets: de-margined quotes, fixture links, consensus, ledgers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pitchloom.functions.columns import implied, normalized, pair_key


def demargined(quotes: DataFrame) -> DataFrame:
    """quotes with prob_home, prob_draw, prob_away and overround; null where a price is not above 1."""
    prices = [F.col(c) for c in ("price_home", "price_draw", "price_away")]
    out = quotes.withColumns(dict(zip(("prob_home", "prob_draw", "prob_away"), implied(*prices), strict=True)))
    return out.withColumn("overround", F.when(F.col("prob_home").isNotNull(), 1 / prices[0] + 1 / prices[1] + 1 / prices[2] - 1))


def linked(quotes: DataFrame, fixture: DataFrame, key: list[str], hours: float = 12) -> DataFrame:
    """quotes (home_team_id, away_team_id, commence_time) with n_fixtures and, if that is 1, match_id and whether the sides are swapped.

    An equi-join on the unordered pair and a span of time as long as the tolerance: a fixture stands in its own span and in both next to it, and
    those of a pair and span are one short array, with one entry for each kickoff however many fixtures share it. So a quote meets one row, is not grouped again, and a frequent pair is no hot key.
    """
    span = int(hours * 3_600_000_000)
    own = F.floor(F.unix_micros("kickoff") / span)
    f = fixture.where("match_id is not null and kickoff is not null").select(pair_key(F.col("home_team_id"), F.col("away_team_id")).alias("__pair"), F.unix_micros("kickoff").alias("__at"), own.alias("__own"), "match_id", "home_team_id")
    f = f.groupBy("__pair", "__own", "__at").agg(F.count("*").alias("n"), F.min("match_id").alias("match_id"), F.min("home_team_id").alias("home"))
    entry = F.struct(F.col("__at").alias("at"), "n", "match_id", "home")
    f = f.select("__pair", entry.alias("__one"), F.explode(F.array(F.col("__own") - 1, F.col("__own"), F.col("__own") + 1)).alias("__span"))
    f = f.groupBy("__pair", "__span").agg(F.collect_list("__one").alias("__all"))
    mine = quotes.withColumn("__p", pair_key(F.col("home_team_id"), F.col("away_team_id"))).withColumn("__s", F.floor(F.unix_micros("commence_time") / span))
    found = mine.join(f, (F.col("__p") == F.col("__pair")) & (F.col("__s") == F.col("__span")), "left")
    near = F.coalesce(F.filter("__all", lambda x: F.abs(x["at"] - F.unix_micros("commence_time")) <= span), F.array().cast(found.schema["__all"].dataType))
    total = F.aggregate("__near", F.lit(0).cast("long"), lambda n, x: n + x["n"]).cast("int")
    one, only = F.get("__near", F.lit(0)), F.col("__n") == 1
    rest = [c for c in quotes.columns if c not in key]
    counted = found.withColumn("__near", near).withColumn("__n", total)
    return counted.select(*key, *rest, F.col("__n").alias("n_fixtures"), F.when(only, one["match_id"]).alias("match_id"), F.when(only, one["home"] != F.col("home_team_id")).alias("swapped"))


def oriented(df: DataFrame, home: str, away: str, swapped: str = "swapped") -> DataFrame:
    """Two columns exchanged where the sides are swapped."""
    return df.withColumns({home: F.when(F.col(swapped), F.col(away)).otherwise(F.col(home)), away: F.when(F.col(swapped), F.col(home)).otherwise(F.col(away))})


def fresh(quotes: DataFrame, as_of: Column, hours: float = 24) -> DataFrame:
    """Quotes captured at most so long before the instant, and not after it."""
    age = F.unix_micros(as_of) - F.unix_micros("captured_at")
    return quotes.where((age >= 0) & (age <= int(hours * 3_600_000_000)))


def consensus(probabilities: DataFrame, by: list[str]) -> DataFrame:
    """Medians over bookmakers, normalized; means; number of bookmakers. One aggregation brings the few quotes of a match together.

    Quotes without probabilities are left out inside the aggregation: the optimizer would put a filter below what makes the probabilities, and make them there again.
    """
    names = ("home", "draw", "away")

    def median(name):
        n = F.size("__q")
        return (F.get(f"__{name}s", F.floor((n - 1) / 2).cast("int")) + F.get(f"__{name}s", F.floor(n / 2).cast("int"))) / 2

    priced = F.col("prob_home").isNotNull() & ~F.isnan("prob_home")
    one = F.struct(*[f"prob_{n}" for n in names], "bookmaker")
    table = probabilities.groupBy(*by).agg(F.collect_list(F.when(priced, one)).alias("__q"), *[F.avg(F.when(priced, F.col(f"prob_{n}"))).alias(f"prob_{n}_mean") for n in names]).where(F.size("__q") > 0)
    bookmakers = F.size(F.array_distinct(F.filter(F.transform("__q", lambda q: q["bookmaker"]), lambda b: b.isNotNull()))).cast("long")
    table = table.withColumns({f"__{n}s": F.array_sort(f"__q.prob_{n}") for n in names})
    table = table.select("*", *[median(n).alias(f"__{n}") for n in names], bookmakers.alias("n_bookmakers"))
    shares = normalized(*[F.col(f"__{n}") for n in names])
    return table.select(*by, *[s.alias(f"prob_{n}") for s, n in zip(shares, names, strict=True)], *[f"prob_{n}_mean" for n in names], "n_bookmakers")


def ledger_rows(predictions: DataFrame, market: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Priced predictions with the market's probabilities and the outcome where known (joined at read time, so it fills in later)."""
    m = market.select("match_id", *[F.col(f"prob_{n}").alias(f"market_{n}") for n in ("home", "draw", "away")])
    return predictions.join(m, "match_id").join(outcomes.select("match_id", "outcome"), "match_id", "left")


def deltas(series: DataFrame, snapshot: str, key: str, value: str) -> DataFrame:
    """Each key's value per snapshot, the change to the snapshot before and to the first one (zero where there is none)."""
    w = Window.partitionBy(key).orderBy(snapshot)
    return series.select(snapshot, key, value, (F.col(value) - F.coalesce(F.lag(value).over(w), F.col(value))).alias("to_previous"), (F.col(value) - F.first(value).over(w)).alias("to_first"))


def publication(baseline: DataFrame, eligibility: DataFrame, challenger: DataFrame, promoted: bool) -> DataFrame:
    """One row per baseline prediction: the published family and why the challenger was not taken.

    Reasons by priority: not_promoted, ineligible, no_prediction.
    """
    joined = baseline.join(eligibility.select("match_id", "eligible"), "match_id", "left").join(challenger.select("match_id", *[F.col(c).alias(f"__{c}") for c in ("p_home", "p_draw", "p_away")]), "match_id", "left")
    reason = F.when(~F.lit(promoted), "not_promoted").when(~F.coalesce("eligible", F.lit(False)), "ineligible").when(F.col("__p_home").isNull(), "no_prediction")
    out = joined.withColumn("fallback_reason", reason).withColumn("published_family", F.when(F.col("fallback_reason").isNull(), "challenger").otherwise("baseline"))
    for c in ("p_home", "p_draw", "p_away"):
        out = out.withColumn(c, F.when(F.col("published_family") == "challenger", F.col(f"__{c}")).otherwise(F.col(c)))
    return out.drop("__p_home", "__p_draw", "__p_away", "eligible")


def disagreements(ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """Matches whose goals or set of participants differ between two result tables."""
    o, t = ours.alias("o"), theirs.alias("t")
    teams = lambda x: F.array_sort(F.array(f"{x}.team_a", f"{x}.team_b"))
    goals = (F.col("o.goals_a") != F.col("t.goals_a")) | (F.col("o.goals_b") != F.col("t.goals_b"))
    return o.join(t, F.col("o.match_id") == F.col("t.match_id")).where(goals | (teams("o") != teams("t"))).select("o.match_id", goals.alias("goals_differ"), (teams("o") != teams("t")).alias("teams_differ"))
