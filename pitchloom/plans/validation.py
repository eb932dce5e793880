"""Temporal validation: models fitted strictly before each holdout, one long table of forecasts, scores and gates.

Goal models of all holdouts and decays come from one scan of the matches. The holdouts are few and known, so the driver loops over what is left.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitchloom.operators import challenger, goals, matches, ratings, scoring
from pitchloom.sources.work import written


@dataclass(frozen=True)
class Holdout:
    """A calendar year and a SQL predicate; training ends strictly before ``cutoff``."""

    name: str
    year: int
    predicate: str
    cutoff: str
    expected: int | None = None


FORECAST = ["match_id", "outcome", *scoring.P]


def _goal_model(games: DataFrame, h: Holdout, xi: float):
    cutoff = F.lit(h.cutoff).cast("date")
    return goals.fit(matches.weighted(games, cutoff, xi), xi, h.cutoff)


def forecasts(games: DataFrame, holdouts: list[Holdout], xi: float, rated: DataFrame | None = None) -> DataFrame:
    """holdout, model (goal_model, rating, uniform), match_id, outcome and P of every holdout match. rated: ``ratings.history`` of the games, if known."""
    games = written(games, "games")
    gaps = ratings.rated(games) if rated is None else ratings.with_ratings(games, rated)
    gaps = written(gaps.withColumn("dr", F.col("rating_difference")), "gaps")
    models = goals.fit_all(games, sorted({h.cutoff for h in holdouts}), [xi])
    parts = []
    for h in holdouts:
        held = matches.holdout(games, h.year, F.expr(h.predicate), h.expected)
        model = models[h.cutoff, xi]
        rows = {"goal_model": goals.with_outcomes(goals.rates(held, model), model.rho)}
        c1, c2, scale = goals.fit_ordered_logit(gaps.where(F.col("date") < F.lit(h.cutoff).cast("date")))
        named = [p.alias(n) for p, n in zip(goals.ordered_logit(F.col("dr"), c1, c2, scale), scoring.P, strict=True)]
        rows["rating"] = matches.holdout(gaps, h.year, F.expr(h.predicate)).select("match_id", "outcome", *named)
        rows["uniform"] = held.select("match_id", "outcome", *[F.lit(1 / 3).alias(n) for n in scoring.P])
        parts += [df.select(F.lit(h.name).alias("holdout"), F.lit(m).alias("model"), *FORECAST) for m, df in rows.items()]
    return reduce(DataFrame.unionByName, parts)


def decay_search(games: DataFrame, holdouts: list[Holdout], grid: tuple[float, ...] = (0.00095, 0.0018)) -> DataFrame:
    """(xi, holdout, n, log_loss) of the goal model; scoring.best_parameter() picks the decay.

    One scan gives the sums of all fits, a second one all forecasts: a match of a holdout meets the models of that holdout.
    """
    models = goals.fit_all(games, sorted({h.cutoff for h in holdouts}), list(grid))
    named = {f"{i} {h.name}": models[h.cutoff, xi] for i, xi in enumerate(grid) for h in holdouts}
    own = [F.when((F.year("date") == h.year) & F.expr(h.predicate), F.struct(F.lit(h.name).alias("holdout"), F.lit(xi).alias("xi"), F.lit(f"{i} {h.name}").alias("fit"))) for i, xi in enumerate(grid) for h in holdouts]
    rows = games.where(F.year("date").isin([h.year for h in holdouts])).select("*", F.explode(F.array_compact(F.array(*own))).alias("__of")).select(*games.columns, "__of.*")
    rated = goals.rates_of(rows, named)
    losses = scoring.losses(goals.with_outcomes(rated, F.col("rho")))
    return losses.groupBy("xi", "holdout").agg(F.count("log_loss").alias("n"), F.avg("log_loss").alias("log_loss"))


def report(games: DataFrame, holdouts: list[Holdout], xi: float) -> DataFrame:
    """Rows and mean scores by holdout and model."""
    return scoring.scores(forecasts(games, holdouts, xi), ["holdout", "model"])


def compare(games: DataFrame, h: Holdout, xi: float, kind: str = "trees", **options) -> DataFrame:
    """model (goal_model, challenger, ensemble), match_id, outcome and P of the eligible matches of a holdout.

    The training rows before the cutoff are split by time: the classifier learns on the earlier part; the calibration is chosen on
    the halves of the later quarter and the weight of the mix on all of it. The same classifier then meets the holdout.
    """
    games = written(games, "games")
    model = _goal_model(games, h, xi)
    known_sides = goals.with_outcomes(goals.rates(ratings.rated(games), model), model.rho)
    table = written(challenger.features_of(games, known_sides).where("eligible and lambda_home_dc is not null"), "features")
    known = table.where(F.col("date") < F.lit(h.cutoff).cast("date"))
    split = written(matches.latest_fraction(known, 0.25, ["date", "match_id"]), "split")
    classifier = challenger.fit(split.where("not recent"), kind, **options)
    late = written(challenger.predict(split.where("recent").drop("recent"), classifier), "late")
    even = F.pmod(F.xxhash64("match_id"), F.lit(2)) == 0
    calibrator = challenger.best_calibration(late.where(even), late.where(~even))

    def both(rows):
        base = [F.col(c).alias(n) for c, n in zip(("p_home_win_dc", "p_draw_dc", "p_away_win_dc"), scoring.P, strict=True)]
        return challenger.calibrated(rows, calibrator).select("match_id", "outcome", *base, *[F.col(c).alias(f"q{c[1:]}") for c in scoring.P])

    weight = challenger.best_mix(both(late)).first()["weight"]
    own = matches.holdout(games, h.year, F.expr(h.predicate)).select("match_id")
    held = both(challenger.predict(table.join(own, "match_id", "left_semi"), classifier))
    mixed = {"goal_model": 0.0, "challenger": 1.0, "ensemble": weight}
    variants = F.array(*[F.struct(F.lit(m).alias("model"), *[(w * F.col(f"q{c[1:]}") + (1 - w) * F.col(c)).alias(c) for c in scoring.P]) for m, w in mixed.items()])
    return held.select("match_id", "outcome", F.explode(variants).alias("v")).select(F.lit(h.name).alias("holdout"), "v.model", "match_id", "outcome", *[F.col(f"v.{c}").alias(c) for c in scoring.P])
