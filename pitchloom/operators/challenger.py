"""The supervised challenger: point-in-time features, a classifier, calibration, and its mix with the baseline."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pitchloom.functions.columns import log_loss, picked
from pitchloom.operators import boosting, ratings
from pitchloom.operators.matches import perspectives, rolling_form
from pitchloom.operators.scoring import P

#: The feature contract, in its order.
FEATURES = (
    "elo_diff",
    "is_host_home",
    "days_rest_diff",
    "form_points_diff_last_5",
    "goal_diff_per_match_diff_last_5",
    "goals_for_per_match_diff_last_5",
    "goals_against_per_match_diff_last_5",
    "lambda_home_dc",
    "lambda_away_dc",
    "p_home_win_dc",
    "p_draw_dc",
    "p_away_win_dc",
)
#: Ways to calibrate; of equal losses the first one is taken.
METHODS = ("none", "sigmoid", "isotonic")


def features(matches: DataFrame, history: DataFrame, forecasts: DataFrame) -> DataFrame:
    """Every match with its features, eligibility and numbers of prior matches; nothing of the match itself or later enters.

    forecasts: match_id, rate_home, rate_away, p_home, p_draw, p_away of the goal model. Features that cannot be known (rest before a first match) are null.
    """
    goal_model = forecasts.select("match_id", "rate_home", "rate_away", *P)
    return features_of(matches, ratings.with_ratings(matches, history).join(goal_model, "match_id", "left"))


def features_of(matches: DataFrame, known: DataFrame) -> DataFrame:
    """``features`` where known already has matches with rating_difference and the goal model's columns.

    The two sides of a match meet in one hash aggregation of plain numbers, of which each has one value.
    """
    form = rolling_form(perspectives(matches))
    values = ("form_points", "form_scored", "form_conceded", "form_difference", "n_prior", "eligible", "rest_days")
    own = [F.max(F.when(F.col("is_home") == at, F.col(c))).alias(f"{s}_{c}") for s, at in (("h", True), ("a", False)) for c in values]
    sides = form.groupBy("match_id").agg(*own)
    joined = known.join(sides, "match_id")

    def gap(c):
        return F.col(f"h_{c}") - F.col(f"a_{c}")

    columns = (F.col("rating_difference"), F.when(F.col("neutral"), 0.0).otherwise(1.0), gap("rest_days").cast("double"), gap("form_points"), gap("form_difference"), gap("form_scored"), gap("form_conceded"), *map(F.col, ("rate_home", "rate_away", *P)))
    return joined.select(
        "match_id", "date", "outcome",
        F.col("h_n_prior").alias("n_prior_home"), F.col("a_n_prior").alias("n_prior_away"), (F.col("h_eligible") & F.col("a_eligible")).alias("eligible"),
        *[c.alias(n) for c, n in zip(columns, FEATURES, strict=True)],
    )


def _assembled(rows: DataFrame) -> DataFrame:
    """With the feature vector; an unknown feature counts as zero, that is no difference between the sides."""
    return VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(rows.fillna(0.0, subset=list(FEATURES)))


@dataclass(frozen=True)
class Classifier:
    """A multinomial model of pyspark.ml, or boosted trees."""

    model: Any


def fit(rows: DataFrame, kind: str = "trees", **options) -> Classifier:
    """Fit on rows with match_id, FEATURES and outcome. kind: ``trees`` (``boosting.fit`` with its options; unknown features stay unknown) or ``logistic``."""
    seen = {r["outcome"] for r in rows.select("outcome").distinct().collect()}  # classes
    if seen != {0, 1, 2}:
        raise ValueError(f"challenger: outcomes {sorted(seen, key=str)}, 0, 1 and 2 expected")
    if kind == "trees":
        return Classifier(boosting.fit(rows, FEATURES, "match_id", "outcome", **options))
    return Classifier(LogisticRegression(labelCol="outcome", family="multinomial", regParam=1e-3).fit(_assembled(rows)))


def _shares(parts: list[Column]) -> list[Column]:
    """Clipped to [0, 1] and normalized; three zeros become thirds."""
    parts = [F.least(F.greatest(p, F.lit(0.0)), F.lit(1.0)) for p in parts]
    total = parts[0] + parts[1] + parts[2]
    return [F.when(total > 0, p / F.nullif(total, F.lit(0.0))).otherwise(1 / 3) for p in parts]


def predict(rows: DataFrame, classifier: Classifier) -> DataFrame:
    """rows with p_home, p_draw and p_away."""
    model = classifier.model
    if isinstance(model, boosting.Boosted):
        out = rows.withColumn("__p", boosting.probabilities(model))
    else:
        out = model.copy({model.probabilityCol: "__v", model.rawPredictionCol: "__r", model.predictionCol: "__y"}).transform(_assembled(rows)).withColumn("__p", vector_to_array("__v"))
    return out.select(*rows.columns, *[s.alias(n) for s, n in zip(_shares([F.col("__p")[i] for i in range(3)]), P, strict=True)])


@dataclass(frozen=True)
class Calibrator:
    """method, and for each class what maps its probability: slope and intercept, or an isotonic model."""

    method: str
    maps: tuple[Any, ...] = ()


def calibrate(rows: DataFrame, method: str) -> Calibrator:
    """Fit on rows with P and outcome, one class against the rest."""
    if method not in METHODS:
        raise ValueError(f"unknown calibration {method!r}")
    maps: list[Any] = []
    for c, name in enumerate(P) if method != "none" else ():
        hit = F.when(F.col("outcome") == c, 1.0).otherwise(0.0)
        if method == "isotonic":
            maps.append(IsotonicRegression(featuresCol=name, labelCol="label").fit(rows.select(name, hit.alias("label"))))
            continue
        n, n_hit = rows.agg(F.count("*"), F.coalesce(F.sum(hit), F.lit(0.0))).first()
        # Smoothed targets: each row stands for both labels, by weight.
        target = F.when(F.col("outcome") == c, (n_hit + 1) / (n_hit + 2)).otherwise(1 / (n - n_hit + 2))
        both = F.array(F.struct(F.lit(1.0).alias("label"), target.alias("w")), F.struct(F.lit(0.0).alias("label"), (1 - target).alias("w")))
        table = rows.select(name, F.explode(both).alias("b")).select(name, "b.label", "b.w")
        model = LogisticRegression(labelCol="label", weightCol="w").fit(VectorAssembler(inputCols=[name], outputCol="features").transform(table))
        maps.append((float(model.coefficients[0]), float(model.intercept)))
    return Calibrator(method, tuple(maps))


def calibrated(rows: DataFrame, calibrator: Calibrator) -> DataFrame:
    """rows with P mapped, clipped and normalized."""
    if calibrator.method == "none":
        return rows
    out, parts = rows, []
    for name, m in zip(P, calibrator.maps, strict=True):
        if calibrator.method == "isotonic":
            out = m.copy({m.featuresCol: name, m.predictionCol: f"__{name}"}).transform(out)
            parts.append(F.col(f"__{name}"))
        else:
            parts.append(1 / (1 + F.exp(-(F.lit(m[0]) * F.col(name) + F.lit(m[1])))))
    return out.withColumns(dict(zip(P, _shares(parts), strict=True))).select(*rows.columns)


def best_calibration(fit_rows: DataFrame, score_rows: DataFrame) -> Calibrator:
    """The method fitted on one slice whose mean log-loss on the other is least."""
    found = []
    for place, method in enumerate(METHODS):
        calibrator = calibrate(fit_rows, method)
        loss = calibrated(score_rows, calibrator).agg(F.avg(log_loss(picked([F.col(c) for c in P], F.col("outcome"))))).first()[0]
        found.append((float("inf") if loss is None else loss, place, calibrator))
    return min(found, key=lambda x: x[:2])[2]


def mix_losses(rows: DataFrame, points: int = 11) -> DataFrame:
    """(weight, log_loss) of weight * challenger + (1 - weight) * baseline over an even grid, all in one aggregation.

    rows: p_home, p_draw, p_away (baseline), q_home, q_draw, q_away (challenger), outcome.
    """
    weights = [i / (points - 1) for i in range(points)]

    def loss(w):
        return F.avg(log_loss(picked([w * F.col(f"q{c[1:]}") + (1 - w) * F.col(c) for c in P], F.col("outcome"))))

    sums = rows.agg(*[loss(w).alias(f"w{i}") for i, w in enumerate(weights)])
    return sums.select(F.explode(F.array(*[F.struct(F.lit(w).alias("weight"), F.col(f"w{i}").alias("log_loss")) for i, w in enumerate(weights)])).alias("x")).select("x.*")


def best_mix(rows: DataFrame, points: int = 11) -> DataFrame:
    """One row: the weight of the least loss (the smaller of equals) and that loss."""
    return mix_losses(rows, points).agg(F.min_by("weight", F.struct("log_loss", "weight")).alias("weight"), F.min("log_loss").alias("log_loss"))
