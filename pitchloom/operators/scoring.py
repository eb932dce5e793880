"""Forecast scores and gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pitchloom.functions.columns import brier, log_loss, picked, ranked_probability

P = ("p_home", "p_draw", "p_away")


def losses(predictions: DataFrame, outcome: str = "outcome", p: tuple[str, ...] = P) -> DataFrame:
    """predictions with log_loss, brier and rps of each row (null while the outcome is)."""
    columns = [F.col(c) for c in p]
    total = columns[0] + columns[1] + columns[2]
    happened = F.col(outcome)
    known = happened.isNotNull()
    return (
        predictions.withColumn("log_loss", F.when(known, log_loss(picked(columns, happened) / total)))
        .withColumn("brier", F.when(known, brier(columns, happened)))
        .withColumn("rps", F.when(known, ranked_probability(columns, happened)))
    )


def scores(predictions: DataFrame, by: list[str]) -> DataFrame:
    """Rows and mean scores of resolved predictions in each group."""
    rows = losses(predictions).where("outcome is not null")
    return rows.groupBy(*by).agg(F.count("*").alias("n"), *[F.avg(c).alias(c) for c in ("log_loss", "brier", "rps")])


def cumulative(predictions: DataFrame, snapshot: str) -> DataFrame:
    """Mean scores over all resolved rows up to each snapshot; snapshots before the first resolved row give none.

    Rows are summed by snapshot first, so the running window has one row per snapshot.
    """
    sums = losses(predictions).where("outcome is not null").groupBy(snapshot).agg(F.count("*").alias("c"), *[F.sum(x).alias(f"s_{x}") for x in ("log_loss", "brier", "rps")])
    w = Window.partitionBy(F.lit(0)).orderBy(snapshot).rowsBetween(Window.unboundedPreceding, 0)
    n = F.sum("c").over(w)
    return sums.select(snapshot, n.alias("n"), *[(F.sum(f"s_{x}").over(w) / n).alias(x) for x in ("log_loss", "brier", "rps")])


def best_parameter(table: DataFrame, parameter: str, loss: str = "log_loss") -> DataFrame:
    """The parameter whose mean loss over holdouts is least; the smaller one of a tie."""
    means = table.groupBy(parameter).agg(F.avg(loss).alias("mean_loss"), F.count("*").alias("holdouts"))
    return means.agg(F.min_by(parameter, F.struct("mean_loss", parameter)).alias(parameter), F.min("mean_loss").alias("mean_loss"))


def gate(table: DataFrame, baseline: str, candidates: list[str], every: bool = True) -> DataFrame:
    """(model, mean_loss, passed): passed if lower than the baseline on every holdout (or on the mean). Table: holdout, model, log_loss."""
    base = table.where(F.col("model") == baseline).select("holdout", F.col("log_loss").alias("base"))
    joined = table.where(F.col("model").isin(candidates)).join(base, "holdout")
    passed: Column = F.every(F.col("log_loss") < F.col("base")) if every else F.avg("log_loss") < F.avg("base")
    return joined.groupBy("model").agg(F.avg("log_loss").alias("mean_loss"), passed.alias("passed"))


def winner(gates: DataFrame, baseline: str, order: list[str]) -> DataFrame:
    """One row: the passed model of the lowest mean loss (ties by the given order), or the baseline."""
    place = F.array_position(F.array(*[F.lit(m) for m in order]), F.col("model"))
    return gates.agg(F.coalesce(F.min_by("model", F.when(F.col("passed"), F.struct("mean_loss", place))), F.lit(baseline)).alias("winner"))
