"""Challenger, temporal validation, sinks and the live stream."""

import math

import pytest
from pyspark.sql import functions as F

from pitchloom.operators import challenger, contracts, ratings
from pitchloom.operators.scoring import P
from pitchloom.plans import queries as Q
from pitchloom.plans import validation
from pitchloom.sources import scans, sinks
from pitchloom.streaming import live

GAME = "match_id string, date date, home_team_id string, away_team_id string, home_score int, away_score int, neutral boolean, after_extra_time boolean, k_factor int, outcome int"


def games(spark):
    df = spark.createDataFrame([(1, "2020-01-01", "a", "b", 2, 0), (2, "2020-01-05", "b", "a", 1, 1), (3, "2020-01-09", "a", "b", 0, 3)], "n int, d string, h string, w string, x int, y int")
    return df.selectExpr("concat('m', n) match_id", "date(d) date", "h home_team_id", "w away_team_id", "x home_score", "y away_score", "false neutral", "false after_extra_time", "20 k_factor", "case when x > y then 0 when x = y then 1 else 2 end outcome")


def test_features_look_back_only(spark):
    g = games(spark)
    forecasts = g.select("match_id", *[F.lit(1.0).alias(c) for c in ("rate_home", "rate_away", *P)])
    got = {r["match_id"]: r for r in challenger.features(g, ratings.history(g), forecasts).collect()}
    first, third = got["m1"], got["m3"]
    assert first["elo_diff"] == 100 and first["days_rest_diff"] is None and first["n_prior_home"] == 0
    assert third["form_points_diff_last_5"] == pytest.approx(2.0 - 0.5) and third["goal_diff_per_match_diff_last_5"] == pytest.approx(2.0)
    assert third["days_rest_diff"] == 0 and third["n_prior_away"] == 2 and not third["eligible"]
    changed = g.withColumn("home_score", F.when(F.col("match_id") == "m3", 9).otherwise(F.col("home_score")))
    again = {r["match_id"]: r for r in challenger.features(changed, ratings.history(changed), forecasts).collect()}
    assert again["m3"]["elo_diff"] == third["elo_diff"] and again["m3"]["form_points_diff_last_5"] == third["form_points_diff_last_5"]


def table(spark, n=240):
    """The outcome follows the first feature."""
    x = F.col("id") % 3
    other = [F.lit(0.0).alias(c) for c in challenger.FEATURES[1:]]
    return spark.range(n).select(F.concat(F.lit("m"), "id").alias("match_id"), F.when(F.col("id") % 10 == 0, 1).otherwise(x).cast("int").alias("outcome"), (x * 100.0).alias("elo_diff"), *other)


@pytest.mark.parametrize("kind", ["trees", "logistic"])
def test_classifiers_give_probabilities(spark, kind):
    rows = table(spark)
    options = {"rounds": 3, "rate": 0.5} if kind == "trees" else {}
    got = challenger.predict(rows, challenger.fit(rows, kind, **options)).toPandas()
    assert (got[list(P)].sum(axis=1) - 1).abs().max() < 1e-9 and got[list(P)].min().min() >= 0
    likeliest = got[list(P)].to_numpy().argmax(axis=1)
    assert (likeliest == got["elo_diff"] // 100).mean() == 1
    with pytest.raises(ValueError, match="outcomes"):
        challenger.fit(rows.where("outcome < 2"), kind)


def forecast(spark):
    """Forecasts that are too sure: 0.9 where 0.6 is right."""
    rows = []
    for i in range(300):
        said = i % 3
        happened = said if (i // 3) % 10 < 6 else (said + 1 + i % 2) % 3
        rows.append((f"m{i}", happened, *[0.9 if c == said else 0.05 for c in range(3)]))
    return spark.createDataFrame(rows, "match_id string, outcome int, p_home double, p_draw double, p_away double")


@pytest.mark.parametrize("method", challenger.METHODS)
def test_calibration(spark, method):
    rows = forecast(spark)
    got = challenger.calibrated(rows, challenger.calibrate(rows, method)).toPandas()
    assert got.columns.tolist() == rows.columns and (got[list(P)].sum(axis=1) - 1).abs().max() < 1e-9
    top = got[list(P)].max(axis=1)
    assert abs(top.mean() - (0.9 if method == "none" else 0.6)) < 0.06


def test_calibration_choice_and_unknown_method(spark):
    assert challenger.best_calibration(forecast(spark), forecast(spark)).method != "none"
    flat = forecast(spark).withColumns({p: F.lit(1 / 3) for p in P})
    assert challenger.best_calibration(flat, flat.limit(0)).method == "none"  # of equal losses the first
    with pytest.raises(ValueError, match="unknown"):
        challenger.calibrate(flat, "other")


def test_mix_equals_hand_values(spark):
    rows = spark.createDataFrame([(0, 0.5, 0.3, 0.2, 0.7, 0.2, 0.1), (2, 0.5, 0.3, 0.2, 0.7, 0.2, 0.1)], "outcome int, p_home double, p_draw double, p_away double, q_home double, q_draw double, q_away double")
    got = {round(r["weight"], 1): r["log_loss"] for r in challenger.mix_losses(rows).collect()}
    want = {w / 10: -(math.log(0.5 + 0.02 * w) + math.log(0.2 - 0.01 * w)) / 2 for w in range(11)}
    assert got == pytest.approx(want)
    assert challenger.best_mix(rows).first()["weight"] == pytest.approx(min(want, key=want.get))
    same = rows.withColumns({f"q{c[1:]}": F.col(c) for c in P})
    assert challenger.best_mix(same).first()["weight"] == 0


def test_validation_harness(spark, sf_dir):
    games_ = scans.matches(spark, sf_dir).persist()
    holdouts = [validation.Holdout("y2000", 2000, "k_factor = 60", "2000-01-01")]
    got = {r["model"]: r for r in validation.report(games_, holdouts, 0.00095).collect()}
    assert set(got) == {"goal_model", "rating", "uniform"} and got["uniform"]["log_loss"] == pytest.approx(math.log(3))
    mixed = validation.compare(games_, holdouts[0], 0.00095, "logistic").toPandas()
    assert set(mixed["model"]) == {"goal_model", "challenger", "ensemble"} and (mixed[list(P)].sum(axis=1) - 1).abs().max() < 1e-9
    with pytest.raises(ValueError, match="expected"):
        validation.report(games_, [validation.Holdout("x", 2000, "true", "2000-01-01", 1)], 0.00095)
    games_.unpersist()


def test_registered_challenger_query(spark, sf_dir):
    assert Q.QUERIES["ensemble_mix"](spark, sf_dir).count() == 11


def test_write_once(spark, tmp_path):
    df, path = spark.range(5).withColumnRenamed("id", "k"), f"file://{tmp_path}/t"
    first = sinks.write_once(df, path, ["k"])
    assert sinks.write_once(df.orderBy(F.desc("k")).repartition(3), path, ["k"]) == first and first["rows"] == 5
    assert spark.read.parquet(path).count() == 5
    with pytest.raises(sinks.ImmutableError):
        sinks.write_once(df.where("k < 4"), path, ["k"])
    assert spark.read.parquet(path).count() == 5


def test_ledger_rejects_keys_it_has(spark, tmp_path):
    path = f"file://{tmp_path}/ledger"
    row = lambda *x: spark.createDataFrame(list(x), "match_id string, snapshot_id string, p double")
    sinks.append_rows(row(("a", "s1", 0.1), ("b", "s1", 0.2)), path, ["match_id", "snapshot_id"])
    sinks.append_rows(row(("a", "s2", 0.3)), path, ["match_id", "snapshot_id"])
    for bad in (row(("a", "s2", 0.9)), row(("c", "s3", 0.1), ("c", "s3", 0.1)), row(("c", None, 0.1)), row(("c", "s3", 0.1)).drop("p")):
        with pytest.raises(sinks.ImmutableError):
            sinks.append_rows(bad, path, ["match_id", "snapshot_id"])
    assert sinks.ledger(spark, path).count() == 3
    known = sinks.as_of_rows(sinks.ledger(spark, path), spark.createDataFrame([("a", 1)], "match_id string, outcome int"))
    assert known.where("known_outcome = 1").count() == 2


def test_bundle_is_written_once_and_verified(spark, tmp_path):
    folder = f"file://{tmp_path}/snapshots"
    made = sinks.publish_bundle(spark, {"t": (spark.range(3), ["id"])}, folder, "s1", {"seed": 7})
    assert sinks.read_json(spark, f"{folder}/s1/metadata") == made and made["seed"] == 7
    assert sinks.verify_bundle(spark, f"{folder}/s1") == []
    spark.range(1).write.mode("append").parquet(f"{folder}/s1/t")
    assert sinks.verify_bundle(spark, f"{folder}/s1") == ["t"]
    with pytest.raises(sinks.ImmutableError):
        sinks.publish_bundle(spark, {}, folder, "s1", {})
    with pytest.raises(ValueError, match="snapshot name"):
        sinks.publish_bundle(spark, {}, folder, "../x", {})


def test_reuse_by_fingerprint(spark, tmp_path):
    one = sinks.fingerprint(xi=0.1, teams=["a", "b"])
    assert one == sinks.fingerprint(teams=["a", "b"], xi=0.1) != sinks.fingerprint(teams=["a"], xi=0.1)
    built = []
    build = lambda: built.append(1) or {"rho": 0.1}
    for _ in range(2):
        assert sinks.reuse_or(spark, f"file://{tmp_path}/models", one, build) == {"rho": 0.1}
    assert len(built) == 1


def test_live_stream_appends_each_result_once(spark, tmp_path):
    source, path, checkpoint = (f"file://{tmp_path}/{n}" for n in ("in", "out", "checkpoint"))
    contract = contracts.Contract({"match_id": "string", "goals": "int"}, rules={"goals": "goals >= 0"}, keys=(("match_id",),))
    row = lambda *x: spark.createDataFrame(list(x), "match_id string, goals int")

    def run():
        stream = spark.readStream.schema("match_id string, goals int").parquet(source)
        live.ingest(stream, path, checkpoint, contract).awaitTermination()

    row(("a", 1)).write.mode("append").parquet(source)
    run()
    row(("a", 5), ("b", 2)).write.mode("append").parquet(source)
    run()
    assert sorted(map(tuple, spark.read.parquet(path).collect())) == [("a", 1), ("b", 2)]
    row(("c", -1)).write.mode("append").parquet(source)
    with pytest.raises(Exception, match="goals: 1 rows"):
        run()
    assert spark.read.parquet(path).count() == 2
