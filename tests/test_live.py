"""Live results: rules, projection, training set and audit, on small tables."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from pitchloom.operators import live

RESULT = "match_id string, team_a string, team_b string, goals_a int, goals_b int, advanced_team string"
DAY = dt.date(2026, 6, 20)


@pytest.fixture
def fixture(spark):
    late = dt.datetime(2026, 6, 13, 23, 30, tzinfo=dt.timezone.utc)
    return spark.createDataFrame([("M1", late, "Rome", None), ("M2", None, None, "Peru")], "match_id string, kickoff timestamp, host_city string, host_country string")


def test_rules(spark, fixture):
    rows = [("M1", "a", "b", 1, 0, "b"), ("M9", "a", "b", 1, 1, None), (None, "a", "b", 1, 1, None), ("M2", "a", "b", None, 0, None), ("M2", "a", "b", 2, 0, "a")]
    found = live.canonical_errors(spark.createDataFrame(rows, RESULT), fixture).collect()
    assert {tuple(r) for r in found} == {("M1", "wrong_margin"), ("M9", "outside_fixture"), (None, "outside_fixture"), ("M2", "no_score"), ("M2", "repeated")}
    assert len(found) == 5


def test_projection(spark, fixture):
    results = spark.createDataFrame([("M1", "a", "b", 1, 1, "b"), ("M2", "c", "d", 0, 2, "d")], RESULT)
    rows = {r["match_id"]: r for r in live.canonical(results, fixture, F.lit(DAY), "v7", "cup").collect()}
    assert rows["M1"]["date"] == dt.date(2026, 6, 13) and rows["M2"]["date"] == DAY
    assert rows["M1"]["result_after_extra_time"] and not rows["M2"]["result_after_extra_time"]
    assert (rows["M1"]["city"], rows["M1"]["country"], rows["M2"]["city"], rows["M2"]["country"]) == ("Rome", "", "", "Peru")
    bare = live.canonical(results, fixture.select("match_id"), F.lit(DAY), "v7", "cup").collect()
    assert {r["date"] for r in bare} == {DAY} and {r["country"] for r in bare} == {""}
    assert live.canonical(results.limit(0), fixture, F.lit(DAY), "v7", "cup").count() == 0
    with pytest.raises(ValueError, match="M1 wrong_margin"):
        live.canonical(spark.createDataFrame([("M1", "a", "b", 1, 0, "b")], RESULT), fixture, F.lit(DAY), "v7", "cup")


def test_training_set(spark, fixture):
    one = live.canonical(spark.createDataFrame([("M1", "a", "b", 1, 1, "b")], RESULT), fixture, F.lit(DAY), "v7", "cup")
    two = live.canonical(spark.createDataFrame([("M2", "a", "b", 1, 3, None)], RESULT), fixture, F.lit(DAY), "v7", "cup")
    assert live.training_set(one.withColumn("extra", F.lit(1)), two).columns == list(live.CANONICAL)
    assert live.training_set(one, two).count() == 2
    with pytest.raises(ValueError, match="M1"):
        live.training_set(one, one)


def test_training_set_feeds_ratings_and_fit(spark, fixture):
    from pitchloom.operators import goals, matches, ratings

    one = live.canonical(spark.createDataFrame([("M1", "a", "b", 1, 1, "b")], RESULT), fixture, F.lit(DAY), "v7", "cup")
    old = one.withColumns({"match_id": F.lit("H1"), "date": F.lit(dt.date(2025, 1, 1)), "home_score": F.lit(3), "shootout_winner_team_id": F.lit(None).cast("string"), "result_after_extra_time": F.lit(None).cast("boolean"), "tournament": F.lit("old"), "neutral": F.lit(False)})
    factors = spark.createDataFrame([("old", "friendly", 20), ("cup", "wc", 60)], "tournament string, k_category string, k_factor int")
    ready = live.trainable(live.training_set(old, one), factors)
    got = {(r["match_id"], r["team_id"]): r["rating_post"] for r in ratings.history(ready).collect()}
    first = ratings.change(1000, 1000, 3, 1, 20, False, False)
    assert got["H1", "a"] == pytest.approx(1000 + first)
    assert got["M1", "a"] == pytest.approx(1000 + first + ratings.change(1000 + first, 1000 - first, 1, 1, 60, True, True))
    assert {r["match_id"]: r["outcome"] for r in ready.collect()} == {"H1": 0, "M1": 1}
    model = goals.fit(matches.weighted(ready, F.lit(dt.date(2026, 7, 1)), 0.001), 0.001, "2026-07-01")
    assert model.teams == ("a", "b")  # two teams: what one attacks the other defends
    with pytest.raises(Exception, match="no K-factor for tournament old"):
        live.trainable(live.training_set(old, one), factors.where("tournament = 'cup'")).collect()


def test_audit(spark):
    raw = spark.createDataFrame([("A", "B", 1, 0), ("B", "A", None, None)], "home_team string, away_team string, home_score int, away_score int")
    names = spark.createDataFrame([("A",), ("B",), ("B",)], "source_name string")
    table = spark.createDataFrame([("s", "v1")], "source string, source_version string")
    row = live.audit(table, raw, names, "s").first()
    assert row["passed"] and (row["rows"], row["completed"], row["unplayed"], row["teams"]) == (1, 1, 1, 2)
    assert live.audit(table, raw, names.where("source_name = 'A'"), "s").first()["unresolved"] == 1
    half = spark.createDataFrame([("A", None, 1, None)], raw.schema)
    assert live.audit(table, raw.union(half), names, "s").first()["one_sided"] == 1
    for bad in ([("s", "v1"), ("s", "v1")], [("s", None)], [("t", "v1")], [("s", "")]):
        assert not live.audit(spark.createDataFrame(bad, table.schema), raw, names, "s").first()["passed"]
    empty = live.audit(table.limit(0), raw.limit(0), names.limit(0), "s").first()
    assert empty["rows"] == 0 and empty["versions"] == 0 and not empty["passed"]
