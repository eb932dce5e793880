"""From files to canonical tables: verdicts on planted rows, loads that raise, whole flows."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from pitchloom.operators import contracts, intake, live, market, ratings
from pitchloom.plans import world
from pitchloom.sources import documents, sinks

NOW = dt.datetime(2026, 6, 1, 12)
STAGES = {"r32": "round_of_32", "r16": "round_of_16", "qf": "quarterfinal", "sf": "semifinal", "third": "third_place"}


def put(folder, text, name):
    (folder / name).write_text(text)
    return f"file://{folder}/{name}"


def csv(folder, name, head, rows):
    return put(folder, "\n".join([",".join(head), *[",".join("" if v is None else str(v) for v in r) for r in rows]]) + "\n", name)


@pytest.fixture(scope="module")
def aliases(spark):
    rows = [("feed", "Aland", "a", "1900-01-01", None), ("feed", "Beland", "b", "1900-01-01", "1999-12-31"), ("feed", "Beland", "b2", "2000-01-01", None), ("feed", "Twice", "a", "1900-01-01", None), ("feed", "Twice", "b", "1900-01-01", None), ("other", "Celand", "c", "1900-01-01", None)]
    return spark.createDataFrame(rows, "source string, source_name string, team_id string, valid_from string, valid_to string").withColumns({c: F.col(c).cast("date") for c in ("valid_from", "valid_to")})


RESULTS = ["date", "home_team", "away_team", "home_score", "away_score", "tournament", "city", "country", "neutral"]
SHOT = ["date", "home_team", "away_team", "winner", "first_shooter"]


def test_matches_from_files(spark, tmp_path, aliases):
    results = csv(tmp_path, "r.csv", RESULTS, [
        ("1999-12-31", "Aland", "Beland", 1, 1, "Cup", "X", "Y", "TRUE"), ("2000-01-01", "Beland", "Aland", 2, 0, "Cup", None, "Y", "FALSE"),
        ("2000-01-01", "Beland", "Aland", 3, 0, "Cup", None, "Y", "FALSE"), ("2030-01-01", "Nobody", "Aland", "NA", "NA", "Cup", None, "Y", "FALSE"),
    ])
    shot = csv(tmp_path, "s.csv", SHOT, [("1999-12-31", "Aland", "Beland", "Beland", None), ("1950-01-01", "Nobody", "Aland", "Aland", None)])
    table = intake.load_matches(spark, results, shot, aliases, "feed", "v1")
    assert tuple(sorted(table.columns)) == tuple(sorted(live.CANONICAL))
    got = {r["match_id"]: (r["home_team_id"], r["away_team_id"], r["home_score"], r["shootout_winner_team_id"], r["result_after_extra_time"]) for r in table.collect()}
    assert got == {"1999-12-31-aland-beland": ("a", "b", 1, "b", True), "2000-01-01-beland-aland": ("b2", "a", 2, None, False), "2000-01-01-beland-aland-2": ("b2", "a", 3, None, False)}
    factors = spark.createDataFrame([("Cup", "wc", 60)], "tournament string, k_category string, k_factor int")
    rated = ratings.leaderboard(ratings.history(live.trainable(table, factors)))
    assert rated.count() == 3  # a, b and b2: the table feeds ratings as it is


@pytest.mark.parametrize(
    "row, verdict",
    [
        (("2000-01-01", "Aland", "Beland", 1, "NA", "Cup", "X", "Y", "TRUE"), "one score"),
        ((None, "Aland", "Beland", 1, 0, "Cup", "X", "Y", "TRUE"), "no date"),
        (("2000-01-01", "Aland", "Celand", 1, 0, "Cup", "X", "Y", "TRUE"), "unknown name"),
        (("2000-01-01", None, "Aland", 1, 0, "Cup", "X", "Y", "TRUE"), "unknown name"),
        (("2000-01-01", "Twice", "Beland", 1, 0, "Cup", "X", "Y", "TRUE"), "ambiguous name"),
    ],
)
def test_faulty_matches(spark, tmp_path, aliases, row, verdict):
    shot = csv(tmp_path, "s.csv", SHOT, [])
    with pytest.raises(documents.DocumentError, match=verdict):
        intake.load_matches(spark, csv(tmp_path, "r.csv", RESULTS, [row]), shot, aliases, "feed", "v1")


def test_doubled_shootouts_and_missing_columns(spark, tmp_path, aliases):
    results = csv(tmp_path, "r.csv", RESULTS, [("2000-01-01", "Aland", "Beland", 1, 1, "Cup", "X", "Y", "TRUE")])
    doubled = csv(tmp_path, "s.csv", SHOT, [("1950-01-01", "Q", "R", "Q", None)] * 2)
    with pytest.raises(documents.DocumentError, match="several shoot-outs"):
        intake.load_matches(spark, results, doubled, aliases, "feed", "v1")
    with pytest.raises(documents.DocumentError, match="unknown name"):  # the winner's name
        intake.load_matches(spark, results, csv(tmp_path, "s2.csv", SHOT, [("2000-01-01", "Aland", "Beland", "Celand", None)]), aliases, "feed", "v1")
    with pytest.raises(ValueError, match="missing columns"):
        intake.load_matches(spark, results, csv(tmp_path, "s3.csv", SHOT[:3], []), aliases, "feed", "v1")
    empty = intake.load_matches(spark, csv(tmp_path, "e.csv", RESULTS, []), csv(tmp_path, "s4.csv", SHOT, []), aliases, "feed", "v1")
    assert empty.count() == 0


def fixture_lines():
    out = []
    for m, stage, group, home, away, a, b in world.fixture_rows():
        slots = (home, away) if home else (f"{group}{a[-1]}", f"{group}{b[-1]}")
        out.append([m, STAGES.get(stage, stage), group, *slots, a, b, "2026-06-11T19:00:00Z", "V", "C", "USA", "scheduled", "u", "2026-01-01T00:00:00Z", "note"])
    return out


HEAD = [*contracts.FIXTURE.columns, "remark"]


@pytest.fixture(scope="module")
def registered(spark):
    return spark.createDataFrame([(t, True) for t in world.teams()] + [("idle", False)], "team_id string, participates boolean")


def test_sound_fixture(spark, tmp_path, registered):
    fixture = intake.load_fixture(spark, csv(tmp_path, "f.csv", HEAD, fixture_lines()), registered)
    assert fixture.count() == 104 and "remark" not in fixture.columns
    empty = {r["rule"]: r["rows"] for r in intake.fixture_faults(fixture.limit(0), registered.limit(0), intake.Structure()).groupBy("rule").agg(F.sum("rows").alias("rows")).collect()}
    assert empty == {"number of matches": 0, "matches of a group": 0}


@pytest.mark.parametrize(
    "at, column, value, rule",
    [
        (0, 1, "friendly", "unsupported stage"),
        (0, 10, "BRA", "unsupported host country"),
        (0, 7, "2026-06-11 19:00", "kickoff is UTC"),
        (0, 5, None, "group match without teams"),
        (0, 5, "nobody", "unknown team"),
        (0, 5, "idle", "no participant"),
        (0, 6, "team-a3", "group appearances"),
        (0, 2, "B", "matches of a group"),
        (1, 0, "001", "unique match_id"),
        (1, 3, "A1", "home_slot"),
        (80, 3, None, "home_slot is not null"),
    ],
)
def test_faulty_fixture(spark, tmp_path, registered, at, column, value, rule):
    rows = fixture_lines()
    rows[at][column] = value
    if rule == "home_slot":  # the pairing of the first match again
        rows[at][3:5], rule = rows[0][4:2:-1], "repeated pairing"
    with pytest.raises(contracts.ContractError, match=rule):
        intake.load_fixture(spark, csv(tmp_path, "f.csv", HEAD, rows), registered)


def test_short_fixture(spark, tmp_path, registered):
    with pytest.raises(contracts.ContractError, match="number of matches"):
        intake.load_fixture(spark, csv(tmp_path, "f.csv", HEAD, fixture_lines()[:-1]), registered)
    with pytest.raises(ValueError, match="missing columns"):
        intake.load_fixture(spark, csv(tmp_path, "g.csv", HEAD[1:], []), registered)


def test_rating_list(spark, tmp_path):
    lists = put(tmp_path, "1\t2\tAR\t2100\n2\t1\tES\t2050\n", "w.tsv"), put(tmp_path, "AR\tArgentina\nES\tSpain\nFR\tFrance\n", "n.tsv")
    names = lambda rows: spark.createDataFrame(rows, "source_name string, team_id string")
    wanted = spark.createDataFrame([("arg",), ("esp",)], "team_id string")
    good = intake.load_ratings(spark, *lists, names([("Argentina", "arg"), ("Spain", "esp"), ("France", "fra")]), wanted)
    assert {(r["team_id"], r["code"], r["rating"]) for r in good.collect()} == {("arg", "AR", 2100.0), ("esp", "ES", 2050.0)}
    wrong = {
        "no alias": [("Argentina", "arg")],
        "several aliases": [("Argentina", "arg"), ("Argentine", "arg"), ("Spain", "esp")],
        "alias of several teams": [("Spain", "arg"), ("Spain", "esp")],
        "no rating": [("France", "arg"), ("Spain", "esp")],
    }
    for verdict, rows in wrong.items():
        with pytest.raises(documents.DocumentError, match=verdict):
            intake.load_ratings(spark, *lists, names(rows), wanted)
    with pytest.raises(documents.DocumentError, match="code without a name .1, first at ES"):
        intake.load_ratings(spark, lists[0], put(tmp_path, "AR\tArgentina\n", "n2.tsv"), names([("Argentina", "arg")]), wanted.where("team_id = 'arg'"))


QUOTE = "event_id string, bookmaker string, home_team_id string, away_team_id string, commence_time timestamp, updated_at timestamp, declared_match_id string, price_home double, price_draw double, price_away double"


def quote(book, home="a", away="b", hours=0, age=1, declared=None, prices=(2.0, 3.0, 4.0)):
    return ("e", book, home, away, NOW + dt.timedelta(hours=hours), None if age is None else NOW - dt.timedelta(hours=age), declared, *prices)


def test_benchmark(spark, tmp_path):
    fixture = spark.createDataFrame([("m1", NOW, "a", "b"), ("m2", NOW, "c", "d"), ("m3", NOW + dt.timedelta(hours=1), "c", "d")], "match_id string, kickoff timestamp, home_team_id string, away_team_id string")
    rows = {
        "straight": (quote("straight"), None), "turned": (quote("turned", "b", "a", prices=(4.0, 3.0, 2.0)), None), "edge": (quote("edge", hours=12, age=24), None), "unaged": (quote("unaged", age=None, declared="m1"), None),
        "nameless": (quote("nameless", home=None), "unknown team"), "early": (quote("early", hours=-12.01), "no fixture"), "double": (quote("double", "c", "d"), "several fixtures"),
        "declared": (quote("declared", declared="m9"), "another match declared"), "stale": (quote("stale", age=24.01), "stale"), "cheap": (quote("cheap", prices=(1.0, 3.0, 4.0)), "price not above 1"),
        "lost": (quote("lost", prices=(None, 3.0, 4.0)), "price not above 1"), "twice": (quote("twice"), "repeated quote"),
    }
    quotes = spark.createDataFrame([q for q, _ in rows.values()] + [rows["twice"][0]], QUOTE)
    found = intake.benchmark_records(quotes, fixture, F.lit(NOW))
    got = found.collect()
    assert len(got) == len(rows) + 1 and all(r["verdict"] == rows[r["bookmaker"]][1] for r in got)
    good = found.where("verdict is null")
    assert {(r["match_id"], r["home_team_id"], r["price_home"], r["price_away"]) for r in good.collect()} == {("m1", "a", 2.0, 4.0)}
    benchmark = contracts.validate(good.drop("verdict", "place"), contracts.ODDS)
    intake.write_benchmark(benchmark, F.lit(NOW), f"file://{tmp_path}/frozen")
    frozen = spark.read.parquet(f"file://{tmp_path}/frozen").first()
    total = 1 / 2 + 1 / 3 + 1 / 4
    assert frozen["captured_at_utc"] == "2026-06-01T12:00:00Z" and frozen["n_bookmakers"] == 4 and frozen["prob_home"] == pytest.approx(0.5 / total)
    with pytest.raises(sinks.ImmutableError):
        intake.write_benchmark(benchmark.where("bookmaker <> 'edge'"), F.lit(NOW), f"file://{tmp_path}/frozen")
    with pytest.raises(contracts.ContractError, match="empty"):
        intake.write_benchmark(benchmark.limit(0), F.lit(NOW), f"file://{tmp_path}/none")


def test_named_quotes(spark, aliases):
    records = spark.createDataFrame([("e1", "Aland", "Beland", NOW), ("e2", "Twice", "Celand", NOW)], "event_id string, home_team string, away_team string, commence_time timestamp")
    got = {r["event_id"]: (r["home_team_id"], r["away_team_id"], r["declared_match_id"]) for r in intake.named_quotes(records, aliases, "feed").collect()}
    assert got == {"e1": ("a", "b2", None), "e2": (None, None, None)}


def test_publication(spark, tmp_path):
    upcoming = spark.createDataFrame([("m1", "a", "b", 0.5, 0.25, 0.25)], "match_id string, team_a string, team_b string, prob_a double, prob_draw double, prob_b double")
    notes = spark.createDataFrame([("n",)], "note string")
    tables = {"upcoming": (upcoming, ["match_id"]), "notes": (notes, ["note"])}
    intake.publish(spark, tables, f"file://{tmp_path}", "one", {})
    assert sinks.verify_bundle(spark, f"file://{tmp_path}/one") == []
    broken = tables | {"upcoming": (upcoming.withColumn("prob_a", F.lit(0.6)), ["match_id"])}
    with pytest.raises(contracts.ContractError, match="sum"):
        intake.publish(spark, broken, f"file://{tmp_path}", "two", {})
    entries = upcoming.selectExpr("match_id", "'s' as snapshot_id", "'v' as model_version", "prob_a", "prob_draw", "prob_b", "7 as outcome_idx")
    with pytest.raises(contracts.ContractError, match="outcome"):
        intake.publish(spark, tables, f"file://{tmp_path}", "two", {}, (entries, f"file://{tmp_path}/ledger", ["match_id", "snapshot_id"]))
    assert not sinks.exists(spark, f"file://{tmp_path}/two") and not sinks.exists(spark, f"file://{tmp_path}/ledger")


def test_fixtures_of_one_kickoff_are_one_entry(spark):
    """Many fixtures of a pair at one instant count one by one, and a quote meets one entry for all of them."""
    fixture = spark.sql("select concat('m', id) match_id, timestamp'2026-06-11 18:00:00' kickoff, 'a' home_team_id, 'b' away_team_id from range(500) union all select 'single', timestamp'2026-06-20 18:00:00', 'b', 'a'")
    quotes = spark.sql("select 'e1' event_id, 'a' home_team_id, 'b' away_team_id, timestamp'2026-06-11 20:00:00' commence_time union all select 'e2', 'a', 'b', timestamp'2026-06-20 20:00:00' union all select 'e3', 'a', 'b', timestamp'2026-07-20 20:00:00'")
    found = market.linked(quotes, fixture, ["event_id"])
    got = {r["event_id"]: (r["n_fixtures"], r["match_id"], r["swapped"]) for r in found.collect()}
    assert got == {"e1": (500, None, None), "e2": (1, "single", True), "e3": (0, None, None)}
    assert "count(1)" in found._jdf.queryExecution().optimizedPlan().toString()


def test_rows_with_a_verdict_are_dealt(spark):
    """Quotes without a match don't meet the repeats under one key for each bookmaker."""
    fixture = spark.sql("select 'm' match_id, timestamp'2026-06-11 18:00:00' kickoff, 'a' home_team_id, 'b' away_team_id")
    quotes = spark.sql("select concat('e', id) event_id, '1' bookmaker, 'x' home_team_id, 'y' away_team_id, timestamp'2026-06-11 18:00:00' commence_time, cast(null as timestamp) updated_at, cast(null as string) declared_match_id, 2.0D price_home, 3.0D price_draw, 4.0D price_away from range(400)")
    key, before = "spark.sql.adaptive.enabled", spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set(key, "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = intake.benchmark_records(quotes, fixture, F.lit("2026-06-11").cast("timestamp"))
        held = [r["n"] for r in rows.withColumn("__task", F.spark_partition_id()).groupBy("__task").agg(F.count("*").alias("n")).collect()]
    finally:
        spark.conf.unset(key)
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert sum(held) == 400 and len(held) > 1 and max(held) < 200
