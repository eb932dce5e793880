"""Hand values, golden tables, invariants and parameter recovery."""

import datetime
import math

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pitchloom.functions import columns as C
from pitchloom.operators import contracts, goals, ratings, rules, scoring
from pitchloom.operators import matches as M
from pitchloom.operators.simulate import advancement, distribution, group_frame, group_goals, group_positions, group_tables, simulate
from pitchloom.plans import world

SCORES = "home_team_id string, away_team_id string, home_score int, away_score int"


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_hand_values(spark):
    third = [F.lit(1 / 3)] * 3
    rps, brier, slug, advance = one(spark, C.ranked_probability(third, F.lit(0)), C.brier(third, F.lit(0)), C.slug(F.lit("  Côte d'Or 9! ")), C.advance_probability(F.lit(0.05), F.lit(0.9), F.lit(0.05)))
    assert rps == pytest.approx(5 / 18) and brier == pytest.approx(2 / 3)
    assert slug == "c-te-d-or-9" and advance == pytest.approx(0.5)
    assert one(spark, *C.implied(F.lit(2.0), F.lit(4.0), F.lit(0.9))) == (None, None, None)


def test_margins_are_taken_off_once(spark, sf_dir):
    """What makes the probabilities stands in no filter below the aggregation, and a share's sum is not guarded part by part."""
    from pitchloom.plans import queries

    plan = queries.market_consensus(spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    below = plan[plan.index("Aggregate") :]
    assert "Filter" not in below and below.count("1.0 / price_home") <= 12 and "isnan(price" not in below


def test_consensus_leaves_out_quotes_without_a_price(spark):
    from pitchloom.operators import market

    inf, nan = float("inf"), float("nan")
    rows = [("a", 1, 2.0, 4.0, 4.0), ("a", 2, 4.0, 4.0, 2.0), ("a", 3, 2.0, 2.0, 0.0), ("a", 4, None, 2.0, 2.0), ("a", None, 2.0, 4.0, 4.0), ("a", 5, 2.0, nan, 3.0), ("b", 1, 2.0, inf, 2.0), ("c", 1, 0.0, 0.0, 0.0), ("d", 1, 3.0, 3.0, -1.0)]
    got = market.consensus(market.demargined(spark.createDataFrame(rows, "match_id string, bookmaker int, price_home double, price_draw double, price_away double")), ["match_id"]).collect()
    assert [r["match_id"] for r in got] == ["a"] and got[0]["n_bookmakers"] == 2
    assert [got[0][f"prob_{n}"] for n in ("home", "draw", "away")] == pytest.approx([0.5, 0.25, 0.25])
    assert [got[0][f"prob_{n}_mean"] for n in ("home", "draw", "away")] == pytest.approx([1.25 / 3, 0.25, 1 / 3])


@given(st.floats(800, 2000), st.floats(800, 2000), st.integers(0, 9), st.integers(0, 9), st.booleans())
def test_rating_change_is_bounded_and_signed(a, b, home, away, neutral):
    gain = ratings.change(a, b, home, away, 60, neutral, False)
    assert math.isfinite(gain)
    if home != away:
        assert (gain > 0) == (home > away)
    assert ratings.change(a, b, home, away, 60, neutral, True) == ratings.change(a, b, 0, 0, 60, neutral, False)


def test_rating_hand_value():
    assert 1500 + ratings.change(1500, 1500, 1, 0, 60, True, False) == pytest.approx(1520.7944, abs=1e-4)
    # At home the bonus counts for what is expected alone: ln(3) * 2.2 / (0.1 + 2.2) * 40 * (1 - 1 / (1 + 10 ** -0.5)).
    assert ratings.change(1600, 1500, 2, 0, 40, False, False) == pytest.approx(10.098, abs=1e-3)
    # An away win: ln(3) * 2.2 / (-0.1 + 2.2) * 40 * (0 - 1 / (1 + 10 ** -0.5)).
    assert ratings.change(1600, 1500, 0, 2, 40, False, False) == pytest.approx(-34.9765, abs=1e-3)


def test_rating_history_follows_order(spark):
    day = datetime.date(2020, 1, 1)
    rows = [("m2", day, "a", "b", 1, 0, 60, True, False), ("m1", day, "a", "c", 0, 0, 20, False, False), ("m3", day, "c", "b", 2, 2, 60, True, True)]
    df = spark.createDataFrame(rows, "match_id string, date date, home_team_id string, away_team_id string, home_score int, away_score int, k_factor int, neutral boolean, after_extra_time boolean")
    got = {(r.match_id, r.team_id): (r.rating_pre, r.rating_post) for r in ratings.history(df).collect()}
    assert got["m1", "a"][0] == 1000 and got["m2", "a"][0] == got["m1", "a"][1] and got["m3", "c"][0] == got["m1", "c"][1]
    assert sum(post - pre for pre, post in got.values()) == pytest.approx(0)


@pytest.mark.parametrize(("pool", "block"), [(None, 40), ("pool", 60), (None, 1000)])
def test_relaxed_ratings_equal_the_loop(spark, pool, block):
    """Short blocks, a team that pauses, pools of different sizes, several matches of a team on a day, repeated team names across pools."""
    rng = np.random.default_rng(3)
    rows = []
    for i in range(400):
        a, b = rng.choice(5 if i % 3 else 12, 2, replace=False)
        day = datetime.date(2000, 1, 1) + datetime.timedelta(int(rng.integers(0, 60)))
        rows.append((f"m{i:04d}", day, f"t{a}", f"t{b}", int(rng.poisson(1.4)), int(rng.poisson(1.1)), int(rng.choice([20, 60])), bool(rng.random() < 0.5), bool(rng.random() < 0.1), f"p{min(2, i % 7)}"))
    df = spark.createDataFrame(rows, "match_id string, date date, home_team_id string, away_team_id string, home_score int, away_score int, k_factor int, neutral boolean, after_extra_time boolean, pool string").repartition(3)
    now, want = {}, {}
    for m, d, h, a, x, y, k, n, e, p in sorted(rows, key=lambda r: r[1::-1]):
        h_, a_ = ((p if pool else "all", t) for t in (h, a))
        before = now.get(h_, 1000.0), now.get(a_, 1000.0)
        gain = ratings.change(*before, x, y, k, n, e)
        now[h_], now[a_] = before[0] + gain, before[1] - gain
        want[m, h], want[m, a] = (before[0], now[h_]), (before[1], now[a_])
    got = {(r.match_id, r.team_id): (r.rating_pre, r.rating_post) for r in ratings.history(df, pool, block).collect()}
    assert got.keys() == want.keys()
    assert max(abs(g - w) for k in want for g, w in zip(got[k], want[k], strict=True)) < 1e-9
    assert ratings.history(df.limit(0)).count() == 0


def test_expressions_of_ratings_equal_the_change(spark):
    rows = [(1500.0, 1400.0, 3, 1, 40, False), (1500.0, 1720.0, 0, 2, 60, True), (1300.0, 1310.0, 1, 1, 20, False)]
    df = spark.createDataFrame(rows, "a double, b double, x int, y int, k int, neutral boolean")
    gap, margin = F.col("a") - F.col("b"), F.col("x") - F.col("y")
    expected = C.expected_score(gap + F.when(F.col("neutral"), 0.0).otherwise(C.HOME_BONUS))
    gain = F.col("k") * C.margin_factor(margin, F.signum(margin) * gap) * ((F.signum(margin) + 1) / 2 - expected)
    assert [r[0] for r in df.select(gain).collect()] == [pytest.approx(ratings.change(*r, False)) for r in rows]


def games(spark, scores):
    return spark.createDataFrame([(1, *s) for s in scores], "group int, " + SCORES)


def order(df):
    return [r.team_id for r in df.orderBy("position").collect()]


def test_cascade_two_way_head_to_head(spark):
    scores = [("a", "b", 0, 1), ("a", "c", 2, 0), ("a", "d", 1, 0), ("b", "c", 1, 1), ("b", "d", 1, 1), ("c", "d", 0, 0)]
    table = rules.cascade(games(spark, scores), ["group"])
    assert order(table)[0] == "a"
    assert not table.where("tied and team_id in ('a')").count()


def test_cascade_uses_matches_among_the_tied_then_conduct_then_editions(spark):
    drawn = [(x, y, 0, 0) for i, x in enumerate("abcd") for y in "abcd"[i + 1 :]]
    g = games(spark, drawn)
    assert rules.cascade(g, ["group"]).where("tied").count() == 4
    conduct = spark.createDataFrame([("a", -4.0), ("b", -1.0), ("c", -6.0), ("d", -1.0)], "team_id string, conduct double")
    editions = spark.createDataFrame([("b", [5, 2]), ("d", [5, 1])], "team_id string, places array<int>")
    table = rules.cascade(g, ["group"], conduct, editions)
    assert order(table) == ["d", "b", "a", "c"] and not table.where("tied").count()


def test_cascade_order_option_differs(spark):
    scores = [("a", "b", 1, 0), ("a", "c", 1, 0), ("a", "d", 0, 1), ("b", "c", 5, 0), ("b", "d", 5, 0), ("c", "d", 0, 0)]
    g = games(spark, scores)
    assert order(rules.cascade(g, ["group"])) == ["b", "a", "d", "c"]
    assert order(rules.cascade(g, ["group"], overall_first=False)) == ["a", "b", "d", "c"]


def test_slots_reject_other_tokens(spark):
    df = spark.createDataFrame([("1A",), ("3ABCDF",), ("L101",)], "slot string")
    assert [r.slot_kind for r in rules.slots(df, "slot").collect()] == ["group", "third", "loser"]
    with pytest.raises(Exception, match="unsupported slot"):
        rules.slots(spark.createDataFrame([("4X",)], "slot string"), "slot").collect()


def test_third_place_mapping_covers_all_combinations(spark):
    mapping = spark.createDataFrame([(c, next(r[4] for r in world.fixture_rows() if r[0] == m), g) for c, m, g in world.mapping_rows()], "combination string, slot string, group string")
    slots = mapping.withColumn("slot", F.concat(F.lit("3"), F.substring("slot", 2, 20)))
    per = {}
    for c, _, g in world.mapping_rows():
        per.setdefault(c, []).append(g)
    assert len(per) == 495 and all("".join(sorted(v)) == c for c, v in per.items())
    assert slots.where(~F.contains("slot", F.col("group"))).isEmpty()


def test_goal_model_recovers_parameters(spark):
    rng = np.random.default_rng(5)
    att, dfn = rng.normal(0, 0.3, 6), rng.normal(0, 0.3, 6)
    att, dfn = att - att.mean(), dfn - dfn.mean()
    rows = []
    for _ in range(4000):
        i, j = rng.choice(6, 2, replace=False)
        rows.append((f"t{i}", f"t{j}", int(rng.poisson(math.exp(0.2 + att[i] - dfn[j] + 0.3))), int(rng.poisson(math.exp(0.2 + att[j] - dfn[i]))), False, 1.0))
    df = spark.createDataFrame(rows, SCORES + ", neutral boolean, weight double")
    model = goals.fit(df, 0.001, "2020-01-01")
    assert model.intercept == pytest.approx(0.2, abs=0.1) and model.home == pytest.approx(0.3, abs=0.1)
    assert np.abs(np.array(model.attack) - att).max() < 0.15 and abs(model.rho) < 0.08
    assert sum(model.attack) == pytest.approx(0, abs=1e-6)
    unknown = spark.createDataFrame([("t0", "nobody", False)], "home_team_id string, away_team_id string, neutral boolean")
    assert goals.rates(unknown, model).first()["rate_home"] is None


def league(n_teams=5, n=600, seed=8):
    """Weighted matches with dependent low scores, and a team that never scores away."""
    rng = np.random.default_rng(seed)
    rows = []
    for k in range(n):
        i, j = rng.choice(n_teams, 2, replace=False)
        x, y = int(rng.poisson(1.2 + 0.2 * i)), int(rng.poisson(0.9)) if j else 0
        if (x, y) in ((0, 1), (1, 0)) and rng.random() < 0.5:
            x = y = min(x, y)
        rows.append((f"t{i}", f"t{j}", x, y, bool(k % 3 == 0), float(np.exp(-k / 400))))
    return rows


LEAGUE = SCORES + ", neutral boolean, weight double"


def arrays(rows):
    """Sums of one row each, as the likelihood takes them."""
    teams = sorted({t for r in rows for t in r[:2]})
    h, a = (np.array([teams.index(r[k]) for r in rows]) for k in (0, 1))
    x, y, w = (np.array([r[k] for r in rows], float) for k in (2, 3, 5))
    low = {f"w{i}{j}": w * ((x == i) & (y == j)) for i in (0, 1) for j in (0, 1)}
    return {"h": h, "a": a, "home": np.array([0.0 if r[4] else 1.0 for r in rows]), "w": w, "x": w * x, "y": w * y} | low


def value_at(sums, model):
    theta = np.array([*model.attack, *model.defence, model.intercept, model.home, math.atanh(model.rho / goals.RHO_BOUND)])
    return goals.likelihood(sums, theta)


def test_gradient_equals_finite_differences():
    sums = arrays(league())
    theta = np.random.default_rng(1).normal(0, 0.2, 13)
    _, gradient, curvature = goals.likelihood(sums, theta)
    for k in range(len(theta)):
        step = np.zeros(13)
        step[k] = 1e-5
        assert gradient[k] == pytest.approx((goals.likelihood(sums, theta + step)[0] - goals.likelihood(sums, theta - step)[0]) / 2e-5, abs=1e-4)
    assert (curvature > 0).all()
    far = theta.copy()
    far[-3], far[-1] = 2.0, 2.0
    assert goals.likelihood(sums, far)[0] == math.inf


def test_joint_fit_equals_a_dense_solver(spark):
    """Newton's method on the rows themselves, with finite differences of the gradient for the matrix of second derivatives."""
    rows = league()
    model = goals.fit(spark.createDataFrame(rows, LEAGUE).repartition(3), 0.001, "2020-01-01")
    sums = arrays(rows)
    theta = np.zeros(13)
    flat = np.zeros((2, 13))
    flat[0, :5], flat[1, 5:10] = 1, 1
    for _ in range(60):
        gradient = goals.likelihood(sums, theta)[1] + 1e3 * flat.T @ flat @ theta
        second = np.array([(goals.likelihood(sums, theta + e)[1] - goals.likelihood(sums, theta - e)[1]) / 2e-5 for e in np.eye(13) * 1e-5]) + 1e3 * flat.T @ flat
        step = np.linalg.solve(second + 1e-6 * np.eye(13), -gradient)
        theta = theta + step * min(1.0, 0.5 / np.abs(step).max())
    best = goals.likelihood(sums, theta)[0]
    found, gradient, _ = value_at(sums, model)
    assert found <= best + 1e-6 and np.abs(gradient).max() < 1e-3
    assert model.rho == pytest.approx(0.2 * math.tanh(theta[-1]), abs=1e-4) and abs(model.rho) > 0.02
    assert sum(model.attack) == pytest.approx(0, abs=1e-9) and sum(model.defence) == pytest.approx(0, abs=1e-9)


def test_distributed_fit_equals_the_local_one(spark):
    df = spark.createDataFrame(league(3, 90), LEAGUE)
    here, there = goals.fit(df, 0.001, "2020-01-01"), goals.fit(df, 0.001, "2020-01-01", here=3)
    assert there.teams == here.teams
    assert np.allclose([*there.attack, *there.defence, there.intercept, there.home, there.rho], [*here.attack, *here.defence, here.intercept, here.home, here.rho], atol=1e-5)
    with pytest.raises(ValueError, match="no matches"):
        goals.fit(df.limit(0), 0.001, "2020-01-01")


def test_all_fits_of_one_scan_equal_single_fits(spark):
    days = [datetime.date(1990, 1, 1) + datetime.timedelta(i * 9) for i in range(400)]
    g = spark.createDataFrame([(d, *r[:5]) for d, r in zip(days, league(4, 400), strict=True)], "date date, " + SCORES + ", neutral boolean")
    models = goals.fit_all(g, ["1996-03-01", "1999-01-01"], [0.002, 0.01])
    assert set(models) == {(c, xi) for c in ("1996-03-01", "1999-01-01") for xi in (0.002, 0.01)}
    for (c, xi), m in models.items():
        one_ = goals.fit(M.weighted(g, F.lit(c).cast("date"), xi), xi, c)
        assert m.teams == one_.teams and np.allclose([*m.attack, m.home, m.rho], [*one_.attack, one_.home, one_.rho], atol=1e-6)
    rows = g.select("*", F.lit("a").alias("fit")).limit(5)
    got = goals.rates_of(rows, {"a": models["1999-01-01", 0.01], "b": models["1999-01-01", 0.002]})
    want = goals.rates(rows, models["1999-01-01", 0.01])
    assert [tuple(r) for r in got.orderBy("date").select("rate_home", "rate_away").collect()] == [tuple(r) for r in want.orderBy("date").select("rate_home", "rate_away").collect()]


def test_model_document(spark, tmp_path):
    from pitchloom.sources import sinks

    model = goals.GoalModel(("a", "b"), (0.1, -0.1), (0.2, -0.2), 0.3, 0.2, -0.05, 0.001, "2020-01-01")
    sinks.write_json(spark, model.document(), str(tmp_path / "m"))
    assert goals.GoalModel.from_document(sinks.read_json(spark, str(tmp_path / "m"))) == model
    for wrong in ({"rho": 0.3}, {"teams": ["a", "a"]}, {"home": float("nan")}, {"cutoff": "soon"}, {"attack": [1.0]}, {"more": 1}):
        with pytest.raises(ValueError):
            goals.GoalModel.from_document(model.document() | wrong)


def test_rated_and_latest_equal_the_history(spark, sf_dir):
    """Matches with their ratings keep all their columns and equal the join with the history; what the last blocks leave is the leaderboard."""
    from pitchloom.sources import scans

    m = scans.matches(spark, sf_dir).localCheckpoint()
    for pool, block in ((None, 25_000), ("home_region", 700)):
        rated = ratings.history(m, pool, block).localCheckpoint()
        wanted = ratings.with_ratings(m, rated).select(*m.columns, "home_rating", "away_rating", "rating_difference")
        got = ratings.rated(m, pool, block)
        assert got.dtypes == wanted.dtypes
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, wanted.collect()))
        if pool is None:
            board = {tuple(r) for r in ratings.leaderboard(rated).select("team_id", "rating", "rank").collect()}
            assert {tuple(r) for r in ratings.ranked(ratings.latest(m, pool, block)).collect()} == board
    assert ratings.rated(m.limit(0)).count() == 0 and ratings.latest(m.limit(0)).count() == 0
    joins = ratings.rated(m)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in joins


def test_score_matrix_is_made_after_the_joins(spark, sf_dir):
    """Cells are plain products of two arrays: nothing of them goes into a filter below a join, and no function runs over an array of cells."""
    from pitchloom.plans import queries

    plan = queries.score_matrix(spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "lambda" not in plan and "size(" not in plan


def test_score_matrix_cells(spark):
    from math import exp, factorial

    df = spark.createDataFrame([("a", 1.3, 0.7, -0.1), ("b", 0.2, 2.5, 0.05), ("c", None, 1.0, 0.0)], "match_id string, rate_home double, rate_away double, r double")
    got = {(r["match_id"], r["home_goals"], r["away_goals"]): r["p"] for r in goals.score_matrix(df, F.col("r")).collect()}
    assert len(got) == 3 * 121 and all(got["c", i, j] is None for i in range(11) for j in range(11))
    for name, x, y, rho in (("a", 1.3, 0.7, -0.1), ("b", 0.2, 2.5, 0.05)):
        low = {(0, 0): 1 - x * y * rho, (0, 1): 1 + x * rho, (1, 0): 1 + y * rho, (1, 1): 1 - rho}
        cells = {(i, j): exp(-x) * x**i / factorial(i) * exp(-y) * y**j / factorial(j) * low.get((i, j), 1.0) for i in range(11) for j in range(11)}
        assert all(got[name, i, j] == pytest.approx(p / sum(cells.values()), rel=1e-12) for (i, j), p in cells.items())


def test_score_matrix_sums_to_one(spark):
    df = spark.createDataFrame([("x", 1.3, 0.9)], "match_id string, rate_home double, rate_away double")
    assert goals.score_matrix(df, -0.1).agg(F.sum("p"), F.count("*")).first() == (pytest.approx(1), 121)
    assert sum(goals.with_outcomes(df).select(*scoring.P).first()) == pytest.approx(1)


def test_contract_reports_and_raises(spark):
    rows = spark.createDataFrame([("m", "a", "a", 1, 0, None, None, None), ("m", "a", "b", -1, 0, None, None, "c")], "match_id string, team_a string, team_b string, goals_a int, goals_b int, fair_play_a double, fair_play_b double, advanced_team string")
    with pytest.raises(contracts.ContractError, match="advanced team plays: 1 rows.*goals: 1 rows.*two teams: 1 rows.*unique match_id: 2 rows"):
        contracts.validate(rows, contracts.LIVE)
    with pytest.raises(contracts.ContractError, match="missing columns"):
        contracts.validate(rows.drop("goals_a"), contracts.LIVE)


def test_as_of_is_strict(spark):
    h = spark.createDataFrame([("k", 1, 5.0), ("k", 3, 7.0)], "key string, t int, v double")
    e = spark.createDataFrame([("k", 1), ("k", 2), ("k", 3), ("k", 4), ("z", 9)], "key string, t int")
    got = {(r.key, r.t): r.v for r in M.as_of(e, h, "key", "t", "v", 0.0).collect()}
    assert got == {("k", 1): 0.0, ("k", 2): 5.0, ("k", 3): 5.0, ("k", 4): 7.0, ("z", 9): 0.0}


def test_simulation_invariants_and_determinism(spark):
    n = 400
    fixture, rates, mapping = world.fixture(spark), world.rates(spark).persist(), world.mapping(spark)
    table = advancement(spark, simulate(spark, fixture, rates, mapping, n, 11, parts=4), fixture, n).toPandas()
    for column, total in zip(("p_r32", "p_r16", "p_qf", "p_sf", "p_final", "p_champion"), (32, 16, 8, 4, 2, 1), strict=True):
        assert table[column].sum() == pytest.approx(total)
    again = advancement(spark, simulate(spark, fixture.orderBy(F.desc("match_id")), rates, mapping, n, 11, parts=2), fixture, n).toPandas()
    assert table.sort_values("team_id").reset_index(drop=True).equals(again.sort_values("team_id").reset_index(drop=True))


def fixture_of(pairs, rate=1.0):
    return [{"match_id": f"{k}", "group": "A", "home": h, "away": a, "rate_home": rate, "rate_away": rate, "home_score": None, "away_score": None} for k, (h, a) in enumerate(pairs)]


ALL_PAIRS = [(0, 1), (2, 3), (2, 0), (1, 3), (3, 0), (1, 2)]


def test_fixing_a_group_match_moves_no_other(spark):
    sims = spark.range(50).withColumnRenamed("id", "sim")
    matches = fixture_of(ALL_PAIRS)
    free = group_goals(*group_frame(spark, matches), sims, 3)
    fixed = group_goals(*group_frame(spark, [matches[0] | {"home_score": 9, "away_score": 0}, *matches[1:]]), sims, 3)
    rest = [f"{s}{k}" for s in "ab" for k in range(1, 6)]
    pick = lambda df: sorted(tuple(r) for r in df.select("sim", *rest).collect())
    assert pick(free) == pick(fixed)
    assert fixed.where("a0 = 9 and b0 = 0").count() == 50
    assert group_tables(fixed).where("first = 0").count() > 25
    with pytest.raises(ValueError, match="four that meet once"):
        group_frame(spark, matches[:5])


@pytest.mark.parametrize("rate", [0.0, 0.3, 1.4, 9.0])
def test_search_equals_the_inverse_of_the_distribution(spark, rate):
    matches = fixture_of(ALL_PAIRS, rate)
    goals_ = group_goals(*group_frame(spark, matches), spark.range(300).withColumnRenamed("id", "sim"), 5)
    # Pair 1 is teams 0 and 2; team 2 is at home in match 2.
    got = {r["sim"]: (r["a1"], r["b1"]) for r in goals_.collect()}
    u = lambda side: C.keyed_uniform(5, F.lit("2"), F.col("id"), F.lit(side))
    want = {r[0]: (r[1], r[2]) for r in spark.range(300).select("id", *[C.poisson_draw(F.lit(rate), u(s)) for s in ("away", "home")]).collect()}
    assert got == want
    assert distribution(rate)[-1] == pytest.approx(1)


@pytest.mark.parametrize("tail", [None, {0: 3, 1: 1, 2: 2, 3: 1}])
def test_group_tables_equal_the_cascade(spark, tail):
    """Many score patterns as simulations of one group, against the cascade by joins and windows; a mini-table of two and of three, and ties."""
    rng = np.random.default_rng(2)
    patterns = [tuple(int(g) for g in rng.choice([0, 0, 1, 1, 2], 12)) for _ in range(700)] + [(0,) * 12, (1,) * 12]
    names = ["sim", *(f"{s}{k}" for k in range(6) for s in "ab")]
    goals_ = spark.createDataFrame([(i, *p) for i, p in enumerate(patterns)], ", ".join(f"{n} int" for n in names))
    goals_ = goals_.select("*", F.lit("A").alias("group"), *[F.lit(i).alias(f"t{i}") for i in range(4)])
    got = {r["sim"]: (r["first"], r["second"], r["third"], r["fourth"], r["tied"]) for r in group_tables(goals_, "cascade", tail).collect()}
    pairs = [(i, j) for i in range(4) for j in range(i + 1, 4)]
    flat = [(n, str(i), str(j), p[2 * k], p[2 * k + 1]) for n, p in enumerate(patterns) for k, (i, j) in enumerate(pairs)]
    places = tail and spark.createDataFrame([(str(t), [p]) for t, p in tail.items()], "team_id string, places array<int>")
    table = rules.cascade(spark.createDataFrame(flat, "group int, " + SCORES), ["group"], editions=places).collect()
    order_ = {(r["group"], r["position"]): int(r["team_id"]) for r in table}
    tied = {r["group"] for r in table if r["tied"]}
    assert got == {n: (*(order_[n, p] for p in range(1, 5)), n in tied) for n in range(len(patterns))}
    assert tied and len(tied) < len(patterns) / 2
    plain = {r["sim"]: (r["first"], r["fourth"]) for r in group_tables(goals_).collect()}
    assert any(plain[n] != (got[n][0], got[n][3]) for n in plain)
    with pytest.raises(Exception, match="a tie that no rule breaks in group A"):
        group_tables(goals_, "cascade", tail, "raise").collect()


def test_simulation_with_the_cascade(spark):
    fixture, rates, mapping = world.fixture(spark), world.rates(spark), world.mapping(spark)
    tail = {t: i for i, t in enumerate(world.teams())}
    played = spark.createDataFrame([("001", 3, 0, None), ("102", None, None, None)][:1], "match_id string, home_score int, away_score int, advanced_team string")
    table = advancement(spark, simulate(spark, fixture, rates, mapping, 200, 4, played, 4, "cascade", tail, "raise"), fixture, 200).toPandas()
    assert table["p_champion"].sum() == pytest.approx(1) and table["p_r32"].sum() == pytest.approx(32)
    shares = group_positions(spark, group_tables(group_goals(*group_frame(spark, fixture_of(ALL_PAIRS)), spark.range(100).withColumnRenamed("id", "sim"), 1)), ["a", "b", "c", "d"], 100).toPandas()
    assert len(shares) == 4 and shares[["p_1st", "p_2nd", "p_3rd", "p_4th"]].sum().tolist() == pytest.approx([1] * 4)
