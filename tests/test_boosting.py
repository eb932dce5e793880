"""Boosted trees: brute force on one machine, unknown values, partitions, held-out loss."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from pitchloom.functions.columns import log_loss, picked
from pitchloom.operators import boosting, challenger
from pitchloom.operators.scoring import P

NAMES = ("a", "b", "c")


def table(spark, n=400, seed=1):
    """Classes that depend on two features together; c is often unknown, and then class 2 is likelier."""
    r = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        a, b, c = r.uniform(-1, 1), r.uniform(-1, 1), r.uniform(-1, 1)
        y = 2 if c > 0.5 and r.random() < 0.8 else int(a * b > 0) if r.random() < 0.85 else int(r.integers(0, 3))
        rows.append((f"m{i}", round(a, 2), round(b, 2) if i % 11 else float("nan"), None if c > 0.5 else round(c, 2), y))
    return spark.createDataFrame(rows, "id string, a double, b double, c double, y int")


def brute(values, labels, edges, rounds, depth, rate, least, penalty):
    """Recursive growth over row lists: every feature, edge and way of the unknown is tried by summing its rows anew."""
    margins = np.zeros((len(values), 3))
    for _ in range(rounds):
        p = np.exp(margins) / np.exp(margins).sum(axis=1, keepdims=True)
        step = np.zeros_like(margins)
        for c in range(3):
            g, h = p[:, c] - (labels == c), 2 * p[:, c] * (1 - p[:, c])

            def grow(rows, left_depth):
                score = lambda some: g[some].sum() ** 2 / (h[some].sum() + penalty)  # noqa: B023, E731
                best = (1e-6, None)
                for f in range(values.shape[1]) if left_depth else ():
                    v = values[rows, f]
                    for unknown_left in (False, True):
                        for e in (*edges[f], np.inf):  # the last one parts known from unknown
                            left = np.where(np.isnan(v), unknown_left, v <= e)
                            parts = rows[left], rows[~left]
                            if min(h[x].sum() for x in parts) >= least:  # noqa: B023
                                gain = score(parts[0]) + score(parts[1]) - score(rows)
                                if gain > best[0] + 1e-9:
                                    best = (gain, parts)
                if best[1] is None:
                    step[rows, c] = -rate * g[rows].sum() / (h[rows].sum() + penalty)  # noqa: B023
                else:
                    for part in best[1]:
                        grow(part, left_depth - 1)

            grow(np.arange(len(values)), depth)
        margins += step
    return np.exp(margins) / np.exp(margins).sum(axis=1, keepdims=True)


def shares(rows, model):
    got = rows.select("id", boosting.probabilities(model).alias("p")).orderBy("id").collect()
    return np.array([r["p"] for r in got])


def test_equals_brute_force(spark):
    rows = table(spark)
    options = {"rounds": 3, "depth": 2, "rate": 0.5, "least": 2.0, "penalty": 1.0}
    model = boosting.fit(rows, NAMES, "id", "y", share=1.0, columns=1.0, bins=16, every=2, **options)
    flat = rows.orderBy("id").toPandas()
    want = brute(flat[list(NAMES)].to_numpy(float), flat["y"].to_numpy(), model.edges, **options)
    assert np.abs(shares(rows, model) - want).max() < 1e-5
    assert max(map(len, model.edges)) <= 16
    again = boosting.Boosted.from_document(json.loads(json.dumps(model.document())))
    assert (shares(rows, again) == shares(rows, model)).all()
    with pytest.raises(ValueError, match="fit together"):
        boosting.Boosted.from_document(model.document() | {"names": ["a"]})


def test_partitions_do_not_matter(spark):
    rows = table(spark, 200)
    one = boosting.fit(rows.coalesce(1), NAMES, "id", "y", rounds=2, depth=2, bins=8, least=1.0)
    many = boosting.fit(rows.repartition(5), NAMES, "id", "y", rounds=2, depth=2, bins=8, least=1.0)
    assert one.document() == many.document()


def test_unknown_values_find_their_side(spark):
    """Only what is unknown tells the class; a zero in its place would hide it."""
    rows = spark.range(300).selectExpr("concat('m', id) id", "cast(if(id % 3 = 2, null, id % 7 - 3) as double) a", "0.0D b", "cast(null as double) c", "cast(id % 3 as int) y")
    model = boosting.fit(rows, NAMES, "id", "y", rounds=4, depth=2, rate=0.5, share=1.0, columns=1.0, least=1.0)
    got = rows.select("y", boosting.probabilities(model)[2].alias("p")).groupBy(F.col("y") == 2).agg(F.avg("p").alias("p")).orderBy("p").collect()
    assert got[1][0] and got[1]["p"] > 0.7 and got[0]["p"] < 0.2
    assert model.edges[1] == () and model.edges[2] == ()  # constant and wholly unknown features never split
    assert set(model.trees.feature.ravel()) <= {-1, 0}
    assert rows.limit(0).select(boosting.probabilities(model)).collect() == []


def test_extreme_values_and_bounds(spark):
    rows = spark.range(60).selectExpr("concat('m', id) id", "if(id % 3 = 0, double('-infinity'), if(id % 3 = 1, 1e300D, double('infinity'))) a", "id * 1.0D b", "0D c", "cast(id % 3 as int) y")
    model = boosting.fit(rows, NAMES, "id", "y", rounds=3, depth=2, rate=0.5, share=1.0, columns=1.0, least=0.5)
    assert (shares(rows, model).argmax(axis=1) == [r["y"] for r in rows.orderBy("id").collect()]).all()
    with pytest.raises(ValueError, match="bins"):
        boosting.fit(rows, NAMES, "id", "y", bins=1000)


def test_held_out_loss_is_below_the_multinomial_logit(spark):
    """Home and away win follow the product of two features, which no linear model sees."""
    r = np.random.default_rng(3)
    x = r.uniform(-1, 1, (900, 2))
    y = np.where(r.random(900) < 0.2, 1, np.where(x[:, 0] * x[:, 1] > 0, 0, 2))
    rows = spark.createDataFrame([(f"m{i}", int(y[i]), float(x[i, 0]), float(x[i, 1])) for i in range(900)], "match_id string, outcome int, elo_diff double, days_rest_diff double")
    rows = rows.withColumns({n: F.lit(0.0) for n in challenger.FEATURES if n not in rows.columns}).withColumn("late", F.substring("match_id", 2, 3).cast("int") >= 600).persist()
    train, held = rows.where("not late"), rows.where("late")
    loss = {}
    for kind, options in {"trees": {"rounds": 12, "rate": 0.3}, "logistic": {}}.items():
        got = challenger.predict(held, challenger.fit(train, kind, **options))
        loss[kind] = got.agg(F.avg(log_loss(picked([F.col(c) for c in P], F.col("outcome"))))).first()[0]
    rows.unpersist()
    assert loss["trees"] < 0.8 * loss["logistic"]
