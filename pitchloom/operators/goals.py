"""Time-decayed bivariate Poisson goal model: fit, rates, score matrix, outcome probabilities.

Log rates are  intercept + attack - defence (+ home, unless neutral); the four lowest scores carry a factor of dependence rho. All
parameters maximize one weighted likelihood. It depends on the matches only through sums by (home team, away team, neutral): weight, weighted
goals of both, and the weight of each low score. So matches are aggregated once, for any number of cutoffs and decays at a time, and
L-BFGS works on the sums: in the driver while they are few (HERE), else each step is one aggregation of gradient parts in Spark. Parameters are the one
thing whose size is the number of teams; nothing is square in it.
"""

from __future__ import annotations

import datetime
import math
from collections.abc import Callable
from dataclasses import asdict, dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pitchloom.functions.columns import low_score_factor, poisson_pmf
from pitchloom.sources.work import written

MOST_GOALS = 10
RHO_BOUND = 0.2
PAIR = ("home_team_id", "away_team_id", "neutral")
#: Sums of a pair: weight, goals of both sides, and weights of the scores 0-0, 0-1, 1-0 and 1-1.
SUMS = ("w", "x", "y", "w00", "w01", "w10", "w11")
#: Rows of sums that the driver takes (64 bytes each); more stay in Spark.
HERE = 200_000
#: Parameters of up to so many teams are broadcast to the matches.
BROADCAST_TEAMS = 100_000


@dataclass(frozen=True)
class GoalModel:
    """teams with their attack and defence strengths (each sums to zero), intercept, home effect and low-score dependence."""

    teams: tuple[str, ...]
    attack: tuple[float, ...]
    defence: tuple[float, ...]
    intercept: float
    home: float
    rho: float
    xi: float
    cutoff: str

    def __post_init__(self):
        if not len(self.teams) == len(self.attack) == len(self.defence) or abs(self.rho) > RHO_BOUND:
            raise ValueError("goal model: unequal lengths or rho out of bounds")

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(list(zip(self.teams, self.attack, self.defence, strict=True)), "team_id string, attack double, defence double")

    def document(self) -> dict:
        """All of it as plain JSON values."""
        return {k: list(v) if isinstance(v, tuple) else v for k, v in asdict(self).items()}

    @classmethod
    def from_document(cls, document: dict) -> GoalModel:
        """The model of a document, checked: unknown or missing parts, other lengths, repeated teams, numbers that are not finite or a bad date raise."""
        names = set(cls.__dataclass_fields__)
        if set(document) != names:
            raise ValueError(f"goal model: parts {sorted(names ^ set(document))} are missing or unknown")
        numbers = [*document["attack"], *document["defence"], *(document[c] for c in ("intercept", "home", "rho", "xi"))]
        if len(set(document["teams"])) != len(document["teams"]) or not all(isinstance(v, (int, float)) and math.isfinite(v) for v in numbers):
            raise ValueError("goal model: repeated teams or numbers that are not finite")
        datetime.date.fromisoformat(document["cutoff"])
        return cls(**{k: tuple(v) if isinstance(v, list) else v for k, v in document.items()})


def cells(weighted: DataFrame) -> DataFrame:
    """Sufficient statistics of weighted matches: weight and weighted goals by attacker, defender and home effect."""
    side = lambda a, b, home: F.struct(F.col(f"{a}_team_id").alias("attacker"), F.col(f"{b}_team_id").alias("defender"), home.alias("home"), F.col(f"{a}_score").alias("goals"))
    at_home = F.when(F.col("neutral"), 0).otherwise(1)
    rows = weighted.select("weight", F.explode(F.array(side("home", "away", at_home), side("away", "home", F.lit(0)))).alias("s")).select("weight", "s.*")
    return rows.groupBy("attacker", "defender", "home").agg(F.sum("weight").alias("weight"), F.sum(F.col("weight") * F.col("goals")).alias("goals"))


def _sums(weight: Column, suffix: str = "") -> list[Column]:
    x, y = F.col("home_score"), F.col("away_score")
    low = [F.when((x == i) & (y == j), weight).otherwise(0.0) for i in (0, 1) for j in (0, 1)]
    return [F.sum(v).alias(n + suffix) for v, n in zip((weight, weight * x, weight * y, *low), SUMS, strict=True)]


def pair_sums(weighted: DataFrame) -> DataFrame:
    """Sufficient statistics of weighted matches for all parameters: PAIR and SUMS."""
    return weighted.groupBy(*PAIR).agg(*_sums(F.col("weight")))


def decayed_sums(games: DataFrame, cutoffs: list[str], grid: list[float], least: float = 1e-4) -> DataFrame:
    """cutoff, xi, PAIR and SUMS of the matches strictly before each cutoff, with weights exp(-xi * days) of at least ``least``.

    One scan for all of them: days are cut into periods at the cutoffs and at the ends of their reach, and the weight within a period, seen from its
    end, times the weight of the end, seen from the cutoff, is the weight. So a second aggregation of the sums by period gives every fit.
    """
    spark = games.sparkSession
    ends = {c: (datetime.date.fromisoformat(c) - datetime.date(1970, 1, 1)).days for c in cutoffs}
    reach = {xi: math.floor(math.log(1 / least) / xi) for xi in grid}
    bounds = sorted({*ends.values(), *(e - reach[xi] for e in ends.values() for xi in grid)})
    day = F.unix_date("date")
    period = sum([F.when(day >= b, 1).otherwise(0) for b in bounds[1:]], F.lit(0))
    rows = games.where((F.col("date") >= F.date_from_unix_date(F.lit(bounds[0]))) & (F.col("date") < F.date_from_unix_date(F.lit(bounds[-1]))))
    age = F.element_at(F.array(*map(F.lit, bounds[1:])), F.col("period") + 1) - day
    by_period = rows.withColumn("period", period).withColumn("age", age).groupBy("period", *PAIR)
    sums = by_period.agg(*[s for i, xi in enumerate(grid) for s in _sums(F.exp(-F.lit(xi) * F.col("age")), f"_{i}")])
    parts = [(p, c, xi, i, math.exp(-xi * (e - end))) for c, e in ends.items() for i, xi in enumerate(grid) for p, (start, end) in enumerate(zip(bounds, bounds[1:], strict=False)) if start >= e - reach[xi] and end <= e]
    fits = F.broadcast(spark.createDataFrame(parts, "period int, cutoff string, xi double, i int, factor double"))  # periods times fits
    own = lambda n: sum([F.when(F.col("i") == i, F.col(f"{n}_{i}")).otherwise(0.0) for i in range(1, len(grid))], F.when(F.col("i") == 0, F.col(f"{n}_0")).otherwise(0.0))
    return sums.join(fits, "period").groupBy("cutoff", "xi", *PAIR).agg(*[F.sum(F.col("factor") * own(n)).alias(n) for n in SUMS])


def likelihood(sums: dict[str, np.ndarray], theta: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Negative log-likelihood of sums (h and a number the teams), its gradient, and its curvature by parameter; infinite where a factor is not positive.

    theta: attacks, defences, intercept, home effect, and the inverse hyperbolic tangent of rho over its bound.
    """
    n = (len(theta) - 3) // 2
    h, a, home, w = sums["h"], sums["a"], sums["home"], sums["w"]
    slope = math.tanh(theta[-1])
    rho = RHO_BOUND * slope
    log_x, log_y = theta[-3] + theta[h] - theta[n + a] + theta[-2] * home, theta[-3] + theta[a] - theta[n + h]
    x, y = np.exp(np.minimum(log_x, 50)), np.exp(np.minimum(log_y, 50))
    factors = {"w00": 1 - x * y * rho, "w01": 1 + x * rho, "w10": 1 + y * rho, "w11": np.full(len(x), 1 - rho)}
    if any(((f <= 0) & (sums[k] > 0)).any() for k, f in factors.items()):
        return math.inf, np.zeros(len(theta)), np.ones(len(theta))
    factors = {k: np.where(sums[k] > 0, f, 1.0) for k, f in factors.items()}
    share = {k: sums[k] / f for k, f in factors.items()}
    loss = (w * (x + y) - sums["x"] * log_x - sums["y"] * log_y - sum(sums[k] * np.log(f) for k, f in factors.items())).sum()
    both = share["w00"] * x * y * rho
    by_x, by_y = w * x - sums["x"] + both - share["w01"] * x * rho, w * y - sums["y"] + both - share["w10"] * y * rho
    by_rho = share["w00"] * x * y - share["w01"] * x - share["w10"] * y + share["w11"]
    bend = sum(share[k] / factors[k] * v**2 for k, v in (("w00", x * y), ("w01", x), ("w10", y), ("w11", 1.0)))
    chain = RHO_BOUND * (1 - slope**2)

    def gathered(u, v, sign):
        own, other = np.bincount(h, u, n) + np.bincount(a, v, n), np.bincount(a, u, n) + np.bincount(h, v, n)
        return np.concatenate([own, sign * other, [u.sum() + v.sum(), (u * home).sum()]])

    gradient = np.append(gathered(by_x, by_y, -1), by_rho.sum() * chain)
    return float(loss), gradient, np.append(gathered(w * x, w * y, 1), bend.sum() * chain**2)


def distributed_likelihood(numbered: DataFrame, theta: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """``likelihood`` of sums that stay in Spark (h, a, home, SUMS): one aggregation of each task's parts. theta, two numbers a team, goes with the function."""
    size = len(theta)

    def parts(batches):
        total = np.zeros(2 * size + 1)
        for b in batches:
            loss, gradient, curvature = likelihood({c: b.column(i).to_numpy(zero_copy_only=False) for i, c in enumerate(b.schema.names)}, theta)
            total += np.concatenate([gradient, curvature, [loss]])
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["k", "v"])

    out = np.zeros(2 * size + 1)
    for r in numbered.mapInArrow(parts, "k long, v double").groupBy("k").agg(F.sum("v").alias("v")).collect():  # a row for each parameter
        out[r["k"]] = r["v"]
    return float(out[-1]), out[:size], out[size:-1]


def minimized(f: Callable[[np.ndarray], tuple[float, np.ndarray, np.ndarray]], theta: np.ndarray, steps: int = 500, tolerance: float = 1e-8, memory: int = 12) -> np.ndarray:
    """Where f (value, gradient, curvature) is least, by L-BFGS that starts from the curvature; raises if it does not get there.

    It ends where no part of the gradient exceeds ``tolerance`` of the greatest curvature, or where the value is as low as its resolution shows.
    """
    value, gradient, curvature = f(theta)
    scale = tolerance * max(1.0, curvature.max())
    pairs: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(steps):
        if np.abs(gradient).max() <= scale:
            return theta
        direction, used = -gradient, []
        for s, y in reversed(pairs):
            k = s @ direction / (s @ y)
            direction = direction - k * y
            used.append(k)
        direction = direction / np.maximum(curvature, 1e-3)
        for (s, y), k in zip(pairs, reversed(used), strict=True):
            direction = direction + (k - y @ direction / (s @ y)) * s
        fall = gradient @ direction
        if fall >= 0:
            pairs, direction = [], -gradient / np.maximum(curvature, 1e-3)
            fall = gradient @ direction
        size, noise = min(1.0, 4.0 / np.abs(direction).max()), 1e-14 * (1 + abs(value))
        while not (found := f(theta + size * direction))[0] <= value + 1e-4 * size * fall + noise:
            size /= 2
            if size < 1e-6:
                if -fall <= 100 * noise:
                    return theta
                raise ValueError("goal model: no convergence")
        step, turn = size * direction, found[1] - gradient
        if step @ turn > 1e-12 * np.linalg.norm(step) * np.linalg.norm(turn):
            pairs = [*pairs, (step, turn)][-memory:]
        theta, value, gradient = theta + step, found[0], found[1]
        curvature = found[2]
    raise ValueError("goal model: no convergence")


def _solved(teams: list[str], goals: float, weight: float, f: Callable, xi: float, cutoff: str) -> GoalModel:
    """The model of least f. Attacks and defences are centred: their common level is the intercept's."""
    n = len(teams)
    theta = minimized(f, np.concatenate([np.zeros(2 * n), [math.log(max(goals, 1e-9) / (2 * weight)), 0.0, 0.0]]))
    up, down = theta[:n].mean(), theta[n : 2 * n].mean()
    attack, defence = theta[:n] - up, theta[n : 2 * n] - down
    return GoalModel(tuple(teams), tuple(attack.tolist()), tuple(defence.tolist()), float(theta[-3] + up - down), float(theta[-2]), RHO_BOUND * math.tanh(theta[-1]), xi, cutoff)


def _fit_here(rows, xi: float, cutoff: str) -> GoalModel:
    """From sums as a pandas table."""
    if not len(rows):
        raise ValueError("goal model: no matches")
    rows = rows.sort_values(list(PAIR))
    teams = sorted({*rows["home_team_id"], *rows["away_team_id"]})
    place = {t: i for i, t in enumerate(teams)}
    sums = {c: rows[c].to_numpy(float) for c in SUMS}
    sums |= {"h": rows["home_team_id"].map(place).to_numpy(), "a": rows["away_team_id"].map(place).to_numpy(), "home": 1.0 - rows["neutral"].to_numpy(float)}
    return _solved(teams, (sums["x"] + sums["y"]).sum(), sums["w"].sum(), lambda t: likelihood(sums, t), xi, cutoff)


def numbered_sums(sums: DataFrame) -> tuple[list[str], DataFrame]:
    """The teams in order, and sums with h, a and home for ``distributed_likelihood``, as a written table."""
    spark = sums.sparkSession
    teams = sorted(r["t"] for r in sums.select(F.explode(F.array("home_team_id", "away_team_id")).alias("t")).distinct().collect())  # as many as the parameters have
    place = spark.createDataFrame(list(enumerate(teams)), "n int, t string")
    joined = sums.join(place.select(F.col("t").alias("home_team_id"), F.col("n").alias("h")), "home_team_id").join(place.select(F.col("t").alias("away_team_id"), F.col("n").alias("a")), "away_team_id")
    return teams, written(joined.select("h", "a", F.when(F.col("neutral"), 0.0).otherwise(1.0).alias("home"), *SUMS), "sums")


def _fit_there(sums: DataFrame, xi: float, cutoff: str) -> GoalModel:
    """From sums that stay in Spark."""
    teams, numbered = numbered_sums(sums)
    goals, weight = numbered.agg(F.sum(F.col("x") + F.col("y")), F.sum("w")).first()
    return _solved(teams, goals, weight, lambda t: distributed_likelihood(numbered, t), xi, cutoff)


def fit(weighted: DataFrame, xi: float, cutoff: str, here: int = HERE) -> GoalModel:
    """Weighted maximum likelihood over all parameters; no matches, or no convergence, raise."""
    sums = pair_sums(weighted)
    rows = sums.limit(here + 1).toPandas()
    return _fit_here(rows, xi, cutoff) if len(rows) <= here else _fit_there(written(sums, "pairs"), xi, cutoff)


def fit_all(games: DataFrame, cutoffs: list[str], grid: list[float], here: int = HERE) -> dict[tuple[str, float], GoalModel]:
    """The model of each cutoff and decay, from one scan of the matches."""
    sums = decayed_sums(games, cutoffs, grid)
    rows = sums.limit(here + 1).toPandas()
    keys = [(c, xi) for c in cutoffs for xi in grid]
    if len(rows) <= here:
        return {(c, xi): _fit_here(rows[(rows["cutoff"] == c) & (rows["xi"] == xi)], xi, c) for c, xi in keys}
    sums = written(sums, "pairs")
    return {(c, xi): _fit_there(sums.where((F.col("cutoff") == c) & (F.col("xi") == xi)), xi, c) for c, xi in keys}


def rates_of(matches: DataFrame, models: dict[str, GoalModel]) -> DataFrame:
    """matches (with ``fit``, the name of a model) with rate_home, rate_away and rho of their model; null rates for a team that it lacks."""
    spark = matches.sparkSession
    heads = spark.createDataFrame([(k, m.intercept, m.home, m.rho) for k, m in models.items()], "fit string, __c double, __g double, rho double")
    table = spark.createDataFrame([(k, t, a, d) for k, m in models.items() for t, a, d in zip(m.teams, m.attack, m.defence, strict=True)], "fit string, t string, a double, d double")
    if table.count() <= BROADCAST_TEAMS:
        table = F.broadcast(table)
    side = lambda p: table.select("fit", F.col("t").alias(f"{p}_team_id"), F.col("a").alias(f"__{p}_a"), F.col("d").alias(f"__{p}_d"))
    joined = matches.join(F.broadcast(heads), "fit").join(side("home"), ["fit", "home_team_id"], "left").join(side("away"), ["fit", "away_team_id"], "left")
    home = F.when(F.col("neutral"), 0.0).otherwise(F.col("__g"))
    rate_home, rate_away = F.exp(F.col("__c") + F.col("__home_a") - F.col("__away_d") + home), F.exp(F.col("__c") + F.col("__away_a") - F.col("__home_d"))
    return joined.select(*matches.columns, rate_home.alias("rate_home"), rate_away.alias("rate_away"), "rho")


def rates(matches: DataFrame, model: GoalModel) -> DataFrame:
    """matches with rate_home and rate_away; null for a team that the model lacks."""
    table = model.table(matches.sparkSession)
    if len(model.teams) <= BROADCAST_TEAMS:
        table = F.broadcast(table)
    side = lambda p: table.select(F.col("team_id").alias(f"{p}_team_id"), F.col("attack").alias(f"__{p}_attack"), F.col("defence").alias(f"__{p}_defence"))
    joined = matches.join(side("home"), "home_team_id", "left").join(side("away"), "away_team_id", "left")
    home = F.when(F.col("neutral"), 0.0).otherwise(F.lit(model.home))
    out = joined.withColumn("rate_home", F.exp(model.intercept + F.col("__home_attack") - F.col("__away_defence") + home)).withColumn("rate_away", F.exp(model.intercept + F.col("__away_attack") - F.col("__home_defence")))
    return out.drop("__home_attack", "__home_defence", "__away_attack", "__away_defence")


def score_matrix(rated: DataFrame, rho: float | Column = 0.0, most: int = MOST_GOALS) -> DataFrame:
    """One row per match and score (0..most each) with its probability; the probabilities of a match sum to one.

    The two distributions of a match and its sum are made once; its cells are a product each, over a fixed list of scores.
    """
    rho = F.lit(float(rho)) if isinstance(rho, (int, float)) else rho
    a, b, change = _distributions(rated, rho, most)
    total = _added(a) * _added(b) + _added(change)
    made = rated.withColumns(a | b).withColumns(change)
    sides = [F.array(*map(F.col, s)).alias(n) for s, n in ((a, "__a"), (b, "__b"))]
    made = made.select(*rated.columns, *sides, rho.alias("__rho"), total.alias("__all"))
    scores = F.array(*[F.struct(F.lit(i).alias("home_goals"), F.lit(j).alias("away_goals")) for i in range(most + 1) for j in range(most + 1)])
    cells = made.select("*", F.explode(scores).alias("__s")).select("*", "__s.*")
    i, j = F.col("home_goals"), F.col("away_goals")
    p = F.get("__a", i) * F.get("__b", j) * low_score_factor(i, j, F.col("rate_home"), F.col("rate_away"), F.col("__rho")) / F.col("__all")
    return cells.select(*rated.columns, "home_goals", "away_goals", p.alias("p"))


def _added(parts) -> Column:
    first, *rest = [F.col(p) if isinstance(p, str) else p for p in parts]
    return sum(rest, first)


def _distributions(rated: DataFrame, rho: Column, most: int) -> tuple[dict[str, Column], dict[str, Column], dict[str, Column]]:
    """Columns of the two distributions of goals, and what the dependence adds to the four lowest scores (of those columns)."""
    a, b = ({f"__{s}{k}": poisson_pmf(F.lit(k), F.col(r)) for k in range(most + 1)} for s, r in (("a", "rate_home"), ("b", "rate_away")))
    change = {f"__{i}{j}": F.col(f"__a{i}") * F.col(f"__b{j}") * (low_score_factor(F.lit(i), F.lit(j), F.col("rate_home"), F.col("rate_away"), rho) - 1) for i in (0, 1) for j in (0, 1)}
    return a, b, change


def with_outcomes(rated: DataFrame, rho: float | Column = 0.0, most: int = MOST_GOALS) -> DataFrame:
    """rated matches with p_home, p_draw and p_away: sums below, on and above the diagonal of the normalized score matrix."""
    rho = F.lit(float(rho)) if isinstance(rho, (int, float)) else rho
    # The cells are products but for the four lowest: sums of products of the two distributions, as plain columns.
    pmf_a, pmf_b, change = _distributions(rated, rho, most)
    a, b = [F.col(c) for c in pmf_a], [F.col(c) for c in pmf_b]
    sums = {
        "__h": _added([a[i] * _added(b[:i]) for i in range(1, most + 1)]) + F.col("__10"),
        "__d": _added([x * y for x, y in zip(a, b, strict=True)]) + F.col("__00") + F.col("__11"),
        "__v": _added([b[i] * _added(a[:i]) for i in range(1, most + 1)]) + F.col("__01"),
    }
    full = rated.withColumns(pmf_a | pmf_b).withColumns(change).select(*rated.columns, *[c.alias(n) for n, c in sums.items()])
    shares = [F.col(c) / (F.col("__h") + F.col("__d") + F.col("__v")) for c in sums]
    return full.select(*rated.columns, *[s.alias(n) for s, n in zip(shares, ("p_home", "p_draw", "p_away"), strict=True)])


def ordered_logit(dr: Column, c1: float, c2: float, scale: float) -> list[Column]:
    """Home, draw and away probabilities from a rating difference and two cut-points."""
    below = lambda c: 1 / (1 + F.exp(-(c - dr) / scale))
    return [F.greatest(p, F.lit(1e-12)) for p in (1 - below(c2), below(c2) - below(c1), below(c1))]


def fit_ordered_logit(rows: DataFrame, bucket: float = 5.0, most_buckets: int = 20_000) -> tuple[float, float, float]:
    """Cut-points and scale by maximum likelihood over counts of (rating difference in buckets, outcome).

    Rows: dr, outcome. The counts are bounded by the range of differences, at most ``most_buckets`` per outcome; more raise.
    """
    counts = rows.groupBy(F.floor(F.col("dr") / bucket).alias("b"), "outcome").agg(F.avg("dr").alias("dr"), F.count("*").alias("n"))
    table = counts.limit(3 * most_buckets + 1).toPandas()
    if len(table) > 3 * most_buckets:
        raise ValueError(f"ordered logit: more than {most_buckets} buckets")
    dr, y, n = table["dr"].to_numpy(float), table["outcome"].to_numpy(int), table["n"].to_numpy(float)

    def loss(t):
        c1, c2, s = t[0], t[0] + np.exp(t[1]), np.exp(t[2])
        lo, hi = (1 / (1 + np.exp(-np.clip((c - dr) / s, -40, 40))) for c in (c1, c2))
        p = np.choose(y, [1 - hi, hi - lo, lo])
        return -(n * np.log(np.maximum(p, 1e-12))).sum() / n.sum()

    theta = np.array([-60.0, np.log(120.0), np.log(150.0)])
    scales = np.array([1.0, 0.01, 0.01])

    def gradient(t):
        return np.array([(loss(t + e) - loss(t - e)) / (2 * e.sum()) for e in np.diag(scales)])

    inverse, g = np.diag(scales**2) * 1e4, gradient(theta)
    for _ in range(300):
        direction = -inverse @ g
        if direction @ g >= 0:
            inverse = np.diag(scales**2) * 1e4
            direction = -inverse @ g
        size, at = 1.0, loss(theta)
        while size > 1e-10 and loss(theta + size * direction) > at + 1e-4 * size * direction @ g:
            size /= 2
        step = size * direction
        fresh = gradient(theta + step)
        y_, theta, g = fresh - g, theta + step, fresh
        if np.abs(step / scales).max() < 1e-7:
            break
        if (c := y_ @ step) > 1e-14:
            left = np.eye(3) - np.outer(step, y_) / c
            inverse = left @ inverse @ left.T + np.outer(step, step) / c
    return float(theta[0]), float(theta[0] + np.exp(theta[1])), float(np.exp(theta[2]))
