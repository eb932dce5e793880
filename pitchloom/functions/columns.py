"""Scalar column expressions; all of them stay in Catalyst.

Outcome classes are 0 home win, 1 draw, 2 away win, everywhere.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the rating model.
START_RATING, HOME_BONUS, SPREAD = 1000.0, 100.0, 400.0
#: Probabilities are clipped to this before a logarithm.
EPS = 2.220446049250313e-16


def slug(name: Column) -> Column:
    """Lower case, runs of other characters to one hyphen, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(name), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def outcome(home: Column, away: Column, after_extra_time: Column | None = None) -> Column:
    """Outcome class; a match decided after extra time is a draw at 90 minutes. Null scores give null."""
    plain = F.when(home > away, 0).when(home < away, 2).when(home == away, 1)
    return plain if after_extra_time is None else F.when(F.coalesce(after_extra_time, F.lit(False)), 1).otherwise(plain)


def points(scored: Column, conceded: Column) -> Column:
    return F.when(scored > conceded, 3).when(scored == conceded, 1).when(scored < conceded, 0)


def decay(days: Column, xi: float) -> Column:
    """exp(-xi * days)."""
    return F.exp(-F.lit(xi) * days)


def pair_key(a: Column, b: Column) -> Column:
    """Key of an unordered pair."""
    return F.concat_ws("::", F.least(a, b), F.greatest(a, b))


def expected_score(difference: Column) -> Column:
    """Expected result of a side whose rating is higher by ``difference``."""
    return 1 / (F.pow(F.lit(10.0), -difference / SPREAD) + 1)


def margin_factor(goal_difference: Column, winner_minus_loser: Column) -> Column:
    """1 for a draw, else grows with the margin and shrinks with the rating gap."""
    return F.when(goal_difference == 0, 1.0).otherwise(F.log(F.abs(goal_difference) + 1) * 2.2 / (winner_minus_loser * 0.001 + 2.2))


def poisson_pmf(k: Column, rate: Column) -> Column:
    return F.exp(-rate) * F.pow(rate, k) / F.factorial(k)


def low_score_factor(a: Column, b: Column, rate_a: Column, rate_b: Column, rho: Column) -> Column:
    """Correction of the four lowest scores for dependence."""
    return (
        F.when((a == 0) & (b == 0), 1 - rate_a * rate_b * rho)
        .when((a == 0) & (b == 1), 1 + rate_a * rho)
        .when((a == 1) & (b == 0), 1 + rate_b * rho)
        .when((a == 1) & (b == 1), 1 - rho)
        .otherwise(1.0)
    )


def normalized(*parts: Column) -> list[Column]:
    """Parts over their sum; null where the sum is not positive."""
    total = sum(parts[1:], parts[0])
    return [F.when(total > 0, p / total) for p in parts]


def implied(*prices: Column) -> list[Column]:
    """Probabilities without the bookmaker's margin; null unless every price is above 1 (and finite: NaN is above infinity)."""
    good = F.lit(True)
    for p in prices:
        good = good & (p > 1) & (p < float("inf"))
    return [F.when(good, share) for share in normalized(*[1 / p for p in prices])]


def advance_probability(win: Column, draw: Column, loss: Column, shrink: float = 0.0) -> Column:
    """Chance to go through: win, or draw and then the conditional win chance (one half if there is none), shrunk to one half."""
    q = F.when(win + loss > 0, win / (win + loss)).otherwise(0.5)
    return win + draw * (q * (1 - shrink) + 0.5 * shrink)


def keyed_uniform(seed: int | Column, *key: Column) -> Column:
    """A uniform in [0, 1) that depends on the seed and key alone, not on order or partitioning: 52 bits of an MD5."""
    seed = F.lit(str(seed)) if isinstance(seed, int) else seed.cast("string")
    digest = F.md5(F.concat_ws("|", seed, *[k.cast("string") for k in key]).cast("binary"))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / float(2**52)


def poisson_draw(rate: Column, u: Column, first: int = 15) -> Column:
    """The inverse of the Poisson distribution function at u: how many of its values are at most u.

    The first values decide nearly always; else all values go in up to where the tail is below the resolution of u.
    """
    start = F.struct(F.lit(0).alias("n"), F.exp(-rate).alias("p"), F.exp(-rate).alias("cdf"))

    def step(acc, k):
        p = acc["p"] * rate / k
        return F.struct((acc["n"] + F.when(acc["cdf"] <= u, 1).otherwise(0)).alias("n"), p.alias("p"), (acc["cdf"] + p).alias("cdf"))

    short = F.aggregate(F.sequence(F.lit(1), F.lit(first)), start, step, lambda acc: acc["n"])
    enough = F.ceil(rate + 12 * F.sqrt(rate) + 40).cast("int")
    return F.when(short < first, short).otherwise(F.aggregate(F.sequence(F.lit(1), enough), start, step, lambda acc: acc["n"]))


def log_loss(p: Column) -> Column:
    """Loss of the probability given to what happened."""
    return -F.log(F.least(F.greatest(p, F.lit(EPS)), F.lit(1 - EPS)))


def brier(probabilities: list[Column], happened: Column) -> Column:
    terms = [F.pow(p - F.when(happened == i, 1.0).otherwise(0.0), 2) for i, p in enumerate(probabilities)]
    return sum(terms[1:], terms[0])


def ranked_probability(probabilities: list[Column], happened: Column) -> Column:
    """Half the sum of squared differences of the cumulative distributions, three classes in order."""
    first = probabilities[0] - F.when(happened == 0, 1.0).otherwise(0.0)
    second = probabilities[0] + probabilities[1] - F.when(happened <= 1, 1.0).otherwise(0.0)
    return (F.pow(first, 2) + F.pow(second, 2)) / 2


def picked(probabilities: list[Column], happened: Column) -> Column:
    return F.element_at(F.array(*probabilities), happened + 1)


def percent(p: Column) -> Column:
    return F.format_string("%.1f%%", 100 * p)


def signed_points(delta: Column) -> Column:
    return F.format_string("%+.1f pp", 100 * delta)
