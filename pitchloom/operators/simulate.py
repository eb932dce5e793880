"""Conditional Monte Carlo of a tournament: groups, best thirds, bracket.

A row is a group of a simulation up to its table, and a simulation from there on; each knockout match adds the column of its winner and of its
loser. The distribution of every group match is one sorted array, made once and broadcast with the fixture; a draw is a search by
halving. A group's table is a handful of columns: each ordered pair of its four teams has one number that holds points, goal difference and
goals, so a table, or a mini-table of any teams that are level, is a sum of such numbers. There are no joins or windows, and simulations are
dealt out by number once. Randomness is keyed by (seed, match, simulation): fixing one match never moves another, and neither
row order nor partitioning matters.

Played matches are fixed: a group match by its score, a knockout match by the team that advanced, in every simulation.
"""

from __future__ import annotations

import math
from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pitchloom.functions.columns import keyed_uniform

STAGES = ("r32", "r16", "qf", "sf", "final", "champion")
SIZE = 4
PAIRS = tuple(combinations(range(SIZE), 2))
#: Points, goal difference and goals of a match or a table as one number, in that order of weight.
POINTS, DIFFERENCE = 1 << 40, 1 << 20


def distribution(rate: float) -> list[float]:
    """The Poisson distribution function at 0, 1, ... up to where it no longer grows."""
    out, p, total = [], math.exp(-rate), 0.0
    while total + p > total:
        total += p
        out.append(total)
        p *= rate / len(out)
    return out


def group_rows(matches: list[dict]) -> tuple[list[tuple], int]:
    """A row for each group (its name, its four teams, and for each pair of them match, sides, distributions and score), and the length of the distributions.

    matches: match_id, group, home, away (team numbers), rate_home, rate_away, home_score, away_score; every pair of a group meets once.
    """
    length = 1
    while length <= max((len(distribution(m[f"rate_{s}"])) for m in matches for s in ("home", "away")), default=0):
        length *= 2
    rows = []
    for group in sorted({m["group"] for m in matches}):
        own = [m for m in matches if m["group"] == group]
        teams = sorted({t for m in own for t in (m["home"], m["away"])})
        met = {(min(m["home"], m["away"]), max(m["home"], m["away"])): m for m in own}
        if len(teams) != SIZE or len(own) != len(PAIRS) or len(met) != len(PAIRS):
            raise ValueError(f"group {group}: {len(teams)} teams and {len(own)} matches, four that meet once expected")
        pairs = []
        for i, j in PAIRS:
            m = met[teams[i], teams[j]]
            sides = ("home", "away") if m["home"] == teams[i] else ("away", "home")
            # One number beyond every draw ends the search; it never counts.
            arrays = [(distribution(m[f"rate_{s}"]) + [2.0] * length)[: length - 1] for s in sides]
            pairs.append((m["match_id"], *sides, *arrays, *(m[f"{s}_score"] for s in sides)))
        rows.append((group, *teams, *(x for p in pairs for x in p)))
    return rows, length


def group_frame(spark: SparkSession, matches: list[dict]) -> tuple[DataFrame, int]:
    """``group_rows`` as a table: group, t0..t3, and for pair k: m, a_side, b_side, a_cdf, b_cdf, a_score, b_score with the suffix k."""
    rows, length = group_rows(matches)
    pair = "m{k} string, a_side{k} string, b_side{k} string, a_cdf{k} array<double>, b_cdf{k} array<double>, a_score{k} int, b_score{k} int"
    kinds = ["group string", *(f"t{i} int" for i in range(SIZE)), *(pair.format(k=k) for k in range(len(PAIRS)))]
    return spark.createDataFrame(rows, ", ".join(kinds)), length


def group_goals(groups: DataFrame, length: int, sims: DataFrame, seed: int) -> DataFrame:
    """sim, group, t0..t3 and the goals a0, b0, ... of both sides of each pair.

    The fixture has a fixed number of groups; it is broadcast to the simulations.
    """
    rows = sims.crossJoin(F.broadcast(groups))
    names = [(s, k) for k in range(len(PAIRS)) for s in "ab"]
    rows = rows.withColumns({f"u_{s}{k}": keyed_uniform(seed, F.col(f"m{k}"), F.col("sim"), F.col(f"{s}_side{k}")) for s, k in names} | {f"{s}{k}": F.lit(0) for s, k in names})
    step = length // 2
    while step:
        beyond = lambda s, k, n=step: F.get(f"{s}_cdf{k}", F.col(f"{s}{k}") + (n - 1)) <= F.col(f"u_{s}{k}")
        rows = rows.withColumns({f"{s}{k}": F.col(f"{s}{k}") + F.when(beyond(s, k), step).otherwise(0) for s, k in names})
        step //= 2
    return settled(rows.select("sim", "group", *[f"t{i}" for i in range(SIZE)], *[F.coalesce(f"{s}_score{k}", f"{s}{k}").alias(f"{s}{k}") for s, k in names]))


def settled(rows: DataFrame) -> DataFrame:
    """rows behind a generator of one row: filters of a reader stay above it. Pushed down, they would repeat nested columns without bound."""
    return rows.select(F.inline(F.array(F.struct(*rows.columns))))


def _pick(of: dict[int, Column]) -> Column:
    """The value of the one condition that holds."""
    out = F.lit(None)
    for value, condition in of.items():
        out = F.when(condition, F.lit(value)).otherwise(out)
    return out


def group_tables(goals: DataFrame, rule: str = "table", tail: dict[int, int] | None = None, unbroken: str = "number") -> DataFrame:
    """sim, group, the team numbers first, second, third and fourth, their tables k1..k4 (one number each), and tied: a tie that no rule broke.

    rule: ``table`` is points, goal difference and goals; ``cascade`` goes on with the mini-tables of teams that are level, again inside what
    they separate, then with ``tail``, a place for each team number (conduct, then ranking editions). What is still level goes by team number, or raises with unbroken="raise".
    """
    if rule not in ("table", "cascade") or unbroken not in ("number", "raise"):
        raise ValueError(f"unknown rule {rule!r} or {unbroken!r}")
    teams = range(SIZE)
    value = {}
    for k, (i, j) in enumerate(PAIRS):
        for own, other, s, o in ((i, j, f"a{k}", f"b{k}"), (j, i, f"b{k}", f"a{k}")):
            scored, conceded = F.col(s).cast("long"), F.col(o).cast("long")
            points = F.when(scored > conceded, 3 * POINTS).when(scored == conceded, POINTS).otherwise(0)
            value[f"v{own}{other}"] = points + (scored - conceded) * DIFFERENCE + scored
    add = lambda parts: sum(parts[1:], parts[0])
    count = lambda conditions: add([c.cast("int") for c in conditions])
    c = F.col
    rows = goals.withColumns(value).withColumns({f"k{i}": add([c(f"v{i}{j}") for j in teams if j != i]) for i in teams})
    rows = rows.withColumns({f"p{i}": count([c(f"k{j}") > c(f"k{i}") for j in teams if j != i]) for i in teams})
    level = lambda i, j: c(f"p{i}") == c(f"p{j}")
    if rule == "cascade":
        for _ in range(SIZE - 1):
            rows = rows.withColumns({f"h{i}": add([F.when(level(i, j), c(f"v{i}{j}")).otherwise(0) for j in teams if j != i]) for i in teams})
            rows = rows.withColumns({f"p{i}": c(f"p{i}") + count([level(i, j) & (c(f"h{j}") > c(f"h{i}")) for j in teams if j != i]) for i in teams})
        if tail:
            place = F.create_map(*[F.lit(x) for pair in tail.items() for x in pair])
            rows = rows.withColumns({f"h{i}": place[c(f"t{i}")] for i in teams})
            rows = rows.withColumns({f"p{i}": c(f"p{i}") + count([level(i, j) & (c(f"h{j}") < c(f"h{i}")) for j in teams if j != i]) for i in teams})
    tied = add([level(i, j).cast("int") for i, j in PAIRS]) > 0
    if unbroken == "raise":
        tied = F.when(tied, F.raise_error(F.concat(F.lit("a tie that no rule breaks in group "), c("group"))).cast("boolean")).otherwise(False)
    rows = rows.withColumn("tied", tied).withColumns({f"p{i}": c(f"p{i}") + (count([level(i, j) for j in teams if j < i]) if i else F.lit(0)) for i in teams})
    rows = rows.select("sim", "group", "tied", *[f"t{i}" for i in teams], *[f"k{i}" for i in teams], *[_pick({i: c(f"p{i}") == p for i in teams}).alias(f"at{p}") for p in teams])
    named = [_pick_column("t", p).alias(n) for p, n in enumerate(("first", "second", "third", "fourth"))]
    return settled(rows.select("sim", "group", *named, *[_pick_column("k", p).alias(f"k{p + 1}") for p in teams], "tied"))


def _pick_column(prefix: str, place: int) -> Column:
    """The team's column at a place."""
    out = F.col(f"{prefix}0")
    for i in range(1, SIZE):
        out = F.when(F.col(f"at{place}") == i, F.col(f"{prefix}{i}")).otherwise(out)
    return out


def by_simulation(tables: DataFrame, groups: list[str], thirds: int = 8) -> DataFrame:
    """One row per simulation: columns 1A, 2A, ... with team numbers, the letters of the qualified thirds, and their teams by letter."""
    named = [F.max(F.when(F.col("group") == g, F.col(c))).alias(f"{p}{g}") for g in groups for p, c in ((1, "first"), (2, "second"))]
    order = F.array_sort(F.collect_list(F.struct((-F.col("k3")).alias("key"), "group", "third"))).alias("__thirds")
    rows = tables.groupBy("sim").agg(*named, order).withColumn("__thirds", F.slice("__thirds", 1, thirds))
    of = F.map_from_arrays(F.transform("__thirds", lambda x: x["group"]), F.transform("__thirds", lambda x: x["third"]))
    letters = F.array_join(F.array_sort(F.transform("__thirds", lambda x: x["group"])), "")
    return rows.withColumn("by_letter", of).withColumn("combination", letters).drop("__thirds")


def simulate(spark: SparkSession, fixture: DataFrame, rates: DataFrame, mapping: DataFrame, n_sims: int, seed: int, played: DataFrame | None = None, parts: int | None = None, rule: str = "table", tail: dict[str, int] | None = None, unbroken: str = "number") -> DataFrame:
    """One row per simulation with the team numbers of all slots and of winners and losers (w_/l_ and the match_id).

    fixture: match_id, stage (group, r32, ..., third, final), group, home_slot, away_slot, home_team_id, away_team_id.
    rates: home_team_id, away_team_id, rate_home, rate_away, p_advance for every ordered pair. mapping: combination, match_id,
    group. played: match_id, home_score, away_score, advanced_team. rule, tail (by team_id) and unbroken as in ``group_tables``.
    A tournament's fixture, pairs and mapping have a fixed size.
    """
    rows = fixture.orderBy("match_id").collect()  # the fixture of one tournament
    teams = sorted({t for r in rows if r["stage"] == "group" for t in (r["home_team_id"], r["away_team_id"])})
    groups = sorted({r["group"] for r in rows if r["stage"] == "group"})
    number = {t: i for i, t in enumerate(teams)}
    fixed = {r["match_id"]: r for r in played.collect()} if played is not None else {}
    rated = {(r["home_team_id"], r["away_team_id"]): r for r in rates.select("home_team_id", "away_team_id", "rate_home", "rate_away", "p_advance").collect()}  # teams squared
    matches = []
    for r in (r for r in rows if r["stage"] == "group"):
        pair, f = rated.get((r["home_team_id"], r["away_team_id"])), fixed.get(r["match_id"])
        if pair is None:
            raise ValueError(f"no rates for match {r['match_id']}")
        matches.append({"match_id": r["match_id"], "group": r["group"], "home": number[r["home_team_id"]], "away": number[r["away_team_id"]], "rate_home": pair["rate_home"], "rate_away": pair["rate_away"], "home_score": f and f["home_score"], "away_score": f and f["away_score"]})
    chances = {k: r["p_advance"] for k, r in rated.items()}
    missing = [(a, b) for a in teams for b in teams if a != b and (a, b) not in chances]
    if missing:
        raise ValueError(f"no chance to advance for {len(missing)} pairs, {missing[0]} first")
    chance = spark.createDataFrame([([float(chances.get((a, b), 0.5)) for a in teams for b in teams],)], "chance array<double>")
    parts = parts or max(8, min(2_000, n_sims // 2_000))
    sims = spark.range(n_sims).withColumnRenamed("id", "sim").repartition(parts, "sim")
    grouped, length = group_frame(spark, matches)
    tables = group_tables(group_goals(grouped, length, sims, seed), rule, {number[t]: p for t, p in (tail or {}).items()}, unbroken)
    state = by_simulation(tables, groups)
    slots = mapping.groupBy("combination").agg(F.map_from_entries(F.collect_list(F.struct("match_id", "group"))).alias("assigned"))
    state = state.join(F.broadcast(slots), "combination", "left").crossJoin(F.broadcast(chance))  # one row per combination of groups, one row
    def team(slot: str, match_id: str) -> Column:
        if slot[0] in "WL" and slot[1:].isdigit():
            return F.col(f"{slot[0].lower()}_{slot[1:]}")
        if slot[0] == "3":
            return F.col("by_letter")[F.col("assigned")[match_id]]
        return F.col(slot)

    for stage in ("r32", "r16", "qf", "sf", "third", "final"):
        new = {}
        for r in (r for r in rows if r["stage"] == stage):
            m = r["match_id"]
            new[f"h_{m}"], new[f"a_{m}"] = team(r["home_slot"], m), team(r["away_slot"], m)
        state = state.withColumns(new)
        new = {}
        for r in (r for r in rows if r["stage"] == stage):
            m, h, a = r["match_id"], F.col(f"h_{r['match_id']}"), F.col(f"a_{r['match_id']}")
            if m in fixed:
                f = fixed[m]
                if not f["advanced_team"] and f["home_score"] == f["away_score"]:
                    raise ValueError(f"drawn knockout match {m} without advanced_team")
                winner = f["advanced_team"] or (r["home_team_id"] if f["home_score"] > f["away_score"] else r["away_team_id"])
                loser = next((t for t in (r["home_team_id"], r["away_team_id"]) if t != winner), None)
                new[f"w_{m}"], new[f"l_{m}"] = F.lit(teams.index(winner)), F.lit(teams.index(loser) if loser in teams else None).cast("int")
            else:
                through = keyed_uniform(seed, F.lit(m), F.col("sim"), F.lit("advance")) < F.get("chance", h * len(teams) + a)
                new[f"w_{m}"], new[f"l_{m}"] = F.when(through, h).otherwise(a), F.when(through, a).otherwise(h)
        state = state.withColumns(new)
    return settled(state)


def advancement(spark: SparkSession, simulated: DataFrame, fixture: DataFrame, n_sims: int) -> DataFrame:
    """team_id and the share of simulations in which the team reaches each stage."""
    rows = fixture.orderBy("match_id").collect()
    teams = sorted({t for r in rows if r["stage"] == "group" for t in (r["home_team_id"], r["away_team_id"])})
    reach = []
    for stage in ("r32", "r16", "qf", "sf", "final"):
        for r in (r for r in rows if r["stage"] == stage):
            reach += [F.struct(F.lit(stage).alias("stage"), F.col(f"{s}_{r['match_id']}").alias("team")) for s in "ha"]
    reach += [F.struct(F.lit("champion").alias("stage"), F.col(f"w_{r['match_id']}").alias("team")) for r in rows if r["stage"] == "final"]
    counts = simulated.select(F.explode(F.array(*reach)).alias("x")).groupBy("x.team").pivot("x.stage", list(STAGES)).count()
    names = spark.createDataFrame(list(enumerate(teams)), "team int, team_id string")
    return names.join(counts, "team", "left").select("team_id", *[(F.coalesce(F.col(s), F.lit(0)) / n_sims).alias(f"p_{s}") for s in STAGES])


def group_positions(spark: SparkSession, tables: DataFrame, teams: list[str], n_sims: int) -> DataFrame:
    """team_id, group and the share of simulations in each place, from ``group_tables``."""
    placed = F.array(*[F.struct(F.col(c).alias("team"), F.lit(p).alias("position")) for p, c in enumerate(("first", "second", "third", "fourth"), 1)])
    counts = tables.select("group", F.explode(placed).alias("x")).groupBy("x.team", "group").pivot("x.position", [1, 2, 3, 4]).count()
    names = spark.createDataFrame(list(enumerate(teams)), "team int, team_id string")
    return names.join(counts, "team").select("team_id", "group", *[(F.coalesce(F.col(str(p)), F.lit(0)) / n_sims).alias(f"p_{n}") for p, n in enumerate(("1st", "2nd", "3rd", "4th"), 1)])
