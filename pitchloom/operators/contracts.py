"""Table contracts: strict columns, casts, row predicates and keys, checked in one aggregation each."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class ContractError(ValueError):
    """Some rows break a contract; the message has a count for each rule."""


@dataclass(frozen=True)
class Contract:
    """columns: name to Spark type; nullable: columns that may be null; rules: name to SQL predicate that must not be false;
    keys: column lists that are unique (rows with a null in a key of ``sparse`` are exempt)."""

    columns: dict[str, str]
    nullable: frozenset[str] = frozenset()
    rules: dict[str, str] = field(default_factory=dict)
    keys: tuple[tuple[str, ...], ...] = ()
    sparse: tuple[tuple[str, ...], ...] = ()


def cast(df: DataFrame, contract: Contract) -> DataFrame:
    """Exactly the contract's columns, cast; other columns or missing ones raise."""
    missing, extra = set(contract.columns) - set(df.columns), set(df.columns) - set(contract.columns)
    if missing or extra:
        raise ContractError(f"missing columns {sorted(missing)}, unknown columns {sorted(extra)}")
    return df.select(*[F.col(c).cast(t).alias(c) for c, t in contract.columns.items()])


def violations(df: DataFrame, contract: Contract) -> DataFrame:
    """(rule, rows): how many rows break each rule; one pass for the row rules, one aggregation for each key."""
    rules = {f"{c} is not null": F.col(c).isNotNull() for c in contract.columns if c not in contract.nullable}
    rules |= {name: F.coalesce(F.expr(sql), F.lit(True)) for name, sql in contract.rules.items()}
    counts = df.agg(*[F.count_if(~ok).alias(f"r{i}") for i, ok in enumerate(rules.values())])
    pairs = ", ".join(f"'{n.replace(chr(39), chr(39) * 2)}', r{i}" for i, n in enumerate(rules))
    out = counts.selectExpr(f"stack({len(rules)}, {pairs}) as (rule, rows)")
    for key in contract.keys + contract.sparse:
        rows = df.dropna(subset=list(key)) if key in contract.sparse else df
        repeated = rows.groupBy(*key).count().where("count > 1")
        out = out.unionByName(repeated.agg(F.lit(f"unique {', '.join(key)}").alias("rule"), F.coalesce(F.sum("count"), F.lit(0)).alias("rows")))
    return out


def validate(df: DataFrame, contract: Contract) -> DataFrame:
    """The cast table, or ContractError."""
    df = cast(df, contract)
    broken = violations(df, contract).where("rows > 0").orderBy("rule").collect()  # at most one row per rule
    if broken:
        raise ContractError("; ".join(f"{r['rule']}: {r['rows']} rows" for r in broken))
    return df


def unmatched(df: DataFrame, reference: DataFrame, on: list[str]) -> DataFrame:
    """Distinct keys of df that the reference lacks (nulls exempt)."""
    return df.dropna(subset=on).select(*on).distinct().join(reference.select(*on), on, "left_anti")


def set_difference(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows of one side only, with side = missing (from left) or extra (in left)."""
    return right.distinct().exceptAll(left.distinct()).withColumn("side", F.lit("missing")).unionByName(left.distinct().exceptAll(right.distinct()).withColumn("side", F.lit("extra")))


def repeated_pairs(df: DataFrame, a: str, b: str) -> DataFrame:
    """Unordered pairs that occur more than once."""
    return df.groupBy(F.least(a, b).alias("first"), F.greatest(a, b).alias("second")).agg(F.count("*").alias("n")).where("n > 1")


def sums_to_one(columns: list[str], tolerance: float = 1e-9) -> str:
    return f"abs({' + '.join(columns)} - 1) <= {tolerance}"


def shares(columns: list[str]) -> str:
    return " and ".join(f"{c} between 0 and 1" for c in columns)


def publication_report(tables: dict[str, DataFrame]) -> DataFrame:
    """(table, rule, rows): how many rows of each published table break each rule of its contract. Missing or unknown columns raise."""
    reports = [violations(cast(df, PUBLICATION[name]), PUBLICATION[name]).select(F.lit(name).alias("table"), "rule", "rows") for name, df in sorted(tables.items()) if name in PUBLICATION]
    return reduce(DataFrame.unionByName, reports)


SLUG = "^[a-z0-9]+(-[a-z0-9]+)*$"

TEAMS = Contract({"team_id": "string", "canonical_name": "string", "fifa_code": "string", "elo_code": "string", "confederation": "string", "is_world_cup_2026": "boolean", "active_from": "string", "active_to": "string"}, frozenset({"fifa_code", "elo_code", "active_to"}), {"slug": f"team_id rlike '{SLUG}'"}, (("team_id",),), (("fifa_code",), ("elo_code",)))
ALIASES = Contract({"source": "string", "source_name": "string", "team_id": "string", "valid_from": "string", "valid_to": "string", "mapping_note": "string"}, frozenset({"valid_to", "mapping_note"}), {}, (("source", "source_name", "valid_from"),))
MATCHES = Contract({"match_id": "string", "date": "date", "home_team_id": "string", "away_team_id": "string", "home_team_source_name": "string", "away_team_source_name": "string", "home_score": "int", "away_score": "int", "neutral": "boolean", "shootout_winner_team_id": "string", "result_after_extra_time": "boolean", "city": "string", "country": "string", "tournament": "string", "source": "string", "source_version": "string"}, frozenset({"shootout_winner_team_id", "city"}), {"scores": "home_score >= 0 and away_score >= 0", "two teams": "home_team_id <> away_team_id"}, (("match_id",),))
RATING_HISTORY = Contract({"match_id": "string", "date": "date", "team_id": "string", "opponent_id": "string", "rating_pre": "double", "rating_post": "double", "k_factor": "int"}, frozenset(), {"k": "k_factor in (20, 30, 40, 50, 60)", "positive": "rating_pre > 0 and rating_post > 0"}, (("match_id", "team_id"),))
PREDICTIONS = Contract({"match_id": "string", "holdout": "string", "model": "string", "p_home_win": "double", "p_draw": "double", "p_away_win": "double", "outcome_idx": "int"}, frozenset(), {"sum": sums_to_one(["p_home_win", "p_draw", "p_away_win"], 1e-6), "outcome": "outcome_idx in (0, 1, 2)"}, (("match_id", "model"),))
FIXTURE = Contract({"match_id": "string", "stage": "string", "group": "string", "home_slot": "string", "away_slot": "string", "home_team_id": "string", "away_team_id": "string", "kickoff_utc": "string", "venue": "string", "host_city": "string", "host_country": "string", "status": "string", "source_url": "string", "verified_at_utc": "string"}, frozenset({"group", "home_team_id", "away_team_id"}), {"group": "`group` rlike '^[A-L]$'", "two teams": "home_team_id <> away_team_id", "kickoff is UTC": "kickoff_utc like '%Z'", "verified is UTC": "verified_at_utc like '%Z'"}, (("match_id",),))
LIVE = Contract({"match_id": "string", "team_a": "string", "team_b": "string", "goals_a": "int", "goals_b": "int", "fair_play_a": "double", "fair_play_b": "double", "advanced_team": "string"}, frozenset({"fair_play_a", "fair_play_b", "advanced_team"}), {"goals": "goals_a >= 0 and goals_b >= 0", "conduct": "coalesce(fair_play_a, 0) <= 0 and coalesce(fair_play_b, 0) <= 0", "two teams": "team_a <> team_b", "advanced team plays": "advanced_team in (team_a, team_b)", "advanced team won": "goals_a = goals_b or advanced_team is null or advanced_team = if(goals_a > goals_b, team_a, team_b)"}, (("match_id",),))
ODDS = Contract({"event_id": "string", "match_id": "string", "bookmaker": "string", "home_team_id": "string", "away_team_id": "string", "price_home": "double", "price_draw": "double", "price_away": "double", "prob_home": "double", "prob_draw": "double", "prob_away": "double", "overround": "double"}, frozenset(), {"prices": "price_home > 1 and price_draw > 1 and price_away > 1", "sum": sums_to_one(["prob_home", "prob_draw", "prob_away"]), "two teams": "home_team_id <> away_team_id", "overround": "overround >= 0"}, (("match_id", "bookmaker"),))
UPCOMING = Contract({"match_id": "string", "team_a": "string", "team_b": "string", "prob_a": "double", "prob_draw": "double", "prob_b": "double"}, frozenset(), {"shares": shares(["prob_a", "prob_draw", "prob_b"]), "sum": sums_to_one(["prob_a", "prob_draw", "prob_b"])}, (("match_id",),))
FROZEN = Contract({"match_id": "string", "captured_at_utc": "string", "prob_home": "double", "prob_draw": "double", "prob_away": "double", "prob_home_mean": "double", "prob_draw_mean": "double", "prob_away_mean": "double", "n_bookmakers": "long"}, frozenset(), {"captured is UTC": "captured_at_utc like '%Z'", "shares": shares(["prob_home", "prob_draw", "prob_away"]), "sum": sums_to_one(["prob_home", "prob_draw", "prob_away"])}, (("match_id",),))
LEDGER = Contract({"match_id": "string", "snapshot_id": "string", "model_version": "string", "prob_a": "double", "prob_draw": "double", "prob_b": "double", "outcome_idx": "int"}, frozenset({"outcome_idx"}), {"shares": shares(["prob_a", "prob_draw", "prob_b"]), "sum": sums_to_one(["prob_a", "prob_draw", "prob_b"]), "outcome": "outcome_idx in (0, 1, 2)"}, (("match_id", "snapshot_id"),))

#: The contract of each table that a snapshot publishes; other tables have none.
PUBLICATION = {"results": LIVE, "upcoming": UPCOMING, "frozen_benchmark": FROZEN, "ledger": LEDGER}
