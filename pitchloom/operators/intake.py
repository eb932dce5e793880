"""From scanned rows to canonical tables: matches, fixture, rating list, odds benchmark.

Each ``*_records`` function gives every row that a table takes and, with a verdict, every row that it can't take (verdict null if good,
place says where). ``documents.checked`` keeps the good rows and raises on others, naming the first of each kind; the ``load_*`` functions do that for files.
Null keys and names are faults with a verdict, empty tables give empty results, repeated rows are judged each on its own.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pitchloom.functions.columns import slug
from pitchloom.operators import contracts, identity, market
from pitchloom.operators.live import CANONICAL
from pitchloom.sources import documents, scans, sinks


def _named(rows: DataFrame, aliases: DataFrame, name: str, to: str) -> DataFrame:
    """rows with the team of a name on the row's date, and the number of its aliases in force."""
    found = identity.resolve(rows, aliases, [], name)
    return found.withColumnsRenamed({"team_id": to, "n_aliases": f"__n_{name}"})


def match_records(results: DataFrame, shootouts: DataFrame, aliases: DataFrame, source: str, source_version: str, order: list[str]) -> DataFrame:
    """Played results in the columns of ``live.CANONICAL``; verdict, place.

    results: date, home_team, away_team, home_score, away_score, tournament, city, country, neutral and the columns of ``order``; shootouts: date,
    home_team, away_team, winner; aliases: source, source_name, team_id, valid_from, valid_to. Rows without scores are not played yet and go.
    match_id is date, home and away name as slugs; of equal ones the second in ``order`` gets -2 and so on.
    verdict: one score, no date, unknown name, ambiguous name, several shoot-outs (one row for the date and names, whether a result has them or not).
    """
    key = ["date", "home_team", "away_team"]
    shot = shootouts.groupBy(*key).agg(F.count("*").alias("n"), F.min("winner").alias("winner"))
    rows = results.where("home_score is not null or away_score is not null").join(shot.where("n = 1").drop("n"), key, "left").withColumn("source", F.lit(source))
    for name, to in (("home_team", "home_team_id"), ("away_team", "away_team_id"), ("winner", "shootout_winner_team_id")):
        rows = _named(rows, aliases, name, to)
    asked = [(F.col("__n_home_team"), F.lit(True)), (F.col("__n_away_team"), F.lit(True)), (F.col("__n_winner"), F.col("winner").isNotNull())]
    any_of = lambda test: F.greatest(*[(test(n) & needed).cast("int") for n, needed in asked]) == 1
    verdict = (
        F.when(F.col("home_score").isNull() | F.col("away_score").isNull(), "one score")
        .when(F.col("date").isNull(), "no date")
        .when(any_of(lambda n: n == 0), "unknown name")
        .when(any_of(lambda n: n > 1), "ambiguous name")
    )
    place = F.concat_ws(" ", F.col("date").cast("string"), "home_team", "away_team")
    rows = rows.withColumn("verdict", verdict).withColumn("place", place)
    base = F.concat_ws("-", F.col("date").cast("string"), slug(F.col("home_team")), slug(F.col("away_team")))
    # A row with a verdict gets no number: its base is spread, so that faults of one kind are no hot key.
    spread = F.concat(F.lit("?"), F.xxhash64("place", *order).cast("string"))
    rows = identity.numbered_ids(rows, F.when(F.col("verdict").isNull(), base).otherwise(spread), order)
    taken = rows.select(
        F.when(F.col("verdict").isNull(), F.col("row_id")).alias("match_id"), "date", "home_team_id", "away_team_id", F.col("home_team").alias("home_team_source_name"), F.col("away_team").alias("away_team_source_name"),
        "home_score", "away_score", "neutral", "shootout_winner_team_id", F.col("winner").isNotNull().alias("result_after_extra_time"), "city", "country", "tournament", "source", F.lit(source_version).alias("source_version"), "verdict", "place",
    )
    doubled = shot.where("n > 1").select("date", F.col("home_team").alias("home_team_source_name"), F.col("away_team").alias("away_team_source_name"), F.lit("several shoot-outs").alias("verdict"), place.alias("place"))
    return taken.unionByName(doubled, allowMissingColumns=True)


def load_matches(spark: SparkSession, results: str, shootouts: str, aliases: DataFrame, source: str, source_version: str) -> DataFrame:
    """The match table of two CSV files, checked against its contract. Repeated matches are numbered by score and place, which does not depend on how files are split."""
    shot = scans.csv_columns(spark, shootouts, ["date", "home_team", "away_team", "winner"]).withColumn("date", F.col("date").cast("date"))
    rows = match_records(scans.csv_results(spark, results), shot, aliases, source, source_version, ["home_score", "away_score", "tournament", "city", "country", "neutral"])
    return contracts.validate(documents.checked(rows, "matches").select(*contracts.MATCHES.columns), contracts.MATCHES)


@dataclass(frozen=True)
class Structure:
    """What a tournament's fixture must look like. Fixed values of the 2026 tournament by default."""

    matches: int | None = 104
    groups: tuple[str, ...] = tuple("ABCDEFGHIJKL")
    per_group: int = 6
    appearances: int = 3
    stages: tuple[str, ...] = ("group", "round_of_32", "round_of_16", "quarterfinal", "semifinal", "third_place", "final")
    countries: tuple[str, ...] = ("CAN", "MEX", "USA")


def fixture_faults(fixture: DataFrame, teams: DataFrame, structure: Structure) -> DataFrame:
    """(rule, subject, rows): everything about a fixture that differs from its structure; no rows if it is sound.

    fixture: the columns of ``contracts.FIXTURE``; teams: team_id and participates, one row each. subject is a match, a pairing of slots, a group or a team.
    One pass for the rules of a row, one count for matches, pairings, groups and teams each. Null slots make no pairing; a null match_id counts as one that repeats.
    """
    spark = fixture.sparkSession
    group = F.coalesce(F.col("stage") == "group", F.lit(False))
    false = lambda c: ~F.coalesce(c, F.lit(False))
    teams_known, slots_known = F.col("home_team_id").isNotNull() & F.col("away_team_id").isNotNull(), F.col("home_slot").isNotNull() & F.col("away_slot").isNotNull()
    rules = {
        "unsupported stage": false(F.col("stage").isin(*structure.stages)),
        "unsupported host country": false(F.col("host_country").isin(*structure.countries)),
        "kickoff is not UTC": false(F.col("kickoff_utc").endswith("Z")),
        "group match without teams": group & ~teams_known,
        "knockout match without slots": ~group & ~slots_known,
        "team against itself": teams_known & (F.col("home_team_id") == F.col("away_team_id")),
    }
    broken = F.filter(F.array(*[F.when(test, F.lit(name)) for name, test in rules.items()]), lambda r: r.isNotNull())
    out = fixture.select(F.explode(broken).alias("rule"), F.col("match_id").alias("subject")).groupBy("rule", "subject").agg(F.count("*").alias("rows"))

    def counted(rows: DataFrame, rule: str | Column, subject: Column, n: Column, where: Column) -> DataFrame:
        return rows.where(where).select((F.lit(rule) if isinstance(rule, str) else rule).alias("rule"), subject.alias("subject"), n.cast("long").alias("rows"))

    n = F.coalesce("n", F.lit(0))
    ids = fixture.groupBy("match_id").agg(F.count("*").alias("n"))
    out = out.unionByName(counted(ids, "repeated match_id", F.col("match_id"), n, (n > 1) | F.col("match_id").isNull()))
    pairing = F.concat_ws("::", F.least("home_slot", "away_slot"), F.greatest("home_slot", "away_slot"))
    pairs = fixture.where(slots_known).groupBy(pairing.alias("pairing")).agg(F.count("*").alias("n"))
    out = out.unionByName(counted(pairs, "repeated pairing", F.col("pairing"), n, n > 1))
    if structure.matches is not None:
        out = out.unionByName(counted(fixture.agg(F.count("*").alias("n")), "number of matches", F.lit("fixture"), n, n != structure.matches))
    wanted = spark.createDataFrame([(g,) for g in structure.groups], "wanted string")
    games = fixture.where(group)
    sizes = games.groupBy("group").agg(F.count("*").alias("n")).join(wanted, F.col("group") == F.col("wanted"), "full")
    rule = F.when(F.col("wanted").isNull(), "unsupported group").otherwise("matches of a group")
    out = out.unionByName(counted(sizes, rule, F.coalesce("wanted", "group"), n, F.col("wanted").isNull() | (n != structure.per_group)))
    sides = lambda rows: rows.select("stage", F.explode(F.array("home_team_id", "away_team_id")).alias("__team")).where("__team is not null")
    plays = sides(fixture).groupBy("__team").agg(F.count("*").alias("all"), F.count_if(group).alias("n")).join(teams, F.col("__team") == F.col("team_id"), "full")
    takes_part = F.coalesce("participates", F.lit(False))
    rule = (
        F.when(F.col("team_id").isNull(), "unknown team")
        .when(takes_part & (n == 0), "participant without group matches")
        .when(~takes_part & (n > 0), "team of a group match is no participant")
        .when(takes_part & (n != structure.appearances), "group appearances")
    )
    return out.unionByName(counted(plays, rule, F.coalesce("team_id", "__team"), F.when(F.col("team_id").isNull(), F.col("all")).otherwise(n), rule.isNotNull()))


def load_fixture(spark: SparkSession, path: str, teams: DataFrame, structure: Structure | None = None) -> DataFrame:
    """A fixture file (further columns are left out) that meets its contract and its structure; everything else raises and names the first fault of each rule."""
    fixture = contracts.validate(scans.csv_columns(spark, path, list(contracts.FIXTURE.columns)), contracts.FIXTURE)
    faults = fixture_faults(fixture, teams, structure or Structure())
    found = faults.groupBy("rule").agg(F.count("*").alias("n"), F.min("subject").alias("first")).orderBy("rule").collect()  # at most one row per rule
    if found:
        raise contracts.ContractError("; ".join(f"{r['rule']} ({r['n']}, first {r['first']})" for r in found))
    return fixture


def rating_records(rating_list: DataFrame, names: DataFrame, aliases: DataFrame, participants: DataFrame) -> DataFrame:
    """One row for each participant: team_id, source_name, code, rank, rating; verdict, place. One row more for each code of the list without a name.

    rating_list: code, rank, rating; names: code, name; aliases: source_name and team_id of this source; participants: team_id.
    verdict: no alias, several aliases, alias of several teams, no rating, name of several codes, rating is no number, code without a name.
    """
    mine = participants.select("team_id").where("team_id is not null").distinct()
    used = aliases.select("source_name", "team_id").distinct().join(mine, "team_id", "left_semi")
    of_name = used.groupBy("source_name").agg(F.count("*").alias("n_teams"))
    of_team = used.groupBy("team_id").agg(F.count("*").alias("n_aliases"), F.min("source_name").alias("source_name")).join(of_name, "source_name", "left")
    named = rating_list.join(names, "code", "left")
    entry = F.struct("code", "rank", "rating")
    by_name = named.where("name is not null").groupBy("name").agg(F.count("*").alias("n_codes"), F.min(entry).alias("entry"))
    rows = mine.join(of_team, "team_id", "left").join(by_name, F.col("source_name") == F.col("name"), "left")
    verdict = (
        F.when(F.col("source_name").isNull(), "no alias")
        .when(F.col("n_aliases") > 1, "several aliases")
        .when(F.col("n_teams") > 1, "alias of several teams")
        .when(F.col("name").isNull(), "no rating")
        .when(F.col("n_codes") > 1, "name of several codes")
        .when(F.col("entry.rating").isNull() | F.isnan("entry.rating"), "rating is no number")
    )
    taken = rows.select("team_id", "source_name", "entry.code", "entry.rank", "entry.rating", verdict.alias("verdict"), F.col("team_id").alias("place"))
    nameless = named.where("name is null").select("code", "rank", "rating", F.lit("code without a name").alias("verdict"), F.col("code").alias("place"))
    return taken.unionByName(nameless, allowMissingColumns=True)


def load_ratings(spark: SparkSession, ratings: str, names: str, aliases: DataFrame, participants: DataFrame) -> DataFrame:
    """The rating of every participant, from the list and the names of its codes."""
    return documents.checked(rating_records(scans.tsv_ratings(spark, ratings), scans.tsv_names(spark, names), aliases, participants), "rating list")


def named_quotes(records: DataFrame, aliases: DataFrame, source: str) -> DataFrame:
    """Checked ``documents.quote_records`` with the teams of their names, null where a name has no single alias on the day; no match is declared."""
    rows = records.withColumn("source", F.lit(source)).withColumn("date", F.to_date("commence_time")).withColumn("declared_match_id", F.lit(None).cast("string"))
    for name in ("home_team", "away_team"):
        rows = _named(rows, aliases, name, f"{name}_id")
    return rows.drop("source", "date", "__n_home_team", "__n_away_team")


#: Rows with a verdict are dealt under so many numbers.
SPREAD = 1_000


def benchmark_records(quotes: DataFrame, fixture: DataFrame, captured_at: Column, hours: float = 12, fresh_hours: float = 24) -> DataFrame:
    """Quotes in the orientation of their fixture, without the bookmaker's margin: the columns of ``contracts.ODDS``; verdict, place.

    quotes: event_id, bookmaker, home_team_id, away_team_id, commence_time, updated_at (null if unknown), declared_match_id (null if none), price_home, price_draw, price_away.
    fixture: match_id, kickoff, home_team_id, away_team_id. captured_at: an expression without columns. Sides and prices are exchanged where a quote has them the other way round.
    verdict: unknown team, no time, no fixture, several fixtures, another match declared, stale, price not above 1, repeated quote (all rows of a match and bookmaker).
    """
    linked = market.linked(quotes, fixture, ["event_id", "bookmaker"], hours)
    rows = market.oriented(market.oriented(linked, "home_team_id", "away_team_id"), "price_home", "price_away")
    rows = market.demargined(rows)
    late = F.unix_micros(captured_at) - F.unix_micros("updated_at") > int(fresh_hours * 3_600_000_000)
    verdict = (
        F.when(F.col("home_team_id").isNull() | F.col("away_team_id").isNull(), "unknown team")
        .when(F.col("commence_time").isNull(), "no time")
        .when(F.col("n_fixtures") == 0, "no fixture")
        .when(F.col("n_fixtures") > 1, "several fixtures")
        .when(F.col("declared_match_id") != F.col("match_id"), "another match declared")
        .when(late, "stale")
        .when(F.col("prob_home").isNull(), "price not above 1")
    )
    rows = rows.withColumn("verdict", verdict)
    repeats = rows.where("verdict is null").groupBy(F.col("match_id").alias("__match"), F.col("bookmaker").alias("__book")).agg(F.count("*").alias("__n")).where("__n > 1")
    # Rows with a verdict meet nothing: a hash deals them to all tasks, where their null match would gather them by bookmaker.
    spread = F.when(F.col("verdict").isNull(), 0).otherwise(1 + F.pmod(F.xxhash64("event_id", "bookmaker", "commence_time", "price_home", "price_draw", "price_away"), F.lit(SPREAD))).cast("int")
    rows = rows.withColumn("__spread", spread)
    same = (F.col("match_id") == F.col("__match")) & F.col("bookmaker").eqNullSafe(F.col("__book")) & (F.col("__spread") == F.col("__good"))
    rows = rows.join(repeats.withColumn("__good", F.lit(0)), same, "left")
    found = F.coalesce("verdict", F.when(F.col("__n").isNotNull(), F.lit("repeated quote")))
    return rows.select(*contracts.ODDS.columns, found.alias("verdict"), F.concat_ws("/", "event_id", F.col("bookmaker").cast("string")).alias("place"))


def freeze(benchmark: DataFrame, captured_at: Column) -> DataFrame:
    """The consensus of a benchmark's quotes for each match, with the instant of capture on every row, as ``contracts.FROZEN`` has it. An empty benchmark gives no rows."""
    in_utc = F.to_utc_timestamp(captured_at, F.current_timezone())
    stamped = market.consensus(benchmark, ["match_id"]).withColumn("captured_at_utc", F.date_format(in_utc, "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    return stamped.select(*contracts.FROZEN.columns)


def write_benchmark(benchmark: DataFrame, captured_at: Column, path: str) -> dict:
    """A frozen benchmark, checked, in a table that is written once; an empty one raises."""
    frozen = contracts.validate(freeze(benchmark, captured_at), contracts.FROZEN)
    if frozen.isEmpty():
        raise contracts.ContractError("an empty benchmark is not frozen")
    return sinks.write_once(frozen, path, ["match_id"])


def publish(spark: SparkSession, tables: dict[str, tuple[DataFrame, list[str]]], folder: str, name: str, metadata: dict, entries: tuple[DataFrame, str, list[str]] | None = None) -> dict:
    """``sinks.publish_bundle`` of tables that meet the contracts of ``contracts.PUBLICATION``; nothing is written if one is broken. Ledger entries are checked as well."""
    checked = {t: (contracts.validate(df, contracts.PUBLICATION[t]) if t in contracts.PUBLICATION else df, keys) for t, (df, keys) in tables.items()}
    if entries:
        entries = (contracts.validate(entries[0], contracts.LEDGER), *entries[1:])
    return sinks.publish_bundle(spark, checked, folder, name, metadata, entries)
