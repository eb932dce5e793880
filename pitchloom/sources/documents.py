"""JSON documents with a verdict for each record: nothing that fails to parse disappears.

Texts are parsed to variants. A text that is no JSON (cut off, HTML, repeated keys in an object) is one record with a verdict; below
that each record is judged on its own. The strict scans raise and name the first fault of each kind; the others return verdicts beside records.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pitchloom.operators.rules import assignment_errors


class DocumentError(ValueError):
    """A document or some of its records are not what they should be."""


def parsed(text: str) -> Column:
    """A text as one JSON value, null if it is none or more than one: in brackets, as the parser ignores what follows a value."""
    values = F.try_variant_get(F.try_parse_json(F.concat(F.lit("["), F.col(text), F.lit("]"))), "$", "array<variant>")
    return F.when(F.size(values) == 1, F.get(values, F.lit(0)))


def _get(value: str, path: str, kind: str) -> Column:
    return F.try_variant_get(F.col(value), path, kind)


def _is(value: str, kind: str) -> Column:
    return F.coalesce(F.startswith(F.schema_of_variant(F.col(value)), F.lit(kind)), F.lit(False))


def _elements(rows: DataFrame, array: Column, number: str, name: str) -> DataFrame:
    """A row for each element, numbered from 0; rows without elements stay, with nulls."""
    return rows.select("*", F.posexplode_outer(array).alias(number, name))


def checked(records: DataFrame, what: str) -> DataFrame:
    """The records without a verdict; others raise, with their number by verdict."""
    faults = records.where("verdict is not null").groupBy("verdict").agg(F.count("*").alias("n"), F.min("place").alias("place")).orderBy("verdict").collect()  # a row for each kind of fault
    if faults:
        raise DocumentError(f"{what}: " + "; ".join(f"{r['verdict']} ({r['n']}, first at {r['place']})" for r in faults))
    return records.drop("verdict", "place")


def quote_records(payloads: DataFrame, column: str = "payload", source: Column | None = None) -> DataFrame:
    """One row for each head-to-head market of each bookmaker and event of payloads (JSON arrays of events), and one for each thing that is not as it should be.

    event_id, bookmaker, commence_time, updated_at, home_team, away_team, price_home, price_draw, price_away, verdict and place. verdict (null if good): not JSON, not an array,
    event is no object, event lacks id, teams or time, event without quotes, no h2h market, not three-way, no update time, price is no number.
    Markets other than h2h are no quotes. ``source`` names a payload in place.
    """
    rows = payloads.select((F.lit("payload") if source is None else source.cast("string")).alias("place"), parsed(column).alias("v"))
    rows = _elements(rows, _get("v", "$", "array<variant>"), "event_no", "e")
    rows = rows.select("place", "event_no", "v", "e", *[_get("e", f"$.{c}", "string").alias(c) for c in ("id", "home_team", "away_team", "commence_time")])
    rows = _elements(rows, _get("e", "$.bookmakers", "array<variant>"), "book_no", "b")
    h2h = F.filter(_get("b", "$.markets", "array<variant>"), lambda m: F.coalesce(F.try_variant_get(m, "$.key", "string") == "h2h", F.lit(False)))
    rows = _elements(rows, h2h, "market_no", "m").withColumn("o", _get("m", "$.outcomes", "array<variant>"))
    rows = rows.withColumn("names", F.array_sort(F.transform("o", lambda o: F.coalesce(F.try_variant_get(o, "$.name", "string"), F.lit("")))))
    wanted = F.array_sort(F.array("home_team", "away_team", F.lit("Draw")))
    updated = F.coalesce(_get("m", "$.last_update", "string"), _get("b", "$.last_update", "string"))

    def price(name: Column) -> Column:
        return F.try_variant_get(F.get(F.filter("o", lambda o: F.try_variant_get(o, "$.name", "string") == name), F.lit(0)), "$.price", "double")

    prices = {"price_home": price(F.col("home_team")), "price_draw": price(F.lit("Draw")), "price_away": price(F.col("away_team"))}
    rows = rows.withColumn("updated", updated).withColumns(prices)
    lacking = F.exists(F.array("id", "home_team", "away_team", "commence_time"), lambda x: F.coalesce(x, F.lit("")) == "")
    verdict = (
        F.when(F.col("v").isNull(), "not JSON")
        .when(~_is("v", "ARRAY"), "not an array")
        .when(F.col("event_no").isNull(), "nothing")
        .when(~_is("e", "OBJECT"), "event is no object")
        .when(lacking, "event lacks id, teams or time")
        .when(F.col("book_no").isNull(), "event without quotes")
        .when(F.col("market_no").isNull(), "no h2h market")
        .when(F.coalesce(F.col("names") != wanted, F.lit(True)), "not three-way")
        .when(F.coalesce(F.col("updated"), F.lit("")) == "", "no update time")
        .when(F.col("price_home").isNull() | F.col("price_draw").isNull() | F.col("price_away").isNull(), "price is no number")
    )
    place = F.concat_ws("/", "place", *[F.col(c).cast("string") for c in ("event_no", "book_no", "market_no")])
    rows = rows.withColumn("verdict", verdict).where("verdict is null or verdict <> 'nothing'")  # an empty array holds nothing
    return rows.select(
        F.col("id").alias("event_id"), _get("b", "$.key", "string").alias("bookmaker"), F.try_to_timestamp("commence_time").alias("commence_time"), F.try_to_timestamp("updated").alias("updated_at"),
        "home_team", "away_team", *prices, "verdict", place.alias("place"),
    )


def result_records(spark: SparkSession, path: str, allowed: set[str], required: set[str], lines: bool = False) -> DataFrame:
    """One row for each played result of JSON files: the allowed keys as strings, verdict and place (file, and the number of the record or the line's text).

    A file is a document, an array of records or an object with the array ``results``; with ``lines`` each line is a record, and files are split.
    Files that are all empty raise. verdict (null if good): not JSON, no list of results, record is no object, unknown key ..., missing key ....
    """
    texts = spark.read.text(path, wholetext=not lines).select("value", F.col("_metadata.file_path").alias("file"))
    if not lines and texts.isEmpty():
        raise DocumentError(f"{path}: no document, or an empty one")
    rows = texts.where("trim(value) <> ''" if lines else "true").withColumn("v", parsed("value"))
    if lines:
        rows = rows.withColumn("r", F.col("v")).withColumn("place", F.concat_ws("/", "file", F.substring("value", 1, 60)))
        whole = F.lit(True)
    else:
        rows = rows.withColumn("list", F.coalesce(_get("v", "$.results", "array<variant>"), _get("v", "$", "array<variant>")))
        rows = _elements(rows, F.col("list"), "n", "r").withColumn("place", F.concat_ws("/", "file", F.col("n").cast("string")))
        whole = F.col("list").isNotNull()
    rows = rows.withColumn("m", _get("r", "$", "map<string,variant>")).withColumn("keys", F.map_keys("m"))
    names = lambda of: F.array(*[F.lit(x) for x in sorted(of)]).cast("array<string>")
    unknown, missing = F.array_sort(F.array_except("keys", names(allowed))), F.array_except(names(required), F.col("keys"))
    verdict = (
        F.when(F.col("v").isNull(), "not JSON")
        .when(~whole, "no list of results")
        .when(F.col("r").isNotNull() & ~_is("r", "OBJECT"), "record is no object")
        .when(F.size(unknown) > 0, F.concat(F.lit("unknown key "), F.array_join(unknown, ", ")))
        .when(F.size(missing) > 0, F.concat(F.lit("missing key "), F.array_join(missing, ", ")))
    )
    rows = rows.withColumn("verdict", verdict).where("verdict is not null or r is not null")
    return rows.select(*[F.try_variant_get(F.col("m")[k], "$", "string").alias(k) for k in sorted(allowed)], "verdict", "place")


def third_place_mapping(spark: SparkSession, path: str, size: int = 8) -> DataFrame:
    """combination, match_id and group of a reviewed mapping document, checked; faults raise.

    The document is an object with ``cases`` (array of qualified_groups and assignments, an object of match_id to group) and ``selectors`` (match_id to the slot that the third fills).
    """
    rows = spark.read.text(path, wholetext=True).select(parsed("value").alias("v"))
    cases = rows.select(F.explode(_get("v", "$.cases", "array<variant>")).alias("c"))
    cases = cases.select(_get("c", "$.qualified_groups", "string").alias("combination"), _get("c", "$.assignments", "map<string,string>").alias("a"))
    selectors = rows.select(F.explode(_get("v", "$.selectors", "map<string,string>")).alias("match_id", "slot"))
    if cases.isEmpty() or selectors.isEmpty():
        raise DocumentError(f"{path}: not JSON, or no cases or selectors")
    if not cases.where("combination is null or a is null").isEmpty() or not cases.groupBy("combination").count().where("count > 1").isEmpty():
        raise DocumentError(f"{path}: a case without groups or assignments, or a repeated combination")
    mapping = cases.select("combination", F.explode("a").alias("match_id", "group")).join(selectors, "match_id", "left")
    wrong = assignment_errors(mapping.withColumn("slot", F.coalesce("slot", F.lit("?"))), size).select("combination").orderBy("combination").limit(3).collect()
    if wrong:
        raise DocumentError(f"{path}: assignments that break their slots, first {[r['combination'] for r in wrong]}")
    return mapping.select("combination", "match_id", "group")
