"""Scans with declared schemas, and the match view over the star-schema tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pitchloom.functions.columns import outcome
from pitchloom.sources import documents


def parquet(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def csv_strings(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """CSV with a header, every column a string, blanks null, a different header is an error."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    df = spark.read.schema(schema).option("header", True).option("enforceSchema", False).option("mode", "FAILFAST").csv(path)
    return df.select(*[F.expr(f"nullif(trim(`{c}`), '')").alias(c) for c in columns])


def csv_columns(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """The named columns of CSV files with a header as strings, blanks null; further columns are left out, a missing one raises."""
    df = spark.read.option("header", True).option("mode", "FAILFAST").csv(path)
    if missing := set(columns) - set(df.columns):
        raise ValueError(f"{path}: missing columns {sorted(missing)}")
    return df.select(*[F.expr(f"nullif(trim(`{c}`), '')").alias(c) for c in columns])


def csv_results(spark: SparkSession, path: str) -> DataFrame:
    """Match results: date, teams, scores (null while unplayed), tournament, place, neutral."""
    columns = ["date", "home_team", "away_team", "home_score", "away_score", "tournament", "city", "country", "neutral"]
    kinds = {"date": "date", "home_score": "int", "away_score": "int", "neutral": "boolean"}
    df = csv_strings(spark, path, columns)
    return df.select(*[F.expr(f"nullif({c}, 'NA')").cast(kinds.get(c, "string")).alias(c) for c in columns])


def csv_live_results(spark: SparkSession, path: str) -> DataFrame:
    """Live results: five required columns; conduct scores and the advanced team may be missing from the file."""
    required, optional = ["match_id", "team_a", "team_b", "goals_a", "goals_b"], ["fair_play_a", "fair_play_b", "advanced_team"]
    df = spark.read.option("header", True).option("mode", "FAILFAST").csv(path)
    missing, extra = set(required) - set(df.columns), set(df.columns) - {*required, *optional}
    if missing or extra:
        raise ValueError(f"live results: missing columns {sorted(missing)}, unknown columns {sorted(extra)}")
    kinds = {"goals_a": "int", "goals_b": "int", "fair_play_a": "double", "fair_play_b": "double"}
    return df.select(*[(F.expr(f"nullif(trim(`{c}`), '')") if c in df.columns else F.lit(None)).cast(kinds.get(c, "string")).alias(c) for c in [*required, *optional]])


def tsv_ratings(spark: SparkSession, path: str) -> DataFrame:
    """Header-less rating list (rank, previous rank, code, rating); rows without a code go, a rating that is no number raises."""
    raw = spark.read.schema("rank string, previous string, code string, rating string").option("sep", "\t").csv(path)
    rows = raw.where("nullif(trim(code), '') is not null").select(F.trim("code").alias("code"), F.col("rank").cast("int").alias("rank"), F.col("rating").cast("double").alias("rating"))
    return _unique(rows, "code", "rating list")


def _unique(rows: DataFrame, key: str, what: str) -> DataFrame:
    """rows, unless a key repeats. The lists are small dimensions."""
    if not rows.groupBy(key).count().where("count > 1").isEmpty():
        raise ValueError(f"{what}: repeated {key}")
    return rows


def tsv_names(spark: SparkSession, path: str) -> DataFrame:
    """Code and primary name, the first two fields of each line; a line without both, or a repeated code, raises."""
    parts = F.split("value", "\t")
    blank = lambda i: F.nullif(F.trim(F.get(parts, F.lit(i))), F.lit(""))
    rows = spark.read.text(path).select(blank(0).alias("code"), blank(1).alias("name"))
    if not rows.where("code is null or name is null").isEmpty():
        raise ValueError("names: malformed lines")
    return _unique(rows, "code", "names")


def json_quotes(payload: DataFrame, column: str = "payload") -> DataFrame:
    """Bookmaker payloads (a JSON array of events) to one row per event, bookmaker and three-way market. Anything else in them but
    markets of other kinds raises, a text that is cut off or no JSON included; ``documents.quote_records`` gives verdicts instead."""
    return documents.checked(documents.quote_records(payload, column), "quotes")


def strict_json_results(spark: SparkSession, path: str, allowed: set[str], required: set[str], lines: bool = False) -> DataFrame:
    """Played results from JSON documents, or JSON lines: what does not parse, unknown keys and missing ones raise."""
    return documents.checked(documents.result_records(spark, path, allowed, required, lines), "played results")


def latest(spark: SparkSession, folder: str, pattern: str) -> str | None:
    """The greatest file name in a folder that matches a glob: dated artifacts sort by name."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{pattern}")
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path) or []
    return max((str(f.getPath()) for f in found), default=None)


def matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The match view: one row per order between a customer's and a supplier's nation, goals counted from its lines.

    Orders, the larger side, are shuffled once by key with the line aggregate; the nation tables are tiny dimensions of at most
    25 rows and customers and suppliers join by their keys.
    """
    lines = parquet(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(
        F.min("l_suppkey").alias("suppkey"),
        F.count_if(F.col("l_returnflag") == "R").cast("int").alias("home_score"),
        F.count_if(F.col("l_returnflag") == "A").cast("int").alias("away_score"),
    )
    nation = parquet(spark, sf_dir, "nation")
    side = lambda p: F.broadcast(nation.select(F.col("n_nationkey").alias(f"{p}_nation"), F.regexp_replace(F.lower("n_name"), "[^a-z0-9]+", "-").alias(f"{p}_team_id"), F.col("n_regionkey").alias(f"{p}_region")))
    home = parquet(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("home_nation"))
    away = parquet(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("suppkey"), F.col("s_nationkey").alias("away_nation"))
    orders = parquet(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate", "o_orderpriority")
    joined = orders.join(lines, orders["o_orderkey"] == lines["l_orderkey"]).join(home, "o_custkey").join(away, "suppkey").join(side("home"), "home_nation").join(side("away"), "away_nation")
    aet = (F.col("home_score") == F.col("away_score")) & (F.col("o_orderstatus") == "P")
    return joined.where("home_nation <> away_nation").select(
        F.concat(F.lit("M"), F.lpad(F.col("o_orderkey").cast("string"), 9, "0")).alias("match_id"),
        F.to_date("o_orderdate").alias("date"),
        "home_team_id",
        "away_team_id",
        "home_score",
        "away_score",
        ((6 - F.substring("o_orderpriority", 1, 1).cast("int")) * 10 + 10).alias("k_factor"),
        "home_region",
        "away_region",
        (F.col("home_region") != F.col("away_region")).alias("neutral"),
        aet.alias("after_extra_time"),
        outcome(F.col("home_score"), F.col("away_score"), aet).alias("outcome"),
    )


def quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One bookmaker quote per line item of a match."""
    line = parquet(spark, sf_dir, "lineitem")
    return line.select(
        F.concat(F.lit("M"), F.lpad(F.col("l_orderkey").cast("string"), 9, "0")).alias("match_id"),
        (F.col("l_suppkey") % 8).alias("bookmaker"),
        F.col("l_linenumber").alias("line"),
        F.to_timestamp("l_shipdate").alias("captured_at"),
        (1.2 + F.col("l_quantity") / 25).alias("price_home"),
        (2.5 + 10 * F.col("l_discount")).alias("price_draw"),
        (1.5 + 20 * F.col("l_tax")).alias("price_away"),
    )
