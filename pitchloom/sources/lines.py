"""Text files by line: every line with its file and its number, however the files are split, and quote files checked by line."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pitchloom.sources.documents import DocumentError, checked
from pitchloom.sources.work import written

#: Beyond this many file blocks their numbers are joined by a shuffle.
MOST_BLOCKS = 100_000
#: The columns of a file of quotes typed by hand, in order.
QUOTES = ("provider", "bookmaker", "event_id", "match_id", "commence_time_utc", "provider_update_utc", "home_team", "away_team", "price_home", "price_draw", "price_away")
#: The one column that may be empty.
OPTIONAL = "provider_update_utc"


def numbered(spark: SparkSession, path: str) -> DataFrame:
    """file, line (from 1) and value of every line of text files; an empty file has none.

    A line's number is the number of lines in the blocks of its file before its own, plus its place in the block. Places are taken in one
    scan and written, as a second scan may be split in another way. Lines are not shuffled.
    """
    raw = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("place"), "value")
    lines = written(raw, "lines")
    blocks = lines.groupBy("file", "block").agg(F.min("place").alias("first"), F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = written(blocks.select("file", "block", (before + 1 - F.col("first")).alias("shift")), "blocks")
    small = starts.count() <= MOST_BLOCKS
    return lines.join(F.broadcast(starts) if small else starts, ["file", "block"]).select("file", (F.col("place") + F.col("shift")).alias("line"), "value")


def csv_records(spark: SparkSession, path: str, required: tuple[str, ...]) -> DataFrame:
    """file, line, the columns of CSV files as strings (blanks null), and verdict: null, or that a line does not have the header's fields.

    Every file starts with the same header, which has the required columns; other headers raise, as does a path without lines. A record
    is a line: a field cannot hold a line break. Blank lines are no records, but count as lines.
    """
    lines = numbered(spark, path)
    heads = [r["value"] for r in lines.where("line = 1").select(F.trim("value").alias("value")).distinct().limit(2).collect()]
    if len(heads) != 1:
        raise DocumentError(f"{path}: no lines" if not heads else f"{path}: files with different headers")
    width = heads[0].count(",") + 1  # a quoted name may hold commas: at least the number of fields
    names = _header(spark, heads[0], width)
    fields = ", ".join(f"_c{i} string" for i in range(len(names)))
    missing = [c for c in required if c not in names]
    if missing or len(set(names)) < len(names):
        raise DocumentError(f"{path}: missing columns {missing}" if missing else f"{path}: repeated columns in {names}")
    parsed = F.from_csv("value", F.lit(f"{fields}, _bad string"), {"columnNameOfCorruptRecord": "_bad", "mode": "PERMISSIVE"})
    rows = lines.where("line > 1 and trim(value) <> ''").select("file", "line", parsed.alias("r"))
    columns = [F.nullif(F.trim(F.col("r")[f"_c{i}"]), F.lit("")).alias(n) for i, n in enumerate(names)]
    return rows.select("file", "line", *columns, F.when(F.col("r._bad").isNotNull(), F.lit("not the fields of the header")).alias("verdict"))


def _header(spark: SparkSession, line: str, most: int) -> list[str]:
    """The names in one CSV line of at most so many."""
    row = spark.createDataFrame([(line,)], "value string").select(F.from_csv("value", F.lit(", ".join(f"_c{i} string" for i in range(most)))).alias("r")).first()["r"]
    names = [(x or "").strip() for x in row]
    while names and not names[-1]:
        names.pop()
    return names


def manual_quotes(spark: SparkSession, path: str) -> DataFrame:
    """One row for each line of files of quotes typed by hand: QUOTES with prices and times cast, verdict and place (file:line).

    verdict (null if good): fields that are not those of the header, ``missing`` and the empty required columns, ``no number`` or ``no time`` and the columns.
    """
    rows = csv_records(spark, path, QUOTES)

    def named(found: list[tuple[Column, str]], what: str) -> Column:
        names = F.array_compact(F.array(*[F.when(test, F.lit(c)) for test, c in found]))
        return F.when(F.size(names) > 0, F.concat(F.lit(f"{what} "), F.array_join(names, ", ")))

    prices = {c: F.expr(f"try_cast({c} as double)") for c in QUOTES if c.startswith("price_")}
    times = {c: F.try_to_timestamp(c) for c in QUOTES if c.endswith("_utc")}
    missing = named([(F.col(c).isNull(), c) for c in QUOTES if c != OPTIONAL], "missing")
    numbers = named([(F.col(c).isNotNull() & v.isNull(), c) for c, v in prices.items()], "no number")
    moments = named([(F.col(c).isNotNull() & v.isNull(), c) for c, v in times.items()], "no time")
    verdict = F.coalesce("verdict", missing, numbers, moments)
    place = F.concat_ws(":", "file", F.col("line").cast("string"))
    return rows.select(*[(prices | times).get(c, F.col(c)).alias(c) for c in QUOTES], verdict.alias("verdict"), place.alias("place"))


def strict_manual_quotes(spark: SparkSession, path: str) -> DataFrame:
    """QUOTES of files of which every line is good; others raise and name the file and line, and so do files without a quote."""
    rows = checked(manual_quotes(spark, path), "quotes")
    if rows.isEmpty():
        raise DocumentError(f"{path}: no quotes")
    return rows
