"""Digests of tables as trees: equal tables have equal roots, and a differing one tells where.

A row falls into a range by the first hexadecimal digits of the SHA-256 of its key; a range's digest is that of its sorted row digests, and a node
above is that of its (up to sixteen) children. The number of digits follows the number of rows, so that a range holds ROWS of them at most on average
and no task gathers more. Neither row order nor partitioning matters, and nothing passes through the driver. Rows that share a key share a range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROWS = 1_000


def digits(rows: int) -> int:
    """The least number of hexadecimal digits that leaves at most ROWS rows for each range on average."""
    width = 0
    while rows > ROWS * 16**width:
        width += 1
    return width


def _json(columns: list[str]) -> Column:
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})


def ranges(df: DataFrame, keys: list[str], width: int | None = None) -> DataFrame:
    """range (its digits), digest and rows of each range that has rows; ``width`` digits, or as many as the number of rows asks for."""
    width = digits(df.count()) if width is None else width
    row = F.sha2(_json([*keys, *[c for c in df.columns if c not in keys]]), 256)
    rows = df.select(F.substring(F.sha2(_json(keys), 256), 1, width).alias("range"), row.alias("row"))
    return rows.groupBy("range").agg(F.sha2(F.array_join(F.array_sort(F.collect_list("row")), ""), 256).alias("digest"), F.count("*").alias("rows"))


def root(found: DataFrame, width: int) -> DataFrame:
    """One row: digest and rows of the whole, from its ranges; no rows have the digest of an empty text."""
    for level in range(width - 1, -1, -1):
        child = F.struct("range", F.concat(F.col("range"), F.lit(":"), F.col("digest"), F.lit(":"), F.col("rows").cast("string"), F.lit("\n")).alias("line"))
        lines = F.array_join(F.transform(F.array_sort(F.collect_list(child)), lambda x: x["line"]), "")
        found = found.groupBy(F.substring("range", 1, level).alias("range")).agg(F.sha2(lines, 256).alias("digest"), F.sum("rows").alias("rows"))
    return found.agg(F.coalesce(F.max("digest"), F.sha2(F.lit(""), 256)).alias("digest"), F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"))


def content_hash(df: DataFrame, keys: list[str]) -> DataFrame:
    """One row: the root of the table's tree, and its rows."""
    width = digits(df.count())
    return root(ranges(df, keys, width), width)


def differences(stated: DataFrame, found: DataFrame) -> DataFrame:
    """range, stated_rows and found_rows of the ranges (of equal width) whose digests differ; null where there are none."""
    a = stated.select("range", F.col("digest").alias("a"), F.col("rows").alias("stated_rows"))
    b = found.select("range", F.col("digest").alias("b"), F.col("rows").alias("found_rows"))
    return a.join(b, "range", "full").where(~F.col("a").eqNullSafe(F.col("b"))).select("range", "stated_rows", "found_rows")


def in_ranges(df: DataFrame, keys: list[str], wrong: DataFrame) -> DataFrame:
    """The rows of df in these ranges."""
    width = wrong.agg(F.max(F.length("range"))).first()[0] or 0
    return df.join(wrong.select(F.col("range").alias("__range")), F.substring(F.sha2(_json(keys), 256), 1, width) == F.col("__range"), "left_semi")
