"""Team identities: temporal aliases, audits, coverage, collision-free ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _in_force(date: Column) -> Column:
    return (F.col("valid_from") <= date) & (date <= F.coalesce(F.col("valid_to"), F.lit("9999-12-31").cast("date")))


def resolve(rows: DataFrame, aliases: DataFrame, key: list[str], name: str = "source_name", date: str = "date") -> DataFrame:
    """rows with team_id and n_aliases: the alias in force on the date. None gives null and 0, several give null and their number.

    The few aliases of a name are one array, so a row meets one row and is not grouped again; key comes first in the result.
    """
    entry = F.struct("team_id", "valid_from", F.coalesce("valid_to", F.lit("9999-12-31").cast("date")).alias("valid_to"))
    a = aliases.groupBy(F.col("source").alias("__source"), F.col("source_name").alias("__name")).agg(F.collect_list(entry).alias("__all"))
    found = rows.join(a, (F.col("source") == F.col("__source")) & (F.col(name) == F.col("__name")), "left")
    valid = F.coalesce(F.filter("__all", lambda x: x["team_id"].isNotNull() & (x["valid_from"] <= F.col(date)) & (F.col(date) <= x["valid_to"])), F.array().cast(found.schema["__all"].dataType))
    rest = [c for c in rows.columns if c not in key]
    return found.withColumn("__valid", valid).select(*key, *rest, F.size("__valid").alias("n_aliases"), F.when(F.size("__valid") == 1, F.get("__valid", F.lit(0))["team_id"]).alias("team_id"))


def unresolved(rows: DataFrame, aliases: DataFrame, name: str = "source_name", date: str = "date") -> DataFrame:
    """Names without an alias in force: first and last date, and rows."""
    a = aliases.select(F.col("source").alias("__source"), F.col("source_name").alias("__name"), "valid_from", "valid_to")
    lost = rows.join(a, (F.col("source") == F.col("__source")) & (F.col(name) == F.col("__name")) & _in_force(F.col(date)), "left_anti")
    return lost.groupBy("source", name).agg(F.min(date).alias("first_seen"), F.max(date).alias("last_seen"), F.count("*").alias("rows"))


def coverage(teams: DataFrame, sources: DataFrame, aliases: DataFrame) -> DataFrame:
    """A row for every team and source: its first alias there, or none. Both inputs are small dimension tables by nature."""
    first = aliases.groupBy("source", "team_id").agg(F.min_by("source_name", F.struct("valid_from", "source_name")).alias("source_name"))
    grid = teams.select("team_id").crossJoin(F.broadcast(sources.select("source").distinct()))
    return grid.join(first, ["source", "team_id"], "left").withColumn("resolved", F.col("source_name").isNotNull())


def numbered_ids(rows: DataFrame, base: Column, order: list[str]) -> DataFrame:
    """row_id: the base id, with -2, -3, ... for its repetitions in the given order."""
    n = F.row_number().over(Window.partitionBy("__base").orderBy(*order))
    return rows.withColumn("__base", base).withColumn("__n", n).withColumn("row_id", F.when(F.col("__n") == 1, F.col("__base")).otherwise(F.concat_ws("-", "__base", F.col("__n").cast("string")))).drop("__base", "__n")
