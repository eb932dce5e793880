"""Shards of near equal bytes by histogram sort.

Rows are ordered by 128 bits: a hash of the text, then one of doc_id, so equal texts are neighbours. The splitters between shards are found by
rounds of exact counts: each round cuts the intervals that still hold a splitter at evenly spaced probes, one aggregation adds up
the bytes between probes over all partitions, and an interval goes on only if neither of its ends is near enough to the share that the splitter has to
meet. Boundaries inside a group of equal texts are tried last, so a group is divided only where it is larger than the tolerance
allows. Once all splitters are known, the rows are exchanged once, in blocks of a shard that hold about equal numbers of rows; a row's slot is
its place in the block plus the rows of the blocks before.

The driver holds one interval for each splitter and the counts between its probes (65 536 in the first round, 256 for each interval later), whatever the number of rows.

Null texts have no bytes and count as equal to empty ones. A row weighs its bytes and OVERHEAD. A row that is larger than a shard should be leaves shards beside it
short or empty; rows that are equal in text and doc_id are never divided. An empty table gives an empty result. Further columns pass through or are ignored.
"""

from __future__ import annotations

from bisect import bisect_right
from collections import defaultdict
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pitchloom.llm.common import materialize

SHARDS = 40
OVERHEAD = 16
#: A splitter may be off by this part of a shard.
TOLERANCE = 0.002
#: The bits that the key is known by after each round.
DEPTHS = (16, *range(24, 129, 8))
#: Rows of a block, and how many blocks there are at most.
BLOCK_ROWS, BLOCKS = 1_000, 4_000


@dataclass
class Interval:
    """Keys that begin with ``prefix`` (of the current depth), the bytes of all keys below, and the splitters inside with their goals."""

    prefix: int
    below: int
    goals: list[tuple[int, float]]


def keyed(docs: DataFrame) -> DataFrame:
    """docs with __size, __a and __b: the bytes of a row and the two halves of its key."""
    text = F.coalesce(docs["text"], F.lit(""))
    return docs.select("*", (F.octet_length(text).cast("long") + OVERHEAD).alias("__size"), F.xxhash64(text).alias("__a"), F.xxhash64(F.lit("shard"), docs["doc_id"]).alias("__b"))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _halves(prefix: int, depth: int) -> tuple[int, int]:
    """A prefix of the key as the values of two columns: bits of the first half, bits of the second."""
    return (prefix, 0) if depth < 64 else (_signed(prefix >> (depth - 64)), prefix & ((1 << (depth - 64)) - 1))


def _histogram(spark: SparkSession, keys: DataFrame, inside: list[Interval], depth: int, deeper: int) -> list:
    """interval, digit (the bits from depth to deeper), bytes and rows of all keys in the intervals."""
    top = lambda c, bits: F.col(c) if bits >= 64 else F.shiftrightunsigned(c, 64 - bits) if bits else F.lit(0).cast("long")
    width = (1 << (deeper - depth)) - 1
    digit = top("__a", deeper) if deeper <= 64 else top("__b", deeper - 64)
    keys = keys.select(top("__a", depth).alias("p"), top("__b", max(0, depth - 64)).alias("q"), digit.bitwiseAND(F.lit(width)).alias("digit"), "__size")
    known = spark.createDataFrame([(*_halves(x.prefix, depth), i) for i, x in enumerate(inside)], "p long, q long, interval int")  # one row for each splitter at most
    found = keys.join(F.broadcast(known), ["p", "q"]).groupBy("interval", "digit")
    return found.agg(F.sum("__size").alias("bytes"), F.count("*").alias("rows")).orderBy("interval", "digit").collect()


def splitters(keys: DataFrame, shards: int = SHARDS, tolerance: float = TOLERANCE) -> list[int]:
    """The least key (128 bits) of each shard but the first, in order; the key after the last one stands for none."""
    spark = keys.sparkSession
    total = keys.agg(F.sum("__size")).first()[0]
    if not total:
        return [1 << 128] * (shards - 1)
    slack = tolerance * total / shards
    cuts: dict[int, int] = {}
    inside, depth = [Interval(0, 0, [(s, total * s / shards) for s in range(1, shards)])], 0
    for deeper in DEPTHS:
        counted = defaultdict(list)
        for r in _histogram(spark, keys, inside, depth, deeper):
            counted[r["interval"]].append(r)
        further: dict[int, Interval] = {}
        for i, x in enumerate(inside):
            ends, at = [], x.below
            for r in counted[i]:
                at += r["bytes"]
                ends.append(at)
            for s, goal in x.goals:
                k = min(bisect_right(ends, goal), len(ends) - 1)
                r, prefix = counted[i][k], (x.prefix << (deeper - depth)) + counted[i][k]["digit"]
                under, over = goal - (ends[k] - r["bytes"]), ends[k] - goal
                if min(under, over) <= slack or r["rows"] == 1 or deeper == 128:
                    cuts[s] = prefix + (over < under) << (128 - deeper)
                else:
                    further.setdefault(prefix, Interval(prefix, ends[k] - r["bytes"], [])).goals.append((s, goal))
        inside, depth = list(further.values()), deeper
        if not inside:
            break
    return [max(cuts[t] for t in range(1, s + 1)) for s in range(1, shards)]


def with_shard(rows: DataFrame, cuts: list[int]) -> DataFrame:
    """rows with __shard: how many splitters are not above the key. The splitters, 16 bytes each, go with the function."""
    bounds = np.array([c.to_bytes(16, "big") for c in cuts if c < 1 << 128], "S16")

    @F.pandas_udf("int")
    def shard(a: pd.Series, b: pd.Series) -> pd.Series:
        keys = np.empty((len(a), 2), ">u8")
        keys[:, 0], keys[:, 1] = a.to_numpy().view("u8"), b.to_numpy().view("u8")
        return pd.Series(np.searchsorted(bounds, keys.view("S16").ravel(), "right").astype("i4"))

    return rows.withColumn("__shard", shard("__a", "__b"))


def sharded(docs: DataFrame, shards: int = SHARDS, keep: tuple[str, ...] | None = None, tolerance: float = TOLERANCE) -> DataFrame:
    """The columns of ``keep`` (if not given all but columns of these names) with size, shard and slot (a row's place in its shard, from 0 without gaps)."""
    spark = docs.sparkSession
    full = keyed(docs)
    keys = materialize(full.select("__size", "__a", "__b"), "keys")
    cuts = splitters(keys, shards, tolerance)
    n = keys.count()
    share = max(BLOCK_ROWS, -(-n // BLOCKS))
    in_shard = {r["__shard"]: r["count"] for r in with_shard(keys, cuts).groupBy("__shard").count().collect()}  # a row for each shard
    parts = spark.createDataFrame([(s, -(-c // share)) for s, c in in_shard.items()], "__shard int, __parts long")
    block = F.pmod(F.col("__b").bitwiseXOR(F.shiftrightunsigned("__b", 32)), F.col("__parts")).cast("int").alias("__block")
    dealt = lambda rows: with_shard(rows, cuts).join(F.broadcast(parts), "__shard")
    before = F.sum("c").over(Window.partitionBy("__shard").orderBy("__block")) - F.col("c")
    sizes = dealt(keys).groupBy("__shard", block).agg(F.count("*").alias("c")).select("__shard", "__block", before.alias("__before"))  # BLOCKS + shards rows at most
    names = [c for c in docs.columns if c not in ("size", "shard", "slot")] if keep is None else list(keep)
    rows = dealt(full.select(*names, "__size", "__a", "__b")).select(*names, "__size", "__a", "__b", "__shard", block)
    place = F.row_number().over(Window.partitionBy("__shard", "__block").orderBy("__a", "__b")) - 1
    rows = rows.withColumn("__place", place).join(F.broadcast(sizes), ["__shard", "__block"])
    return rows.select(*names, F.col("__size").alias("size"), F.col("__shard").alias("shard"), (F.col("__before") + F.col("__place")).alias("slot"))


def write(docs: DataFrame, path: str, shards: int = SHARDS, tolerance: float = TOLERANCE) -> None:
    """All rows of docs as Parquet under path, a folder shard=N for each shard, in order of slot within files."""
    sharded(docs, shards, tolerance=tolerance).write.partitionBy("shard").parquet(path)


def shard_digest(docs: DataFrame) -> DataFrame:
    """The contract's columns; the law is ``bytes``."""
    marked = docs.select("doc_id", "text", F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"))
    found = sharded(marked, keep=("doc_id", "text_crc32"))
    return found.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
