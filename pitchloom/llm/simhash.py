"""SimHash near-duplicate classes by covering locality-sensitive hashing.

Fingerprints: 64-bit SimHash of word shingles. Two fingerprints link at a Hamming distance of
at most ``RADIUS``. Candidates come from ``2**(RADIUS+1) - 1`` structured bit masks: bit i carries a nonzero vector
m(i) over GF(2) of RADIUS+1 places, and mask v keeps the bits with <m(i), v> = 1. The vectors of
at most RADIUS differing bits span less than the whole space, so some v is orthogonal to them
all and the pair agrees on that mask: no pair within the radius is missed.

Within a bucket no pairs are formed. Members of a bucket with company emit the centres
at distance at most 1 (flips of the bits which the colliding masks leave free); two fingerprints are
within distance 2 iff they share such a centre, and a centre has at most 65 distinct fingerprints. Links go from
each member to the smallest one of its centre, which keeps connectivity.

Components come from star contraction; the neighbours of a hub, and the copies of a frequent text, are spread over tasks
(``common.look_up``), so a group of any size is never gathered.

Nulls and empty texts have no words and fingerprint zero. Rows with a null doc_id keep a fingerprint and
join the class of their fingerprint; a class with no doc_id at all has a null component_id. Repeated rows
stay repeated. An empty table gives an empty result. Further columns are ignored.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitchloom.llm.common import bounded_batches, look_up, materialize, release, remove, stored, utf8

RADIUS = 2
SHINGLE = 3
SEED = 42
BITS = 64
#: Hashes of one document are counted in blocks of this many rows of 64 bits.
BLOCK = 1 << 15


def covering_masks() -> list[int]:
    """The masks of bits to compare: each pair within RADIUS agrees on one of them."""
    places = RADIUS + 1
    vectors = [1 + i % (2**places - 1) for i in range(BITS)]
    return [sum(1 << i for i in range(BITS) if (vectors[i] & v).bit_count() % 2) for v in range(1, 2**places)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def fingerprint(text: bytes | None, shingle: int = SHINGLE) -> int:
    """SimHash of one text (UTF-8): words at ASCII white space, A-Z lower-cased, repeats included."""
    import xxhash

    words = (text or b"").lower().split()
    if not words:
        return 0
    if len(words) < shingle:
        words = [b" ".join(words)]
        shingle = 1
    grams = map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False)) if shingle > 1 else words
    n = len(words) - shingle + 1
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, grams, repeat(SEED)), dtype="<u8", count=n)
    return majority(hashes)


def majority(hashes: np.ndarray) -> int:
    """The number whose bits are those set in over half of the unsigned hashes."""
    n, ones = len(hashes), np.zeros(BITS, np.int64)
    for at in range(0, n, BLOCK):
        part = np.ascontiguousarray(hashes[at : at + BLOCK]).view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, keep: tuple[str, ...] = (), shingle: int = SHINGLE) -> DataFrame:
    """doc_id, the columns of ``keep`` and fp, the fingerprint as a signed long, for each row."""
    names = ["doc_id", *keep, "fp"]

    def run(batches):
        for batch in batches:
            prints = np.array([fingerprint(x, shingle) for x in utf8(batch.column(batch.num_columns - 1))], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(prints)], names=names)
        release()

    fields = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in names[:-1])
    return bounded_batches(docs).select(*names[:-1], docs["text"].alias("__text")).mapInArrow(run, f"{fields}, fp long")


def links(nodes: DataFrame) -> DataFrame:
    """Links (u, v), u > v, that connect all distinct fingerprints ``fp`` within the radius of each other."""
    full = (1 << BITS) - 1
    masks = [(v, _signed(m), _signed(full & ~m)) for v, m in enumerate(covering_masks())]
    tables = F.array(*[F.struct(F.lit(v).alias("v"), F.lit(m).alias("m"), F.lit(free).alias("free")) for v, m, free in masks])
    keyed = nodes.select("fp", F.explode(tables).alias("t")).select("fp", F.col("t.v").alias("v"), F.col("fp").bitwiseAND(F.col("t.m")).alias("key"), "t.free")
    full_buckets = keyed.groupBy("v", "key").agg(F.count("*").alias("n")).where("n > 1").select("v", "key")
    crowded = keyed.join(full_buckets.hint("merge"), ["v", "key"]).groupBy("fp").agg(F.bit_or("free").alias("free"))
    flips = F.array(F.lit(0), *[F.lit(_signed(1 << i)) for i in range(BITS)])
    centres = crowded.select("fp", F.explode(F.filter(flips, lambda b: b.bitwiseAND(F.col("free")) == b)).alias("flip")).select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("centre"))
    balls = centres.groupBy("centre").agg(F.collect_set("fp").alias("members")).where(F.size("members") > 1)
    return balls.select(F.explode("members").alias("u"), F.array_min("members").alias("v")).where((F.col("u") > F.col("v")) & (F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= RADIUS)).distinct()


def connected(edges: DataFrame) -> DataFrame:
    """(node, root) of every node in edges (u > v): alternating large-star and small-star steps, each written to the shared folder.

    Each star is a query of its own: one plan of both holds the first four times, and the driver plans and reports it anew after each of its stages.
    """
    spark = edges.sparkSession

    def mark(df):
        return df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()

    edges, path = stored(edges, "edges")
    before = mark(edges)
    while before[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n")
        large, large_path = stored(look_up(both, least, "u", "m", "v", 2 * before[0]).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "edges")
        remove(spark, path)
        least = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        moved = look_up(large, least, "u", "m", "v", 2 * before[0]).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges, path = stored(moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "edges")
        remove(spark, large_path)
        after = mark(edges)
        if after == before:
            break
        before = after
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))


def near_duplicates(docs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the columns of ``keep``, fingerprint (16 hex digits) and component_id (the smallest doc_id reachable) of every row."""
    prints = materialize(fingerprints(docs, keep), "simhash")
    nodes = prints.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("n"))
    roots = connected(links(nodes.select("fp")))
    rooted = nodes.join(roots.hint("merge"), F.col("fp") == F.col("node"), "left").select("fp", "first", "n", F.coalesce("root", "fp").alias("root"))
    rooted = materialize(rooted, "rooted")
    ids = rooted.groupBy("root").agg(F.min("first").alias("component_id"), F.count("*").alias("n"))
    classes = look_up(rooted, ids, "root", "component_id", "fp").select("fp", "component_id", "n")
    return look_up(prints.withColumn("__row", F.monotonically_increasing_id()), classes, "fp", "component_id", "__row").select("doc_id", *keep, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
