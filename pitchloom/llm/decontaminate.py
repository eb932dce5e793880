"""Benchmark decontamination, native: token windows of documents against a hash set of benchmark windows.

Texts are lower-cased (A-Z) and cut into words; a benchmark item gives each window of ``window`` consecutive words, or
one window of all its words if it has fewer. Documents are scanned once: every window of a document is
looked up in the hash set of windows by its full normalised text, so a match is verified by equality. The
set is broadcast while its counted size is within ``BROADCAST_WINDOWS``; a larger set is joined by
shuffle. Hits come back as one small row per window, next to one row per document with its word count.

Null and empty texts have no words, on either side: such a document is clean, such an item has no window. Repeated
rows of documents give one result row each; repeated item_ids count once in a document's list; null
item_ids take part in hits but not in the list. Empty tables give empty results or all-clean documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitchloom.llm.common import lower_az, materialize

WINDOW = 10
#: Fixed value: what counts as a word after lower-casing.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Up to so many distinct benchmark windows (about 64 bytes each) are broadcast.
BROADCAST_WINDOWS = 1_000_000


def words(text):
    return F.regexp_extract_all(lower_az(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


def grams(column, size):
    """All windows of ``size`` words, space-joined, in order; none if there are fewer words."""
    starts = F.when(F.size(column) >= size, F.sequence(F.lit(1), F.size(column) - size + 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.array_join(F.slice(column, i, size), " "))


def benchmark_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """(gram, size, item_ids): each distinct window with its number of words and the items that hold it."""
    items = benchmark.select("item_id", words(F.col("text")).alias("w")).where(F.size("w") > 0)
    whole = F.array(F.array_join("w", " "))
    found = items.select("item_id", F.least(F.size("w"), F.lit(window)).alias("size"), F.explode(F.when(F.size("w") < window, whole).otherwise(grams(F.col("w"), window))).alias("gram"))
    return found.groupBy("gram", "size").agg(F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("item_ids"))


def hits(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, keep: tuple[str, ...] = ()) -> DataFrame:
    """Per row of docs: row, doc_id, the columns of ``keep``, n_words, hit (sorted word positions from 0), items (sorted ids as strings)."""
    known = materialize(benchmark_windows(benchmark, window), "windows")
    sizes = sorted(r["size"] for r in known.select("size").distinct().collect())  # at most ``window`` numbers
    if known.count() <= BROADCAST_WINDOWS:
        known = F.broadcast(known)  # bounded by BROADCAST_WINDOWS
    cut = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", *keep, words(F.col("text")).alias("w"))
    # One probe per window and size, and one without a window that carries the word count.
    def sized(n):
        return F.transform(grams(F.col("w"), n), lambda g, i: F.struct(F.lit(n).alias("size"), i.alias("at"), g.alias("gram")))

    per_size = [sized(n) for n in sizes]
    count = F.array(F.struct(F.lit(0).alias("size"), F.size("w").alias("at"), F.lit(None).cast("string").alias("gram")))
    probes = cut.select("row", "doc_id", *keep, F.explode(F.concat(count, *per_size)).alias("p")).select("row", "doc_id", *keep, "p.size", "p.at", "p.gram")
    met = probes.join(known, ["gram", "size"], "left").where(F.col("item_ids").isNotNull() | (F.col("size") == 0))
    spans = F.flatten(F.transform(F.collect_set(F.when(F.col("size") > 0, F.struct("at", "size"))), lambda s: F.sequence(s["at"], s["at"] + s["size"] - 1)))
    return met.groupBy("row", "doc_id", *keep).agg(
        F.max(F.when(F.col("size") == 0, F.col("at"))).alias("n_words"),
        F.array_sort(F.array_distinct(spans)).alias("hit"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("item_ids")))).alias("items"),
    )


def decontaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The digest of hits(): doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    return hits(docs, benchmark).select(
        "doc_id",
        F.col("n_words").cast("long").alias("n_words"),
        F.size("hit").cast("long").alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.size("hit") > 0).alias("contaminated"),
    )


def without_spans(docs: DataFrame, found: DataFrame) -> DataFrame:
    """docs with the hit words of ``found`` (hits()) cut out of text; clean texts stay byte for byte.

    A touched text becomes its remaining stretches of words in their original letters, joined by one space. doc_id must be a key here.
    """
    marks = found.where(F.size("hit") > 0).select(F.col("doc_id").alias("__id"), "hit")
    joined = docs.join(marks, docs["doc_id"].eqNullSafe(F.col("__id")), "left")
    raw = F.regexp_extract_all("text", F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"), F.lit(0))
    rest = F.array_join(F.filter(raw, lambda w, i: ~F.array_contains("hit", i)), " ")
    return joined.withColumn("text", F.when(F.col("hit").isNull(), F.col("text")).otherwise(rest)).select(*docs.columns)
