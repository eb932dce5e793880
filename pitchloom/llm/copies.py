"""Near-copy classes: texts whose sets of word shingles have a Jaccard similarity of SIMILAR or more, and what these link.

A text's set is the XXH64 of its shingles (SHINGLE words at ASCII white space, A-Z lower-cased); a shorter text is one shingle.
No pair is missed: in any one order of all shingles, two sets of similarity t share a shingle among
the first n - ceil(t n) + 1 of each (prefix filter). The order puts shingles that a sample of the texts finds common last,
so that buckets stay small; results don't depend on the sample.

First come the pairs that SimHash finds (the covering masks of ``simhash`` over fingerprints of the same shingles), each text with the
smallest of its class there, and the members of a bucket with its smallest one: both link large groups of copies without pairs. Then
buckets whose members are not yet in one class are checked whole: buckets that share members together as far as a task can hold them, only with members whose shingle stands early
enough to be the first that a similar pair shares, and a task counts the shared shingles of the members by a matrix product over
blocks of at most about ``PART`` shingles. A task gives back no pairs but the links that unite classes, fewer than it has members. To
halve the shuffle it counts the upper halves of the hashes, which can only find more; the links are then checked, and groups
with one that fails are done again with whole hashes.

Nulls and empty texts have the empty set and are one class. Rows with a null doc_id join the class of their text.
"""

from __future__ import annotations

from functools import reduce
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pitchloom.llm import simhash
from pitchloom.llm.common import BROADCAST_IDS, bounded_batches, look_up, materialize, release, remove, stored, text_key, utf8
from pitchloom.llm.simhash import SEED, connected

SHINGLE = 5
#: Similarity of 4 / 5 at least, in integers.
SIMILAR = (4, 5)
#: One text of so many is in the sample; at most so many common shingles go to every task.
SAMPLE = 64
COMMON = 200_000
#: Shingles of the members that are compared at once (8 bytes each); members with fewer than WIDE shared shingles go into one matrix.
PART = 1 << 21
WIDE = 4_096
#: Members that are compared at once, at most about.
MOST = 2_000
#: Groups are compared in so many turns, so that the disk holds the sets of a part of them at a time.
TURNS = 4


def shingles(text: bytes | None) -> np.ndarray:
    """The sorted distinct shingles of one text (UTF-8) as signed 64-bit hashes."""
    import xxhash

    words = (text or b"").lower().split()
    if not words:
        return np.empty(0, np.int64)
    grams = map(b" ".join, zip(*(words[i:] for i in range(SHINGLE)), strict=False)) if len(words) >= SHINGLE else [b" ".join(words)]
    n = max(len(words) - SHINGLE + 1, 1)
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, grams, repeat(SEED)), np.uint64, n).view(np.int64))


def prefix(found: np.ndarray, common: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Those shingles of a set, in the order (count in the sample, hash), of which similar sets share one. common is sorted."""
    n = len(found)
    if not n:
        return found
    rank = np.zeros(n, np.int64)
    if len(common):
        at = np.minimum(np.searchsorted(common, found), len(common) - 1)
        rank = np.where(common[at] == found, counts[at], 0)
    least, of = SIMILAR
    return found[np.lexsort((found, rank))][: n + (-least * n) // of + 1]


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    offsets = np.cumsum([0, *map(len, arrays)], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(arrays) if arrays else np.empty(0, np.int64)))


def _sets(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The columns of keep and h, the shingles of the column text."""

    def run(batches):
        for batch in batches:
            found = _lists([shingles(x) for x in utf8(batch.column(batch.num_columns - 1))])
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], found], names=[*keep, "h"])
        release()

    fields = "".join(f"`{c}` {docs.schema[c].dataType.simpleString()}, " for c in keep)
    return bounded_batches(docs).select(*keep, "text").mapInArrow(run, f"{fields}h array<long>")


def common_shingles(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Shingles of several texts of the sample, sorted, and their counts."""
    sample = docs.where(F.pmod(text_key(), F.lit(SAMPLE)) == 0).select("text")
    counts = _sets(sample, []).select(F.explode("h").alias("g")).groupBy("g").count().where("count > 1")
    found = counts.orderBy(F.desc("count"), "g").limit(COMMON).toArrow()
    g, n = found.column("g").to_numpy(), found.column("count").to_numpy()
    order = np.argsort(g)
    return g[order], n[order]


def prefixes(docs: DataFrame, keep: tuple[str, ...]) -> DataFrame:
    """doc_id, the columns of keep, __tk (text_key), node (a hash of the set), n (its size), fp (its SimHash) and prefix, for each row."""
    common, counts = common_shingles(docs)
    keyed = docs.select("doc_id", *keep, text_key().alias("__tk"), F.col("text").alias("__text"))
    names = [*keyed.columns[:-1], "node", "n", "fp", "prefix"]

    def run(batches):
        import xxhash

        for batch in batches:
            nodes, sizes, prints, firsts = [], [], [], []
            for text in utf8(batch.column(batch.num_columns - 1)):
                found = shingles(text)
                nodes.append(xxhash.xxh64_intdigest(found.tobytes(), SEED) if len(found) else 0)
                sizes.append(len(found))
                prints.append(simhash.majority(found.view(np.uint64)))
                firsts.append(prefix(found, common, counts))
            nodes = pa.array(np.array(nodes, np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], nodes, pa.array(sizes, pa.int32()), pa.array(np.array(prints, np.uint64).view(np.int64)), _lists(firsts)], names=names)
        release()

    fields = ", ".join(f"`{c}` {keyed.schema[c].dataType.simpleString()}" for c in names[:-4])
    return bounded_batches(keyed).mapInArrow(run, f"{fields}, node long, n int, fp long, prefix array<long>")


def _possible(pairs: DataFrame) -> DataFrame:
    """Those pairs (u, v) that can be similar; pairs has a row (u, v, un, vn, ua, va: sizes and places) for each shared shingle.

    Beyond the shingles shared in both prefixes, two sets share at most what follows the prefix of one of them.
    """
    least, of = SIMILAR
    behind = [F.ceil(F.lit(least) * F.col(n) / of) - 1 for n in ("un", "vn")]
    found = pairs.groupBy("u", "v", "un", "vn").agg(F.count("*").alias("shared"), F.min("ua").alias("ua"), F.min("va").alias("va"))
    overlap = F.least(F.col("un") - F.col("ua"), F.col("vn") - F.col("va"), F.col("shared") + F.greatest(*behind))
    return found.where((F.least("un", "vn") * of >= F.greatest("un", "vn") * least) & (overlap * (least + of) >= (F.col("un") + F.col("vn")) * least)).select("u", "v")


def sets_of(named: DataFrame, docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """node and h (its shingles) of the named nodes, to be used once. nodes has the text_key (__tk) of one text of each node."""
    needed = materialize(nodes.join(named.hint("merge"), "node", "left_semi"), "needed")
    listed = F.broadcast(needed) if needed.count() <= BROADCAST_IDS else needed.hint("merge")
    texts = docs.select(text_key().alias("__tk"), "text").join(listed, "__tk").select("node", "text").dropDuplicates(["node"])
    return _sets(texts, ["node"])


def similar(pairs: DataFrame, docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Those pairs (u, v) whose sets are similar. nodes has the text_key (__tk) of one text of each node."""
    least, of = SIMILAR
    pairs, pairs_path = stored(pairs, "pairs")
    sets, sets_path = stored(sets_of(pairs.select(F.col("u").alias("node")).union(pairs.select("v")).distinct(), docs, nodes), "sets")
    left = sets.select(F.col("node").alias("u"), F.col("h").alias("__a"))
    right = sets.select(F.col("node").alias("v"), F.col("h").alias("__b"))
    both = pairs.join(left.hint("merge"), "u").join(right.hint("merge"), "v")
    shared = F.size(F.array_intersect("__a", "__b"))
    found = materialize(both.where(shared * (least + of) >= (F.size("__a") + F.size("__b")) * least).select("u", "v"), "similar")
    remove(docs.sparkSession, pairs_path, sets_path)
    return found


def unions(sets: list[np.ndarray], classes: np.ndarray) -> list[tuple[int, int]]:
    """Pairs of places of similar sets that unite the classes of all similar sets, as few as possible.

    Members that a set repeats (cut hashes) count as shared, so no similar pair is missed.
    """
    least, of = SIMILAR
    sizes, labels, out = np.array([len(x) for x in sets]), classes.copy(), []
    sets = [np.unique(x) for x in sets]
    lost = sizes - np.array([len(x) for x in sets])

    def unite(i: int, places: np.ndarray) -> None:
        for j in places:
            if labels[j] != labels[i]:
                out.append((i, int(j)))
                labels[labels == labels[j]] = labels[i]

    if len(sets) <= 8:
        for i in range(len(sets)):
            for j in range(i):
                if labels[i] != labels[j] and min(sizes[i], sizes[j]) * of >= max(sizes[i], sizes[j]) * least:
                    if len(np.intersect1d(sets[i], sets[j], assume_unique=True)) * (least + of) + (lost[i] + lost[j]) * (least + of) >= (sizes[i] + sizes[j]) * least:
                        unite(i, np.array([j]))
        return out
    m, every = len(sets), np.concatenate(sets)
    owner = np.repeat(np.arange(m, dtype=np.int32), sizes - lost)
    by_value = np.argsort(every)
    owner, every = owner[by_value], every[by_value]
    del sets, by_value
    counts = np.diff(np.flatnonzero(np.concatenate([[True], every[1:] != every[:-1], [True]])))[: len(every)]  # of each distinct shingle
    several = counts > 1
    owner = owner[np.repeat(several, counts)]
    place = np.repeat(np.arange(several.sum(), dtype=np.int32), counts[several])  # shared shingles, numbered
    del every
    width = int(place[-1]) + 1 if len(place) else 0
    shared = np.zeros((m, m), np.float32)
    for low in range(0, width, WIDE):
        a, b = np.searchsorted(place, [low, low + WIDE])
        part = np.zeros((m, min(WIDE, width - low)), np.float32)
        part[owner[a:b], place[a:b] - low] = 1
        shared += part @ part.T
    for i in range(m):
        unite(i, np.flatnonzero(((shared[i] + lost[i] + lost) * (least + of) >= (sizes + sizes[i]) * least) & (labels != labels[i])))
    return out


def united(rest: DataFrame, docs: DataFrame, nodes: DataFrame, whole_hashes: bool = False) -> DataFrame:
    """Links (u, v) that unite the similar nodes of each group (members, node, n, class). nodes has the text_key (__tk) of one text of each node."""
    # Buckets of one cluster of copies share most members: under the least number that a member's buckets bear they go together, once each.
    near = rest.withColumn("l", F.min("members").over(Window.partitionBy("node"))).withColumn("l", F.min("l").over(Window.partitionBy("members")))
    small = near.groupBy("l", "node").agg(F.min("n").alias("n")).groupBy("l").agg(F.sum("n").alias("total"), F.count("*").alias("m")).where((F.col("total") * 2 <= PART) & (F.col("m") <= MOST))
    near = near.join(small.select(F.col("l").alias("__l"), F.lit(True).alias("fits")).hint("merge"), F.col("l") == F.col("__l"), "left")
    rest = near.groupBy(F.when(F.col("fits"), F.col("l")).otherwise(F.col("members")).alias("members"), "node").agg(F.min("n").alias("n"), F.min("class").alias("class"))
    whole = Window.partitionBy("members")
    blocks = F.greatest(F.ceil(2 * F.sum("n").over(whole) / PART), F.ceil(2 * F.count("*").over(whole) / MOST)).cast("int")
    if whole_hashes:
        blocks = blocks * 2
    cut = rest.select("members", "node", "class", blocks.alias("b")).withColumn("own", F.pmod(F.xxhash64("node", F.lit("block")), F.col("b")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("b") - 1))
    dealt, dealt_path = stored(cut.select("members", "node", "class", "own", other.alias("k")).select("members", F.least("own", "k").alias("i"), F.greatest("own", "k").alias("j"), "node", "class"), "blocks")
    sets = sets_of(dealt.select("node").distinct(), docs, nodes)
    if not whole_hashes:
        sets = sets.select("node", F.transform("h", lambda x: F.shiftright(x, 32).cast("int")).alias("h"))
    sets, sets_path = stored(sets, "sets")

    def rows_of(turn: int) -> DataFrame:
        part = dealt.where(F.pmod(F.xxhash64("members", "i", "j"), F.lit(TURNS)) == turn)
        both = sets.join(F.broadcast(part) if small_list else part.hint("merge"), "node")
        return both.select("members", "i", "j", "node", "class", "h").repartition("members", "i", "j").sortWithinPartitions("members", "i", "j", "node")

    small_list = dealt.count() <= BROADCAST_IDS

    def run(batches):
        now, held = None, []

        def links_of():
            ids, classes = [x[0] for x in held], np.array([x[1] for x in held], np.int64)
            return [(max(ids[i], ids[j]), min(ids[i], ids[j])) for i, j in unions([x[2] for x in held], classes)]

        def batch_of(out):
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in (0, 1)], names=["u", "v"])

        for batch in batches:
            out = []
            h = batch.column(5)
            values, offsets = h.values.to_numpy(zero_copy_only=False), h.offsets.to_numpy()
            for at, (m, i, j, node, c) in enumerate(zip(*(x.to_pylist() for x in batch.columns[:5]), strict=True)):
                if (m, i, j) != now:
                    out += links_of()
                    now, held = (m, i, j), []
                held.append((node, c, values[offsets[at] : offsets[at + 1]].copy()))
            yield batch_of(out)
        yield batch_of(links_of())
        release()

    turns = [materialize(bounded_batches(rows_of(k)).mapInArrow(run, "u long, v long").distinct(), "found") for k in range(TURNS)]
    remove(docs.sparkSession, dealt_path, sets_path)
    return reduce(DataFrame.union, turns).distinct()


def links(docs: DataFrame, prints: DataFrame) -> DataFrame:
    """(node, root) of every node that is similar to another, directly or through others. prints is prefixes(docs)."""
    bucket = Window.partitionBy("g")
    nodes = prints.groupBy("node").agg(F.min("__tk").alias("__tk"))
    hashed = materialize(prints.select("node", "fp").distinct(), "hashed")
    of_print = connected(simhash.links(hashed.select("fp").distinct()))
    placed = hashed.join(of_print.withColumnsRenamed({"node": "fp", "root": "print"}).hint("merge"), "fp", "left").select("node", F.coalesce("print", "fp").alias("print"))
    placed = materialize(placed, "placed")
    firsts = placed.groupBy("print").agg(F.min("node").alias("v"), F.count("*").alias("n")).where("n > 1")
    close = look_up(placed, firsts, "print", "v", "node").where("node > v").selectExpr("node u", "v")

    rows = prints.select("node", "n", "prefix").dropDuplicates(["node"]).select("node", "n", F.posexplode("prefix").alias("at", "g"))
    first = F.min(F.struct("node", "n", "at")).over(bucket)
    least, of = SIMILAR
    # Where a shingle is the first that a similar pair shares, what follows it in either set holds their overlap, least / (least + of) of both sizes.
    room = (F.col("n") - F.col("at")) * (least + of) - F.col("n") * least
    found = rows.withColumn("c", first).withColumn("last", F.max("node").over(bucket)).withColumn("early", room >= F.min("n").over(bucket) * least)
    members, members_path = stored(found.where("last > c.node").drop("last"), "members")

    stars = members.where("node > c.node").selectExpr("node u", "c.node v", "n un", "c.n vn", "at ua", "c.at va")
    roots = materialize(connected(similar(_possible(stars).union(close).distinct(), docs, nodes)), "roots")

    rest = members.where("early").select("g", "node", "n").join(roots.hint("merge"), "node", "left").select("g", "node", "n", F.coalesce("root", "node").alias("class"))
    marked = rest.select("*", F.min("class").over(bucket).alias("low"), F.max("class").over(bucket).alias("high"), F.min("n").over(bucket).alias("small"), F.max("n").over(bucket).alias("large"), F.bit_xor(F.xxhash64("node")).over(bucket).alias("xor"), F.count("*").over(bucket).alias("m"))
    unlike = (F.col("m") == 2) & (F.col("small") * of < F.col("large") * least)
    rest = marked.where((F.col("low") < F.col("high")) & ~unlike).groupBy(F.xxhash64("xor", "m").alias("members"), "node").agg(F.min("n").alias("n"), F.min("class").alias("class"))
    rest = materialize(rest, "rest")
    remove(docs.sparkSession, members_path)
    found = materialize(united(rest, docs, nodes), "found")
    more = similar(found, docs, nodes)
    failed = materialize(found.join(more, ["u", "v"], "left_anti"), "failed")
    if not failed.isEmpty():
        again = rest.join(failed.select(F.col("u").alias("node")).union(failed.select("v")).distinct(), "node", "left_semi").select("members").distinct()
        more = materialize(more.union(united(rest.join(again, "members", "left_semi"), docs, nodes, True)).distinct(), "more")
    if more.isEmpty():
        return roots
    stars = roots.where("node > root").select(F.col("node").alias("u"), F.col("root").alias("v"))
    return materialize(connected(stars.unionByName(more)), "roots")


def classes(docs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the columns of keep, class (of its near copies) and component_id (the smallest doc_id in it) of every row."""
    prints = materialize(prefixes(docs, keep), "prefixes")
    nodes = prints.groupBy("node").agg(F.min("doc_id").alias("first"), F.count("*").alias("n"))
    rooted = nodes.join(links(docs, prints).hint("merge"), "node", "left").select("node", "first", "n", F.coalesce("root", "node").alias("class"))
    rooted = materialize(rooted, "rooted")
    ids = rooted.groupBy("class").agg(F.min("first").alias("component_id"), F.count("*").alias("n"))
    rooted = look_up(rooted, ids, "class", "component_id", "node").select("node", F.struct("class", "component_id").alias("found"), "n")
    rows = prints.select("doc_id", *keep, "node").withColumn("__row", F.monotonically_increasing_id())
    return look_up(rows, rooted, "node", "found", "__row").select("doc_id", *keep, "found.class", "found.component_id")
