"""Language-model scores from a log-frequency Bloom filter of quantised n-gram counts.

Counting: every task turns its texts into tokens and emits its distinct words and word pairs with counts, packed as arrays of
64-bit hashes by bucket; one shuffle brings a bucket together and adds up. Words keep exact counts (two words would have to
share a 64-bit hash to be confused). Pairs go to the filter: a count c has the level q = 1 + floor(log2 c), and the pair is
inserted once for each level up to q. Each bucket is a Bloom filter of its own, sized by its entries (``BITS`` bits
and ``PROBES`` hash functions each, about 2 % false positives).

Scoring: the filter is probed for level 1, 2, ... until a probe fails; the level stands for the mean of
its counts. P(w | v) = (q(v w) + m(v) * P1(w)) / (c(v) + m(v)), with P1(w) = (c(w) + 1) / (N + V + 1) and m(v) = max(LEAST_MASS,
c(v) ** POWER), as the number of different followers grows with a word; for m alone, words beyond the FREQUENT most frequent ones count
as half the least count of those. The history of a first token is a mark that begins every text. score is the sum of log10 P over the tokens of a text, its end included.

Size: words and filter are cut into shards of at most about ``SHARD_BYTES``, by the hash of the scored word. Each shard
is broadcast in a pass over the texts of its own; the sums are additive over tokens, so the passes are added up by row. With several
shards each pass is written before the next shard is read, so the driver holds one shard. One pass is enough up to some 100 million
distinct pairs. The number of buckets follows the bytes of the training texts, so a bucket stays at about ``BUCKET_BYTES`` at any size. Nothing is
pruned unless asked for (``least``: pairs seen less often are left out), and memory does not grow with the corpus; passes do.

Training rows are those whose crc32(doc_id as text) mod 7 is not 2; a row without doc_id is held out. Nulls and empty texts
are an end alone. Without training rows N = V = 0. Rows with null or repeated ids give one result row each; an empty
table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitchloom.llm.common import materialize

FOLDS, HELD_OUT = 7, 2
LEAST_MASS, POWER = 4.0, 0.9
#: Words whose counts every task has (16 bytes each), for the mass that a history gives to single words.
FREQUENT = 1_000_000
BITS, PROBES = 8, 5
#: Words are cut into this many groups by hash, pairs into at least SUB buckets in the group of their second word.
GROUPS, SUB = 64, 8
SHARD_BYTES = 160 << 20
#: What a bucket brings together, about: twice the bytes of the texts are shuffled over all buckets.
BUCKET_BYTES = 32 << 20
#: Tokens that a task holds at once.
FLUSH = 1_000_000
#: Tokens scored at once.
SLICE = 200_000
END, BEGIN = b" ", b" begin"

U = np.uint64


def tokens(text: bytes | None) -> list[bytes]:
    """Words at ASCII white space, A-Z lower-cased, and the end."""
    return [*(text or b"").lower().split(), END]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit numbers."""
    x = (x ^ (x >> U(31))) * U(0x7FB5D329728EA185)
    x = (x ^ (x >> U(27))) * U(0x81DADEF4BC2DD44D)
    return x ^ (x >> U(33))


def word_hashes(words) -> np.ndarray:
    import xxhash

    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def pair_keys(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return mix(mix(first) + second)


def group_of(h: np.ndarray) -> np.ndarray:
    return (h >> U(64 - GROUPS.bit_length() + 1)).astype(np.int64)


def bucket_of(second: np.ndarray, keys: np.ndarray, sub: int = SUB) -> np.ndarray:
    return group_of(second) * sub + (keys % U(sub)).astype(np.int64)


class Block:
    """Texts of a task as numbers: distinct words, and for each text the places of its words."""

    def __init__(self):
        self.place: dict[bytes, int] = {BEGIN: 0}
        self.texts: list[np.ndarray] = []
        self.n = 0

    def add(self, text: bytes | None) -> None:
        place = self.place
        words = tokens(text)
        self.texts.append(np.array([place.setdefault(w, len(place)) for w in words], np.int32))
        self.n += len(words)

    def arrays(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Hashes of the distinct words (the first is BEGIN), and for each token its word, the word before it, and its text."""
        lengths = np.array([len(t) for t in self.texts], np.int64)
        here = np.concatenate([*self.texts, np.zeros(0, np.int32)])
        before = np.zeros(len(here), np.int32)
        before[1:] = here[:-1]
        before[np.cumsum(lengths) - lengths] = 0
        return word_hashes(list(self.place)), here, before, np.repeat(np.arange(len(lengths)), lengths)


def probes(keys: np.ndarray, level: int, size: np.ndarray) -> Iterator[np.ndarray]:
    """Bit places of each key at a level, one array for each hash function, in a filter of ``size`` bits."""
    one = mix(keys + U(level * 0x9E3779B97F4A7C15 % 2**64))
    two = mix(one) | U(1)
    for i in range(PROBES):
        yield ((one + U(i) * two) % size).astype(np.int64)


def build_filter(keys: np.ndarray, counts: np.ndarray, bits_each: int = BITS) -> np.ndarray:
    """The bytes of a log-frequency Bloom filter of distinct keys and their counts."""
    levels = np.frexp(counts.astype(float))[1].astype(np.int64)  # 1 + floor(log2)
    size = max(64, -(-int(levels.sum()) * bits_each // 8) * 8)
    bits = np.zeros(size, np.uint8)
    for level in range(1, int(levels.max(initial=0)) + 1):
        for place in probes(keys[levels >= level], level, U(size)):
            bits[place] = 1
    return np.packbits(bits, bitorder="little")


def look_up(keys: np.ndarray, buckets: np.ndarray, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Estimated counts of pairs: the level at which the first probe fails, less one."""
    level_of = np.zeros(len(keys), np.int64)
    alive = np.flatnonzero(sizes[buckets] > 0)
    for level in range(1, 64):
        if not len(alive):
            break
        start = starts[buckets[alive]]
        places = probes(keys[alive], level, sizes[buckets[alive]].astype(np.uint64))
        left = np.arange(len(alive))
        for place in places:
            at = place[left]
            left = left[(data[start[left] + (at >> 3)] >> (at & 7).astype(np.uint8)) & 1 == 1]
        alive = alive[left]
        level_of[alive] = level
    top = np.exp2(level_of)
    return np.where(level_of > 0, (top / 2 + top - 1) / 2, 0.0)


def _add(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    found, place = np.unique(keys, return_inverse=True)
    return found, np.bincount(place, counts, len(found)).astype(np.int64)


def counted(training: DataFrame, sub: int = SUB, least: int = 1, bits: int = BITS) -> DataFrame:
    """One row per bucket: pairs (bool), bucket, distinct, total, keys and counts of words, or the filter of pairs."""

    def emit(block):
        hashes, here, before, _ = block.arrays()
        n = len(hashes)
        rows = []

        def cut(pairs, buckets, keys, counts):
            order = np.argsort(buckets, kind="stable")
            buckets, keys, counts = buckets[order], keys[order], counts[order]
            edges = [0, *(np.flatnonzero(np.diff(buckets)) + 1).tolist(), len(buckets)] if len(buckets) else [0]
            rows.extend((pairs, int(buckets[a]), keys[a:b].tobytes(), counts[a:b].astype("<u4").tobytes()) for a, b in zip(edges, edges[1:], strict=False))

        words = np.bincount(here, minlength=n)
        used = np.flatnonzero(words)
        cut(False, group_of(hashes[used]), hashes[used], words[used])
        both, counts = np.unique(before.astype(np.int64) * n + here, return_counts=True)
        second = hashes[both % n]
        keys = pair_keys(hashes[both // n], second)
        cut(True, bucket_of(second, keys, sub), keys, counts)
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.bool_(), pa.int32(), pa.binary(), pa.binary()))], names=["pairs", "bucket", "keys", "counts"])

    def run(batches):
        block = Block()
        for batch in batches:
            for text in batch.column(0).cast(pa.binary()):
                block.add(text.as_py())
                if block.n >= FLUSH:
                    yield emit(block)
                    block = Block()
        if block.n:
            yield emit(block)

    def merge(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        keys, counts = _add(np.frombuffer(b"".join(rows["keys"]), "<u8"), np.frombuffer(b"".join(rows["counts"]), "<u4"))
        n, total = len(keys), int(counts.sum())
        data = build_filter(keys[counts >= least], counts[counts >= least], bits) if key[0] else keys
        return pd.DataFrame([(key[0], key[1], n, total, data.tobytes(), b"" if key[0] else counts.astype("<i8").tobytes())], columns=["pairs", "bucket", "n", "total", "data", "counts"])

    parts = training.select("text").mapInArrow(run, "pairs boolean, bucket int, keys binary, counts binary")
    return parts.groupBy("pairs", "bucket").applyInPandas(merge, "pairs boolean, bucket int, n long, total long, data binary, counts binary")


def shards(model: DataFrame, sub: int = SUB) -> list[tuple[int, int]]:
    """Ranges of groups whose words and filters take at most SHARD_BYTES together (or a single group)."""
    group = F.when(F.col("pairs"), F.floor(F.col("bucket") / sub)).otherwise(F.col("bucket"))
    sizes = {r["g"]: r["b"] for r in model.groupBy(group.alias("g")).agg(F.sum(F.octet_length("data") + F.octet_length("counts")).alias("b")).collect()}  # GROUPS rows
    out, start, held = [], 0, 0
    for g in range(GROUPS):
        if held and held + sizes.get(g, 0) > SHARD_BYTES:
            out.append((start, g))
            start, held = g, 0
        held += sizes.get(g, 0)
    return [*out, (start, GROUPS)]


def load(model: DataFrame, low: int, high: int, sub: int = SUB) -> dict:
    """The arrays of one shard."""
    rows = model.where((~F.col("pairs") & F.col("bucket").between(low, high - 1)) | (F.col("pairs") & F.col("bucket").between(low * sub, high * sub - 1)))
    words, filters = {}, {}
    for r in rows.toLocalIterator():
        (filters if r["pairs"] else words)[r["bucket"]] = r
    starts, sizes = np.zeros(GROUPS * sub, np.int64), np.zeros(GROUPS * sub, np.int64)
    at = 0
    for b, r in sorted(filters.items()):
        starts[b], sizes[b] = at, len(r["data"]) * 8
        at += len(r["data"])
    return {
        "words": np.frombuffer(b"".join(words[b]["data"] for b in sorted(words)), "<u8"),
        "counts": np.frombuffer(b"".join(words[b]["counts"] for b in sorted(words)), "<i8"),
        "data": np.frombuffer(b"".join(filters[b]["data"] for b in sorted(filters)), np.uint8),
        "starts": starts,
        "sizes": sizes,
        "sub": sub,
    }


def frequent(model: DataFrame, most: int) -> dict:
    """The counts of the ``most`` most frequent words at most (all words of a count or none), sorted by hash, and the count that others are taken for."""
    keys, counts, floor = np.zeros(0, np.uint64), np.zeros(0, np.int64), 0
    for r in model.where("not pairs").toLocalIterator():  # a bucket at a time
        keys, counts = np.concatenate([keys, np.frombuffer(r["data"], "<u8")]), np.concatenate([counts, np.frombuffer(r["counts"], "<i8")])
        if len(counts) > most:
            floor = max(floor, int(np.partition(counts, len(counts) - most - 1)[len(counts) - most - 1]))
        keys, counts = keys[counts > floor], counts[counts > floor]
    order = np.argsort(keys)
    return {"frequent": keys[order], "often": counts[order], "rest": floor / 2}


def partial_scores(block: Block, shard: dict, low: int, high: int, total: int, distinct: int, n_texts: int) -> np.ndarray:
    """Columns n_tokens, n_known, base_score and score of each text, as far as the shard's words decide them."""
    hashes, here, before, text = block.arrays()
    mine = (group_of(hashes) >= low) & (group_of(hashes) < high)
    place = np.searchsorted(shard["words"], hashes)
    place[place == len(shard["words"])] = 0
    count = np.zeros(len(hashes))
    if len(shard["words"]):
        count = np.where(shard["words"][place] == hashes, shard["counts"][place], 0).astype(float)
    plain = (count + 1) / (total + distinct + 1)
    mass = np.full(len(hashes), shard["rest"], float)
    if len(shard["frequent"]):
        place = np.minimum(np.searchsorted(shard["frequent"], hashes), len(shard["frequent"]) - 1)
        mass = np.where(shard["frequent"][place] == hashes, shard["often"][place], mass)
    mass[0] = n_texts
    mass = np.maximum(LEAST_MASS, mass**POWER)
    scored = mine[here]
    t, w, v = text[scored], here[scored], before[scored]
    keys = pair_keys(hashes[v], hashes[w])
    pair = look_up(keys, bucket_of(hashes[w], keys, shard["sub"]), shard["data"], shard["starts"], shard["sizes"])
    count[0], mine[0] = n_texts, low == 0  # BEGIN
    history = mine[before]
    n = len(block.texts)
    score = np.bincount(t, np.log10(pair + mass[v] * plain[w]), n) - np.bincount(text[history], np.log10(count[before[history]] + mass[before[history]]), n)
    return np.stack([np.bincount(t, minlength=n), np.bincount(t, count[w] > 0, n), np.bincount(t, np.log10(plain[w]), n), score], axis=1).astype(float)


def lm_scores(docs: DataFrame, most: int = FREQUENT, least: int = 1, bits: int = BITS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row."""
    spark = docs.sparkSession
    fold = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(FOLDS))
    size = docs.where(fold != HELD_OUT).agg(F.sum(F.octet_length("text"))).first()[0] or 0
    sub = max(SUB, -(-2 * size // (GROUPS * BUCKET_BYTES)))
    model = materialize(counted(docs.where(fold != HELD_OUT), sub, least, bits), "ngrams")
    sums = model.where("not pairs").agg(F.coalesce(F.sum("total"), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0))).first()
    total, distinct = int(sums[0]), int(sums[1])
    n_texts = docs.where(fold != HELD_OUT).count()
    often = frequent(model, most)
    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.coalesce(fold == HELD_OUT, F.lit(True)).alias("held_out"), "text")
    names = ["row", "doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"]
    kind = docs.schema["doc_id"].dataType.simpleString()

    def one(low, high):
        shard = spark.sparkContext.broadcast(load(model, low, high, sub) | often)  # at most SHARD_BYTES, unless one group is larger

        def run(batches):
            for batch in batches:
                out, block = [], Block()
                for text in batch.column(3).cast(pa.binary()):
                    block.add(text.as_py())
                    if block.n >= SLICE:
                        out.append(partial_scores(block, shard.value, low, high, total, distinct, n_texts))
                        block = Block()
                if block.n:
                    out.append(partial_scores(block, shard.value, low, high, total, distinct, n_texts))
                found = np.concatenate(out) if out else np.zeros((0, 4))
                yield pa.RecordBatch.from_arrays([*batch.columns[:3], *(pa.array(found[:, i].astype(np.int64)) for i in (0, 1)), *(pa.array(found[:, i]) for i in (2, 3))], names=names)

        return rows.mapInArrow(run, f"row long, doc_id {kind}, held_out boolean, n_tokens long, n_known long, base_score double, score double"), shard

    ranges = shards(model, sub)
    if len(ranges) == 1:
        scored = one(*ranges[0])[0]
    else:
        passes = []
        for low, high in ranges:
            found, shard = one(low, high)
            passes.append(materialize(found, "pass"))
            shard.destroy()
        scored = reduce(DataFrame.unionByName, passes).groupBy("row", "doc_id", "held_out").agg(*[F.sum(c).alias(c) for c in names[3:]])
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score")
