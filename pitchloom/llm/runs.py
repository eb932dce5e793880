"""Periodic runs of words by Crochemore's partition refinement.

A class of length l holds the places of a text whose next l words are equal. Classes of length l + 1 come from those of length l:
a place goes with the class of its right neighbour. Neighbouring members of a class at a distance of exactly l are a square of
period l (with a root that is no power, as a member between them would show); squares at consecutive places are one run.

Lengths up to WIDE are refined for all documents of a batch at once, by sorting the places that still have company; most
texts have none left then. From there on each text goes by smaller halves: only the parts that split off in the last step, but for the
largest part of each class, can split others, and members are moved between linked lists. So a place is moved at most log n
times, and n log n bounds the work on a text of any shape.

A document is the unit of work: tasks hold TEXT_BYTES of texts, or one longer text, at a time. Nothing is shuffled.

Null, empty and blank texts have no words and no runs; collapsed is empty. Rows with a null doc_id are treated alike, repeated rows stay
repeated, an empty table gives an empty result, and further columns are ignored.
"""

from __future__ import annotations

from collections import defaultdict
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pitchloom.llm.bpe import groups
from pitchloom.llm.common import bounded_batches, release, utf8

LEAST = 12
WIDE = 12
WORDS = r"[^\x20\x09-\x0D]+"


def _long_squares(n: int, classes: list[list[int]], at: int) -> dict[int, list[int]]:
    """Squares of period ``at`` and more of a text of n words; classes: those of length ``at`` with two members or more, in order."""
    own, after, before = [0] * (n + 2), [-1] * (n + 1), [-1] * (n + 1)
    head, size, waiting = [-1], [0], defaultdict(list)

    def link(members: list[int]) -> None:
        """Members become a class of their own; a single one leaves."""
        if len(members) == 1:
            own[members[0]], after[members[0]] = 0, -1
            return
        c, last = len(head), -1
        head.append(members[0])
        size.append(len(members))
        for i in members:
            own[i], before[i] = c, last
            if last >= 0:
                after[last] = i
                waiting[i - last].append(last)
            last = i
        after[last] = -1

    for members in classes:
        link(members)
    small = classes + [[i + 1] for members in classes for i in members if not own[i + 1]]
    found = {}
    while small and 2 * at <= n:
        here = {i for i in waiting.pop(at, ()) if after[i] == i + at}
        if here:
            found[at] = sorted(here)
        touched = defaultdict(list)
        for part in small:
            split = defaultdict(list)
            for j in part:
                if j and (c := own[j - 1]):
                    split[c].append(j - 1)
            for c, members in split.items():
                touched[c].append(members)
        small = []
        for c, parts in touched.items():
            rest = size[c] - sum(map(len, parts))
            if not rest:
                parts.sort(key=len)
                rest = len(parts.pop())
                if not parts:
                    continue
            for members in parts:
                for i in members:
                    left, right = before[i], after[i]
                    if left >= 0:
                        after[left] = right
                    else:
                        head[c] = right
                    if right >= 0:
                        before[right] = left
                        if left >= 0:
                            waiting[right - left].append(left)
            size[c] = rest
            widest = max(parts, key=len)
            if len(widest) <= rest:
                small += parts
            else:
                i, left_over = head[c], []
                while i >= 0:
                    left_over.append(i)
                    i = after[i]
                small += [p for p in parts if p is not widest] + [left_over]
            for members in parts:
                link(members)
            if rest == 1:
                own[head[c]], after[head[c]] = 0, -1
        at += 1
    return found


def _stretches(places: np.ndarray, period: int) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs whose squares begin at these places, in order."""
    cuts = np.flatnonzero(np.diff(places) != 1) + 1
    first, last = places[np.r_[0, cuts]], places[np.r_[cuts - 1, len(places) - 1]]
    return [(s, n, period) for s, n in zip(first.tolist(), (last - first + 2 * period).tolist(), strict=True)]


def runs_of(texts: list[list], least: int = LEAST, wide: int = WIDE) -> list[list[tuple[int, int, int]]]:
    """Runs (start, length, period) of length ``least`` or more, by start and period, of each list of words."""
    ids: list[int] = []
    starts, free = [], 0
    for words in texts:
        starts.append(len(ids))
        number = {w: i for i, w in enumerate(dict.fromkeys(words), free)}
        free += len(number) + 1
        ids.extend(map(number.__getitem__, words))
        ids.append(free - 1)  # ends the text: equal to nothing
    own = np.array(ids, np.int64)
    starts = np.array(starts, np.int64)
    found: list[tuple[int, int, int]] = []
    active = np.arange(len(own))
    key, at = own, 1
    while True:
        order = np.argsort(key, kind="stable")
        places, key = active[order], key[order]
        fresh = np.r_[True, key[1:] != key[:-1]]
        own[places] = free + np.cumsum(fresh)
        free += len(places) + 1
        company = ~(fresh & np.r_[fresh[1:], True])
        places, fresh = places[company], fresh[company]
        if at > wide or not len(places):
            break
        squares = np.sort(places[:-1][~fresh[1:] & (np.diff(places) == at)])
        if len(squares):
            found += _stretches(squares, at)
        active = np.sort(places)
        key = own[active] * free + own[active + 1]
        at += 1
    if len(places):
        doc = np.searchsorted(starts, places, "right") - 1
        classes = defaultdict(list)
        cuts = np.flatnonzero(fresh)
        local = (places - starts[doc]).tolist()
        for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(local)], strict=True):
            classes[int(doc[a])].append(local[a:b])
        for d, members in classes.items():
            for period, squares in _long_squares(len(texts[d]), members, at).items():
                found += [(int(starts[d]) + s, n, p) for s, n, p in _stretches(np.array(squares), period)]
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    for s, n, p in found:
        if n >= least:
            d = int(np.searchsorted(starts, s, "right")) - 1
            out[d].append((s - int(starts[d]), n, p))
    return [sorted(r, key=lambda x: (x[0], x[2])) for r in out]


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words joined by spaces, of each run its first period only."""
    if runs:
        change = [0] * (len(words) + 1)
        for start, length, period in runs:
            change[start + period] += 1
            change[start + length] -= 1
        words = [w for w, c in zip(words, accumulate(change), strict=False) if not c]
    return b" ".join(words)


def periodic_runs(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), least: int = LEAST) -> DataFrame:
    """The columns of ``keep``, with runs (array of start, length, period, by start and period) and the collapsed text of each document."""
    fields = [docs.schema[c] for c in keep]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), "runs array<struct<start: bigint, length: bigint, period: bigint>>, collapsed string"])
    kind = pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")]))

    def run(batches):
        for batch in batches:
            for at, n in groups(batch.column(batch.num_columns - 1)):
                part = batch.slice(at, n)
                texts = [(t or b"").split() for t in utf8(part.column(part.num_columns - 1))]
                runs = runs_of(texts, least)
                told = pa.array([[dict(zip(("start", "length", "period"), r, strict=True)) for r in of] for of in runs], kind)
                short = pa.array(map(collapsed, texts, runs), pa.binary()).cast(pa.string())
                del texts
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], told, short], names=[*keep, "runs", "collapsed"])
        release()

    return bounded_batches(docs).select(*keep, docs["text"].alias("__text")).mapInArrow(run, schema)


def planted(docs: DataFrame) -> DataFrame:
    """doc_id and text of documents, where the contract makes the text of every tenth hash of doc_id periodic from some word on."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.regexp_extract_all("text", F.lit(WORDS), F.lit(0))
    rows = docs.select("doc_id", "text", h.alias("h"), F.floor(h / 10).alias("g"), F.when((h % 10 == 0) & F.col("text").rlike(r"[^\x20\x09-\x0D]"), words).alias("w"))
    rows = rows.withColumn("n", F.size("w")).withColumn("a", F.expr("if(w is null, null, g % n)"))
    rows = rows.withColumn("p", F.expr("1 + (n - a) div (3 + g % 8)"))
    periodic = F.expr("array_join(transform(w, (x, i) -> if(i < a, x, w[cast(a + (i - a) % p as int)])), ' ')")
    return rows.select("doc_id", F.when(F.col("w").isNull(), F.col("text")).otherwise(periodic).alias("text"))


def longest(runs: Column) -> Column:
    """The run of greatest length; ties go to the smallest start, then period. Null if there is none."""
    rank = F.transform(runs, lambda r: F.struct((-r["length"]).alias("a"), r["start"].alias("start"), r["period"].alias("period"), r["length"].alias("length")))
    return F.array_min(rank)


def run_digest(docs: DataFrame) -> DataFrame:
    """The contract's columns, derived from the runs and the collapsed text."""
    found = periodic_runs(planted(docs)).withColumn("top", longest(F.col("runs")))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n")))
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "top.start", "top.length", "top.period", F.expr("top.length * 1000 div top.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
