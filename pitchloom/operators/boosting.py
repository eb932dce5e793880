"""Boosted trees for three classes on shared softmax gradients, grown from histograms.

Values become bins once. A round grows one tree for each class, level by level: tasks add up gradients by class, node, feature and bin
over their rows, Spark adds the tasks' sums, and the driver picks the splits from them. Their number depends on features, bins and depth,
never on rows. Gradients are summed as whole numbers, so the trees do not depend on how rows are partitioned.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pitchloom.sources.work import written

CLASSES = 3
#: Gradients are whole multiples of 1 / SCALE; sums stay exact up to some 5e11 rows.
SCALE = 2**24
#: A bin is a tinyint; bin 0 holds the unknown values.
MOST_BINS = 126
STATE = "key bigint, label tinyint, bins array<tinyint>, margins array<double>"


@dataclass(frozen=True)
class Trees:
    """Trees in the order of rounds, the three classes of a round in turn; nodes lie as in a heap.

    feature: of a node's split, -1 in a leaf. A row goes left if its bin is at most ``cut``, an unknown value where ``unknown_left`` says.
    value: what a leaf adds to the margin of its class.
    """

    feature: np.ndarray
    cut: np.ndarray
    unknown_left: np.ndarray
    value: np.ndarray

    @classmethod
    def bare(cls, n: int, depth: int) -> Trees:
        shape = (n, 2 ** (depth + 1) - 1)
        return cls(np.full(shape, -1, np.int16), np.zeros(shape, np.int16), np.zeros(shape, bool), np.zeros(shape))

    def __getitem__(self, some: slice) -> Trees:
        return Trees(self.feature[some], self.cut[some], self.unknown_left[some], self.value[some])

    def leaves(self, tree: int, bins: np.ndarray) -> np.ndarray:
        """The node that each row ends in."""
        feature, node, rows = self.feature[tree], np.zeros(len(bins), np.int64), np.arange(len(bins))
        for _ in range((feature.size + 1).bit_length() - 2):
            f = feature[node]
            b = bins[rows, np.maximum(f, 0)]
            left = np.where(b == 0, self.unknown_left[tree][node], b <= self.cut[tree][node])
            node = np.where(f < 0, node, 2 * node + 2 - left)
        return node

    def margins(self, bins: np.ndarray) -> np.ndarray:
        """What all trees add to the margins of the classes."""
        out = np.zeros((len(bins), CLASSES))
        for t in range(len(self.feature)):
            out[:, t % CLASSES] += self.value[t][self.leaves(t, bins)]
        return out


@dataclass(frozen=True)
class Boosted:
    """Fitted trees with the names and the bin edges of their features."""

    names: tuple[str, ...]
    edges: tuple[tuple[float, ...], ...]
    trees: Trees

    def document(self) -> dict:
        """As a JSON document."""
        t = self.trees
        return {"names": list(self.names), "edges": [list(e) for e in self.edges], "trees": {c: getattr(t, c).tolist() for c in ("feature", "cut", "unknown_left", "value")}}

    @classmethod
    def from_document(cls, document: dict) -> Boosted:
        kinds = {"feature": np.int16, "cut": np.int16, "unknown_left": bool, "value": float}
        arrays = {c: np.array(document["trees"][c], kind) for c, kind in kinds.items()}
        if len({a.shape for a in arrays.values()}) != 1 or len(document["names"]) != len(document["edges"]) or arrays["feature"].max(initial=-1) >= len(document["names"]):
            raise ValueError("boosted trees: parts of the document do not fit together")
        return cls(tuple(document["names"]), tuple(map(tuple, document["edges"])), Trees(**arrays))


def binned(values: np.ndarray, edges: tuple[tuple[float, ...], ...]) -> np.ndarray:
    """A column for each feature: 0 where unknown, else 1 plus the number of edges below the value."""
    out = np.zeros(values.shape, np.int8)
    for i, e in enumerate(edges):
        known = ~np.isnan(values[:, i])
        out[known, i] = 1 + np.searchsorted(np.array(e, float), values[known, i], side="left")
    return out


def softmax(margins: np.ndarray) -> np.ndarray:
    e = np.exp(margins - margins.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _edges(rows: DataFrame, names: tuple[str, ...], bins: int) -> tuple[tuple[float, ...], ...]:
    """Quantiles of every feature's known values, in one scan; the greatest value separates nothing."""
    at = F.lit([i / bins for i in range(1, bins + 1)])
    known = [F.nullif(F.col(f"`{n}`").cast("double"), F.lit(float("nan"))) for n in names]
    found = rows.agg(*[F.percentile_approx(k, at, 10_000) for k in known]).first()
    return tuple(tuple(sorted(set(q or ()))[:-1]) for q in found)


def _values(names: tuple[str, ...]) -> Column:
    return F.array(*[F.coalesce(F.col(f"`{n}`").cast("double"), F.lit(float("nan"))) for n in names])


def _matrix(column: pa.Array, n: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(n, -1)


def _lists(values: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(values) + 1) * values.shape[1], pa.int32()), pa.array(values.ravel()))


def uniforms(keys: np.ndarray, number: int) -> np.ndarray:
    """Uniform numbers in [0, 1) that depend on a key and a number only (splitmix64)."""
    with np.errstate(over="ignore"):
        z = keys.view(np.uint64) + np.uint64(number * 0x9E3779B97F4A7C15 % 2**64)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        z ^= z >> np.uint64(31)
    return (z >> np.uint64(11)) / 2.0**53


def gradients(margins: np.ndarray, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and second derivatives of the loss by class, in multiples of 1 / SCALE."""
    p = softmax(margins)
    g, h = p - (labels[:, None] == np.arange(CLASSES)), 2 * p * (1 - p)
    return np.rint(g * SCALE), np.rint(h * SCALE)


def _sums(state: DataFrame, trees: Trees, open_: Trees, level: int, draw: int, share: float, width: int, bins: int) -> np.ndarray:
    """Gradient sums [class, node of the level, feature, bin, 2]: one scan, one aggregation of the tasks' sums."""
    nodes = 2**level
    shape = (CLASSES, nodes, width, bins + 1)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, int(np.prod(shape))), np.int64)
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            drawn = uniforms(batch.column("key").to_numpy().copy(), draw) < share
            b = _matrix(batch.column("bins"), n)
            sums = gradients(_matrix(batch.column("margins"), n) + trees.margins(b), batch.column("label").to_numpy())
            for c in range(CLASSES):
                place = open_.leaves(c, b) - (nodes - 1)
                here = drawn & (place >= 0)
                slot = ((c * nodes + place[here, None]) * width + np.arange(width)) * (bins + 1) + b[here]
                for i, s in enumerate(sums):
                    total[i] += np.bincount(slot.ravel(), np.repeat(s[here, c], width), total.shape[1]).astype(np.int64)
        used = np.flatnonzero(total.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(total[0, used]), pa.array(total[1, used])], ["slot", "g", "h"])

    found = state.mapInArrow(add, "slot int, g bigint, h bigint").groupBy("slot").agg(F.sum("g").alias("g"), F.sum("h").alias("h")).toArrow()  # at most a row for each class, node, feature and bin
    out = np.zeros((int(np.prod(shape)), 2))
    out[found.column("slot").to_numpy()] = np.stack([found.column("g").to_numpy(), found.column("h").to_numpy()], axis=1) / SCALE
    return out.reshape(*shape, 2)


def best_split(sums: np.ndarray, allowed: np.ndarray, least: float, penalty: float) -> tuple[float, int, int, bool, np.ndarray, np.ndarray] | None:
    """(gain, feature, cut, unknown_left, left sums, right sums) of one node's sums [feature, bin, 2]; None if nothing gains.

    Of equal gains the first feature is taken, then unknown values to the right, then the first cut.
    """
    whole, unknown, upto = sums.sum(axis=1), sums[:, :1], np.cumsum(sums[:, 1:], axis=1)
    left = np.stack([upto, upto + unknown], axis=1)
    right = whole[:, None, None] - left

    def score(s):
        return s[..., 0] ** 2 / (s[..., 1] + penalty)

    gain = score(left) + score(right) - score(whole)[:, None, None]
    gain[(left[..., 1] < least) | (right[..., 1] < least) | ~allowed[:, None, None]] = 0.0
    f, way, cut = np.unravel_index(gain.argmax(), gain.shape)
    return (gain[f, way, cut], int(f), int(cut) + 1, bool(way), left[f, way, cut], right[f, way, cut]) if gain[f, way, cut] > 1e-6 else None


def fit(
    rows: DataFrame, names: tuple[str, ...], key: str, label: str, rounds: int = 200, depth: int = 3, rate: float = 0.05, share: float = 0.9, columns: float = 0.9,
    least: float = 5.0, penalty: float = 1.0, bins: int = 64, every: int = 25, seed: int = 20260616,
) -> Boosted:
    """Fit on rows whose label is 0, 1 or 2; null or NaN features are unknown and go where a split gains most.

    share and columns: of rows (by a hash of ``key``) in a round and of features in a tree. least: sum of second derivatives that a child needs.
    penalty: on squared leaf values. Margins are written every ``every`` rounds; in between tasks apply the trees grown since.
    """
    if not 2 <= bins <= MOST_BINS:
        raise ValueError(f"bins: 2 to {MOST_BINS}")
    names, width = tuple(names), len(names)
    edges = _edges(rows, names, bins)

    def start(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            b = binned(_matrix(batch.column("values"), batch.num_rows), edges) if batch.num_rows else np.zeros((0, width), np.int8)
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("label"), _lists(b), _lists(np.zeros((len(b), CLASSES)))], ["key", "label", "bins", "margins"])

    raw = rows.select(F.xxhash64(F.col(f"`{key}`")).alias("key"), F.col(f"`{label}`").cast("tinyint").alias("label"), _values(names).alias("values"))
    state = written(raw.mapInArrow(start, STATE), "boosting").persist()
    trees, since = Trees.bare(rounds * CLASSES, depth), 0
    taken = max(1, int(columns * width))
    try:
        for r in range(rounds):
            own = slice(r * CLASSES, (r + 1) * CLASSES)
            grown = trees[own]  # views of the arrays
            order = [np.argsort(uniforms(np.arange(width), seed + 1 + r * CLASSES + c), kind="stable") for c in range(CLASSES)]
            for level in range(depth):
                sums = _sums(state, trees[slice(since, own.start)], grown, level, seed + 7919 * (r + 1), share, width, bins)
                split_any = False
                for c in range(CLASSES):
                    allowed = np.isin(np.arange(width), order[c][:taken])
                    for i in range(2**level):
                        node = 2**level - 1 + i
                        if not level:
                            g, h = sums[c, i, 0].sum(axis=0)
                            grown.value[c, node] = -rate * g / (h + penalty)
                        found = best_split(sums[c, i], allowed, least, penalty)
                        if found:
                            _, grown.feature[c, node], grown.cut[c, node], grown.unknown_left[c, node], *children = found
                            grown.value[c, [2 * node + 1, 2 * node + 2]] = [-rate * g / (h + penalty) for g, h in children]
                            split_any = True
                if not split_any:
                    break
            if own.stop - since == every * CLASSES and r + 1 < rounds:
                state, old = _applied(state, trees[slice(since, own.stop)]).persist(), state
                old.unpersist()
                since = own.stop
    finally:
        state.unpersist()
    return Boosted(names, edges, trees)


def _applied(state: DataFrame, trees: Trees) -> DataFrame:
    """The state with the margins of trees added, written."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                margins = _matrix(batch.column("margins"), batch.num_rows) + trees.margins(_matrix(batch.column("bins"), batch.num_rows))
                batch = pa.RecordBatch.from_arrays([*batch.columns[:3], _lists(margins)], ["key", "label", "bins", "margins"])
            yield batch

    return written(state.mapInArrow(add, STATE), "boosting")


def probabilities(model: Boosted) -> Column:
    """An array of the three probabilities of a row that has the model's features."""

    @F.pandas_udf("array<double>")
    def of(values: pd.Series) -> pd.Series:
        if values.empty:
            return pd.Series([], dtype=object)
        return pd.Series(list(softmax(model.trees.margins(binned(np.stack(values.to_list()), model.edges)))))

    return of(_values(model.names))
