"""Toxicity scores by non-negative positive-unlabelled learning.

Confirmed toxic texts are the positives; all other training texts, labelled or not, are unlabelled. A linear classifier on the
presence of words and word beginnings (letter runs, A-Z lower-cased, hashed) is fitted with numpy by minimizing the
non-negative risk  prior * R+(P) + max(0, R-(U) - prior * R-(P))  with the logistic loss and a quadratic penalty; when the
difference falls below zero the step goes against it, so the classifier cannot explain
unlabelled positives away. The class prior is the share of positives among labelled training rows.

A word or beginning is a trait; its presence, and its repetition where it is dense, are the features. Features enter if their document frequencies among positives and unlabelled texts differ by
a log-likelihood ratio of ``SCREEN`` at least, and if prior * P(feature | positive) / P(feature | unlabelled), the share of
toxic texts among those with the feature, is ``POSTERIOR`` at least; the rest only adds noise to long texts. Exact copies count once in the sample.

The sample is bounded: at most about 1.25 * ``MAX_POSITIVE`` positives and 1.25 * ``MAX_UNLABELLED`` unlabelled texts, taken by a hash of
the text from the whole training part, however often ids or texts repeat. Everything else is over all rows: each whole text is scored.

Training rows are those whose crc32(doc_id as text) mod 5 is not 0; labels, lang, source and doc_id are never
inputs of a score. Nulls and empty texts have no words and get the score of the bias. A null doc_id counts as held
out. Labels that are null or contradict each other for one doc_id: any 1 makes it positive. Without positives or unlabelled
texts the score is the prior (0.5 at most, exclusive) for all rows. Repeated rows give one result row each.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitchloom.llm.common import BROADCAST_IDS, bounded_batches, materialize, release, utf8

FOLDS = 5
MAX_POSITIVE = 2_000
MAX_UNLABELLED = 6_000
HASHES = 1 << 21
LEVELS = 3
BEGINNINGS = (4, 5, 6)
#: A trait that makes up less than one word in so many does not count as dense.
SPARSE = 256
SCREEN = 20.0
POSTERIOR = 0.75
#: Words whose traits a scorer remembers (about 150 bytes each; results don't depend on it).
REMEMBERED = 100_000
EPOCHS = 300
RATE = 0.1
PENALTY = 1e-4

_WORD = re.compile(rb"[a-z\x80-\xff]+")


def fold(column):
    return F.pmod(F.crc32(column.cast("string").cast("binary")), F.lit(FOLDS))


def traits(word: bytes) -> list[int]:
    """Hashes of a word: itself and its beginnings of ``BEGINNINGS`` bytes."""
    import xxhash

    parts = [word, *(b"^" + word[:n] for n in BEGINNINGS if len(word) > n)]
    return [xxhash.xxh64_intdigest(p) % HASHES * LEVELS for p in parts]


def _levels(count: int, length: int) -> int:
    """How many features a trait has in a text: present; twice or four times and dense."""
    dense = count * SPARSE >= length
    return 1 + (dense and count >= 2) + (dense and count >= 4)


def features(text: bytes | None, traits_of=traits) -> set[int]:
    """Features of a text: each trait's levels."""
    counts: Counter[int] = Counter()
    words = Counter(_WORD.findall((text or b"").lower()))
    for word, n in words.items():
        for t in traits_of(word):
            counts[t] += n
    length = words.total()
    return {t + k for t, n in counts.items() for k in range(_levels(n, length))}


@dataclass(frozen=True)
class Model:
    """Weights of the words that entered, and the bias."""

    words: np.ndarray
    weights: np.ndarray
    bias: float


def _log_ratio(p: np.ndarray, n_p: int, u: np.ndarray, n_u: int) -> np.ndarray:
    """Log-likelihood ratio of two document frequencies."""

    def term(k, n):
        with np.errstate(divide="ignore", invalid="ignore"):
            q = k / n
            return np.nan_to_num(k * np.log(q)) + np.nan_to_num((n - k) * np.log1p(-q))

    return 2 * (term(p, n_p) + term(u, n_u) - term(p + u, n_p + n_u))


def _places(words: np.ndarray, found: np.ndarray) -> np.ndarray:
    """Where those of found that are in words (sorted, not empty) stand there, in the order of found."""
    at = np.minimum(np.searchsorted(words, found), len(words) - 1)
    return at[words[at] == found]


def fit(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float) -> Model:
    """Non-negative PU fit over lists of feature sets."""
    base = float(np.clip(prior, 1e-3, 0.49))
    none = Model(np.zeros(0, np.int64), np.zeros(0), float(np.log(base / (1 - base))))
    if not positive or not unlabelled:
        return none
    seen, n_seen = np.unique(np.concatenate(positive), return_counts=True)
    others = np.zeros(len(seen), np.int64)
    for d in unlabelled if len(seen) else ():
        others[_places(seen, d)] += 1
    ratio = _log_ratio(n_seen, len(positive), others, len(unlabelled))
    posterior = base * (n_seen / len(positive)) / np.maximum(others / len(unlabelled), 1e-12)
    words = seen[(ratio >= SCREEN) & (posterior >= POSTERIOR)].astype(np.int64)
    if not len(words):
        return none

    def matrix(docs):
        columns = [_places(words, d) for d in docs]
        return np.repeat(np.arange(len(docs)), list(map(len, columns))), np.concatenate(columns), len(docs)

    sets = matrix(positive), matrix(unlabelled)
    theta, m, v = np.zeros(len(words) + 1), np.zeros(len(words) + 1), np.zeros(len(words) + 1)
    theta[-1] = none.bias

    def sigmoid(z):
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))

    def margins(part):
        rows, columns, n = part
        return theta[-1] + np.bincount(rows, theta[columns], n)

    def pull(part, slope):
        """Gradient of the mean of a loss whose slopes by margin are given."""
        rows, columns, n = part
        return np.append(np.bincount(columns, slope[rows], len(words)), slope.sum()) / n

    for step in range(1, EPOCHS + 1):
        z_p, z_u = margins(sets[0]), margins(sets[1])
        s_p, s_u = sigmoid(z_p), sigmoid(z_u)
        negative = np.logaddexp(0, z_u).mean() - base * np.logaddexp(0, z_p).mean()
        toward = base * pull(sets[0], s_p - 1)
        away = pull(sets[1], s_u) - base * pull(sets[0], s_p)
        grad = toward + away if negative >= 0 else -away
        grad[:-1] += PENALTY * theta[:-1]
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        theta = theta - RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return Model(words, theta[:-1], float(theta[-1]))


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """Fit on the bounded sample of the training part.

    The sample is taken by a hash of the text and copies go in Spark, so it is bounded however often an id or a text repeats: a side with more
    texts than its bound after a first cut is cut again by the share that is too much.
    """
    marked = labels.where(fold(F.col("doc_id")) != 0).groupBy("doc_id").agg(F.max("toxic").alias("toxic")).where("toxic is not null")
    n, n_toxic = marked.agg(F.count("*"), F.coalesce(F.sum(F.when(F.col("toxic") == 1, 1)), F.lit(0))).first()
    training = docs.select("doc_id", "text").where(fold(F.col("doc_id")) != 0)
    n_docs = training.count()
    part = lambda most, count: F.pmod(F.xxhash64("text", F.lit("toxicity")), F.lit(1 << 20)) < int((1 << 20) * min(1.0, most / max(count, 1)))
    toxic = materialize(marked.where("toxic = 1").select("doc_id"), "toxic")
    toxic = F.broadcast(toxic) if n_toxic <= BROADCAST_IDS else toxic
    unlabelled = training.where(part(MAX_UNLABELLED, n_docs)).join(toxic, "doc_id", "left_anti").select("text", F.lit(False).alias("positive"))
    confirmed = training.join(toxic, "doc_id", "left_semi").where(part(MAX_POSITIVE, n_toxic)).select("text", F.lit(True).alias("positive"))
    texts = materialize(bounded_batches(unlabelled.unionByName(confirmed)).distinct(), "sample")
    counts = {r["positive"]: r["count"] for r in texts.groupBy("positive").count().collect()}
    again = F.pmod(F.xxhash64("text", F.lit("again")), F.lit(1 << 20))
    within = F.lit(False)
    for side, most in ((True, MAX_POSITIVE), (False, MAX_UNLABELLED)):
        share = int((1 << 20) * min(1.0, 1.25 * most / max(counts.get(side, 0), 1)))
        within = within | ((F.col("positive") == side) & (again < share))

    def run(batches):
        for batch in batches:
            found = [np.array(sorted(features(t)), "<i4").tobytes() for t in utf8(batch.column(0))]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(found, pa.binary())], names=["positive", "words"])
        release()

    rows = texts.where(within).select("text", "positive").mapInArrow(run, "positive boolean, words binary").toArrow()  # bounded by the two sizes
    found = sorted(set(zip(*(c.to_pylist() for c in rows.columns), strict=True)))
    del rows
    sets: dict[bool, list[np.ndarray]] = {True: [], False: []}
    for side, packed in found:
        sets[side].append(np.frombuffer(packed, "<i4"))
    model = fit(sets[True], sets[False], n_toxic / n if n else 0.1)
    del found, sets
    release()
    return model


def scorer(model: Model):
    """A function of texts (UTF-8) that gives their scores; it remembers the words it has met."""
    weights = dict(zip(model.words.tolist(), model.weights.tolist(), strict=True))
    carrying = {f - f % LEVELS for f in weights}
    memory: dict[bytes, tuple[int, ...]] = {}  # the traits of a word that carry weight

    def known(word):
        if word not in memory:
            if len(memory) >= REMEMBERED:
                memory.clear()
            memory[word] = tuple([t for t in traits(word) if t in carrying])
        return memory[word]

    def run(texts):
        z = np.array([model.bias + sum(weights.get(f, 0.0) for f in sorted(features(t, known))) for t in texts], float)
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))

    return run


def score(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns of ``keep`` with the score of each whole text."""

    def run(batches):
        of = scorer(model)
        for batch in batches:
            scores = of(utf8(batch.column(batch.num_columns - 1)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(scores, pa.float64())], names=[*keep, "score"])
        release()

    fields = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return bounded_batches(docs).select(*keep, docs["text"].alias("__text")).mapInArrow(run, f"{fields}, score double")


def without_toxic(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """The rows of docs, all columns, that score below the threshold."""

    def run(batches):
        of = scorer(model)
        for batch in batches:
            scores = of(utf8(batch.column(batch.schema.get_field_index("text"))))
            yield batch.filter(pa.array(scores < threshold))
        release()

    return bounded_batches(docs).mapInArrow(run, docs.schema)


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every row."""
    scored = score(docs, train(docs, labels))
    held = F.coalesce(fold(F.col("doc_id")) == 0, F.lit(True))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
