"""Near-copy classes and the pipeline's near_dedup stage against all pairs."""

import itertools
import random

import numpy as np
import pytest

import corpus_pipeline
from pitchloom.llm import copies


def shingle_set(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()}


def brute_classes(texts):
    """Numbers of the classes, by all pairs."""
    sets = [shingle_set(t) for t in texts]
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(range(len(sets)), 2):
        if sets[a] == sets[b] or 9 * len(sets[a] & sets[b]) >= 4 * (len(sets[a]) + len(sets[b])):
            parent[find(a)] = find(b)
    return [find(i) for i in range(len(sets))]


def edited(rng, words, k):
    words = list(words)
    for _ in range(k):
        words[rng.randrange(len(words))] = f"e{rng.randrange(10**6)}"
    return words


@pytest.fixture(scope="module")
def texts():
    """Edited copies around the limit of similarity, chains of them, a common line, short, empty and null texts."""
    rng = random.Random(5)
    line = [f"c{i}" for i in range(12)]
    out = []
    for _ in range(25):
        base = [f"w{rng.randrange(400)}" for _ in range(rng.randrange(6, 150))] + line
        out.append(base)
        for _ in range(4):
            base = edited(rng, base, rng.randrange(1, 4))
            out.append(base)
    return [" ".join(w) for w in out] + [None, "", " \n", "A b", "a B", "c", out[0][0], " ".join(out[1]).upper(), " ".join(line), " ".join(line)]


@pytest.mark.parametrize("sample", [1, 64])
def test_classes(spark, texts, monkeypatch, sample):
    monkeypatch.setattr(copies, "SAMPLE", sample)
    ids = [i if i % 7 else None for i in range(len(texts))]
    frame = spark.createDataFrame([(i, t, k) for k, (i, t) in enumerate(zip(ids, texts, strict=True))], "doc_id long, text string, k long")
    want = brute_classes(texts)
    least = {c: min((i for i, x in zip(ids, want, strict=True) if x == c and i is not None), default=None) for c in want}
    rows = {r.k: r for r in copies.classes(frame, ("k",)).collect()}
    assert len(rows) == len(texts)
    assert [rows[k].component_id for k in range(len(texts))] == [least[c] for c in want]
    assert len({(rows[k]["class"], c) for k, c in enumerate(want)}) == len({r["class"] for r in rows.values()}) == len(set(want))
    assert copies.classes(frame.limit(0), ("k",)).count() == 0


@pytest.mark.parametrize("m", [5, 60])
def test_unions_equal_all_pairs(m):
    """Links within a group unite what all pairs unite, by whole hashes; by cut ones at least that."""
    rng = np.random.default_rng(m)
    base = [np.unique(rng.integers(-(2**63), 2**63 - 1, 40)) for _ in range(4)]
    sets = []
    for k in range(m):
        x = base[k % 4].copy()
        x[rng.choice(len(x), rng.integers(0, 8), replace=False)] = rng.integers(-(2**63), 2**63 - 1)
        sets.append(np.unique(x))
    labels = np.arange(m)
    for a, b in itertools.combinations(range(m), 2):
        if 9 * len(np.intersect1d(sets[a], sets[b])) >= 4 * (len(sets[a]) + len(sets[b])):
            labels[labels == labels[a]] = labels[b]

    def classes(links):
        out = np.arange(m)
        for a, b in links:
            out[out == out[a]] = out[b]
        return out

    for cut in (sets, [(x >> 32).astype(np.int32) for x in sets]):
        links = copies.unions(cut, np.arange(m))
        got = classes(links)
        assert len(links) < m and all((got[a] == got[b]) == (labels[a] == labels[b]) for a, b in itertools.combinations(range(m), 2))
    tiny = [(x & 3).astype(np.int32) for x in sets]  # collisions everywhere: nothing is missed
    assert len(set(classes(copies.unions(tiny, np.arange(m))))) <= len(set(labels))


def test_stage_drops_edited_copies(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = {min(i for i, x in enumerate(brute_classes(texts)) if x == c) for c in set(brute_classes(texts))}
    got = corpus_pipeline.drop_near_duplicates(spark, docs, "")
    assert sorted(r.doc_id for r in got.collect()) == sorted(want)


def test_stage_keeps_one_row_of_each_class(spark):
    """Repeated ids in different classes, repeated rows, and classes without any id."""
    rows = [(5, "A", "x"), (5, "B", "x"), (7, "B", "x"), (5, "A", "w"), (None, "C", "z"), (None, "C", "y"), (None, "A", "x"), (None, None, "x"), (None, "", "x"), (8, "D", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = [tuple(r) for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()]
    lone = [r for r in got if not r[1]]
    assert len(lone) == 1
    assert sorted(r for r in got if r[1] and r[0]) == [(5, "A", "w"), (5, "B", "x"), (8, "D", "x")]
    assert [r for r in got if r[1] and r[0] is None] == [(None, "C", "y")]


def test_unions_of_a_full_block_take_little_memory():
    import tracemalloc

    rng = np.random.default_rng(1)
    base = rng.integers(-(2**31), 2**31, 1_000)
    sets = [np.where(rng.random(1_000) < 0.3, rng.integers(-(2**31), 2**31, 1_000), base).astype(np.int32) for _ in range(copies.MOST)]
    tracemalloc.start()
    try:
        copies.unions(sets, np.arange(copies.MOST))
        assert tracemalloc.get_traced_memory()[1] < 80 << 20
    finally:
        tracemalloc.stop()
    assert copies.unions([np.empty(0, np.int32)] * 9, np.zeros(9, int)) == []
