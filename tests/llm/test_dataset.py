"""Periodic runs, the Merkle manifest and shards against brute force, on small tables with nulls, empty and long texts, repeats and clashing columns."""

import hashlib
import random
import re
import zlib
from bisect import bisect_right
from collections import defaultdict

import pytest

from pitchloom.llm import merkle, runs, sharding

FRAME = "doc_id long, text string, lang string, source string, n_chars long, runs int, tree string, key int, leaf string, shard int, slot int, size int, top int"


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def crc(i):
    return None if i is None else zlib.crc32(str(i).encode())


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(17)
    out = []
    for i in range(260):
        text = " ".join(rng.choice("ab é ß cc").strip() or "d" for _ in range(rng.randrange(90)))
        out.append((i * 7, text, rng.choice(["en", "de", "én", "", None, "x"][:: 1 + i % 2]), rng.choice(["web", None, ""]), rng.choice([None, len(text)])))
    line = " ".join(f"w{k}" for k in range(6))
    out += [(5_000, None, None, None, None), (5_001, "", "one", "s", 0), (5_002, " \t\r\n\x0b\x0c", "en", "s", 6), (5_003, "one", "en", "s", 3), (5_004, f"{line} {line} {line} x {line}", "en", "s", 9)]
    out += [(6_000 + i, "same text " * 30, "en", "s", 1) for i in range(150)]
    long = " ".join(f"u{rng.randrange(400)}" for _ in range(1_500))
    out += [(9_000, long, "de", "s", 5), (9_001, f"{long} {long}", "de", "s", 5), (None, "of no id a a a a a a a a a a a a a", "en", "s", 1), (None, None, None, "s", 1)]
    out += [out[3], out[3]]
    rng.shuffle(out)
    return out


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "t", 2, "l", 3, 4, 5, 6) for r in rows], FRAME).repartition(5)


# --- runs


def brute_runs(w, least=12):
    seen = {}
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j - i >= q and j - i + q >= least:
                seen.setdefault((i, j - i + q), q)
            i = max(j, i + 1)
    return sorted([(s, n, q) for (s, n), q in seen.items()], key=lambda r: (r[0], r[2]))


def brute_run_row(i, text):
    w, h = re.findall(r"[^\x20\x09-\x0D]+", text or ""), crc(i)
    n = len(w)
    if h is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[k] if k < a else w[a + (k - a) % p] for k in range(n)]
    found = brute_runs(w)
    kept = [x for k, x in enumerate(w) if not any(s + q <= k < s + m for s, m, q in found)]
    top = min(found, key=lambda r: (-r[1], r[0], r[2]), default=None)
    best = (None, None, None, None) if top is None else (*top, top[1] * 1000 // top[2])
    return (i, len(found), *best, sha("".join(f"{s},{m},{q}\n" for s, m, q in found)), sha(" ".join(kept)))


def ordered(found):
    return sorted(found, key=repr)


def test_runs_equal_brute_force(spark, rows):
    got = runs.run_digest(frame(spark, rows)).collect()
    assert runs.run_digest(frame(spark, rows)).columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    want = [brute_run_row(r[0], r[1]) for r in rows]
    assert ordered(tuple(r) for r in got) == ordered(want)
    assert sum(r[1] > 0 for r in want) > 20 and sum(r[1] > 1 for r in want) > 5


@pytest.mark.parametrize("wide", [0, 1, 3, 12])
def test_refinement_equals_brute_force(wide):
    rng = random.Random(wide)
    for _ in range(400):
        texts = []
        for _ in range(rng.randrange(1, 5)):
            w = [rng.randrange(rng.choice([1, 2, 3, 50])) for _ in range(rng.randrange(90))]
            if w and rng.random() < 0.5:
                a = rng.randrange(len(w))
                p = 1 + (len(w) - a) // rng.randrange(3, 11)
                w = [x if i < a else w[a + (i - a) % p] for i, x in enumerate(w)]
            texts.append(w)
        least = rng.choice([2, 4, 12])
        assert runs.runs_of(texts, least, wide) == [brute_runs(w, least) for w in texts]


def test_real_outputs_of_runs(spark):
    line = "a b c d e f"
    row = runs.periodic_runs(spark.createDataFrame([(1, f"x {line} {line} y", 2)], "doc_id int, text string, runs int")).first()
    assert [tuple(r) for r in row["runs"]] == [(1, 12, 6)] and row["collapsed"] == f"x {line} y"
    assert runs.run_digest(frame(spark, [])).count() == 0


# --- manifest


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([sha("".join(out[-1][i : i + 2])) for i in range(0, len(out[-1]), 2)])
    return out


def way(tree, at):
    for nodes in tree[:-1]:
        yield at % 2, nodes[at ^ 1] if at ^ 1 < len(nodes) else None
        at //= 2


def brute_manifest(rows):
    def leaf(r, plus=0):
        fields = (r[0], r[3], r[2], None if r[4] is None else r[4] + plus, r[1])
        return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in fields))

    parts = defaultdict(list)
    for r in rows:
        parts[r[2]].append((r[0] is not None, r[0] or 0, leaf(r), r))
    names = sorted(parts, key=lambda p: (p is not None, (p or "").encode()))
    trees = {p: levels([m[2] for m in sorted(parts[p], key=lambda m: m[:3])]) for p in names}
    last = levels([trees[p][-1][0] for p in names])
    out = []
    for k, p in enumerate(names):
        for at, (*_, own, r) in enumerate(sorted(parts[p], key=lambda m: m[:3])):
            tried = r[0] is not None and crc(r[0]) % 7 == 0
            d, met = leaf(r, int(tried)), []
            for right, other in [*way(trees[p], at), *way(last, k)]:
                met += [other] if other else []
                d = sha((other + d if right else d + other) if other else d)
            root = last[-1][0]
            out.append((r[0], own, trees[p][-1][0], root, sha("".join(met)), d, d == root))
    return out


@pytest.mark.parametrize(("block", "top"), [(10, 1 << 14), (2, 8)])
def test_manifest_equals_brute_force(spark, rows, block, top):
    """Small blocks and a small top make the upper part of the trees distributed as well."""
    docs = frame(spark, rows)
    tried = merkle.F.crc32(docs["doc_id"].cast("string").cast("binary")) % 7 == 0
    got = merkle.manifest(docs, tried, block, top).collect()
    picked = [(r["doc_id"], r["leaf"], r["subroot"], r["root"], sha(r["siblings"]), r["folded_root"], r["verified"]) for r in got]
    assert ordered(picked) == ordered(brute_manifest(rows))
    assert any(not r["verified"] for r in got) and all(len(r["siblings"]) == 64 * (len(r["sides"]) - r["sides"].count("-")) for r in got)


def test_manifest_of_few_rows(spark, rows):
    assert merkle.manifest_digest(frame(spark, [])).count() == 0
    for part in (rows[:1], [r for r in rows if r[2] == "de"][:3]):
        got = merkle.manifest_digest(frame(spark, part)).collect()
        assert ordered(tuple(r) for r in got) == ordered(brute_manifest(part))


# --- shards


def test_shards_are_near_equal_and_gapless(spark, rows):
    got = sharding.shard_digest(frame(spark, rows)).collect()
    size = lambda t: len((t or "").encode()) + 16
    assert ordered((r["doc_id"], r["size"], r["text_crc32"], r["law"], r["grown_shard"]) for r in got) == ordered((r[0], size(r[1]), zlib.crc32((r[1] or "").encode()), "bytes", None) for r in rows)
    held = defaultdict(list)
    for r in got:
        held[r["shard"]].append(r)
    assert set(held) <= set(range(40))
    for members in held.values():
        assert sorted(r["slot"] for r in members) == list(range(len(members)))


@pytest.mark.parametrize("shards", [3, 8])
def test_splitters_equal_those_of_sorted_keys(spark, rows, shards):
    """Every splitter is the boundary of a key, no farther from its goal than a row or the tolerance, and groups of equal texts are divided only if they must be."""
    rows = [r for r in rows if len(r[1] or "") < 2_000] + [(20_000 + i, f"text number {i} " * (1 + i % 9), "en", "s", 1) for i in range(2_000)]
    docs = frame(spark, rows)
    keys = [((r["__a"] % 2**64 << 64) + r["__b"] % 2**64, r["__size"]) for r in sharding.keyed(docs).select("__a", "__b", "__size").collect()]
    keys.sort()
    total = sum(n for _, n in keys)
    slack, widest = 0.01 * total / shards, max(n for _, n in keys)
    cuts = sharding.splitters(sharding.keyed(docs), shards, 0.01)
    assert cuts == sorted(cuts)
    for s, cut in enumerate(cuts, 1):
        below = sum(n for k, n in keys if k < cut)
        assert abs(below - total * s / shards) <= max(slack, widest)
    found = sharding.sharded(docs, shards, tolerance=0.01).collect()
    want = defaultdict(list)
    for r in sharding.keyed(docs).select("doc_id", "text", "__a", "__b").collect():
        want[r["doc_id"], r["text"]].append(bisect_right(cuts, (r["__a"] % 2**64 << 64) + r["__b"] % 2**64))
    assert ordered((r["doc_id"], r["text"], r["shard"]) for r in found) == ordered((i, t, s) for (i, t), of in want.items() for s in of)
    places = defaultdict(set)
    for r in found:
        places[r["text"] or ""].add(r["shard"])
    divided = [t for t, p in places.items() if len(p) > 1]
    assert divided in ([], ["same text " * 30])


def test_written_shards(spark, rows, tmp_path):
    sharding.write(frame(spark, rows).drop("shard"), str(tmp_path / "out"), 4)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == len(rows) and {r["shard"] for r in back.select("shard").distinct().collect()} <= set(range(4))
    assert sharding.shard_digest(frame(spark, [])).count() == 0
    same = frame(spark, [(1, "same", "en", "s", 1)] * 7)
    assert sorted(r["slot"] for r in sharding.shard_digest(same).collect()) == list(range(7))
