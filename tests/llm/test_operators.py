"""Each training-data operator against a brute-force version on small tables with nulls, empty and long texts, ties, repeats and clashing columns."""

import collections
import datetime
import hashlib
import itertools

import math
import random
import re
import tracemalloc
import zlib

import numpy as np
import pandas as pd

import public_tokenizers
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from pitchloom.llm import bpe, chat, decontaminate, html, lm, pii, simhash, topk, toxicity, warc
from pitchloom.llm import queries as Q

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
FRAME = "doc_id long, text string, row long, w string, fp long, score double, n_words int, gram string"


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def documents(spark, rows):
    """Documents with extra columns whose names the operators might use."""
    return spark.createDataFrame([(i, t, 1, "w", 2, 0.5, 3, "g") for i, t in rows], FRAME)


def sentence(rng, n):
    return " ".join("".join(rng.choice("abcdeéß") for _ in range(rng.randrange(1, 6))) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    base = [sentence(rng, rng.randrange(1, 60)) for _ in range(30)]
    near = [b + " x" for b in base[:10]] + [b.upper() for b in base[:5]]
    odd = [None, "", "   \n", "A", "a b", "x" * 5000, sentence(rng, 3000)]
    rows = list(enumerate(base + near + odd + base[:4]))
    return [*rows, rows[0], (None, base[3]), (None, None)]


# --- decontamination


def brute_hits(rows, items, window=10):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    grams = collections.defaultdict(set)
    for i, t in items:
        w = word.findall((t or "").translate(LOWER))
        n = min(window, len(w))
        for k in range(len(w) - n + 1 if w else 0):
            grams[tuple(w[k : k + n])].add(i)
    out = []
    for i, t in rows:
        w, hit, found = word.findall((t or "").translate(LOWER)), set(), set()
        for n in {len(g) for g in grams}:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in grams:
                    hit.update(range(k, k + n))
                    found |= {str(x) for x in grams[tuple(w[k : k + n])] if x is not None}
        out.append((i, len(w), len(hit), len(found), sha(",".join(sorted(found))), bool(hit)))
    return out


def key(r):
    return tuple((x is not None, x) for x in r)


def same(got, want):
    assert sorted(map(tuple, got), key=key) == sorted(map(tuple, want), key=key)


@pytest.mark.parametrize("broadcast", [True, False])
def test_decontamination(spark, texts, monkeypatch, broadcast):
    if not broadcast:
        monkeypatch.setattr(decontaminate, "BROADCAST_WINDOWS", 0)
    items = [(1, texts[0][1]), (2, texts[7][1]), (2, texts[7][1]), (10, texts[1][1].upper()), (5, "a b"), (6, None), (7, "!!"), (None, texts[2][1])]
    bench = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, gram string")
    same(decontaminate.decontaminated(documents(spark, texts), bench).collect(), brute_hits(texts, items))


def test_decontamination_of_nothing(spark, texts):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.decontaminated(documents(spark, texts), none).where("contaminated").count() == 0
    assert decontaminate.decontaminated(documents(spark, []), none).count() == 0


def test_spans_are_removed(spark):
    docs = spark.createDataFrame([(1, "Keep This. one two three four five six seven eight nine ten End!"), (2, "clean,  text")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "one two three four five six seven eight nine ten")], "item_id long, text string")
    cut = decontaminate.without_spans(docs, decontaminate.hits(docs, bench))
    assert {r.doc_id: r.text for r in cut.collect()} == {1: "Keep This End", 2: "clean,  text"}


# --- BPE


@pytest.fixture(scope="module")
def coder():
    return bpe.Bpe(public_tokenizers.path(bpe.VOCABULARY))


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path(bpe.VOCABULARY))


def check_coding(coder, library, texts):
    for text, (ids, n, decoded) in zip(texts, coder.encode_batch(texts), strict=True):
        want = library.encode(text or "", add_special_tokens=False).ids
        assert ids == " ".join(map(str, want)) and n == len(want)
        assert decoded == library.decode(want, skip_special_tokens=False)


def test_bpe_equals_library_on_odd_texts(coder, library):
    odd = [None, "", " ", "Hello World's don't we'll<|endoftext|> x <|startoftext|>A", "<|ENDOFTEXT|>", "a</w>b </w>", "\x1c a\x1db\x85c", "ΑΣΑΣ ς İı ǅ", "é́ Å K", "日本語 123 ½", "👩‍👩‍👧 !!!...", "a" * 300, "ab" * 200, "zero​width", "x\x00y"]
    check_coding(coder, library, odd)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(max_size=40), max_size=4))
def test_bpe_equals_library(coder, library, texts):
    check_coding(coder, library, [t.encode("utf-8", "ignore").decode() for t in texts])


def test_bpe_memory_does_not_change_results(coder, library, monkeypatch):
    monkeypatch.setattr(bpe, "MEMORY_BYTES", 1_000)
    monkeypatch.setattr(bpe, "PAIRS", 3)
    coder.forget()
    for texts in (["the quick brown fox jumps", "over the lazy dog again", "the dog"], ["the quick dog's don't", "again"], ["the lazy fox"]):
        check_coding(coder, library, texts)
    assert len(coder.chunks.young) + len(coder.chunks.old) <= 12


def test_bpe_computes_only_the_prefixes_that_are_asked_for(coder, library, monkeypatch):
    asked, last, letters = [], coder._last, []
    monkeypatch.setattr(coder, "_last", lambda word, end, *rest: asked.append((word, end)) or last(word, end, *rest))
    lettered = coder._lettered
    monkeypatch.setattr(coder, "_lettered", lambda word: letters.append(word) or lettered(word))
    coder.forget()
    assert coder.encode_words(["the"]) == {"the": [coder.final["the"]]} and not asked  # a token of its own rests on no prefix
    words = [*("thequx" * k + "zq" for k in (1, 2, 5)), "w" * 3_000, "ab" * 2_000 + "é", *(f"{a}{b}" for a in ("un", "pre", "x7") for b in ("happiness", "happinesses", "likely!", "zzkq"))]
    for word in words:
        asked.clear()
        assert coder.encode(word)[0] == " ".join(map(str, library.encode(word, add_special_tokens=False).ids))
        assert len(asked) < max(len(word), 2)
    coder.forget()
    letters.clear()
    coder.encode("well, (indeed) it's 3.5%; no?")
    assert not letters  # printable ASCII stands for itself


def test_bpe_looks_up_only_lengths_that_tokens_have_and_cuts_words_once(coder, library, monkeypatch):
    for ends, tokens in ((coder.ends_inner, coder.inner), (coder.ends_final, coder.final)):
        for word in ("thequx", "zq", "q", "x7happinesses", "\u0101\u0102", "the", "a</w>"):
            assert coder._lengths(ends, word, len(word))[0] <= max(map(len, tokens))
            assert {n for n in range(1, len(word) + 1) if word[-n:] in tokens} <= set(coder._lengths(ends, word, len(word)))
    coder.forget()
    encoded, whole = [], coder.encode_words
    monkeypatch.setattr(coder, "encode_words", lambda words: encoded.extend(words) or whole(words))
    texts = ["gronkel", "gronkel, (gronkel) gronkel's", "日本語 日本語。 gronkel!"]
    for text in texts:
        check_coding(coder, library, [text])
    assert encoded.count("gronkel") == 1 and encoded.count(coder._lettered("日本語")) == 1  # a word of a chunk is what the same chunk is
    assert all(isinstance(i, int) for entry in coder.chunks.young.values() for i in entry)


def test_bpe_leaves_no_coder_in_a_worker(spark):
    docs = documents(spark, [(i, f"some text {i}") for i in range(8)])
    assert bpe.encode_decode(docs, public_tokenizers.path(bpe.VOCABULARY)).count() == 8

    def living(batches):
        import gc

        import pyarrow as pa

        for _ in batches:
            yield pa.RecordBatch.from_arrays([pa.array([sum(type(x).__name__ == "Bpe" for x in gc.get_objects())], pa.int64())], names=["n"])

    assert not any(r.n for r in docs.select("doc_id").mapInArrow(living, "n long").collect())


def test_bpe_groups_cover_all_texts_in_order(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(bpe, "TEXT_BYTES", 5)
    assert list(bpe.groups(pa.array(["ab", None, "abc", "a" * 9, "", "b"]))) == [(0, 3), (3, 1), (4, 2)]
    assert list(bpe.groups(pa.array([], pa.string()))) == []


def test_bpe_compatibility_equals_replay(coder):
    rng = random.Random(1)
    inner, every = list(coder.inner.values()), list(coder.vocab.values())
    for _ in range(3000):
        a, b = rng.choice(inner), rng.choice(every)
        left, right = coder.text_of[a], coder.text_of[b]
        assert coder._compatible(a, b) == (coder._replay(coder._symbols(left) + coder._symbols(right)) == [left, right])


def test_bpe_query(spark, texts, library):
    got = bpe.encode_decode(documents(spark, texts), public_tokenizers.path(bpe.VOCABULARY)).collect()
    want = [library.encode(t or "", add_special_tokens=False).ids for _, t in texts]
    same([(r.doc_id, r.n_tokens, r.ids_sha256) for r in got], [(i, len(w), sha(" ".join(map(str, w)))) for (i, _), w in zip(texts, want, strict=True)])


# --- SimHash


def brute_simhash(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    grams = [" ".join(w[k : k + 3]) for k in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
    counts = [0] * 64
    for g in grams:
        h = xxhash.xxh64_intdigest(g.encode(), 42)
        counts = [c + (h >> b & 1) for b, c in enumerate(counts)]
    return sum(1 << b for b in range(64) if 2 * counts[b] > len(grams))


def components(prints, ids):
    """Smallest id reachable from each place."""
    parent = list(range(len(prints)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(range(len(prints)), 2):
        if (prints[a] ^ prints[b]).bit_count() <= 2:
            parent[find(a)] = find(b)
    least = {}
    for i, x in enumerate(ids):
        r = find(i)
        if x is not None:
            least[r] = min(x, least.get(r, x))
    return [least.get(find(i)) for i in range(len(prints))]


def test_simhash(spark, texts):
    prints = [brute_simhash(t) for _, t in texts]
    ids = [i for i, _ in texts]
    want = [(i, f"{p:016x}", c) for i, p, c in zip(ids, prints, components(prints, ids), strict=True)]
    same(simhash.near_duplicates(documents(spark, texts)).collect(), want)
    assert simhash.near_duplicates(documents(spark, [])).count() == 0


def test_covering_masks_miss_no_pair():
    masks = simhash.covering_masks()
    assert len(masks) == 7
    for a, b in itertools.combinations_with_replacement(range(64), 2):
        assert any(not m & ((1 << a) | (1 << b)) for m in masks)


def test_links_of_chains_and_crowds(spark):
    rng = random.Random(9)
    prints = [rng.getrandbits(64)]
    for _ in range(60):  # a chain of small steps, then a crowd around one point, then strangers
        prints.append(prints[-1] ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)))
    prints += [prints[0] ^ (1 << a) ^ (1 << b) for a in range(0, 40, 2) for b in (1, 41, 63)] + [rng.getrandbits(64) for _ in range(60)]
    prints = sorted(set(prints))
    frame = spark.createDataFrame([(simhash._signed(p),) for p in prints], "fp long")
    root = {r.node: r.root for r in simhash.connected(simhash.links(frame)).collect()}
    got = [root.get(simhash._signed(p), simhash._signed(p)) for p in prints]
    want = components(prints, [simhash._signed(p) for p in prints])
    assert got == want


# --- WARC


def pages(spark):
    x = "<p>" + "y" * 200
    rows = [(5, None, x), (3, "http://a\r\nb", x), (9, "c", x), (9, "c", x), (1, "d", None), (2, "e", ""), (None, "f", x), (7, "g", "short"), (8, "g", "short"), (4, "h", "é" * 100)]
    return rows, spark.createDataFrame([(*r, "z") for r in rows], "page_id long, url string, html string, digest string")


@pytest.mark.parametrize("broadcast", [True, False])
def test_warc_round_trip(spark, tmp_path, monkeypatch, broadcast):
    if not broadcast:
        monkeypatch.setattr(warc, "BROADCAST_PAYLOADS", 0)
    rows, df = pages(spark)
    same_payload = collections.defaultdict(list)
    for i, _, h in rows:
        if i is not None and len((h or "").encode()) >= 100:
            same_payload[h].append(i)
    want = []
    for i, _, h in rows:
        first = min(same_payload[h]) if h in same_payload else None
        refers = first if i is not None and first is not None and first != i else None
        want.append((i, len((h or "").encode()), sha(h or ""), "revisit" if refers is not None else "response", refers))
    same(warc.archived(df, f"file://{tmp_path}/a").collect(), want)
    assert warc.archived(df.limit(0), f"file://{tmp_path}/b").count() == 0


def test_warc_ids_of_any_text(spark, tmp_path):
    ids = ["a\r\nb", "", None, "a b%20>", "<urn:x-page:é>", "ü"]
    df = spark.createDataFrame([(i, "u", "z" * 200) for i in ids], "page_id string, url string, html string")
    got = {r.page_id: (r.record_type, r.refers_to) for r in warc.archived(df, f"file://{tmp_path}/a").collect()}
    assert got == {i: ("revisit", "") if i else ("response", None) for i in ids}
    days = spark.sql("select date'2020-01-02' as page_id, 'u' as url, 'x' as html")
    assert warc.archived(days, f"file://{tmp_path}/b").first().page_id == datetime.date(2020, 1, 2)


def test_warc_tells_what_does_not_read_back(spark, tmp_path, monkeypatch):
    df = spark.createDataFrame([(i, "u", f"{i}" * 300) for i in range(4)], "page_id long, url string, html string")
    written = warc.write

    def damaged(pages, folder):
        files = written(pages, folder)
        path = files.first().file.removeprefix("file://")
        with open(path, "r+b") as f:
            f.seek(30)
            f.write(b"\0" * 8)
        return files

    monkeypatch.setattr(warc, "write", damaged)
    with pytest.raises(Exception, match="do not read back"):
        warc.archived(df, f"file://{tmp_path}/a").count()
    monkeypatch.setattr(warc, "RECORD_BYTES", 100)
    with pytest.raises(ValueError, match="readable"):
        warc.record(1, "u", b"x" * 100, "d")


def salvaged(data):
    import io

    return [(at, n, f) for at, n, _, f in warc.salvage(io.BytesIO(data), len(data))]


@pytest.mark.parametrize("zipped", [True, False])
def test_salvage_recovers_later_records_and_logs_gaps(zipped):
    records = [warc.record(i, f"http://x/{i}", f"page {i} ".encode() * 40, hashlib.sha256(f"page {i} ".encode() * 40).hexdigest()) for i in range(20)]
    if zipped:
        import gzip

        records = [gzip.compress(r) for r in records]
    starts = list(itertools.accumulate([0, *map(len, records)]))
    data = bytearray(b"".join(records))
    data[starts[4] - 30] ^= 0xFF  # a flipped byte of the payload
    data[starts[7] : starts[7] + 4] = b"\0\0\0\0"  # a lost start
    broken = bytes(data[: starts[19] + 30])  # a lost end
    found = salvaged(broken)
    kept = [f["page_id"] for _, _, f in found if isinstance(f, dict)]
    assert kept == [str(i) for i in range(19) if i not in (3, 7)]
    gaps = [(a, n) for a, n, f in found if isinstance(f, str)]
    assert gaps == [(starts[3], len(records[3])), (starts[7], len(records[7])), (starts[19], 30)]
    assert sum(n for _, n, _ in found) == len(broken)
    assert not salvaged(b"") and len(salvaged(b"no archive at all")) == 1


def other_record(kind, block, **fields):
    lines = ["WARC/1.0", f"WARC-Type: {kind}", "WARC-Record-ID: <urn:uuid:1>", *(f"{k.replace('_', '-')}: {v}" for k, v in fields.items()), f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


@pytest.mark.parametrize("zipped", ["one", "each", "no"])
def test_records_of_other_writers(zipped):
    import base64
    import gzip

    body = b"HTTP/1.1 200 OK\r\n\r\nhello"
    sha1 = lambda x: "sha1:" + base64.b32encode(hashlib.sha1(x).digest()).decode()
    records = [
        other_record("warcinfo", b"software: x\r\n", Content_Type="application/warc-fields"),
        other_record("request", b"GET / HTTP/1.1\r\n\r\n", Content_Type="application/http; msgtype=request"),
        other_record("response", body, Content_Type="application/http", WARC_Payload_Digest=sha1(b"hello"), WARC_Block_Digest=sha1(body)),
        other_record("response", body, Content_Type="application/http", WARC_Payload_Digest=sha1(b"hallo")),
        other_record("metadata", b"a: b"),
    ]
    data = {"no": b"".join(records), "one": gzip.compress(b"".join(records)), "each": b"".join(map(gzip.compress, records))}[zipped]
    found = salvaged(data)
    assert [f["record_type"] for _, _, f in found if isinstance(f, dict)] == ["warcinfo", "request", "response", "metadata"]
    assert [f["payload"] for _, _, f in found if isinstance(f, dict)][2] == b"hello"
    assert [f for _, _, f in found if isinstance(f, str)] == ["digest differs"]


def test_records_before_the_damage_of_a_member_stay():
    import gzip

    records = [warc.record(i, "u", bytes([65 + i]) * 300_000, hashlib.sha256(bytes([65 + i]) * 300_000).hexdigest()) for i in range(3)]
    data = bytearray(gzip.compress(b"".join(records)) + gzip.compress(records[0]))
    data[len(gzip.compress(records[0])) + 200] ^= 0xFF
    found = salvaged(bytes(data))
    kept = [f["page_id"] for _, _, f in found if isinstance(f, dict)]
    assert kept[0] == "0" and kept[-1] == "0" and len(kept) >= 2 and any(isinstance(f, str) for _, _, f in found)


def test_reading_damaged_files_in_spark(spark, tmp_path):
    _, df = pages(spark)
    files = warc.write(df, f"file://{tmp_path}/c")
    path = files.orderBy("file").first()["file"].removeprefix("file://")
    data = open(path, "rb").read()
    open(path, "wb").write(b"garbage" + data)
    out = warc.read(spark, files)
    assert out.where("fault is not null").select("offset", "length").first() == (0, 7)
    assert out.where("fault is null").count() == 10
    whole = bytearray(data)
    whole[len(data) // 2] ^= 0xFF  # a flipped byte in a compressed member costs that record alone
    open(path, "wb").write(bytes(whole))
    assert warc.read(spark, files).where("fault is not null").count() == 1 and warc.read(spark, files).where("fault is null").count() == 9


# --- toxicity


def toxic_corpus(seed=2, n=900):
    rng = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        bad = rng.random() < 0.12
        words = sentence(rng, rng.randrange(5, 80)).split()
        if bad:
            for _ in range(rng.randrange(2, 5)):
                words.insert(rng.randrange(len(words)), rng.choice(["Vileword", "scumlord,", "nastything"]))
        rows.append((i, " ".join(words)))
        if rng.random() < 0.6:
            labels.append((i, 1, int(bad)))
    return rows, labels


def test_toxicity_on_held_out_rows(spark):
    rows, labels = toxic_corpus()
    marked = spark.createDataFrame([*labels, labels[0], (10**6, 1, None)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in toxicity.toxicity(documents(spark, rows), marked).collect()}
    assert len(got) == len(rows)
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for i, r in got.items())
    held = [(y, got[i].predicted) for i, _, y in labels if got[i].held_out]
    assert sum(y == p for y, p in held) / len(held) > 0.97


def test_sample_is_bounded_when_ids_repeat(spark, monkeypatch):
    """One confirmed id with many rows and texts: the sample stays near its bounds."""
    monkeypatch.setattr(toxicity, "MAX_POSITIVE", 40)
    monkeypatch.setattr(toxicity, "MAX_UNLABELLED", 60)
    sizes = []
    monkeypatch.setattr(toxicity, "fit", lambda p, u, prior: sizes.append((len(p), len(u))))
    ids = [i for i in range(40) if zlib.crc32(str(i).encode()) % 5]
    name = lambda i: "".join(chr(97 + int(c)) for c in str(i))
    rows = [(ids[0], f"bad {name(i)}") for i in range(1500)] + [(ids[0], "same")] * 500 + [(ids[1 + i % 20], f"fine {name(i)}") for i in range(1500)]
    toxicity.train(documents(spark, rows), spark.createDataFrame([(ids[0], 1, 1)], "doc_id long, quality int, toxic int"))
    assert 20 <= sizes[0][0] <= 80 and 10 <= sizes[0][1] <= 120


def test_toxicity_of_odd_rows(spark, texts):
    nothing = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert toxicity.toxicity(documents(spark, texts), nothing).where("predicted = 0").count() == len(texts)
    assert toxicity.toxicity(documents(spark, []), nothing).count() == 0


def test_labels_of_held_out_rows_change_nothing(spark):
    rows, labels = toxic_corpus(n=300)
    flipped = [(i, q, 1 - t if zlib.crc32(str(i).encode()) % 5 == 0 else t) for i, q, t in labels]
    a, b = (toxicity.train(documents(spark, rows), spark.createDataFrame(x, "doc_id long, quality int, toxic int")) for x in (labels, flipped))
    assert np.array_equal(a.words, b.words) and np.array_equal(a.weights, b.weights) and a.bias == b.bias


# --- top-k


def test_top_k(spark, monkeypatch):
    rng = np.random.default_rng(4)
    rows = [(i, rng.integers(-2, 3, 6).astype(float).tolist()) for i in range(0, 400, 2)] + [(i, [0.5] * 6) for i in range(1001, 1009)]
    rows += [(3000, [2.0**24] * 6), (3001, [-(2.0**20), 0.0, 0.0, 0.0, 0.0, 2.0**21 + 0.125])]
    rows += [(2000, None), (2050, [1.0, None]), (2100, [float("nan")] * 6), (2150, [float("inf")] * 6), (2200, [1.0, 2.0]), (2250, []), (None, [1.0] * 6), (50, [0.25] * 6)]
    monkeypatch.setattr(topk, "CANDIDATE_BLOCK", 37)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 3)
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<double>, score int, rank int")
    good = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    want = []
    for i, q in good:
        if i % 50 == 0:
            found = sorted((-sum(a * b for a, b in zip(q, v, strict=False)), j) for j, v in good if j != i)[:5]
            want += [(i, r, j, -s) for r, (s, j) in enumerate(found, 1)]
    same(topk.top_k(df).collect(), want)
    assert topk.top_k(df.limit(0)).count() == 0
    exact = topk.scan(pd.DataFrame({"vec_id": [0], "row": [0], "v": [[2.0**31, 1.0, -(2.0**31)]]}), pd.DataFrame({"vec_id": [1, 2], "v": [[2.0**31, 1.0, 2.0**31], [2.0**31 - 256, 0.0, 0.0]]}), 5)
    assert exact.values.tolist() == [[0, 0, 2, 2**62 - 256 * 2**31], [0, 0, 1, 1]]
    with pytest.raises(OverflowError):
        topk.scan(pd.DataFrame({"vec_id": [0], "row": [0], "v": [[2.0**40]]}), pd.DataFrame({"vec_id": [1], "v": [[2.0**40]]}), 5)


# --- chat


def brute_repair(roles):
    """Least cost, from the definition alone: a legal sequence of roles in which each turn keeps its place, is relabelled (3), merged
    into the turn before (1), and empty turns (2 each) fill the gaps. By all ways to write the sequence, one role at a time."""
    legal_next = {"": "su", "s": "u", "u": "a", "a": "u"}
    cheapest = {("", 0): 0}  # (last role written, turns used) to cost
    queue = [(0, "", 0)]
    while queue:
        queue.sort()
        cost, last, used = queue.pop(0)
        if cost > cheapest[last, used]:
            continue
        if used == len(roles) and last == "a":
            return cost
        steps = [(2, r, used) for r in legal_next[last]]
        if used < len(roles):
            steps += [(0 if roles[used] == r else 3, r, used + 1) for r in legal_next[last]]
            steps += [(1 + (0 if roles[used] == last else 3), last, used + 1)] if last else []
        for c, r, n in steps:
            if cost + c < cheapest.get((r, n), 1 << 60):
                cheapest[r, n] = cost + c
                queue.append((cost + c, r, n))


def legal(roles):
    return re.fullmatch(r"s?(ua)+", "".join(r[0] for r in roles)) is not None


def shown_roles(rows):
    out = []
    for r in rows:
        out += [x for x in r.inserted.split(",") if x]
        if not r.merged:
            out.append(r.new_role)
        out += [x for x in r.appended.split(",") if x]
    return out


@pytest.mark.parametrize("part", [5_000, 7])
def test_chat_repair(spark, monkeypatch, part):
    monkeypatch.setattr(chat, "PART", part)
    rng = random.Random(8)
    names = ["user", "assistant", "system", "Human", " bot ", "tool", None]
    rows = [(c, t, rng.choice(names), f"t{c}.{t}") for c in range(12) for t in range(rng.randrange(1, 9))]
    rows += [(99, t, rng.choice(names), None) for t in range(60)] + [(None, None, "user", "a"), (None, 1, "assistant", "b"), (5, 3, "user", "again")]
    df = spark.createDataFrame([(*r, 0) for r in rows], "conv_id long, turn long, role string, text string, part int")
    got = chat.repaired(df).collect()
    assert len(got) == len(rows)
    by = collections.defaultdict(list)
    for r in got:
        by[r.conv_id].append(r)
    for conv, turns in by.items():
        turns.sort(key=lambda r: (r.turn is not None, r.turn or 0, r.role, re.search(r"t[\d.]+|again|$", r.rendered)[0]))
        assert legal(shown_roles(turns)), conv
        if conv == 99:
            turns = sorted(turns, key=lambda r: r.turn)
        kind = {"user": "u", "human": "u", "assistant": "a", "bot": "a", "system": "s"}
        assert sum(r.cost for r in turns) == brute_repair([kind.get(r.role.strip().lower(), "") for r in turns])


def test_chat_keeps_large_ids_beside_nulls(spark):
    big = 2**53 + 1
    df = spark.createDataFrame([(big, big, "user", "a"), (big, None, "user", "b"), (None, big, "user", "c"), (0, 0, "user", "d")], "conv_id long, turn long, role string, text string")
    assert {(r.conv_id, r.turn) for r in chat.repaired(df).collect()} == {(big, big), (big, None), (None, big), (0, 0)}


def test_chat_cuts_change_nothing(spark, monkeypatch):
    rng = random.Random(1)
    rows = [(1, t, rng.choice(["user", "assistant", "system", "x"]), f"t{t}") for t in range(80)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    whole = sorted(map(tuple, chat.repaired(df).collect()))
    monkeypatch.setattr(chat, "PART", 9)
    assert sorted(map(tuple, chat.repaired(df).collect())) == whole
    assert chat.repaired(df.limit(0)).count() == 0


# --- language model


def brute_base(rows):
    token = lambda t: [*re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER)), " "]
    held = lambda i: i is None or zlib.crc32(str(i).encode()) % 7 == 2
    c = collections.Counter(w for i, t in rows if not held(i) for w in token(t))
    total = sum(c.values())
    return [(i, held(i), len(token(t)), sum(w in c for w in token(t)), total, round(sum(math.log10((c[w] + 1) / (total + len(c) + 1)) for w in token(t)), 6)) for i, t in rows]


@pytest.mark.parametrize("shard", [160 << 20, 400])
def test_lm_base_and_shards(spark, texts, monkeypatch, shard):
    monkeypatch.setattr(lm, "SHARD_BYTES", shard)
    got = lm.lm_scores(documents(spark, texts)).collect()
    same([(r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got], brute_base(texts))
    assert all(math.isfinite(r.score) and r.score < 0 for r in got)
    assert lm.lm_scores(documents(spark, [])).count() == 0


def test_log_frequency_filter():
    rng = np.random.default_rng(0)
    keys = lm.mix(np.arange(20_000, dtype=np.uint64))
    counts = np.minimum(rng.geometric(0.4, 20_000) ** 3, 5000)
    data = lm.build_filter(keys, counts)
    sizes, starts, zero = np.array([len(data) * 8]), np.array([0]), np.zeros(20_000, np.int64)
    found = lm.look_up(keys, zero, data, starts, sizes)
    levels = np.frexp(counts.astype(float))[1]
    assert (found >= (2.0 ** (levels - 1) + 2.0**levels - 1) / 2).all()  # never below the true level
    assert (found == (2.0 ** (levels - 1) + 2.0**levels - 1) / 2).mean() > 0.95
    assert (lm.look_up(lm.mix(keys + np.uint64(1 << 40)), zero, data, starts, sizes) > 0).mean() < 0.05


def test_lm_scores_equal_the_formula(spark, texts, monkeypatch):
    """With a filter so wide that it never errs, every score is that of the formula over exact counts, however many buckets there are."""
    monkeypatch.setattr(lm, "BUCKET_BYTES", 16)
    token = lambda t: [*re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER)), "</s>"]
    train = [token(t) for i, t in texts if i is not None and zlib.crc32(str(i).encode()) % 7 != 2]
    word = collections.Counter(w for t in train for w in t)
    pair = collections.Counter(p for t in train for p in zip(["<s>", *t], t, strict=False))
    total, distinct = sum(word.values()), len(word)
    history = word | collections.Counter({"<s>": len(train)})
    mass = lambda c: max(lm.LEAST_MASS, c**lm.POWER)
    mean = lambda c: 0 if not c else (2 ** (math.frexp(c)[1] - 1) + 2 ** math.frexp(c)[1] - 1) / 2
    want = [(i, round(sum(math.log10((mean(pair[a, b]) + mass(history[a]) * (word[b] + 1) / (total + distinct + 1)) / (history[a] + mass(history[a]))) for a, b in zip(["<s>", *token(t)], token(t), strict=False)), 6)) for i, t in texts]
    same([(r.doc_id, round(r.score, 6)) for r in lm.lm_scores(documents(spark, texts), bits=512).collect()], want)


def test_mass_of_words_beyond_the_frequent_ones(spark):
    """The table of frequent words holds whole counts only; the others count as half the least one, in one shard or several."""
    rows = [(i, " ".join(f"w{k}" for k in range(1 + i % 7))) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = lm.counted(docs)
    table = lm.frequent(model, 3)
    counts = sorted(collections.Counter(w for _, t in rows for w in [*t.split(), " "]).values())
    assert sorted(table["often"].tolist()) == [c for c in counts if c > counts[-4]] and table["rest"] == counts[-4] / 2
    few, many = lm.lm_scores(docs, most=3).collect(), lm.lm_scores(docs).collect()
    assert [r.base_score for r in few] == [r.base_score for r in many] and few != many


def test_lm_score_equals_the_formula_with_exact_counts(spark):
    rows = [(i, f"the cat sat on the mat {i % 3}") for i in range(40)]
    r = {x.doc_id: x for x in lm.lm_scores(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    train = [t.split() for i, t in rows if zlib.crc32(str(i).encode()) % 7 != 2]
    word = collections.Counter(w for t in train for w in [*t, "</s>"])
    pair = collections.Counter(p for t in train for p in zip(["<s>", *t], [*t, "</s>"], strict=True))
    word["<s>"] = len(train)
    total, distinct = sum(word.values()) - len(train), len(word) - 1

    def level_mean(c):
        return 0 if not c else (2 ** (math.frexp(c)[1] - 1) + 2 ** math.frexp(c)[1] - 1) / 2

    text = rows[0][1].split()
    mass = lambda c: max(lm.LEAST_MASS, c**lm.POWER)
    want = sum(math.log10((level_mean(pair[a, b]) + mass(word[a]) * (word[b] + 1) / (total + distinct + 1)) / (word[a] + mass(word[a]))) for a, b in zip(["<s>", *text], [*text, "</s>"], strict=True))
    assert r[0].score == pytest.approx(want, abs=0.2)


# --- HTML


PAGE = """<!DOCTYPE html><html><head><title>T</title><script>var a="<p>no</p>";</script></head><body><header>Top</header><nav><ul><li><a href=x>Menu {n}</a></ul></nav>
<div class="ad">Buy {n}</div>{body}<div id=comments><p>Nice!</div><footer>&copy; x</footer></body></html>"""


@pytest.mark.parametrize(
    ("source", "want"),
    [
        (None, ""),
        ("", ""),
        ("plain &amp; simple", "plain & simple"),
        ("<article><h1>A&nbsp;&lt;b</h1><p><b>One\n two<br>three<p>Four<!-- <p>x --></article>tail", "A <b\nOne two three\nFour"),
        ("<main><p>In</p><form><input>Out</form></main><p>Out</p>", "In"),
        ("<p>a<p>b<div>c</div>d", "a\nb\nc\nd"),
        ("<ul><li>a<ul><li>b</ul><li>c</ul>", "a\nb\nc"),
        ("<article><p class='share-bar'>Share</p><p>Text</article>", "Text"),
        ("<p>1 < 2 and 3 > 2</p><p title='a>b'>ok", "1 < 2 and 3 > 2\nok"),
        ('<body class="no-sidebar single-post"><p data-id="ad">Text', "Text"),
        ('<article class="post comments-open">In</article>', "In"),
        ('<div id="search-results-explained">Text</div><div class="comments">No</div>', "Text"),
        ("<div>" * 3000 + "deep", "deep"),
        ("<article>never closed <p>x", "never closed\nx"),
    ],
)
def test_html_text(source, want):
    assert html.main_text(html.tree(source)) == want


def test_wrapper_leaves_varying_slots(spark):
    rows = [(i, f"https://host.example/{i}", PAGE.format(n=i, body=f"<div><p>Fixed notice of the house</p><p>Story number {i}</p><p>More {i * i}</p></div>")) for i in range(20)]
    rows += [(100, "http://other.example/", PAGE.format(n=1, body="<article><p>Fixed notice of the house</article>")), (None, None, None), (0, rows[0][1], rows[0][2])]
    df = spark.createDataFrame([(*r, "h") for r in rows], "page_id long, url string, html string, host string")
    got = {(r.page_id, r.url): (r.text, r.n_chars) for r in html.extract(df).collect()}
    assert got[7, "https://host.example/7"] == ("Story number 7\nMore 49", 22)
    assert got[100, "http://other.example/"][0] == "Fixed notice of the house"
    assert got[None, None] == ("", 0)
    assert html.extract(df).count() == len(rows) and html.extract(df.limit(0)).count() == 0


def brute_match(a, b):
    """Size of the largest match, by all order-preserving choices of children."""
    if a.label != b.label:
        return 0

    def children(x, y):
        if not x or not y:
            return 0
        return max(children(x[1:], y), children(x, y[1:]), (brute_match(x[0], y[0]) or -99) + children(x[1:], y[1:]))

    return 1 + children(a.children, b.children)


@pytest.mark.parametrize("cells", [1 << 20, 4])
def test_matching_equals_brute_force(monkeypatch, cells):
    monkeypatch.setattr(html, "CELLS", cells)
    rng = random.Random(4)

    def page(depth):
        return "".join(f"<{t}>{page(depth - 1) if depth else rng.choice('xyz')}</{t}>" for t in rng.choices(("div", "b", "i"), k=rng.randrange(0, 5)))

    for _ in range(150):
        a, b = html.tree(page(2)), html.tree(page(2))
        pairs = html.matched(a, b)
        assert len(pairs) == brute_match(a, b)
        assert all(x.label == y.label and (x.parent is None or (x.parent, y.parent) in pairs) for x, y in pairs)


def test_deep_and_wide_pages_are_matched():
    deep = html.tree("<div>" * 3000 + "x")
    assert len(html.matched(deep, html.tree("<div>" * 2990 + "x"))) == 2991
    wide = [html.tree("".join(f"<p>{i}</p>" for i in range(n))) for n in (2000, 1990)]
    assert len(html.matched(*wide)) == 1991


def test_template_decides_without_tags_under_any_partitioning(spark):
    page = "<div><div>House of stories {end}</div><div><p>Story {n} of today</p><p>More on {m}</p></div><div>All rights kept</div></div>"
    rows = [(i, "http://plain.example/" + str(i), page.format(n=i, m=i * 7, end="" if i % 10 else "!")) for i in range(40)]
    rows += [(100 + i, "http://plain.example/c", rows[3][2]) for i in range(200)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    found = [{(r.page_id, r.text) for r in html.extract(df.repartition(n)).collect()} for n in (1, 3, 17)]
    assert found[0] == found[1] == found[2]
    texts = dict(found[0])
    assert texts[7] == "Story 7 of today\nMore on 49" and texts[10] == "House of stories !\nStory 10 of today\nMore on 70" and texts[150] == texts[3]


def test_simple_tree_matching_size():
    a, b = html.tree("<div><p>1</p><ul><li>x<li>y</ul></div>"), html.tree("<div><h1>t</h1><p>1</p><ul><li>x</ul></div>")
    assert len(html.matched(a, b)) == 5  # root, div, p, ul, one li


# --- personal data


SAMPLES = [
    "mail a.b@x-y.example.co and c@d.e_x@f.gh, 1.2.3.4.5.6.7.8 999.1.1.1 001.02.3.255",
    "card 4111 1111 1111 1111, not 4111 1111 1111 1112, long 41111111111111111111, +1 (555) 555-0100. +12345 +49-30-1234567890123456",
    "IBAN GB82 WEST 1234 5698 7654 32 and GB82WEST12345698765431 é😀 x@y.zz 10.0.0.1",
    "a" * 3000 + "@", "1" * 3000, "1.1" * 500, "+" * 2000, "@a.b", "x@a." + "b." * 4000, None, "",
]


def brute_pii(text):
    def luhn(d):
        return sum(int(c) if k % 2 == 0 else sum(divmod(2 * int(c), 10)) for k, c in enumerate(reversed(d))) % 10 == 0

    kinds = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]
    out = []
    for order, (kind, pattern) in enumerate(kinds):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            good = {"email": lambda: True, "ip": lambda: all(int(p) <= 255 for p in m[0].split(".")), "card": lambda: 14 <= len(digits) <= 19 and luhn(digits), "phone": lambda: 10 <= len(digits) <= 15}[kind]()
            if good:
                out.append((m.start(), order, kind, m.end()))
    return sorted(out)


def test_pii(spark):
    rows = [(i, t) for i, t in enumerate([*SAMPLES, *SAMPLES[:1]])]
    got = {r.doc_id: r for r in pii.pii_digest(documents(spark, rows)).collect()}
    for i, t in rows:
        base = brute_pii(t)
        assert [got[i][f"n_{k}"] for k in ("email", "ip", "card", "phone")] == [sum(x[2] == k for x in base) for k in ("email", "ip", "card", "phone")], t and t[:60]
        assert got[i].base_sha256 == sha(",".join(f"{k}:{a}:{b}" for a, _, k, b in base))
    assert [x for x in got[2].spans.split(",") if x.startswith("iban")] == ["iban:5:32"]


def test_context_decides(spark):
    rows = [
        (1, "GB82WEST12345698765432 AND MORE"), (2, "ES91 2100 0418 4502 0005 1332 MORE"), (3, "our account 123456789, order 123456789"),
        (4, "SSN 123-45-6789 but part " + "x" * 40 + " 123-45-6789"), (5, 'token = "04dbebab91ab85687d33eeaaf9ac699e1188f962"'), (6, "commit 04dbebab91ab85687d33eeaaf9ac699e1188f962"),
        (7, "write to a@b.cd"), (8, "a@b.cd"),
    ]
    got = {r.doc_id: (r.spans, r.scores, r.n_other) for r in pii.pii_digest(documents(spark, rows)).collect()}
    assert got == {
        1: ("iban:0:22", "0.60", 1), 2: ("iban:0:29", "0.60", 1), 3: ("account:12:21,account:29:38", "0.55,0.55", 2), 4: ("ssn:4:15", "0.65", 1),
        5: ("secret:9:49", "0.55", 1), 6: ("", "", 0), 7: ("email:9:15", "1.05", 0), 8: ("email:0:6", "0.80", 0),
    }


def test_many_matches(spark):
    text = "x@y.zz 10.0.0.1 " * 400
    r = pii.pii_digest(documents(spark, [(1, text)])).first()
    assert (r.n_email, r.n_ip) == (400, 400) and r.base_sha256 == sha(",".join(f"{k}:{a}:{b}" for a, _, k, b in brute_pii(text)))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="a1@.+- ()%é25", max_size=60), min_size=30, max_size=30))
def test_pii_on_random_texts(spark, texts):
    got = {r.doc_id: r.base_sha256 for r in pii.pii_digest(documents(spark, list(enumerate(texts)))).collect()}
    for i, t in enumerate(texts):
        assert got[i] == sha(",".join(f"{k}:{a}:{b}" for a, _, k, b in brute_pii(t)))


def test_redaction(spark):
    docs = spark.createDataFrame([(1, "to a@b.cd, +1 (555) 555-0100!", 1, "k"), (2, None, 2, "k"), (3, "clean", 3, "k")], "doc_id long, text string, pii int, email string")
    assert {r.doc_id: r.text for r in pii.redact(docs).collect()} == {1: "to [email], [phone]!", 2: None, 3: "clean"}


def test_redaction_beside_columns_of_any_name(spark):
    names = ["doc_id", "text", "__email", "__pii", "___card", "a.b", "n_chars"]
    docs = spark.createDataFrame([(1, "to a@b.cd", "e", 1, 2, 3, 4)], "doc_id long, text string, __email string, __pii int, ___card int, `a.b` int, n_chars long")
    out = pii.redact(docs)
    assert out.columns == names and tuple(out.first()) == (1, "to [email]", "e", 1, 2, 3, 4)
    assert pii.pii_digest(docs).first().n_email == 1


# --- the registry


def test_registry_names():
    numbers = sorted(int(re.match(r"op(\d+)_", n)[1]) for n in Q.QUERIES if n != "pipeline")
    assert numbers == list(range(1, 14)) and "pipeline" in Q.QUERIES


@pytest.mark.parametrize("name", sorted(Q.ORACLE_SQL))
def test_query_equals_sql(spark, sf_dir, name):
    import duckdb

    connection = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings", "pages"):
        connection.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    want = connection.sql(Q.ORACLE_SQL[name])
    df = Q.QUERIES[name](spark, sf_dir)
    assert sorted(df.columns) == sorted(want.columns)
    got = df.select(*want.columns).collect()
    same(got, want.fetchall())


def test_fit_takes_memory_for_the_features_met():
    rng = np.random.default_rng(5)
    top = toxicity.HASHES * toxicity.LEVELS - 1
    positive = [np.array([k, 9_000, top - 1], np.int32) for k in range(20)]
    unlabelled = [np.unique(rng.integers(30, 8_000, 40)).astype(np.int32) for _ in range(200)] + [np.array([top], np.int32)]
    tracemalloc.start()
    model = toxicity.fit(positive, unlabelled, 0.1)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert model.words.tolist() == [9_000, top - 1]
    assert (model.weights > 0).all()
    assert peak < 10e6  # arrays over all hashes take 75 MB


def test_stars_are_queries_of_their_own(spark):
    edges = spark.createDataFrame([(k + 1, k) for k in range(1, 40)] + [(100, 1), (200, 150)], "u long, v long")
    store, bus = spark._jsparkSession.sharedState().statusStore(), spark.sparkContext._jsc.sc().listenerBus()
    bus.waitUntilEmpty(30_000)
    before = max((x.executionId() for x in map(store.executionsList().apply, range(store.executionsList().size()))), default=-1)
    found = sorted(tuple(r) for r in simhash.connected(edges).collect())
    assert found == sorted([(k, 1) for k in [*range(2, 41), 100]] + [(200, 150)])
    bus.waitUntilEmpty(30_000)
    done = store.executionsList()
    ids = [i for i in (done.apply(k).executionId() for k in range(done.size())) if i > before]
    assert max(store.planGraph(i).allNodes().size() for i in ids) <= 80
