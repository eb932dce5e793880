"""run() over the four stages that are functions of the texts alone, against a brute-force version.

The first stage is a trained model: its operator is tested on held-out rows in test_operators.
"""

import hashlib
import random

import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from tests.llm.test_copies import brute_classes
from tests.llm.test_operators import brute_hits, sentence


def test_stages_equal_brute_force(spark, tmp_path, monkeypatch):
    rng = random.Random(11)
    texts = [sentence(rng, 40) for _ in range(24)]
    texts += [t + " x" for t in texts[:4]] + texts[4:7] + [None, "", " \n", "Ab é", sentence(rng, 2000)]
    leak = sentence(rng, 14)
    texts += [f"{sentence(rng, 30)} {leak.replace("a", "A") if k else leak} {sentence(rng, 30)}" for k in range(2)]
    private = [f"{sentence(rng, 25)} ann.b+{k}@site{k}.example.org {sentence(rng, 25)}" for k in range(3)]
    rows = list(enumerate(texts + private))
    rng.shuffle(rows)
    items = [(1, leak), (2, sentence(rng, 20)), (3, None)]
    spark.createDataFrame([(i, t, "en", "s", len(t or ""), 7) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, class int").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, t) for i, t in items], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_dedup", "decontaminate", "pii", "bpe"]
    monkeypatch.setattr(corpus_pipeline, "STAGES", corpus_pipeline.STAGES[1:])
    got = {r["doc_id"]: (r["lang"], r["source"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}

    classes = brute_classes([t for _, t in rows])
    first = {}
    for (i, _), c in zip(rows, classes, strict=True):
        first[c] = min(i, first.get(c, i))
    stays = [(i, t) for (i, t), c in zip(rows, classes, strict=True) if first[c] == i]
    assert len(stays) < len(rows)
    clean = [r for r, h in zip(stays, brute_hits(stays, items), strict=True) if not h[-1]]
    assert len(clean) == len(stays) - 2
    library = Tokenizer.from_file(str(public_tokenizers.path("word_bpe_49k.json")))
    library.no_truncation()
    library.no_padding()
    want = {}
    for i, t in clean:
        text = " ".join("[email]" if "@" in w else w for w in t.split(" ")) if t in private else t or ""
        ids = library.encode(text, add_special_tokens=False).ids
        sha = [hashlib.sha256(x.encode()).hexdigest() for x in (" ".join(map(str, ids)), library.decode(ids, skip_special_tokens=False))]
        want[i] = ("en", "s", len(ids), *sha)
    assert got == want


def test_repeated_rows_beside_columns_with_dots(spark, tmp_path):
    rows = [(1, "one text of five words", 2), (1, "one text of five words", 1), (2, "one text of five words", 0), (3, None, 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, `a.b` int")
    kept = corpus_pipeline.drop_near_duplicates(spark, docs, str(tmp_path))
    assert kept.columns == docs.columns
    assert sorted(tuple(r) for r in kept.collect()) == [(1, "one text of five words", 1), (3, None, 5)]
