"""The registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from pitchloom.llm.common import table


def op3_simhash(spark, sf_dir):
    from pitchloom.llm.simhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def op1_decontaminate(spark, sf_dir):
    from pitchloom.llm.decontaminate import decontaminated

    return decontaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_pii(spark, sf_dir):
    from pitchloom.llm.pii import pii_digest

    return pii_digest(table(spark, sf_dir, "documents"))


def op2_bpe(spark, sf_dir, vocabulary: str | None = None):
    from pitchloom.llm.bpe import VOCABULARY, encode_decode

    if vocabulary is None:
        import public_tokenizers

        vocabulary = public_tokenizers.path(VOCABULARY)
    return encode_decode(table(spark, sf_dir, "documents"), vocabulary, ids=False)


def op5_toxicity(spark, sf_dir):
    from pitchloom.llm.toxicity import toxicity

    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def pipeline(spark, sf_dir):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def op4_warc(spark, sf_dir):
    from pitchloom.llm.common import scratch
    from pitchloom.llm.warc import archived

    return archived(table(spark, sf_dir, "pages"), scratch(spark, "warc"))


def op6_topk(spark, sf_dir):
    from pitchloom.llm.topk import top_k

    return top_k(table(spark, sf_dir, "embeddings"))


def op8_lm(spark, sf_dir):
    from pitchloom.llm.lm import lm_scores

    return lm_scores(table(spark, sf_dir, "documents"))


def op9_html(spark, sf_dir):
    from pitchloom.llm.html import extract

    return extract(table(spark, sf_dir, "pages"))


def op7_chat(spark, sf_dir):
    from pitchloom.llm.chat import repaired

    return repaired(table(spark, sf_dir, "conversations"))


def op11_runs(spark, sf_dir):
    from pitchloom.llm.runs import run_digest

    return run_digest(table(spark, sf_dir, "documents"))


def op12_merkle(spark, sf_dir):
    from pitchloom.llm.merkle import manifest_digest

    return manifest_digest(table(spark, sf_dir, "documents"))


def op13_sharding(spark, sf_dir):
    from pitchloom.llm.sharding import shard_digest

    return shard_digest(table(spark, sf_dir, "documents"))


QUERIES = {"op11_runs": op11_runs, "op12_merkle": op12_merkle, "op13_sharding": op13_sharding, "op7_chat": op7_chat, "op9_html": op9_html, "op8_lm": op8_lm, "op6_topk": op6_topk, "op4_warc": op4_warc, "pipeline": pipeline, "op5_toxicity": op5_toxicity, "op2_bpe": op2_bpe, "op1_decontaminate": op1_decontaminate, "op10_pii": op10_pii, "op3_simhash": op3_simhash}
ORACLE_SQL = {}

ORACLE_SQL["op6_topk"] = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
         CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5
"""

ORACLE_SQL["op4_warc"] = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest,
         min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first
  FROM pages)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id <> first THEN first END AS refers_to
FROM p
"""

WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

ORACLE_SQL["op1_decontaminate"] = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {WORDS} AS w FROM documents),
b AS (SELECT item_id, w, least(len(w), 10) AS n FROM (SELECT item_id, {WORDS} AS w FROM benchmark) WHERE len(w) > 0),
windows AS (SELECT DISTINCT item_id, n, array_to_string(w[i : i + n - 1], ' ') AS gram FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS i FROM b)),
places AS (SELECT r, n, i, array_to_string(w[i : i + n - 1], ' ') AS gram
  FROM (SELECT r, n, w, unnest(range(1, greatest(len(w) - n + 2, 1))) AS i FROM d, (SELECT DISTINCT n FROM windows))),
met AS (SELECT r, item_id, n, i FROM places JOIN windows USING (gram, n)),
hit AS (SELECT r, count(DISTINCT pos) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS pos FROM met) GROUP BY r),
items AS (SELECT r, list_sort(list(DISTINCT CAST(item_id AS VARCHAR))) AS items FROM met GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(len(items), 0) AS n_items,
       sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (r) LEFT JOIN items USING (r)
"""

#: The manifest: levels of the trees as one recursion, the way up of each row as another; the CRC of doc_id bit by bit.
ORACLE_SQL["op12_merkle"] = """
WITH RECURSIVE f AS (
  SELECT doc_id, lang, coalesce(octet_length(encode(CAST(doc_id AS VARCHAR))) || ':' || doc_id, '-') || coalesce(octet_length(encode(source)) || ':' || source, '-')
    || coalesce(octet_length(encode(lang)) || ':' || lang, '-') AS a, n_chars, coalesce(octet_length(encode(text)) || ':' || text, '-') AS b FROM documents),
l AS (
  SELECT doc_id, coalesce('1' || lang, '0') AS tree, sha256(a || coalesce(length(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') || b) AS leaf,
         sha256(a || coalesce(length(CAST(n_chars + 1 AS VARCHAR)) || ':' || (n_chars + 1), '-') || b) AS changed FROM f),
p AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id, leaf) - 1 AS pos, count(*) OVER (PARTITION BY tree) AS n FROM l),
up AS (
  SELECT tree, 0 AS level, pos, leaf AS d, n FROM p
  UNION ALL
  SELECT tree, level + 1, pos // 2, sha256(string_agg(d, '' ORDER BY pos)), (min(n) + 1) // 2 FROM up WHERE n > 1 GROUP BY tree, level, pos // 2),
s AS (SELECT tree, d AS subroot, row_number() OVER (ORDER BY tree) - 1 AS pos, count(*) OVER () AS n FROM up WHERE n = 1),
top AS (
  SELECT 0 AS level, pos, subroot AS d, n FROM s
  UNION ALL
  SELECT level + 1, pos // 2, sha256(string_agg(d, '' ORDER BY pos)), (min(n) + 1) // 2 FROM top WHERE n > 1 GROUP BY level, pos // 2),
crc AS (
  SELECT CAST(doc_id AS VARCHAR) AS t, 0 AS i, 4294967295::BIGINT AS c FROM documents
  UNION ALL
  SELECT t, i + 1, CASE WHEN i % 9 = 0 THEN xor(c, ascii(substr(t, i // 9 + 1, 1))::BIGINT) ELSE xor(c >> 1, (c & 1) * 3988292384) END FROM crc WHERE i < 9 * length(t)),
tried AS (SELECT DISTINCT t FROM crc WHERE i = 9 * length(t) AND xor(c, 4294967295::BIGINT) % 7 = 0),
walk AS (
  SELECT p.tree, p.doc_id, p.pos AS row, 0 AS level, p.pos, p.n, '' AS met, CASE WHEN t IS NULL THEN leaf ELSE changed END AS d FROM p LEFT JOIN tried ON t = CAST(doc_id AS VARCHAR)
  UNION ALL
  SELECT w.tree, w.doc_id, w.row, w.level + 1, w.pos // 2, (w.n + 1) // 2, w.met || coalesce(o.d, ''), sha256(CASE WHEN w.pos % 2 = 1 THEN o.d || w.d ELSE w.d || coalesce(o.d, '') END)
  FROM walk w LEFT JOIN up o ON o.tree = w.tree AND o.level = w.level AND o.pos = xor(w.pos, 1) WHERE w.n > 1),
last AS (
  SELECT w.tree, w.doc_id, w.row, 0 AS level, s.pos, s.n, w.met, w.d, s.subroot FROM walk w JOIN s USING (tree) WHERE w.n = 1
  UNION ALL
  SELECT w.tree, w.doc_id, w.row, w.level + 1, w.pos // 2, (w.n + 1) // 2, w.met || coalesce(o.d, ''), sha256(CASE WHEN w.pos % 2 = 1 THEN o.d || w.d ELSE w.d || coalesce(o.d, '') END), w.subroot
  FROM last w LEFT JOIN top o ON o.level = w.level AND o.pos = xor(w.pos, 1) WHERE w.n > 1)
SELECT p.doc_id, p.leaf, last.subroot, r.d AS root, sha256(met) AS proof_sha256, last.d AS folded_root, last.d = r.d AS verified
FROM last JOIN p ON p.tree = last.tree AND p.pos = last.row, (SELECT d FROM top WHERE n = 1) r WHERE last.n = 1
"""
