"""A corpus pipeline: five stages over documents, each one operator over all rows that its predecessor kept.

toxicity     documents that the classifier rejects (score of 0.5 or more) go
near_dedup   one document of each class of near copies (five-word shingles, Jaccard similarity of 0.8 or more) stays, the
             one of the smallest doc_id (rows without one come last); of rows that repeat its doc_id one stays, the least
decontaminate  documents that hold a benchmark window go
pii          personal data in text is replaced by its kind in brackets; n_chars follows
bpe          token ids of each text, their number, and the digest of the decoded text

Each stage but the last returns the columns of its input; further columns of documents pass through. Null and
empty texts count as empty: they are one near-duplicate class. Empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pitchloom.llm import bpe, copies, decontaminate, pii, toxicity
from pitchloom.llm.common import materialize, table, text_key, without_rows


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.without_toxic(docs, model)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    classes = materialize(copies.classes(docs.select("doc_id", "text", text_key().alias("__key")), ("__key",)), "classes")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("missing"), "doc_id", "__key"))
    stays = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("__key") == F.col("first.__key"))
    marked = classes.join(classes.groupBy("class").agg(first.alias("first")).hint("merge"), "class").select("doc_id", "__key", stays.alias("stays"))
    kept = without_rows(docs, marked.where("not stays").distinct())
    again = materialize(marked.where("stays").groupBy("doc_id", "__key").count().where("count > 1").select("doc_id", "__key"), "again")
    if again.isEmpty():
        return kept
    found = again.select(F.col("doc_id").alias("__id"), F.col("__key").alias("__hash"))
    repeated = kept.join(found, kept["doc_id"].eqNullSafe(found["__id"]) & (text_key() == found["__hash"]), "left_semi")
    named = {c: F.col("`" + c.replace("`", "``") + "`") for c in docs.columns}  # a name may hold dots
    ordered = F.struct(*[named[c] for c, kind in docs.dtypes if "map<" not in kind and kind != "variant"])
    one = repeated.groupBy("doc_id", text_key().alias("__key")).agg(F.min_by(F.struct(*named.values()), ordered).alias("row")).select("row.*")
    return without_rows(kept, again).unionByName(one)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = decontaminate.hits(docs.select("doc_id", "text", text_key().alias("__key")), table(spark, sf_dir, "benchmark"), keep=("__key",))
    return without_rows(docs, found.where(F.size("hit") > 0))


def redact_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    clean = pii.redact(docs)
    if "n_chars" not in docs.columns:
        return clean
    return clean.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str, vocabulary: str | None = None) -> DataFrame:
    if vocabulary is None:
        import public_tokenizers

        vocabulary = public_tokenizers.path(bpe.VOCABULARY)
    return bpe.encode_decode(docs, vocabulary, keep=tuple(c for c in ("doc_id", "lang", "source") if c in docs.columns))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_duplicates),
    ("decontaminate", drop_contaminated),
    ("pii", redact_pii),
    ("bpe", encode),
]

#: No stage chain with a trained classifier, SimHash and BPE can be put in SQL; tests compare near_dedup with all pairs, the others through their operators.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs
