"""Sinks that never lose or overwrite: write-once tables, append-only ledgers, snapshot bundles, small JSON documents.

A table is staged under a sibling name, claims its own and is renamed, so readers see all of it or nothing and of two writers one wins.
A ledger is a list of batches, each of which claims a number once its rows are written. Its digest is the root of a tree over ranges of its
keys, by aggregation: no table passes through the driver. A snapshot keeps the ranges too, so a table that was changed shows where. Paths are those of any file system that Spark knows.
"""

from __future__ import annotations

import hashlib
import json
import os
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pitchloom.sources.digests import content_hash, differences, digits, ranges, root


class ImmutableError(ValueError):
    """A name is taken by other content, or a key is."""


def _path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    system, p = _path(spark, path)
    return system.exists(p)


def claim(spark: SparkSession, path: str, text: str, link: bool | None = None) -> bool:
    """A file with this text under a name that is free, name and text in one step; False if the name is taken.

    Local files get their name by a hard link, others by a rename that never overwrites (``link`` chooses; by default the scheme does).
    """
    system, p = _path(spark, path)
    staged = _path(spark, f"{path.rsplit('/', 1)[0]}/.{uuid.uuid4().hex}")[1]
    out = system.create(staged, False)
    out.write(bytearray(text.encode()))
    out.close()
    try:
        if system.getScheme() == "file" if link is None else link:
            os.link(staged.toUri().getPath(), p.toUri().getPath())
        else:
            jvm = spark._jvm
            ways = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
            ways[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(system.getUri(), spark._jsc.hadoopConfiguration()).rename(staged, p, ways)
    except FileExistsError:
        return False
    except Py4JJavaError as e:
        if "FileAlreadyExistsException" in str(e.java_exception.getClass().getName()):
            return False
        raise
    finally:
        system.delete(staged, False)
    return True


def _publish(spark: SparkSession, staged: str, path: str) -> None:
    """Give a complete folder its name, which it claims first: of several writers one wins, the others' folders go.

    A name that was claimed by a writer who died before the rename gets that writer's folder, which was complete.
    """
    system, target = _path(spark, path)
    name = f"{path.rsplit('/', 1)[0]}/_names/{path.rsplit('/', 1)[1]}"
    mine = not system.exists(target) and claim(spark, name, staged)
    if not system.exists(target):
        owner = staged if mine else spark.read.text(name).first()["value"]
        if not system.rename(_path(spark, owner)[1], target) and not system.exists(target):
            raise OSError(f"{owner} could not become {path}")
    if not mine:
        system.delete(_path(spark, staged)[1], True)
        raise ImmutableError(f"{path} exists")


def write_json(spark: SparkSession, document: dict, path: str) -> None:
    """One document with sorted keys, under a name that is free."""
    spark.createDataFrame([(json.dumps(document, sort_keys=True),)], "value string").coalesce(1).write.mode("errorifexists").text(path)


def read_json(spark: SparkSession, path: str) -> dict:
    return json.loads("".join(r["value"] for r in spark.read.text(path).collect()))  # one small document


def digest(df: DataFrame, keys: list[str]) -> dict:
    """Digest and rows of a table."""
    return content_hash(df, keys).first().asDict()


def write_once(df: DataFrame, path: str, keys: list[str]) -> dict:
    """Write a table under a free name; equal content there already is accepted, other content raises. Returns digest and rows."""
    spark, found = df.sparkSession, digest(df, keys)
    if exists(spark, path):
        if read_json(spark, f"{path}/_digest") != found:
            raise ImmutableError(f"{path} has other content")
        return found
    staged = f"{path}.staging-{uuid.uuid4().hex}"
    df.write.parquet(staged)
    write_json(spark, found, f"{staged}/_digest")
    try:
        _publish(spark, staged, path)
    except ImmutableError:  # another writer was first
        if read_json(spark, f"{path}/_digest") != found:
            raise
    return found


def _claims(spark: SparkSession, path: str) -> list[dict]:
    """The claims of a ledger by number, void ones marked; a few hundred bytes for each batch, not for each row."""
    if not exists(spark, f"{path}/_claims"):
        return []
    files = {r["name"]: r["value"] for r in spark.read.text(f"{path}/_claims", wholetext=True).select("value", F.col("_metadata.file_name").alias("name")).collect()}
    return [json.loads(text) | {"void": f"{name}.void" in files} for name, text in sorted(files.items()) if not name.endswith(".void")]


def _batches(spark: SparkSession, claims: list[dict]) -> DataFrame:
    schema = T.StructType.fromJson(claims[0]["schema"])
    folders = [c["batch"] for c in claims if not c["void"]]
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)


def ledger(spark: SparkSession, path: str) -> DataFrame:
    """The rows of all claimed batches, but for void ones and those whose bundle is not published (yet)."""
    claims = _claims(spark, path)
    if not claims:
        raise FileNotFoundError(f"{path}: no batches")
    return _batches(spark, [c | {"void": c["void"] or bool(c["bundle"]) and not exists(spark, c["bundle"])} for c in claims])


def append_rows(df: DataFrame, path: str, keys: list[str], bundle: str | None = None) -> int:
    """Append a batch to a ledger and return its number; a key that is null, occurs twice in df or is in the ledger raises, and no reader sees the batch.

    The rows are written first and count from the moment the batch has claimed the next number. A writer who loses a number to another
    checks that one's rows too before the next try, so of two writers with one key one fails. With ``bundle``, a file of a bundle to come,
    the rows count once that is there; until then, or until ``void``, they block their keys.
    """
    spark, batch = df.sparkSession, f"{path}/_batches/{uuid.uuid4().hex}"
    df.write.parquet(batch)
    try:
        own = spark.read.schema(df.schema).parquet(batch).select(*keys)
        if not own.where(" or ".join(f"`{k}` is null" for k in keys)).isEmpty():
            raise ImmutableError(f"{path}: keys that are null")
        if not own.groupBy(*keys).count().where("count > 1").isEmpty():
            raise ImmutableError(f"{path}: repeated keys in the batch")
        text = json.dumps({"batch": batch, "bundle": bundle, "schema": json.loads(df.schema.json())})
        checked = 0
        while True:
            claims = _claims(spark, path)
            if claims and [(f.name, f.dataType) for f in T.StructType.fromJson(claims[0]["schema"])] != [(f.name, f.dataType) for f in df.schema]:
                raise ImmutableError(f"{path}: other columns than the ledger has")
            if len(claims) > checked and not own.join(_batches(spark, claims[checked:]).select(*keys), keys, "left_semi").isEmpty():
                raise ImmutableError(f"{path}: keys that are stored already")
            checked = len(claims)
            if claim(spark, f"{path}/_claims/{checked:012d}", text):
                return checked
    except Exception:
        system, p = _path(spark, batch)
        system.delete(p, True)
        raise


def void(spark: SparkSession, path: str, number: int) -> None:
    """Take back a batch whose bundle will not come; a batch whose rows count stays."""
    c = _claims(spark, path)[number]
    if not c["bundle"] or exists(spark, c["bundle"]):
        raise ImmutableError(f"{path}: batch {number} counts")
    claim(spark, f"{path}/_claims/{number:012d}.void", "void")


def publish_bundle(
    spark: SparkSession, tables: dict[str, tuple[DataFrame, list[str]]], folder: str, name: str, metadata: dict, entries: tuple[DataFrame, str, list[str]] | None = None
) -> dict:
    """A snapshot: all tables (with their keys) and a metadata document with the digest of each, by one rename. Names are never reused.

    entries: rows for a ledger, its path and its keys. They count from the rename on; a bundle that is given up leaves none.
    """
    if "/" in name or name.startswith((".", "_")):
        raise ValueError(f"not a snapshot name: {name!r}")
    path = f"{folder}/{name}"
    if exists(spark, path):
        raise ImmutableError(f"{path} exists")
    staged, mark = f"{folder}/_staging-{uuid.uuid4().hex}", f"_mark-{uuid.uuid4().hex}"
    digests = {}
    for table, (df, keys) in sorted(tables.items()):
        df.write.parquet(f"{staged}/{table}")
        width = digits((stored := spark.read.parquet(f"{staged}/{table}")).count())
        ranges(stored, keys, width).write.parquet(f"{staged}/_ranges/{table}")
        digests[table] = root(spark.read.parquet(f"{staged}/_ranges/{table}"), width).first().asDict() | {"keys": keys, "digits": width}
    document = metadata | {"name": name, "tables": digests}
    if entries:
        rows, at, keys = entries
        claim(spark, f"{staged}/{mark}", "")
        document["ledger"] = {"path": at, "batch": append_rows(rows, at, keys, bundle=f"{path}/{mark}")}
    try:
        write_json(spark, document, f"{staged}/metadata")
        _publish(spark, staged, path)
    except ImmutableError:
        if entries:
            void(spark, at, document["ledger"]["batch"])
        raise
    return document


def verify_bundle(spark: SparkSession, path: str) -> list[str]:
    """The tables of a snapshot whose content differs from its metadata."""
    document = read_json(spark, f"{path}/metadata")
    wrong = []
    for table, stated in sorted(document["tables"].items()):
        found = root(ranges(spark.read.parquet(f"{path}/{table}"), stated["keys"], stated["digits"]), stated["digits"]).first().asDict()
        if found != {c: stated[c] for c in ("digest", "rows")}:
            wrong.append(table)
    return wrong


def changed_ranges(spark: SparkSession, path: str, table: str) -> DataFrame:
    """range, stated_rows and found_rows: where a table of a snapshot differs from what was published. ``digests.in_ranges`` gives its rows there."""
    stated = read_json(spark, f"{path}/metadata")["tables"][table]
    return differences(spark.read.parquet(f"{path}/_ranges/{table}"), ranges(spark.read.parquet(f"{path}/{table}"), stated["keys"], stated["digits"]))


def fingerprint(**parts) -> str:
    """SHA-256 of named inputs; equal inputs, equal print."""
    return hashlib.sha256(json.dumps(parts, sort_keys=True, default=str).encode()).hexdigest()


def reuse_or(spark: SparkSession, folder: str, print_: str, build) -> dict:
    """The document kept for these inputs, or a new one from ``build()`` that is kept under their fingerprint."""
    path = f"{folder}/{print_}"
    if exists(spark, path):
        return read_json(spark, path)
    document = build()
    write_json(spark, document, path)
    return document


def as_of_rows(ledger: DataFrame, outcomes: DataFrame) -> DataFrame:
    """A ledger read with what is known by now: its rows never change, outcomes are joined."""
    return ledger.join(outcomes.select("match_id", F.col("outcome").alias("known_outcome")), "match_id", "left")
