"""Digests of tables as trees, and snapshots that tell where they were changed."""

import hashlib

from pyspark.sql import functions as F

from pitchloom.sources import digests, sinks


def table(spark, n=300):
    return spark.range(n).select(F.col("id").alias("k"), (F.col("id") % 7).cast("string").alias("v"), F.when(F.col("id") % 5 > 0, F.col("id") * 0.5).alias("x"))


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def test_root_depends_on_content_alone(spark, monkeypatch):
    monkeypatch.setattr(digests, "ROWS", 8)
    df = table(spark)
    first = digests.content_hash(df, ["k"]).first()
    assert digests.digits(300) == 2 and first["rows"] == 300
    assert digests.content_hash(df.orderBy(F.desc("v")).repartition(3), ["k"]).first() == first
    others = [df.withColumn("v", F.when(F.col("k") == 7, "z").otherwise(F.col("v"))), df.where("k <> 7"), df.union(df.where("k = 7")), df.withColumn("x", F.coalesce("x", F.lit(0.0)))]
    found = {digests.content_hash(o, ["k"]).first()["digest"] for o in others}
    assert len(found) == 4 and first["digest"] not in found
    none = digests.content_hash(df.limit(0), ["k"]).first()
    assert (none["digest"], none["rows"]) == (sha(""), 0)


def test_tree_equals_brute_force(spark):
    """Two digits: ranges, then nodes of one digit, then the root."""
    df = table(spark, 40)
    rows = [(sha('{"k":%d}' % r["k"]), sha('{"k":%d,"v":"%s","x":%s}' % (r["k"], r["v"], "null" if r["x"] is None else r["x"]))) for r in df.collect()]
    level = {}
    for key, row in rows:
        level.setdefault(key[:2], []).append(row)
    level = {p: (sha("".join(sorted(d))), len(d)) for p, d in level.items()}
    assert {r["range"]: (r["digest"], r["rows"]) for r in digests.ranges(df, ["k"], 2).collect()} == level
    for width in (1, 0):
        up = {}
        for p in sorted(level):
            up.setdefault(p[:width], []).append((p, *level[p]))
        level = {p: (sha("".join(f"{c}:{d}:{n}\n" for c, d, n in of)), sum(n for *_, n in of)) for p, of in up.items()}
    assert tuple(digests.root(digests.ranges(df, ["k"], 2), 2).first()) == level[""]


def test_snapshot_tells_where_it_changed(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(digests, "ROWS", 20)
    sinks.publish_bundle(spark, {"t": (table(spark), ["k"])}, str(tmp_path), "one", {})
    path = str(tmp_path / "one")
    assert sinks.verify_bundle(spark, path) == [] and sinks.changed_ranges(spark, path, "t").isEmpty()
    altered = table(spark).withColumn("v", F.when(F.col("k") == 77, "other").otherwise(F.col("v"))).where("k <> 5").collect()
    spark.createDataFrame(altered, table(spark).schema).write.mode("overwrite").parquet(f"{path}/t")
    assert sinks.verify_bundle(spark, path) == ["t"]
    wrong = sinks.changed_ranges(spark, path, "t").collect()
    assert {r["range"] for r in wrong} == {sha('{"k":%d}' % k)[:1] for k in (77, 5)}
    rows = digests.in_ranges(spark.read.parquet(f"{path}/t"), ["k"], sinks.changed_ranges(spark, path, "t"))
    assert 77 in {r["k"] for r in rows.collect()} and rows.count() < 150
