"""Matches as keyed state: overdue and excused, copies and corrections, and the same table after a stop."""

from pyspark.sql import functions as F

from pitchloom.streaming import live

DAY = "2026-06-{:02d} 12:00:00"


def rec(match, kind, day, kickoff=None, a=None, b=None, reason=None):
    return (match, kind, DAY.format(day), kickoff and DAY.format(kickoff), a, b, reason)


#: Three files, read one after the other.
FILES = [
    [rec(m, "fixture", 1, k) for m, k in (("m1", 3), ("m2", 4), ("m3", 5), ("m4", 20))] + [rec("m3", "override", 2, reason="abandoned"), rec("m4", "override", 2, reason=" ")],
    [rec("m1", "result", 3, a=2, b=1), rec("m1", "result", 4, a=2, b=1), rec("m1", "result", 5, a=2, b=2), rec("m4", "result", 5), rec(None, "other", 5), rec("m1", "result", 8, a=2, b=2)],
    [rec("m2", "override", 9, reason="late"), rec("m2", "result", 10, a=0, b=0)],
]
WANT = [
    (None, "unusable", None, None, "other"), ("m1", "copy", 2, 1, None), ("m1", "copy", 2, 2, None), ("m1", "corrected", 2, 2, None), ("m1", "played", 2, 1, None), ("m2", "excused", None, None, "late"),
    ("m2", "overdue", None, None, None), ("m2", "played", 0, 0, None), ("m3", "excused", None, None, "abandoned"), ("m4", "unusable", None, None, "override"), ("m4", "unusable", None, None, "result"),
]


def put(spark, source, files):
    for rows in files:
        df = spark.createDataFrame(rows, "match_id string, kind string, at string, kickoff string, goals_a int, goals_b int, reason string")
        df.withColumns({"at": F.to_timestamp("at"), "kickoff": F.to_timestamp("kickoff")}).coalesce(1).write.mode("append").parquet(source)


def run(spark, source, out, checkpoint):
    records = spark.readStream.schema(live.RECORD).option("maxFilesPerTrigger", 1).parquet(source)
    live.follow(records, "1 day").writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def table(spark, out):
    rows = spark.read.parquet(out).select("match_id", "event", "goals_a", "goals_b", "reason").collect()
    return sorted(map(tuple, rows), key=lambda r: [(x is not None, str(x)) for x in r])


def test_events_and_a_stop(spark, tmp_path):
    source, out, checkpoint = (f"file://{tmp_path}/{n}" for n in ("in", "out", "checkpoint"))
    for rows in FILES:  # a stop after every file
        put(spark, source, [rows])
        run(spark, source, out, checkpoint)
    assert table(spark, out) == sorted(WANT, key=lambda r: [(x is not None, str(x)) for x in r])
    run(spark, source, out, checkpoint)  # nothing new
    assert len(table(spark, out)) == len(WANT)
    stands = live.standing(spark.read.parquet(out)).orderBy("match_id").collect()
    assert [tuple(r) for r in stands] == [("m1", 2, 2), ("m2", 0, 0)]


def test_one_run_gives_the_same_events(spark, tmp_path):
    """All files in one run: the watermark moves between batches as it does between runs."""
    source, out, checkpoint = (f"file://{tmp_path}/{n}" for n in ("in", "out", "checkpoint"))
    put(spark, source, FILES)
    run(spark, source, out, checkpoint)
    assert table(spark, out) == sorted(WANT, key=lambda r: [(x is not None, str(x)) for x in r])
