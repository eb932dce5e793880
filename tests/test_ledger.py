"""Claims: of several writers one wins, nothing is doubled, an aborted bundle leaves no rows."""

import os
from concurrent.futures import ThreadPoolExecutor

import pytest

from pitchloom.sources import sinks

KEYS = ["match_id", "snapshot_id"]


def rows(spark, *found):
    return spark.createDataFrame(list(found), "match_id string, snapshot_id string, p double")


def content(spark, path):
    return sorted(map(tuple, sinks.ledger(spark, path).collect()))


@pytest.mark.parametrize("link", [None, False])
def test_a_name_is_claimed_once(spark, tmp_path, link):
    path = f"file://{tmp_path}/names/one"
    assert sinks.claim(spark, path, "first", link) and not sinks.claim(spark, path, "second", link)
    assert (tmp_path / "names" / "one").read_text() == "first"
    assert not [f for f in os.listdir(tmp_path / "names") if f.startswith(".") and not f.endswith(".crc")]


def test_writers_at_once(spark, tmp_path):
    """Eight writers, four keys twice: every key gets in once, whoever wins."""
    path = f"file://{tmp_path}/ledger"

    def write(i):
        try:
            return sinks.append_rows(rows(spark, (f"m{i % 4}", "s", float(i)), (f"own{i}", "s", 0.0)), path, KEYS)
        except sinks.ImmutableError:
            return None

    with ThreadPoolExecutor(8) as pool:
        numbers = list(pool.map(write, range(8)))
    assert sorted(n for n in numbers if n is not None) == [0, 1, 2, 3]
    won = [i for i, n in enumerate(numbers) if n is not None]
    assert content(spark, path) == sorted([(f"m{i % 4}", "s", float(i)) for i in won] + [(f"own{i}", "s", 0.0) for i in won])
    assert len(os.listdir(tmp_path / "ledger" / "_batches")) == 4  # what lost is gone


def test_a_lost_number_means_another_check(spark, tmp_path, monkeypatch):
    """Another writer takes the number between check and claim, with the same key."""
    path, real, once = f"file://{tmp_path}/ledger", sinks.claim, []

    def slow(spark_, name, text, link=None):
        if not once:
            once.append(sinks)
            sinks.append_rows(rows(spark, ("a", "s", 2.0)), path, KEYS)
        return real(spark_, name, text, link)

    monkeypatch.setattr(sinks, "claim", slow)
    with pytest.raises(sinks.ImmutableError, match="stored"):
        sinks.append_rows(rows(spark, ("a", "s", 1.0)), path, KEYS)
    assert content(spark, path) == [("a", "s", 2.0)]


def test_rows_without_a_claim_do_not_count(spark, tmp_path):
    path = f"file://{tmp_path}/ledger"
    with pytest.raises(FileNotFoundError):
        sinks.ledger(spark, path)
    rows(spark, ("a", "s", 1.0)).write.parquet(f"{path}/_batches/left")  # its writer died
    assert sinks.append_rows(rows(spark, ("a", "s", 2.0)), path, KEYS) == 0
    assert sinks.append_rows(rows(spark).limit(0), path, KEYS) == 1
    assert sinks.ledger(spark, path).select("match_id", "snapshot_id", "p").collect() == [("a", "s", 2.0)]
    with pytest.raises(sinks.ImmutableError, match="counts"):
        sinks.void(spark, path, 0)


def test_a_bundle_and_its_entries(spark, tmp_path, monkeypatch):
    folder, path = f"file://{tmp_path}/snapshots", f"file://{tmp_path}/ledger"
    tables = {"t": (spark.range(3), ["id"])}
    one = sinks.publish_bundle(spark, tables, folder, "s1", {}, (rows(spark, ("a", "s1", 1.0)), path, KEYS))
    assert one["ledger"] == {"path": path, "batch": 0} and content(spark, path) == [("a", "s1", 1.0)]
    assert sinks.verify_bundle(spark, f"{folder}/s1") == []

    publish = sinks._publish
    monkeypatch.setattr(sinks, "_publish", lambda *_: (_ for _ in ()).throw(OSError("driver lost")))
    with pytest.raises(OSError, match="driver lost"):
        sinks.publish_bundle(spark, tables, folder, "s2", {}, (rows(spark, ("a", "s2", 2.0)), path, KEYS))
    monkeypatch.setattr(sinks, "_publish", publish)
    assert content(spark, path) == [("a", "s1", 1.0)]  # claimed, but its bundle never came
    with pytest.raises(sinks.ImmutableError, match="stored"):
        sinks.append_rows(rows(spark, ("a", "s2", 3.0)), path, KEYS)
    sinks.void(spark, path, 1)
    sinks.publish_bundle(spark, tables, folder, "s2", {}, (rows(spark, ("a", "s2", 3.0)), path, KEYS))
    assert content(spark, path) == [("a", "s1", 1.0), ("a", "s2", 3.0)]


def test_a_name_taken_meanwhile_voids_the_entries(spark, tmp_path, monkeypatch):
    folder, path = f"file://{tmp_path}/snapshots", f"file://{tmp_path}/ledger"
    publish = sinks._publish

    def late(spark_, staged, target):
        monkeypatch.setattr(sinks, "_publish", publish)
        sinks.publish_bundle(spark, {"t": (spark.range(1), ["id"])}, folder, "s1", {})
        publish(spark_, staged, target)

    monkeypatch.setattr(sinks, "_publish", late)
    with pytest.raises(sinks.ImmutableError, match="exists"):
        sinks.publish_bundle(spark, {}, folder, "s1", {}, (rows(spark, ("a", "s1", 1.0)), path, KEYS))
    assert content(spark, path) == [] and spark.read.parquet(f"{folder}/s1/t").count() == 1
    sinks.append_rows(rows(spark, ("a", "s1", 2.0)), path, KEYS)
    assert content(spark, path) == [("a", "s1", 2.0)]


def test_a_claimed_name_is_completed(spark, tmp_path):
    """A writer claims a name and dies before the rename: the next one completes it, and takes equal content as its own."""
    path, staged = f"file://{tmp_path}/t", f"file://{tmp_path}/t.staging-x"
    df = spark.range(4)
    df.write.parquet(staged)
    sinks.write_json(spark, sinks.digest(df, ["id"]), f"{staged}/_digest")
    assert sinks.claim(spark, f"file://{tmp_path}/_names/t", staged)
    assert sinks.write_once(spark.range(4), path, ["id"])["rows"] == 4 and spark.read.parquet(path).count() == 4
    with pytest.raises(sinks.ImmutableError):
        sinks.write_once(spark.range(5), path, ["id"])
