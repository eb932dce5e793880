"""Line numbers under any split, CSV records by line, quotes typed by hand."""

import pytest
from pyspark.sql import functions as F

from pitchloom.operators.identity import numbered_ids
from pitchloom.sources import lines
from pitchloom.sources.documents import DocumentError

HEAD = ",".join(lines.QUOTES)
GOOD = "manual,book,e1,M1,2026-06-24T22:00:00Z,2026-06-24T15:16:33Z,Scotland,Brazil,9.9,5.75,1.32"


@pytest.fixture(params=[40, 333, 1 << 27])
def split(spark, request):
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = [spark.conf.get(n) for n in names]
    for n, v in zip(names, (request.param, 1), strict=True):
        spark.conf.set(n, str(v))
    yield request.param
    for n, v in zip(names, before, strict=True):
        spark.conf.set(n, v)


def stem(c):
    return F.element_at(F.split(c, "/"), -1)


def test_numbers_do_not_depend_on_splits(spark, tmp_path, split):
    texts = {"a.txt": [f"line {i} " + "x" * (i * 7 % 90) for i in range(60)], "b.txt": ["", "ü" * 50, "", "last without an end"], "c.txt": []}
    for name, found in texts.items():
        (tmp_path / name).write_text("\r\n".join(found) if name == "b.txt" else "".join(x + "\n" for x in found))
    got = lines.numbered(spark, f"file://{tmp_path}").select(stem("file").alias("f"), "line", "value").orderBy("f", "line").collect()
    assert [tuple(r) for r in got] == [(f, i, x) for f, found in sorted(texts.items()) for i, x in enumerate(found, 1)]


def test_many_blocks_join_by_a_shuffle(spark, tmp_path, split, monkeypatch):
    (tmp_path / "a.txt").write_text("".join(f"{i}\n" for i in range(1, 200)))
    monkeypatch.setattr(lines, "MOST_BLOCKS", 0)
    assert lines.numbered(spark, f"file://{tmp_path}").where("cast(value as long) <> line").isEmpty()


def test_collisions_are_numbered_in_file_order(spark, tmp_path, split):
    (tmp_path / "a.csv").write_text("day,home,away\n" + "".join(f"d{i % 3},x,y\n" for i in range(30)))
    rows = lines.csv_records(spark, f"file://{tmp_path}/a.csv", ("day",))
    got = numbered_ids(rows, F.concat_ws("-", "day", "home", "away"), ["file", "line"])
    name = next(c for c in got.columns if c not in rows.columns)
    want = [f"d{i % 3}-x-y" + ("" if i < 3 else f"-{i // 3 + 1}") for i in range(30)]
    assert [r[name] for r in got.orderBy("line").collect()] == want


def test_faults_name_file_and_line(spark, tmp_path, split):
    swap = lambda a, b: GOOD.replace(a, b)
    body = [GOOD, "", swap("book", ""), swap("9.9", "many"), swap("2026-06-24T22:00:00Z", "soon"), "too,few", GOOD + ",more", swap("2026-06-24T15:16:33Z", ""), swap("Scotland", '"Scot, land"'), swap("Brazil", " ").replace("1.32", "")]
    (tmp_path / "q.csv").write_text("\n".join([HEAD, *body]) + "\n")
    rows = lines.manual_quotes(spark, f"file://{tmp_path}/q.csv")
    got = {int(r["place"].rsplit(":", 1)[1]): r for r in rows.collect()}
    fields = "not the fields of the header"
    assert {n: r["verdict"] for n, r in got.items()} == {2: None, 4: "missing bookmaker", 5: "no number price_home", 6: "no time commence_time_utc", 7: fields, 8: fields, 9: None, 10: None, 11: "missing away_team, price_away"}
    assert got[10]["home_team"] == "Scot, land" and got[2]["price_home"] == 9.9 and got[9]["provider_update_utc"] is None and got[2]["commence_time_utc"] is not None
    with pytest.raises(DocumentError, match=r"missing bookmaker \(1, first at .*q.csv:4\)"):
        lines.strict_manual_quotes(spark, f"file://{tmp_path}/q.csv")


def test_good_files_and_headers(spark, tmp_path):
    path = tmp_path / "q"
    path.mkdir()
    (path / "a.csv").write_text(f"{HEAD}\n{GOOD}\n")
    (path / "b.csv").write_text(f"{HEAD}\n{GOOD.replace('M1', 'M2')}")
    got = lines.strict_manual_quotes(spark, f"file://{path}")
    assert got.columns == list(lines.QUOTES) and sorted(r["match_id"] for r in got.collect()) == ["M1", "M2"]
    for name, text, message in (("none", "", "no lines"), ("head", HEAD, "no quotes"), ("short", "provider\nx\n", "missing columns"), ("twice", f"{HEAD},provider\n", "repeated columns")):
        (tmp_path / name).write_text(text)
        with pytest.raises(DocumentError, match=message):
            lines.strict_manual_quotes(spark, f"file://{tmp_path}/{name}")
    (path / "c.csv").write_text(f"other,{HEAD}\n")
    with pytest.raises(DocumentError, match="different headers"):
        lines.manual_quotes(spark, f"file://{path}")
