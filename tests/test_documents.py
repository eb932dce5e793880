"""JSON documents and file scans: what is good comes back, what is not raises or carries a verdict."""

import json

import pytest

from pitchloom.plans import world
from pitchloom.sources import documents, scans

ALLOWED = {"match_id", "team_a", "team_b", "goals_a", "goals_b", "advanced_team"}
REQUIRED = ALLOWED - {"advanced_team"}
GOOD = {"match_id": "m1", "team_a": "a", "team_b": "b", "goals_a": 1, "goals_b": 0}


def put(tmp_path, text, name="f.json"):
    (tmp_path / name).write_text(text)
    return str(tmp_path / name)


def event(**changes):
    market = {"key": "h2h", "outcomes": [{"name": n, "price": p} for n, p in (("A", 2.0), ("Draw", 3), ("B", 4.5))]}
    book = {"key": "k", "last_update": "2026-06-01T00:00:00Z", "markets": [{"key": "h2h_lay", "outcomes": []}, market]}
    return {"id": "e", "commence_time": "2026-06-02T00:00:00Z", "home_team": "A", "away_team": "B", "bookmakers": [book]} | changes


def payloads(spark, *texts):
    return spark.createDataFrame([(t,) for t in texts], "payload string")


def test_quotes(spark):
    row = scans.json_quotes(payloads(spark, json.dumps([event()]), "[]")).first()
    assert (row["event_id"], row["bookmaker"], row["price_home"], row["price_draw"], row["price_away"]) == ("e", "k", 2.0, 3.0, 4.5)
    assert row["updated_at"].isoformat() == "2026-06-01T00:00:00" and "verdict" not in row.asDict()
    lay = {"key": "k", "markets": [{"key": "lay"}]}
    two = {"key": "k", "last_update": "x", "markets": [{"key": "h2h", "outcomes": [{"name": "A", "price": 1}]}]}
    late = json.loads(json.dumps(event()["bookmakers"][0]).replace('"last_update"', '"other"'))
    word = json.loads(json.dumps(event()["bookmakers"][0]).replace("4.5", '"often"'))
    faults = {
        json.dumps([event()])[:-9]: "not JSON",
        "<html>busy</html>": "not JSON",
        "[] []": "not JSON",
        "": "not JSON",
        '[{"id": "e", "id": "f"}]': "not JSON",
        '{"message": "quota"}': "not an array",
        "[7]": "event is no object",
        json.dumps([event(id="")]): "event lacks id, teams or time",
        json.dumps([event(bookmakers=[])]): "event without quotes",
        json.dumps([event(bookmakers=[lay])]): "no h2h market",
        json.dumps([event(bookmakers=[two])]): "not three-way",
        json.dumps([event(bookmakers=[late])]): "no update time",
        json.dumps([event(bookmakers=[word])]): "price is no number",
    }
    for text, verdict in faults.items():
        with pytest.raises(documents.DocumentError, match=verdict):
            scans.json_quotes(payloads(spark, text))
    told = documents.quote_records(payloads(spark, *faults, json.dumps([event()]))).collect()
    assert sorted(r["verdict"] or "" for r in told) == sorted(["", *faults.values()])


@pytest.mark.parametrize("text", [json.dumps([GOOD]), json.dumps({"results": [GOOD]}), json.dumps([GOOD], indent=2)])
def test_results_of_documents(spark, tmp_path, text):
    row = scans.strict_json_results(spark, put(tmp_path, text), ALLOWED, REQUIRED).first()
    assert (row["match_id"], row["goals_a"], row["advanced_team"]) == ("m1", "1", None)


def test_results_of_lines(spark, tmp_path):
    path = put(tmp_path, "\n".join(json.dumps(GOOD | {"match_id": f"m{i}"}) for i in range(5)) + "\n\n")
    assert scans.strict_json_results(spark, path, ALLOWED, REQUIRED, lines=True).count() == 5
    with pytest.raises(documents.DocumentError, match="not JSON"):
        scans.strict_json_results(spark, path, ALLOWED, REQUIRED)
    cut = put(tmp_path, json.dumps(GOOD) + "\n" + json.dumps(GOOD)[:-3], "cut.json")
    with pytest.raises(documents.DocumentError, match=r"not JSON \(1,"):
        scans.strict_json_results(spark, cut, ALLOWED, REQUIRED, lines=True)


@pytest.mark.parametrize(("text", "verdict"), [("[", "not JSON"), ("<html>", "not JSON"), ("", "empty"), (json.dumps([GOOD]) + " x", "not JSON"), ('{"rows": []}', "no list of results"), ("[1]", "record is no object"), (json.dumps([GOOD | {"x": 1}]), "unknown key x"), ('[{"match_id": "m"}]', "missing key goals_a, goals_b, team_a, team_b"), ('[{"match_id": 1, "match_id": 2}]', "not JSON")])
def test_results_that_raise(spark, tmp_path, text, verdict):
    with pytest.raises(documents.DocumentError, match=verdict):
        scans.strict_json_results(spark, put(tmp_path, text), ALLOWED, REQUIRED)


def test_mapping_from_a_file(spark, tmp_path):
    slots = {r[0]: "3" + r[4][1:] for r in world.fixture_rows() if r[4] and r[4][0] == "3"}
    cases = {}
    for c, m, g in world.mapping_rows():
        cases.setdefault(c, {})[m] = g
    document = {"cases": [{"qualified_groups": c, "assignments": a} for c, a in cases.items()], "selectors": slots}
    found = documents.third_place_mapping(spark, put(tmp_path, json.dumps(document)))
    assert sorted(tuple(r) for r in found.collect()) == sorted(world.mapping_rows())
    first = document["cases"][0]
    wrong = {
        "repeated combination": document | {"cases": [*document["cases"], first]},
        "break their slots": document | {"cases": [first | {"assignments": dict(zip(first["assignments"], [*first["assignments"].values()][::-1], strict=True)) | {"073": "Z"}}]},
        "no cases or selectors": {"cases": []},
    }
    for text, fault in wrong.items():
        with pytest.raises(documents.DocumentError, match=text):
            documents.third_place_mapping(spark, put(tmp_path, json.dumps(fault), "w.json"))


def test_file_scans(spark, tmp_path):
    head = "date,home_team,away_team,home_score,away_score,tournament,city,country,neutral\n"
    results = put(tmp_path, head + "2020-01-02,A,B,1,0,Cup,X,Y,TRUE\n2030-01-02,A,B,NA,NA,Cup,,Y,FALSE\n", "r.csv")
    first, second = scans.csv_results(spark, results).orderBy("date").collect()
    assert (first["home_score"], first["neutral"], second["home_score"], second["city"]) == (1, True, None, None)
    with pytest.raises(Exception):
        scans.csv_results(spark, put(tmp_path, "date,other\n1,2\n", "bad.csv")).collect()
    live = put(tmp_path, "match_id,team_a,team_b,goals_a,goals_b\nm,a,b,2,1\n", "live.csv")
    assert scans.csv_live_results(spark, live).first()["advanced_team"] is None
    with pytest.raises(ValueError, match="missing columns"):
        scans.csv_live_results(spark, put(tmp_path, "match_id,team_a\nm,a\n", "l2.csv"))
    rated = scans.tsv_ratings(spark, put(tmp_path, "1\t2\tAR\t2100\n2\t1\tES\t2050\n3\t3\t\t1\n", "w.tsv"))
    assert {(r["code"], r["rating"]) for r in rated.collect()} == {("AR", 2100.0), ("ES", 2050.0)}
    with pytest.raises(ValueError, match="repeated code"):
        scans.tsv_names(spark, put(tmp_path, "AR\tArgentina\tx\nAR\tOther\n", "n.tsv"))
    with pytest.raises(ValueError, match="malformed"):
        scans.tsv_names(spark, put(tmp_path, "AR\n", "n2.tsv"))
    assert scans.latest(spark, str(tmp_path), "*.tsv").endswith("w.tsv") and scans.latest(spark, str(tmp_path), "*.none") is None
