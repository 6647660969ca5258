"""Files of several shapes to one master table."""

from __future__ import annotations

import datetime as dt
import hashlib
import json

import pytest
from pyspark.sql import functions as F

from pitchline.functions.seasons import file_url, recent_seasons, season_code, season_of
from pitchline.operators.features import require_known
from pitchline.operators.matches import first_out_of_order, reject_reason
from pitchline.schema import FEATURE_COLUMNS, TABLE_COLUMNS, check_features
from pitchline.sources import matches as source


@pytest.fixture()
def folder(tmp_path):
    (tmp_path / "E0_2324.csv").write_bytes("Div,Date,HomeTeam,AwayTeam,FTHG,FTAG,FTR,B365H,B365D,B365A\nE0,11/08/2023, Ayr ,Bath,2,1,H,1.5,4.0,7.0\nE0,12/08/23,Bath,Córdoba,0,0,D,2.0,,3\nE0,11/08/2023,Ayr,Bath,9,0,H,2,3,4\nE0,13/08/2023,Ayr,Córdoba,,,,2,3,4\nE0,14/08/2023,Ayr,Bath,1,0,A,2,3,4\n".encode("latin-1"))
    (tmp_path / "SP1_2324.csv").write_text("HomeTeam,AwayTeam,Date,FTR,FTHG,FTAG,PSCH,PSCD,PSCA,B365H,B365D,B365A\nDax,Eden,20/08/2023, A ,0.0,3.0,1.0,3.5,4.5,2.5,3.1,2.9\n")
    (tmp_path / "XX_2324.csv").write_text("HomeTeam,AwayTeam,Date\nx,y,1/1/2023\n")
    (tmp_path / "I1_2324.csv").write_text("HomeTeam,AwayTeam\nx,y\n")
    return tmp_path


def test_build(spark, folder):
    built = source.build_matches(source.scan_folder(spark, f"file://{folder}"))
    rows = {(r["league"], r["date"], r["home"], r["away"]): r for r in built.matches.collect()}
    assert len(rows) == 3
    first = rows["English Premier League", dt.date(2023, 8, 11), "Ayr", "Bath"]
    assert (first["ft_home_goals"], first["odds_home"]) == (2, 1.5)
    assert rows["English Premier League", dt.date(2023, 8, 12), "Bath", "Córdoba"]["odds_home"] is None
    assert rows["Spanish La Liga", dt.date(2023, 8, 20), "Dax", "Eden"]["odds_home"] == 2.5
    assert [r["reason"] for r in built.rejects.collect()] == ["score"]


def test_unknown_team_stops_the_build_only_in_complete_rows(spark, folder):
    raw = source.scan_folder(spark, f"file://{folder}")
    registry = spark.createDataFrame([("English Premier League", t) for t in ("Ayr", "Bath", "Córdoba")] + [("Spanish La Liga", "Dax")], "league string, team string")
    with pytest.raises(source.UnknownTeam, match="Eden"):
        source.build_matches(raw, registry)
    aliases = spark.createDataFrame([("Eden", "Dax B")], "alias string, team string")
    more = registry.unionByName(spark.createDataFrame([("Spanish La Liga", "Dax B")], registry.schema))
    assert source.build_matches(raw, more, aliases).matches.where("away = 'Dax B'").count() == 1


def test_round_trip_and_note(spark, folder, tmp_path):
    built = source.build_matches(source.scan_folder(spark, f"file://{folder}")).matches
    source.write_table(built, f"{tmp_path}/out", {"rows": 3})
    assert source.read_table(spark, f"{tmp_path}/out").exceptAll(built).count() == 0
    assert json.loads(spark.read.text(f"{tmp_path}/out.meta").first()["value"]) == {"rows": 3}


def test_manifest(spark, folder):
    rows = source.file_manifest(spark, f"file://{folder}").orderBy("filename").collect()
    assert [(r["filename"], r["season"]) for r in rows] == [("E0_2324.csv", "2324"), ("I1_2324.csv", "2324"), ("SP1_2324.csv", "2324")]
    assert all(len(r["sha256"]) == 64 and r["bytes"] > 0 for r in rows)


def test_manifest_reads_what_changed_only(spark, folder):
    place, at = f"file://{folder}/manifest", f"file://{folder}"
    rows = lambda: sorted(tuple(r) for r in source.refreshed_manifest(spark, at, place).collect())
    first = rows()
    assert first == sorted(tuple(r) for r in source.file_manifest(spark, at).collect())
    # A digest in the stored manifest that no file has: it stays as long as its file isn't read again.
    stored = spark.read.parquet(f"{place}/v-0")
    marked = spark.createDataFrame([r.asDict() | {"sha256": "kept"} for r in stored.collect()], stored.schema)
    marked.write.parquet(f"{place}/v-1")
    (folder / "I1_2324.csv").write_text("HomeTeam,AwayTeam\nx,z,w\n")
    (folder / "D1_2324.csv").write_text("Date\n")
    (folder / "SP1_2324.csv").unlink()
    second = {r[3]: r[4] for r in rows()}
    assert sorted(second) == ["D1_2324.csv", "E0_2324.csv", "I1_2324.csv"]
    assert second["E0_2324.csv"] == "kept" and second["I1_2324.csv"] != "kept" != second["D1_2324.csv"]
    assert {r["sha256"] for r in source.refreshed_manifest(spark, at, place, force=True).collect()} == {r["sha256"] for r in source.file_manifest(spark, at).collect()}
    assert len(list((folder / "manifest").glob("v-*"))) == 2


def test_long_files_are_hashed_in_chunks(spark, tmp_path):
    with open(tmp_path / "E0_2021.csv", "wb") as f:
        f.truncate(source.CHUNK * 3 + 17)
    (tmp_path / "E0_2122.csv").write_bytes(b"short")
    digests = lambda whole: sorted((r["filename"], r["sha256"]) for r in source.file_digests(spark, f"file://{tmp_path}", whole=whole).collect())
    want = [(p.name, hashlib.sha256(p.read_bytes()).hexdigest()) for p in sorted(tmp_path.glob("*.csv"))]
    assert digests(1 << 30) == digests(100) == digests(0) == want


def test_one_scan_a_header_in_any_folder(spark, tmp_path, monkeypatch):
    for n in range(30):
        shape = "Date,HomeTeam" if n % 3 else "HomeTeam,Date"
        row = f"{n}/1/2023,t{n}" if n % 3 else f"t{n},{n}/1/2023"
        (tmp_path / f"E0 x_{n:04}.csv").write_text(f"{shape}\r\n{row}\r\n{row}\r\n")
    (tmp_path / "E0 x_empty.csv").write_text("")
    for known in (True, False):
        monkeypatch.setattr(source, "_streams", lambda path, known=known: known)
        raw = source.scan_folder(spark, f"file://{tmp_path}", {"E0 x": "L"})
        assert len(raw.inputFiles()) == 30 and raw._jdf.queryExecution().optimizedPlan().toString().count("Relation") == 2
        assert sorted((r["league"], r["HomeTeam"], r["Date"]) for r in raw.collect()) == sorted(("L", f"t{n}", f"{n}/1/2023") for n in range(30) for _ in "ab")
    assert source.scan_folder(spark, f"file://{tmp_path}", {"E1": "L"}) is None


def test_registry_file(spark, tmp_path):
    (tmp_path / "teams.json").write_text('{\n "L": ["b", "a"],\n "M": ["c"]}')
    assert {tuple(r) for r in source.read_registry(spark, f"file://{tmp_path}/teams.json").collect()} == {("L", "a"), ("L", "b"), ("M", "c")}


def test_dates(spark):
    texts = ["11/08/2023", "1/8/23", "31/12/99", "2023-08-11", "soon", "32/01/2023", "", None]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(source.parse_date(F.col("t")).alias("d")).collect()
    assert [r["d"] for r in rows] == [dt.date(2023, 8, 11), dt.date(2023, 8, 1), dt.date(1999, 12, 31), dt.date(2023, 8, 11), None, None, None, None]


def test_seasons(spark):
    row = spark.range(1).select(season_code(F.lit(1999)).alias("a"), season_of(F.lit("2023-06-30").cast("date")).alias("b"), season_of(F.lit("2023-07-01").cast("date")).alias("c"), file_url("http://x/", F.lit("E0"), F.lit(2023)).alias("d")).first()
    assert tuple(row) == ("9900", "2223", "2324", "http://x/2324/E0.csv")
    assert [r["start_year"] for r in recent_seasons(spark, 3, "2024-05-01").orderBy("start_year").collect()] == [2021, 2022, 2023]


@pytest.mark.parametrize("change,reason", [({"home": ""}, "empty_home"), ({"away": None}, "empty_away"), ({"date": dt.date(1980, 1, 1)}, "date"), ({"date": None}, "date"), ({"ft_home_goals": -1}, "goals"), ({"result": "X"}, "result_value"), ({"odds_draw": 1.0}, "odds"), ({"source": "hearsay"}, "source"), ({"away": "A"}, "same_team"), ({"result": "D"}, "score"), ({}, None), ({"odds_home": None}, None)])
def test_one_broken_field_at_a_time(spark, change, reason):
    good = {"league": "L", "date": dt.date(2020, 1, 1), "home": "A", "away": "B", "ft_home_goals": 2, "ft_away_goals": 1, "result": "H", "odds_home": 2.0, "odds_draw": 3.0, "odds_away": 4.0, "source": "football-data"}
    schema = "league string, date date, home string, away string, ft_home_goals long, ft_away_goals long, result string, odds_home double, odds_draw double, odds_away double, source string"
    row = good | change
    assert spark.createDataFrame([tuple(row.values())], schema).select(reject_reason().alias("r")).first()["r"] == reason


def test_unknown_fixtures_are_named(spark):
    fixtures = spark.createDataFrame([("L", "A", "Z")], "league string, home string, away string")
    registry = spark.createDataFrame([("L", "A")], "league string, team string")
    with pytest.raises(ValueError, match=r"Z \(L\)"):
        require_known(fixtures, registry)


def test_out_of_order(spark):
    rows = spark.createDataFrame([("L", 1, dt.date(2020, 1, 2)), ("L", 2, dt.date(2020, 1, 1))], "league string, at int, date date")
    assert [r["at"] for r in first_out_of_order(rows, "at").collect()] == [2]


def test_columns():
    assert len(FEATURE_COLUMNS) == 30 and len(TABLE_COLUMNS) == 40
    check_features(list(FEATURE_COLUMNS))
    with pytest.raises(RuntimeError):
        check_features(list(FEATURE_COLUMNS[::-1]))
