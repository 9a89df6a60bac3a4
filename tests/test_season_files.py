"""Season files with lineage, and Parquet files that can't be read."""

import hashlib

import pytest

from touchline.sources import preflight, seasons


@pytest.fixture
def root(tmp_path):
    files = {
        "2324/E0.csv": b"\xef\xbb\xbfDate,HomeTeam,FTHG\n01/08/2023,Arsenal,2\n02/08/2023,\"Spurs, \"\"N\"\"\",1\n",
        "2324/SP1.csv": "Date,HomeTeam,FTHG,Bet\n01/08/2023,Málaga,0,1.5\n03/08/2023,Cádiz\n".encode("latin1"),
        "2425/E0.csv": b"Date,HomeTeam,FTHG,,Bet\r\n01/08/2024,Leeds,3,x,2\r\n\r\n",
        "2425/D1.csv": b"Date,HomeTeam\n01/08/2024,Bayern,1,2\n02/08/2024,Mainz\n",
        "2425/F1.csv": b"Date,HomeTeam\n",
        "2425/N1.csv": b"",
        "2425/ZZ.csv": b"HomeTeam,hometeam,league\nAjax,b,c\n",
        "notes/E0.csv": b"a\n1\n",
    }
    for name, content in files.items():
        p = tmp_path / "raw" / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(content)
    return tmp_path / "raw"


def test_census_and_union(spark, root):
    files = seasons.census(spark, f"file://{root}", ["Date", "HomeTeam", "FTHG"])
    got = {(r.season, r.league_code): r for r in files.collect()}
    assert {k: r.status for k, r in got.items()} == {("2324", "E0"): "read", ("2324", "SP1"): "read", ("2425", "E0"): "read", ("2425", "D1"): "broken", ("2425", "F1"): "empty", ("2425", "ZZ"): "read"}
    assert got["2324", "SP1"].encoding == "ISO-8859-1" and got["2324", "E0"].encoding == "UTF-8"
    assert got["2425", "D1"].long_lines == 1 and got["2425", "D1"].missing == ["FTHG"]
    assert all(r.sha256 == hashlib.sha256((root / k[0] / f"{k[1]}.csv").read_bytes()).hexdigest() for k, r in got.items())
    rows = seasons.combined(spark, files)
    assert rows.columns[-3:] == ["league", "season", "_file"]
    found = {(r.league, r.season, r.Date, r.HomeTeam, r.FTHG, r.Bet) for r in rows.collect()}
    assert found == {
        ("Premier League", "2324", "01/08/2023", "Arsenal", "2", None), ("Premier League", "2324", "02/08/2023", 'Spurs, "N"', "1", None),
        ("La Liga", "2324", "01/08/2023", "Málaga", "0", "1.5"), ("La Liga", "2324", "03/08/2023", "Cádiz", None, None),
        ("Premier League", "2425", "01/08/2024", "Leeds", "3", "2"), ("ZZ", "2425", None, "Ajax", None, None),
    }
    m = seasons.manifest(files).first()
    order = ["2324/E0", "2324/SP1", "2425/E0", "2425/ZZ"]
    assert (m.total_rows, m.n_files, m.league_seasons) == (6, 4, ["E0/2324", "E0/2425", "SP1/2324", "ZZ/2425"])
    assert m.input_hash == hashlib.sha256("".join(hashlib.sha256((root / f"{x}.csv").read_bytes()).hexdigest() for x in order).encode()).hexdigest()


def test_changed_missing_and_broken_files(spark, root):
    recorded = seasons.census(spark, f"file://{root}").select("season", "league_code", "sha256").collect()
    recorded = spark.createDataFrame([(r.season, r.league_code, None if r.league_code == "F1" else r.sha256) for r in recorded], "season string, league_code string, sha256 string")
    assert seasons.lineage(seasons.changes(recorded, seasons.scan(spark, f"file://{root}"))).first().asDict() == {"verified": 5, "failures": 0, "skipped": 1, "passed": True}
    (root / "2324/E0.csv").write_bytes(b"Date\n1\n")
    (root / "2425/ZZ.csv").unlink()
    (root / "2425/F1.csv").unlink()
    (root / "2425/E1.csv").write_bytes(b"Date\n1,2\n")
    files = seasons.census(spark, f"file://{root}")
    got = {(r.season, r.league_code): r.status for r in seasons.changes(recorded, files).collect()}
    assert got == {("2324", "E0"): "changed", ("2324", "SP1"): "same", ("2425", "E0"): "same", ("2425", "D1"): "same", ("2425", "F1"): "skipped", ("2425", "ZZ"): "missing", ("2425", "E1"): "new"}
    assert seasons.lineage(seasons.changes(recorded, files)).first().asDict() == {"verified": 3, "failures": 2, "skipped": 1, "passed": False}
    assert {r.league_code for r in files.where("status = 'broken'").collect()} == {"D1", "E1"}


def test_no_files(spark, tmp_path):
    (tmp_path / "2425").mkdir()
    (tmp_path / "2425" / "N1.csv").write_bytes(b"")
    (tmp_path / "2425" / "F1.csv").write_bytes(b"\n\n")
    files = seasons.census(spark, f"file://{tmp_path}", ["Date"])
    assert seasons.combined(spark, files).collect() == []
    assert seasons.manifest(files).first().asDict() == {"total_rows": 0, "n_files": 0, "league_seasons": [], "input_hash": ""}


def test_columns(spark):
    df = spark.createDataFrame([(1, None), (2, "x")], "a int, `b.c` string")
    assert {tuple(r) for r in seasons.columns(df, ["a", "z"]).collect()} == {("a", "int", 2, 0, "expected"), ("b.c", "string", 2, 1, "extra"), ("z", None, 2, None, "missing")}
    assert {tuple(r) for r in seasons.columns(df.limit(0)).collect()} == {("a", "int", 0, 0, None), ("b.c", "string", 0, 0, None)}


@pytest.mark.parametrize("whole", [preflight.WHOLE, 0])
def test_preflight(spark, tmp_path, whole):
    root, apart = tmp_path / "data", tmp_path / "apart"
    spark.range(5000).selectExpr("id", "sha2(cast(id as string), 256) as s").coalesce(1).write.parquet(f"file://{root}/good")
    good = next((root / "good").glob("*.parquet"))
    content = good.read_bytes()
    (root / "bad").mkdir()
    (root / "bad" / "cut.parquet").write_bytes(content[: len(content) // 2])
    (root / "bad" / "spoilt.parquet").write_bytes(content[:40] + bytes(4000) + content[4040:])
    report = preflight.preflight(spark, f"file://{root}", whole)
    got = {r.path.rsplit("/", 1)[1]: r for r in report.collect()}
    assert {k: r.readable for k, r in got.items()} == {good.name: True, "cut.parquet": False, "spoilt.parquet": False}
    assert (got[good.name].n_rows, got[good.name].n_columns) == (5000, 2) and got["cut.parquet"].error
    assert preflight.set_apart(spark, report, f"file://{root}", f"file://{apart}").count() == 2 and not apart.exists()
    preflight.set_apart(spark, report, f"file://{root}", f"file://{apart}", dry_run=False)
    assert sorted(p.name for p in (apart / "bad").glob("*.parquet")) == ["cut.parquet", "spoilt.parquet"] and not list((root / "bad").glob("*.parquet"))
    assert preflight.set_apart(spark, report, f"file://{root}", f"file://{apart}", dry_run=False).count() == 0
    assert preflight.put_back(spark, f"file://{apart}") == 2 and (root / "bad" / "cut.parquet").exists()
