from pyspark.sql import functions as F

from tidegrid.sources import match_files as mf

MATCH = 'var ScheduleID=1001; var hometeam="H"; var guestteam="G";\nvar game=Array("281|900|Bet 365|1.75|3.70|4.33|53|25|21|93.2|1.80|3.60|0|52|26|22|93.0|0.93|0.94|0.95" , "90|901|Short");\nvar gameDetail=Array("900^1.75|3.70|4.33|08-20 10:00|0.93|0.94|0.95|2024;1.80|3.60|4.20|08-22 18:50|1|1|1|;","901^");'
LEAGUE = "var arrLeague=[36,'EPL','x'];\nvar arrTeam=[[19,'Arsenal'],[25,'Old'],[25,'New']];\njh[\"R_1\"]=[[1001,36,-1,'2024-08-17 19:30',19,25,'2-0','1-0'],[1002,0,-1,'2024-08-18 19:30',19,77,'','']];\njh[\"R_2\"]=[[1003,36,-1,'2024-08-24 19:30',25,19,'1-1','0-0']];"


def test_match_script(spark, tmp_path):
    (tmp_path / "epl" / "2024-2025").mkdir(parents=True)
    (tmp_path / "epl" / "2024-2025" / "1001.js").write_text(MATCH)
    (tmp_path / "epl" / "2024-2025" / "note.txt").write_text("no")
    files = mf.read_scripts(spark, str(tmp_path))
    assert [(r["season"], r["file_id"]) for r in files.collect()] == [("2024", 1001)]
    odds = mf.betting_odds(files).collect()
    assert len(odds) == 1 and float(odds[0]["init_win"]) == 1.75 and odds[0]["final_lose"] is None and float(odds[0]["kelly_lose"]) == 0.95
    assert mf.betting_odds(files, ["Easybets"]).count() == 0
    path = sorted(tuple(r)[:7] for r in mf.trajectories(files).collect())
    assert path == [(1001, "900", "Bet 365", 0, "1.75", "3.70", "4.33"), (1001, "900", "Bet 365", 1, "1.80", "3.60", "4.20")]


def test_league_script(spark):
    df = spark.createDataFrame([(LEAGUE, "2024"), ("nothing here", "2024")], "text string, season string")
    rows = sorted(mf.league_matches(df).collect())
    assert [(r["match_id"], r["league_id"], r["round"], r["home_team_name"], r["away_team_name"], r["final_score"]) for r in rows] == [(1001, 36, 1, "Arsenal", "New", "2-0"), (1002, None, 1, "Arsenal", "Unknown (77)", None), (1003, 36, 2, "New", "Arsenal", "1-1")]
    assert {r["league_name"] for r in rows} == {"EPL"}


def test_handicap_page(spark):
    page = "<table id='oddsDetail'><tr class=thead2><th>36*</th><th>比分</th><th>时间</th></tr><tr><td>平手/半球1.080.72</td><td></td><td>8-20 18:22</td></tr><tr><td>1.100.70</td><td>1-0</td><td>8-20 20:00</td></tr><tr><td>1.100.70</td><td></td><td>8-20 21:00</td></tr></table>"
    df = spark.createDataFrame([("a", page.encode("gbk")), ("b", None)], "file string, content binary")
    got = [(r["handicap"], r["home"], r["away"], r["time"]) for r in mf.handicap_history(df, 0).orderBy("row_no").collect()]
    assert got == [("平手/半球", 1.08, 0.72, "8-20 18:22"), (None, 1.1, 0.7, "8-20 21:00")]


def test_stream_upsert(spark, tmp_path):
    from tidegrid.streaming.incremental import upsert_stream

    for i, rows in enumerate([[(1, "a", 1), (2, "b", 1)], [(2, "c", 2), (3, "d", 2)]]):
        spark.createDataFrame(rows, "id int, v string, at int").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema("id int, v string, at int").parquet(str(tmp_path / "in"))
        upsert_stream(stream, str(tmp_path / "out"), ["id"], [F.col("at").desc()], str(tmp_path / "check")).awaitTermination()
    got = sorted(tuple(r)[:2] for r in spark.read.parquet(str(tmp_path / "out" / "v=1")).select("id", "v").collect())
    assert got == [(1, "a"), (2, "c"), (3, "d")]
