"""Handicap and analysis pages, JSON files, settings, listings and sinks."""

import json

from pyspark.sql import functions as F

from tidegrid.functions import odds
from tidegrid.sources import handicap_pages as hp
from tidegrid.sources import json_files as jf
from tidegrid.sources import match_files as mf
from tests.test_sources import MATCH


def row(name, cells, colour="#FFFFFF"):
    return f"<tr bgcolor='{colour}'><td>1</td><td>{name}</td><td></td>" + "".join(f"<td{a}>{t}</td>" for t, a in cells) + "</tr>"


def plain(*texts):
    return [(t, "") for t in texts]


TIMED = " title='2024-08-20 18:22'"
PAGE = "<table id='odds'>" + "".join(
    [
        "<tr bgcolor='#000000'><td></td><td>36*</td><td></td><td>9</td><td>x</td><td>9</td></tr>",
        row("36*", [("1.10", TIMED), ("半球", ""), ("0.80", TIMED), *plain("1", "2", "3", "0.90", "一球", "1.00")]),
        row("易*x", [("-", ""), ("-", ""), ("-", ""), ("0.95", " oddstype='wholeLastOdds'"), ("平手", " oddstype='wholeLastOdds'"), ("0.93", " oddstype='wholeLastOdds'")], "#fafafa"),
        row("澳*", [*plain("0.70", "受让半球", "1.20"), *plain("", "", ""), *plain("", "", "")]),
        row("36*", plain("5", "6", "7")),
        row("其他", plain("1", "2", "3")),
    ]
) + "</table><table id='oddsDetail'><tr><th>36*</th><th>易胜*</th><th>比分</th><th>时间</th></tr><tr><td>平手1.080.72</td><td>半球0.900.98</td><td></td><td>8-20 18:22</td></tr></table>"


def test_summary_page_levels(spark, tmp_path):
    for name, text in (("77_total.html", PAGE), ("5_total.html", "<p>"), ("x_total.html", PAGE)):
        (tmp_path / name).write_bytes(text.encode("gbk"))
    pages = hp.read_pages(spark, str(tmp_path))
    assert [r["match_id"] for r in hp.read_pages(spark, str(tmp_path), limit=1).collect()] == [5] and hp.read_pages(spark, str(tmp_path), match_id=77).count() == 1
    got = [tuple(r)[1:] for r in hp.summary(pages).collect()]
    assert got == [
        (77, "bet365", 1.10, "半球", 0.80, "一球", 0.90, 1.00), (77, "easybets", 0.95, "平手", 0.93, None, None, None), (77, "macau", 0.70, "受让半球", 1.20, None, None, None), (77, "bet365", 5.0, "6", 7.0, None, None, None),
    ]
    full = {(r["bookmaker"], r["init_odds_home"]): r["odds_detail"] for r in hp.full_records(pages).collect()}
    assert json.loads(full["bet365", 1.10]) == [{"handicap": "平手", "home": 1.08, "away": 0.72, "time": "8-20 18:22"}] and full["macau", 0.70] is None
    first = [tuple(r)[1:] for r in hp.first_summary(pages, "bet365").collect()]
    assert first == [(77, 1.10, 0.5, 0.80)]
    assert [tuple(r)[1:] for r in hp.first_summary(pages, "macau").collect()] == [(77, 0.70, -0.5, 1.20)]


def test_analysis_score(spark):
    df = spark.createDataFrame([("a", b'<span class="row">(2-1)</span>'), ("b", b"none"), ("c", None)], "file string, content binary")
    assert [tuple(r) for r in hp.analysis_scores(df).collect()] == [("a", "2-1")]


def test_lines_of_both_maps(spark):
    words = {"受二球/二球半": -2.25, "受二球半": -2.5, "受二球半/三球": -2.75, "受三球半/四球": -3.75, "受四球": -4.0, "受四球半": -4.5, "受四球半/五球": -4.75, "受五球": -5.0, "受半/一": -0.75, "受让半球": -0.5, "四球": None, "平手": 0.0}
    df = spark.createDataFrame(list(words.items()), "w string, v double")
    assert [r for r in df.select("w", "v", odds.line_value(F.col("w")).alias("got")).collect() if r["v"] != r["got"]] == []


def test_scripts_nested_and_light(spark, tmp_path):
    (tmp_path / "epl" / "2024-2025").mkdir(parents=True)
    (tmp_path / "epl" / "2024-2025" / "1001.js").write_text(MATCH)
    (tmp_path / "7.js").write_text("nothing")
    files = mf.read_scripts(spark, str(tmp_path), folders=True)
    assert [(r["league"], r["season"]) for r in files.collect()] == [("epl", "2024")]
    assert mf.read_scripts(spark, str(tmp_path), league="serie a").count() == 0 and mf.read_scripts(spark, str(tmp_path)).count() == 2
    record = mf.nested_matches(files).first().asDict(recursive=True)
    assert record["scheduleId"] == 1001 and [b["bookmakerName"] for b in record["bookmakers"]] == ["Bet 365"]
    assert [(r["home"], r["time"], r["year"]) for r in record["bookmakers"][0]["runningOdds"]] == [("1.75", "08-20 10:00", "2024"), ("1.80", "08-22 18:50", "")]
    assert mf.nested_matches(files, ["Easybets"]).first()["bookmakers"] == [] and mf.trajectories(files, ["Easybets"]).count() == 0 and mf.trajectories(files, ["Bet 365"]).count() == 2
    assert [tuple(r) for r in mf.opening_prices(mf.read_scripts(spark, str(tmp_path))).collect()] == [(1001, "H", "G", 1.75, 3.7, 4.33)]


def test_json_files_and_sinks(spark, tmp_path):
    reading = lambda h: {"home": h, "draw": "3.1", "away": 4, "time": "t"}
    record = {"scheduleId": 5, "season": "2024", "bookmakers": [{"bookmakerName": "A", "runningOdds": [reading("2.0"), reading("封"), reading(2.5)]}, {"bookmakerName": "B", "runningOdds": [reading("2.0"), reading("-1")]}]}
    (tmp_path / "a_details.json").write_text(json.dumps([record, record | {"scheduleId": 6, "bookmakers": []}]))
    (tmp_path / "b_details.json").write_text(json.dumps({"scheduleId": 7, "bookmakerName": "C", "runningOdds": [reading(1.5), reading(1.6)]}))
    (tmp_path / "c_details.json").write_text('{"scheduleId": 8, "book')
    (tmp_path / "sax_config_bet_365.json").write_text(json.dumps({"bookmaker": "Bet 365", "strategy": "interleaved", "word_size": 6, "alphabet_size": 4, "interpolate_len": 32, "breakpoints_type": "empirical", "empirical_breakpoints": [-0.5, 0.1, 0.6], "gaussian_breakpoints": [-0.67, 0, 0.67]}))
    files = jf.read_json(spark, str(tmp_path))
    assert sorted(r["schedule_id"] for r in jf.matches(files).collect()) == ["5", "6", "7"]
    assert sorted((r["schedule_id"], r["bookmaker"], [x["home"] for x in r["readings"]]) for r in jf.valid_series(files).collect()) == [("5", "A", [2.0, 2.5]), ("7", "C", [1.5, 1.6])]
    assert jf.valid_series(files, "B").count() == 0
    assert [(r["word_size"], r["breakpoints"]) for r in jf.encoder_settings(spark, str(tmp_path)).collect()] == [(6, [-0.5, 0.1, 0.6])]
    assert {(r["kind"], r["files"]) for r in jf.inventory(spark, str(tmp_path)).collect()} == {("details", 3), ("", 1)} and jf.listed(spark, str(tmp_path), "_details.json").count() == 3
    (tmp_path / "labels.json").write_text(json.dumps([{"match_id": 1, "home_score": 2, "away_score": 1}, {"match_id": 2, "home_score": 0}, {"match_id": 3, "home_score": 0, "away_score": 0, "ground_truth": "A"}]))
    assert [(r["match_id"], r["label"]) for r in jf.labelled(jf.read_json(spark, str(tmp_path), "labels.json")).orderBy("match_id").collect()] == [(1, "H"), (2, "D"), (3, "A")]
    df = spark.createDataFrame([("A", 1), ("B", 2)], "bookmaker string, n int")
    jf.write_json(df, str(tmp_path / "out"))
    assert sorted(map(tuple, spark.read.json(str(tmp_path / "out")).select("bookmaker", "n").collect())) == [("A", 1), ("B", 2)]
    for _ in range(2):
        jf.append_log(df, str(tmp_path / "log"))
    assert spark.read.parquet(str(tmp_path / "log")).count() == 4
    assert jf.table_ddl(df, "t", ["n"]) == "CREATE TABLE IF NOT EXISTS t (\n  `bookmaker` string,\n  `n` int\n) USING parquet\nPARTITIONED BY (n)"
    assert df.select(jf.match_links(F.col("n"), "page/%d.htm").alias("u")).first()["u"] == "page/1.htm"
