"""The bookmaker's column of a history page is found by its name in the header row."""

from tidegrid.sources import match_files as mf


def test_column_by_header_prefix(spark):
    def page(*names):
        cell = {"36*": "平手1.080.72", "易胜*": "半球0.900.98"}
        return ("<table id='oddsDetail'><tr>" + "".join(f"<th>{n}</th>" for n in names) + "<th>比分</th><th>时间</th></tr><tr>" + "".join(f"<td>{cell[n]}</td>" for n in names) + "<td></td><td>8-20 18:22</td></tr></table>").encode("gbk")

    df = spark.createDataFrame([("a", page("36*", "易胜*")), ("b", page("易胜*", "36*")), ("c", page("易胜*")), ("d", None)], "file string, content binary")
    got = sorted((r["file"], r["handicap"], r["home"], r["away"]) for r in mf.handicap_history(df, "36*").collect())
    assert got == [("a", "平手", 1.08, 0.72), ("b", "平手", 1.08, 0.72)]
