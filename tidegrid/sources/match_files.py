"""Sources: match and league scripts, handicap pages and nested JSON files, as DataFrames.

Scripts are read whole (one row per file) and taken apart by Catalyst's string functions; nothing is evaluated. Only HTML
needs Python, batch-wise in ``mapInArrow``.
"""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegrid.functions.odds import leading_number

# Positions of the prices in an entry of ``game``.
PRICE_AT = {"init_win": 3, "init_draw": 4, "init_lose": 5, "init_return": 9, "final_win": 10, "final_draw": 11, "final_lose": 12, "final_return": 16, "kelly_win": 17, "kelly_draw": 18, "kelly_lose": 19}


def read_scripts(spark: SparkSession, path: str, pattern: str = "*.js", league: str | None = None, season: str | None = None, folders: bool = False) -> DataFrame:
    """All files under ``path`` whose name fits, one row each: file, text, file_id, and league and season (its first year) as
    its folders say. ``folders``: only files that lie in a season's folder (``2024`` or ``2024-2025``) of a league's folder."""
    df = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern).text(path, wholetext=True)
    file = F.col("_metadata.file_path")
    of = F.regexp_extract(file, r"([^\\/]+)[\\/]\d{4}(?:-\d{4})?[\\/][^\\/]+$", 1)
    df = df.select(file.alias("file"), F.col("value").alias("text"), F.nullif(of, F.lit("")).alias("league"), F.nullif(F.regexp_extract(file, r"(\d{4})(?:-\d{4})?[\\/][^\\/]+$", 1), F.lit("")).alias("season"), F.regexp_extract(file, r"(\d+)\.\w+$", 1).try_cast("bigint").alias("file_id"))
    for column, wanted in (("league", league), ("season", season)):
        df = df.where(F.col(column) == wanted) if wanted else df
    return df.where("league is not null and season is not null") if folders else df


def variable(text: Column, name: str) -> Column:
    """The value of ``var name="..."`` or ``var name=...;``; NULL where absent."""
    return F.nullif(F.regexp_extract(text, rf'(?:var\s+)?\b{name}\s*=\s*"?([^";]*)"?\s*;', 1), F.lit(""))


def entries(text: Column, name: str) -> Column:
    """The strings of ``name=Array("...","...")``, without quotes and empty ones."""
    body = F.regexp_extract(text, rf"(?s)\b{name}\s*=\s*Array\((.*?)\);", 1)
    return F.filter(F.transform(F.split(body, r'"\s*,\s*"'), lambda x: F.btrim(x, F.lit('" \n\r\t'))), lambda x: x != "")


def betting_odds(scripts: DataFrame, only: list[str] | None = None) -> DataFrame:
    """One row per bookmaker entry of each match script: entries with under 20 fields are dropped, a price 0 is NULL."""
    rows = scripts.select(variable(F.col("text"), "ScheduleID").try_cast("bigint").alias("schedule_id"), F.explode(entries(F.col("text"), "game")).alias("e"))
    rows = rows.withColumn("f", F.split("e", r"\|")).where(F.size("f") >= 20)
    rows = rows.select("schedule_id", F.get("f", F.lit(2)).alias("bookmaker_name"), *[leading_number(F.get("f", F.lit(i))).cast("decimal(5,2)").alias(c) for c, i in PRICE_AT.items()])
    return rows.where(F.col("bookmaker_name").isin(only)) if only else rows


def trajectories(scripts: DataFrame, only: list[str] | None = None) -> DataFrame:
    """One row per record of each bookmaker's history (``gameDetail``), joined to its entry by the internal id in the script;
    of the bookmakers ``only``, if given.

    The look-up stays within the row of the script, so nothing is shuffled.
    """
    game = F.transform(entries(F.col("text"), "game"), lambda e: F.split(e, r"\|"))
    rows = scripts.select(variable(F.col("text"), "ScheduleID").try_cast("bigint").alias("schedule_id"), game.alias("game"), F.explode(entries(F.col("text"), "gameDetail")).alias("d"))
    rows = rows.withColumn("internal_id", F.get(F.split("d", r"\^"), F.lit(0)))
    name = F.get(F.get(F.filter("game", lambda e: F.get(e, F.lit(1)) == F.col("internal_id")), F.lit(0)), F.lit(2))
    rows = rows.withColumn("bookmaker_name", name)
    rows = rows.where(F.col("bookmaker_name").isin(only)) if only else rows
    rows = rows.select("schedule_id", "internal_id", "bookmaker_name", F.posexplode(F.filter(F.split(F.get(F.split("d", r"\^"), F.lit(1)), ";"), lambda r: r != "")).alias("seq", "r"))
    f = F.split("r", r"\|")
    return rows.select("schedule_id", "internal_id", "bookmaker_name", "seq", *[F.get(f, F.lit(i)).alias(c) for i, c in enumerate(("home", "draw", "away", "time", "return_home", "return_draw", "return_away", "year"))])


def nested_matches(scripts: DataFrame, only: list[str] | None = None) -> DataFrame:
    """One nested record per match script: its names and time, and its bookmakers with opening and closing prices and the
    trajectory, in the layout of ``match_odds.payload``. Everything stays within the script's row."""
    text = F.col("text")
    keys = ("home", "draw", "away", "time", "return_home", "return_draw", "return_away", "year")

    def reading(r: Column) -> Column:
        f = F.split(r, r"\|")
        at = {k: F.get(f, F.lit(i)) for i, k in enumerate(keys)}
        rates = F.struct(*[at[f"return_{k}"].alias(k) for k in keys[:3]]).alias("returnRate")
        return F.struct(*[at[k].alias(k) for k in keys[:4]], rates, at["year"].alias("year"))

    details = entries(text, "gameDetail")

    def entry(e: Column) -> Column:
        f = F.split(e, r"\|")
        own = F.get(F.filter(details, lambda d: F.substring_index(d, "^", 1) == F.get(f, F.lit(1))), F.lit(0))
        history = F.filter(F.split(F.coalesce(F.get(F.split(own, r"\^"), F.lit(1)), F.lit("")), ";"), lambda r: r != "")
        prices = lambda at: F.struct(*[F.get(f, F.lit(at + i)).alias(k) for i, k in enumerate(keys[:3])])
        return F.struct(F.get(f, F.lit(0)).alias("bookmakerId"), F.get(f, F.lit(1)).alias("internalId"), F.get(f, F.lit(2)).alias("bookmakerName"), prices(3).alias("initialOdds"), prices(10).alias("finalOdds"), F.transform(history, reading).alias("runningOdds"))

    made = F.transform(F.filter(entries(text, "game"), lambda e: F.size(F.split(e, r"\|")) >= 14), entry)
    kept = F.filter(made, lambda e: e["bookmakerName"].isin(only)) if only else made
    return scripts.select(variable(text, "ScheduleID").try_cast("bigint").alias("scheduleId"), variable(text, "hometeam").alias("hometeam"), variable(text, "guestteam").alias("guestteam"), variable(text, "MatchTime").alias("matchTime"), "season", kept.alias("bookmakers"))


def opening_prices(scripts: DataFrame, bookmaker_id: int = 281) -> DataFrame:
    """The light scan for training: ids, teams and one bookmaker's opening prices; scripts without that bookmaker give no row."""
    text = F.col("text")
    entry = F.split(F.regexp_extract(text, rf'"({bookmaker_id}\|[^"]*)"', 1), r"\|")
    rows = scripts.select(variable(text, "ScheduleID").try_cast("bigint").alias("match_id"), variable(text, "hometeam").alias("home_team"), variable(text, "guestteam").alias("away_team"), *[F.get(entry, F.lit(i)).try_cast("double").alias(c) for i, c in ((3, "eu_home"), (4, "eu_draw"), (5, "eu_away"))], F.size(entry).alias("n"))
    return rows.where("match_id is not null and n >= 6").drop("n")


def league_matches(scripts: DataFrame) -> DataFrame:
    """Rows of the rounds ``jh["R_n"]`` of league scripts, with team names by id (of a repeated id the last name)."""
    fixed = F.replace(F.col("text"), F.lit("'"), F.lit('"'))
    body = F.regexp_replace(F.regexp_extract(fixed, r"(?s)arrTeam\s*=\s*(\[\[.*?\]\])\s*;", 1), r",(?=\s*[,\]])", ',""')
    teams = F.coalesce(F.from_json(body, "array<array<string>>"), F.array().cast("array<array<string>>"))
    last = F.aggregate(teams, F.create_map().cast("map<string,string>"), lambda m, t: F.map_concat(F.map_filter(m, lambda k, _: k != F.get(t, F.lit(0))), F.create_map(F.get(t, F.lit(0)), F.get(t, F.lit(1)))))
    rounds = F.regexp_extract_all(fixed, F.lit(r'(?s)jh\["R_(\d+)"\]\s*=\s*\[\[.*?\]\]\s*;'), F.lit(0))
    rows = scripts.select("season", F.regexp_extract(fixed, r'arrLeague\s*=\s*\[\s*\d+\s*,\s*"([^"]*)"', 1).alias("league_name"), last.alias("names"), F.explode(rounds).alias("r"))
    cells = F.from_json(F.regexp_replace(F.regexp_extract("r", r"(?s)=\s*(\[\[.*\]\])", 1), r",(?=\s*[,\]])", ',""'), "array<array<string>>")
    rows = rows.select("season", "league_name", "names", F.regexp_extract("r", r"R_(\d+)", 1).cast("int").alias("round"), F.explode(cells).alias("c"))

    def cell(i: int) -> Column:
        return F.get("c", F.lit(i))

    def team(i: int) -> Column:
        return F.coalesce(F.try_element_at("names", cell(i)), F.concat(F.lit("Unknown ("), cell(i), F.lit(")")))

    return rows.select(cell(0).try_cast("bigint").alias("match_id"), F.nullif(cell(1).try_cast("int"), F.lit(0)).alias("league_id"), "league_name", "season", "round", cell(3).alias("match_time"), cell(4).try_cast("int").alias("home_team_id"), team(4).alias("home_team_name"), cell(5).try_cast("int").alias("away_team_id"), team(5).alias("away_team_name"), F.nullif(cell(6), F.lit("")).alias("final_score"), F.nullif(cell(7), F.lit("")).alias("half_score"))


class _Cells(HTMLParser):
    """The rows of the table with an id: (colour, cells), a cell being (text, title, kind)."""

    def __init__(self, table_id: str):
        super().__init__()
        self.table_id, self.depth, self.rows, self.text, self.own = table_id, 0, [], None, ("", "")

    def handle_starttag(self, tag, attrs):
        of = dict(attrs)
        if tag == "table" and (self.depth or of.get("id") == self.table_id):
            self.depth += 1
        elif self.depth and tag == "tr":
            self.rows.append((of.get("bgcolor"), []))
        elif self.depth and tag in ("td", "th") and self.rows:
            self.text, self.own = [], (of.get("title"), of.get("oddstype"))

    def handle_endtag(self, tag):
        if tag == "table" and self.depth:
            self.depth -= 1
        elif tag in ("td", "th") and self.text is not None:
            self.rows[-1][1].append(("".join(self.text).strip(), *self.own))
            self.text = None

    def handle_data(self, data):
        if self.text is not None:
            self.text.append(data)


_CELL = pa.struct([("text", pa.string()), ("title", pa.string()), ("kind", pa.string())])


def html_rows(pages: DataFrame, table_id: str, encoding: str = "gb18030") -> DataFrame:
    """(file, row_no, colour, cells) of the table with ``table_id`` in pages (file, content binary); bytes are decoded as declared."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for file, content in zip(b["file"].to_pylist(), b["content"].to_pylist(), strict=True):
                parser = _Cells(table_id)
                parser.feed((content or b"").decode(encoding, "replace"))
                out += [(file, i, c, [dict(zip(("text", "title", "kind"), x, strict=True)) for x in r]) for i, (c, r) in enumerate(parser.rows)]
            kinds = (pa.string(), pa.int32(), pa.string(), pa.list_(_CELL))
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], t) for i, t in enumerate(kinds)], names=["file", "row_no", "colour", "cells"])

    return pages.select("file", "content").mapInArrow(run, "file string, row_no int, colour string, cells array<struct<text:string,title:string,kind:string>>")


def html_table(pages: DataFrame, table_id: str, encoding: str = "gb18030") -> DataFrame:
    """(file, row_no, cells) with the cells' texts only."""
    return html_rows(pages, table_id, encoding).select("file", "row_no", F.col("cells.text").alias("cells"))


def fused_cell(cell: Column) -> list[Column]:
    """Line, home and away price of a fused cell such as ``半球1.080.72``; the line may be missing."""
    pattern = r"^(.*?)(\d+\.\d{2})(\d+\.\d{2})$"
    return [F.nullif(F.regexp_extract(cell, pattern, 1), F.lit("")).alias("handicap"), F.regexp_extract(cell, pattern, 2).try_cast("double").alias("home"), F.regexp_extract(cell, pattern, 3).try_cast("double").alias("away")]


def handicap_history(pages: DataFrame, column: int | str) -> DataFrame:
    """Readings of one bookmaker of the history table; rows in play (a score with a dash) are left out.

    ``column`` is the number of its column, or the prefix of its name (such as ``36*``), by which the column is found in each
    page's header row; a page without it gives no row.
    """
    rows = html_table(pages, "oddsDetail")
    if isinstance(column, str):
        at = F.array_position(F.transform("cells", lambda c: c.startswith(column)), F.lit(True)).cast("int") - 1
        rows = rows.join(rows.where("row_no = 0").select("file", at.alias("at")).where("at >= 0"), "file")
    else:
        rows = rows.withColumn("at", F.lit(column))
    n = F.size("cells")
    rows = rows.where(n > F.col("at") + 2)
    rows = rows.where(~F.coalesce(F.contains(F.get("cells", n - 2), F.lit("-")), F.lit(False))).withColumn("cell", F.get("cells", F.col("at"))).where("cell rlike '\\\\d+\\\\.\\\\d{2}\\\\d+\\\\.\\\\d{2}$'")
    return rows.select("file", "row_no", *fused_cell(F.col("cell")), F.get("cells", n - 1).alias("time"))
