"""Handicap and analysis pages: directory scans, the summary table with its price fallbacks, history as JSON, scores."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegrid.functions.odds import MASKED, line_value, masked_bookmaker
from tidegrid.sources.match_files import handicap_history, html_rows

# Colours of the summary's rows, columns of opening and closing prices, and the attributes that mark them.
COLOURS = ["#FFFFFF", "#FAFAFA"]
OPENING, CLOSING = 3, 9
LAST, CURRENT = "wholeLastOdds", "wholeOdds"


def match_id_of(file: Column) -> Column:
    """The number before ``_total.html`` in a file's name; NULL for other names."""
    return F.regexp_extract(file, r"(?:^|[\\/])(\d+)_total\.html$", 1).try_cast("bigint")


def read_pages(spark: SparkSession, path: str, pattern: str = "*_total.html", match_id: int | None = None, limit: int | None = None) -> DataFrame:
    """Pages under ``path`` (file, match_id, content), read where the tasks are. ``limit`` takes the smallest numbers (a listing's feature)."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path)
    df = df.select(F.col("path").alias("file"), match_id_of(F.col("path")).alias("match_id"), "content").where("match_id is not null")
    df = df.where(F.col("match_id") == match_id) if match_id is not None else df
    return df.orderBy("match_id", "file").limit(limit) if limit is not None else df


def _triple(home: Column, line: Column, away: Column, ok: Column) -> Column:
    return F.when(ok, F.struct(home.alias("home"), F.nullif(line, F.lit("")).alias("line"), away.alias("away")))


def _opening(cells: Column) -> Column:
    """The opening prices: cells with a time in their title, else those marked as last, else as current, else the plain cells."""

    def cell(i: int) -> Column:
        return F.get(cells, F.lit(OPENING + i))

    def timed(i: int) -> Column:
        return F.when(F.coalesce(cell(i)["title"], F.lit("")) != "", cell(i)["text"].try_cast("double"))

    def marked(kind: str) -> Column:
        own = F.filter(cells, lambda c: c["kind"] == kind)
        at = lambda i: F.get(own, F.lit(i))["text"]
        home, away = at(0).try_cast("double"), at(2).try_cast("double")
        return _triple(home, at(1), away, (F.size(own) >= 3) & home.isNotNull() & away.isNotNull())

    plain = _triple(cell(0)["text"].try_cast("double"), cell(1)["text"], cell(2)["text"].try_cast("double"), F.size(cells) >= OPENING + 3)
    return F.coalesce(_triple(timed(0), cell(1)["text"], timed(2), timed(0).isNotNull()), marked(LAST), marked(CURRENT), plain)


def _closing(cells: Column) -> Column:
    at = lambda i: F.get(cells, F.lit(CLOSING + i))["text"]
    return _triple(at(0).try_cast("double"), at(1), at(2).try_cast("double"), F.size(cells) >= CLOSING + 3)


def summary(pages: DataFrame, encoding: str = "gb18030") -> DataFrame:
    """A row per known bookmaker's line of the summary table: opening and closing price and line. Whole triples are taken from
    the first place that has them, never parts of two."""
    rows = html_rows(pages, "odds", encoding).where(F.upper("colour").isin(COLOURS) & (F.size("cells") >= 5))
    rows = rows.withColumn("bookmaker", masked_bookmaker(F.get("cells", F.lit(1))["text"])).where("bookmaker is not null")
    rows = rows.select("file", match_id_of(F.col("file")).alias("match_id"), "bookmaker", _opening(F.col("cells")).alias("o"), _closing(F.col("cells")).alias("c"))
    return rows.select("file", "match_id", "bookmaker", F.col("o.home").alias("init_odds_home"), F.col("o.line").alias("handicap"), F.col("o.away").alias("init_odds_away"), F.col("c.line").alias("final_handicap"), F.col("c.home").alias("final_odds_home"), F.col("c.away").alias("final_odds_away"))


def histories(pages: DataFrame) -> DataFrame:
    """(file, bookmaker, odds_detail): each known bookmaker's history as a JSON array in page order, one short list per page."""
    own = [handicap_history(pages, header).withColumn("bookmaker", F.lit(key)) for key, (_, header) in MASKED.items()]
    item = F.struct("row_no", F.struct("handicap", "home", "away", "time").alias("r"))
    rows = reduce(DataFrame.unionByName, own).groupBy("file", "bookmaker").agg(F.array_sort(F.collect_list(item)).alias("rows"))
    return rows.select("file", "bookmaker", F.to_json(F.transform("rows", lambda x: x["r"])).alias("odds_detail"))


def full_records(pages: DataFrame) -> DataFrame:
    """The summary with each bookmaker's history, as the handicap table stores it."""
    return summary(pages).join(histories(pages), ["file", "bookmaker"], "left")


def first_summary(pages: DataFrame, bookmaker: str = "bet365", encoding: str = "gb18030") -> DataFrame:
    """The light scan for training: plain opening cells of the first row of one bookmaker; the line as goals, NULL if unknown."""
    rows = html_rows(pages, "odds", encoding).where(F.upper("colour").isin(COLOURS) & (F.size("cells") >= 6) & F.startswith(F.get("cells", F.lit(1))["text"], F.lit(MASKED[bookmaker][0])))
    first = rows.groupBy("file").agg(F.min_by("cells", "row_no").alias("cells"))
    text = lambda i: F.get("cells", F.lit(i))["text"]
    return first.select("file", match_id_of(F.col("file")).alias("match_id"), text(3).try_cast("double").alias("asian_home"), line_value(text(4)).alias("asian_handicap"), text(5).try_cast("double").alias("asian_away"))


def analysis_scores(pages: DataFrame) -> DataFrame:
    """(file, final_score) of analysis pages that show a score."""
    score = F.regexp_extract(F.decode("content", "UTF-8"), r'<span class="row">\((\d+-\d+)\)</span>', 1)
    return pages.select("file", F.nullif(score, F.lit("")).alias("final_score")).where("final_score is not null")
