"""JSON files of trajectories, labelled matches and encoder settings, and listings of files; sinks for results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegrid.operators.nested import Level, NestedTable, Way, flatten

#: A file holds one record or an array of them.
_RECORD = (Way((), array=False), Way(("*",), array=True))
_ENTRY = (Way(("bookmakers", "*"), array=False), Way((), array=False, without="bookmakers", having=("runningOdds",)))
MATCHES = NestedTable((Level("record_no", _RECORD, (("schedule_id", ("scheduleId",)), ("hometeam", ("hometeam",)), ("guestteam", ("guestteam",)), ("match_time", ("matchTime",)), ("season", ("season",)))),))
READINGS = NestedTable(
    (
        Level("record_no", _RECORD, (("schedule_id", ("scheduleId",)),)),
        Level("entry_no", _ENTRY, (("bookmaker", ("bookmakerName",)),)),
        Level("seq", (Way(("runningOdds", "*")),), (("home", ("home",)), ("draw", ("draw",)), ("away", ("away",)), ("time", ("time",)))),
    )
)
LABELLED = NestedTable((Level("record_no", _RECORD, (("match_id", ("match_id",)), ("home_score", ("home_score",)), ("away_score", ("away_score",)), ("ground_truth", ("ground_truth",)))),))


def read_json(spark: SparkSession, path: str, pattern: str = "*_details.json") -> DataFrame:
    """(file, text) of the files whose name fits; the pattern keeps settings files in the same folder out. What is no JSON
    gives no record further on."""
    df = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern).text(path, wholetext=True)
    return df.select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("text"))


def matches(files: DataFrame) -> DataFrame:
    return flatten(files, "text", MATCHES, ["file"])


def valid_series(files: DataFrame, bookmaker: str | None = None) -> DataFrame:
    """(file, schedule_id, bookmaker, readings) of entries with two readings and two valid ones: three prices that are numbers over 0."""
    rows = flatten(files, "text", READINGS, ["file"])
    rows = rows.where(F.col("bookmaker") == bookmaker) if bookmaker else rows
    price = {c: F.col(c).try_cast("double") for c in ("home", "draw", "away")}
    ok = (price["home"] > 0) & (price["draw"] > 0) & (price["away"] > 0)
    own = rows.groupBy("file", "record_no", "entry_no", "schedule_id", "bookmaker").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list(F.when(ok, F.struct("seq", *[p.alias(c) for c, p in price.items()])))).alias("readings"))
    return own.where((F.col("n") >= 2) & (F.size("readings") >= 2)).drop("n", "record_no", "entry_no")


def labelled(files: DataFrame) -> DataFrame:
    """Matches with their label: as given, else H, D or A by the scores, else D where one is missing."""
    h, a = F.col("home_score").try_cast("int"), F.col("away_score").try_cast("int")
    label = F.coalesce("ground_truth", F.when(h > a, "H").when(h < a, "A").otherwise("D"))
    return flatten(files, "text", LABELLED, ["file"]).select("file", F.col("match_id").try_cast("bigint").alias("match_id"), h.alias("home_score"), a.alias("away_score"), label.alias("label"))


SETTINGS = "bookmaker string, strategy string, word_size int, alphabet_size int, interpolate_len int, breakpoints_type string, empirical_breakpoints array<double>, gaussian_breakpoints array<double>"


def encoder_settings(spark: SparkSession, path: str) -> DataFrame:
    """The settings files ``sax_config_*.json``: a row per bookmaker, with the breakpoints its type names."""
    df = spark.read.schema(SETTINGS).option("recursiveFileLookup", True).option("pathGlobFilter", "sax_config_*.json").option("multiLine", True).json(path)
    marks = F.when(F.col("breakpoints_type") == "empirical", F.col("empirical_breakpoints")).otherwise(F.col("gaussian_breakpoints"))
    return df.where("bookmaker is not null").withColumn("breakpoints", marks)


def listed(spark: SparkSession, path: str, suffix: str = "") -> DataFrame:
    """(file, kind, bytes) of the files under ``path`` whose name ends so; contents are not read."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", f"*{suffix}").load(path)
    return df.select(F.col("path").alias("file"), F.regexp_extract("path", r"([A-Za-z]+)\.\w+$", 1).alias("kind"), F.col("length").alias("bytes"))


def inventory(spark: SparkSession, path: str) -> DataFrame:
    """Files and bytes by kind, the last word of a file's name."""
    return listed(spark, path).groupBy("kind").agg(F.count(F.lit(1)).alias("files"), F.sum("bytes").alias("bytes"))


# ---- sinks


def write_json(df: DataFrame, path: str, by: str | None = "bookmaker") -> None:
    """Results as JSON lines, a folder per value of ``by``."""
    writer = df.write.mode("overwrite")
    (writer.partitionBy(by) if by else writer).json(path)


def append_log(df: DataFrame, path: str) -> None:
    """Rows with the time of writing, appended to a log table."""
    df.withColumn("logged_at", F.current_timestamp()).write.mode("append").parquet(path)


def table_ddl(df: DataFrame, name: str, partition_by: list[str] | None = None) -> str:
    """The statement that creates a table for ``df``."""
    columns = ",\n  ".join(f"`{f.name}` {f.dataType.simpleString()}{'' if f.nullable else ' NOT NULL'}" for f in df.schema.fields)
    by = f"\nPARTITIONED BY ({', '.join(partition_by)})" if partition_by else ""
    return f"CREATE TABLE IF NOT EXISTS {name} (\n  {columns}\n) USING parquet{by}"


def match_links(match_id: Column, template: str) -> Column:
    """The page of each match; ``template`` holds ``%d`` for its number."""
    return F.format_string(template, match_id)
