"""Queries of the general problems (1, 4, 5, 6, 7) over the odds tables."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tidegrid.operators.grid import regular_grid
from tidegrid.operators.nested import Stage, flatten
from tidegrid.operators.orphans import classified, orphans
from tidegrid.operators.spikes import flag_readings, numbers
from tidegrid.operators.timestamps import OK, PLAIN_FULL, PLAIN_LOOSE, PLAIN_SHORT, created_microseconds, instants, parse_times
from tidegrid.operators.zones import current_version
from tidegrid.plans import odds_tables as tables
from tidegrid.session import table

SLOT_SECONDS = 6 * 3600


def _arrow(fields: tuple[T.StructField, ...]) -> pa.Schema:
    return to_arrow_schema(T.StructType(list(fields)))


def _batch(fields: tuple[T.StructField, ...], columns: list) -> pa.RecordBatch:
    schema = _arrow(fields)
    return pa.RecordBatch.from_arrays([(c if isinstance(c, pa.Array) else pa.array(c)).cast(f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def _times(b: pa.RecordBatch, version: str, plain: str | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return parse_times(b["time"], b["year"] if "year" in b.schema.names else None, created_microseconds(b["created_at"]), plain, version)


# ---- problem 1: irregular readings onto a regular grid

_SERIES = (T.StructField("src", T.StringType()), T.StructField("match_id", T.LongType()), T.StructField("bookmaker", T.StringType()), T.StructField("seconds", T.LongType()))
_SERIES_VALUES = (*_SERIES, T.StructField("home", T.DoubleType()), T.StructField("away", T.DoubleType()))


def _series_stage(src: str, key: str, values: bool) -> Stage:
    """Readings with an instant, as series rows; without values one per series and slot of the chunk is enough."""
    version = current_version()

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        status, epoch, _ = _times(b, version)
        match = np.asarray(b[key].fill_null(0))
        use = np.flatnonzero((status == OK) & (match != 0) & np.asarray(b["bookmaker"].is_valid()))
        if not values and len(use):
            name = np.asarray(b["bookmaker"].take(pa.array(use)).dictionary_encode().indices)
            rows = np.stack([match[use], name, epoch[use] // SLOT_SECONDS])
            use = use[np.unique(rows, axis=1, return_index=True)[1]]
        at = pa.array(use)
        columns = [pa.array([src] * len(use), pa.string()), match[use], b["bookmaker"].take(at), epoch[use]]
        if values:
            for c in ("home", "away"):
                x = numbers(b[c].take(at))
                columns.append(pa.array(x, mask=np.isnan(x)))
        return _batch(_SERIES_VALUES if values else _SERIES, columns)

    return Stage(_SERIES_VALUES if values else _SERIES, run)


def _series(spark: SparkSession, sf: str, values: bool) -> DataFrame:
    odds = flatten(table(spark, sf, "match_odds"), "payload", tables.READING_PRICES if values else tables.READING_TIMES, ["schedule_id", "created_at"], _series_stage("running_odds", "schedule_id", values))
    detail = flatten(table(spark, sf, "total_handicap"), "odds_detail", tables.DETAIL_READINGS if values else tables.DETAIL_TIMES, ["match_id", "bookmaker", "created_at"], _series_stage("odds_detail", "match_id", values))
    return odds.unionByName(detail)


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    """Empty six-hour slots strictly between the first and last reading of each series."""
    grid = regular_grid(_series(spark, sf, False), ["src", "match_id", "bookmaker"], "seconds", SLOT_SECONDS, gaps_only=True)
    return grid.select("src", "match_id", "bookmaker", "slot")


def p1_grid(spark: SparkSession, sf: str) -> DataFrame:
    """The whole grid of each series: latest home and away price per slot, short gaps interpolated, long ones marked."""
    return regular_grid(_series(spark, sf, True), ["src", "match_id", "bookmaker"], "seconds", SLOT_SECONDS, ["home", "away"], max_fill=2)


# ---- problem 4: mixed timestamp forms

_INSTANT = (T.StructField("src", T.StringType()), T.StructField("id", T.LongType()), T.StructField("bookmaker", T.StringType()), T.StructField("seq", T.IntegerType()), T.StructField("instant", T.StringType()))


def _instant_stage(src: str, plain: str, cases_only: bool) -> Stage:
    version = current_version()

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        status, epoch, is_plain = _times(b, version, plain)
        use = np.flatnonzero((status >= 0) & ~(is_plain & cases_only))
        at, n = pa.array(use), len(use)
        named = "bookmaker" in b.schema.names
        return _batch(_INSTANT, [pa.array([src] * n, pa.string()), b["id"].take(at), b["bookmaker"].take(at) if named else pa.array([""] * n, pa.string()), b["seq"].take(at) if named else np.zeros(n, np.int32), instants(status[use], epoch[use])])

    return Stage(_INSTANT, run)


def _instants(spark: SparkSession, sf: str, cases_only: bool) -> DataFrame:
    matches = table(spark, sf, "league_matches").select("id", F.col("match_time").alias("time"), "created_at")
    stage = _instant_stage("match_time", PLAIN_FULL, cases_only)
    flat = matches.mapInArrow(lambda batches: (stage.run(b) for b in batches), T.StructType(list(_INSTANT)))
    odds = flatten(table(spark, sf, "match_odds"), "payload", tables.READING_TIMES, ["id", "created_at"], _instant_stage("running_odds", PLAIN_SHORT, cases_only))
    detail = flatten(table(spark, sf, "total_handicap"), "odds_detail", tables.DETAIL_TIMES, ["id", "bookmaker", "created_at"], _instant_stage("odds_detail", PLAIN_LOOSE, cases_only))
    return flat.unionByName(odds).unionByName(detail)


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    """Times that are not in their field's plain form, as one UTC instant or the reason why there is none."""
    return _instants(spark, sf, True)


# ---- problem 5: implausible spikes


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    return flag_readings(table(spark, sf, "match_odds"), "payload", tables.READING_PRICES).select("id", "bookmaker", "seq").distinct()


def p5_flags(spark: SparkSession, sf: str) -> DataFrame:
    """Every flag of every flagged reading, the rate of change among them, with the fence it was held against."""
    return flag_readings(table(spark, sf, "match_odds"), "payload", tables.READING_PRICES, rates=True)


# ---- problem 6: references to records that do not exist

_REFERENCES = {"betting_odds": "schedule_id", "sax_encoding": "match_id", "total_handicap": "match_id"}


def _references(spark: SparkSession, sf: str) -> DataFrame:
    """The broken references of all three tables, which point at one and the same table and are looked up together."""
    rows = reduce(DataFrame.unionByName, [table(spark, sf, src).select(F.lit(src).alias("src"), "id", F.col(ref).alias("ref"), "created_at") for src, ref in _REFERENCES.items()])
    return classified(rows, ["ref"], "created_at", table(spark, sf, "league_matches"), ["match_id"], "created_at", table(spark, sf, "match_removals"), ["match_id"])


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    return _references(spark, sf).select("src", "id", "reason")


def p6_report(spark: SparkSession, sf: str) -> DataFrame:
    """Broken references per table and month of created_at."""
    month = F.date_format("created_at", "yyyy-MM")
    return _references(spark, sf).groupBy("src", month.alias("month"), "reason").agg(F.count(F.lit(1)).alias("n"))


def p6_composite(spark: SparkSession, sf: str) -> DataFrame:
    """Encodings whose (match_id, bookmaker), partly NULL, is in no row of betting_odds, under each match semantics.

    The bookmaker counts as not given (NULL) where it is the lottery, which no price table is asked about.
    """
    rows = table(spark, sf, "sax_encoding").select("id", "match_id", F.nullif("bookmaker", F.lit("Lottery Official")).alias("bookmaker"))
    odds = table(spark, sf, "betting_odds")
    found = [orphans(rows, ["match_id", "bookmaker"], odds, ["schedule_id", "bookmaker_name"], m).select(F.lit(m).alias("semantics"), "id", "null_mask") for m in ("simple", "partial", "full")]
    return reduce(DataFrame.unionByName, found)


_P6 = """
WITH first_made AS (SELECT match_id, min(created_at) AS made FROM league_matches GROUP BY match_id),
gone AS (SELECT DISTINCT match_id FROM match_removals),
refs AS (
  SELECT 'betting_odds' AS src, id, schedule_id AS ref, created_at FROM betting_odds
  UNION ALL SELECT 'sax_encoding', id, match_id, created_at FROM sax_encoding
  UNION ALL SELECT 'total_handicap', id, match_id, created_at FROM total_handicap),
judged AS (
  SELECT r.src, r.id, r.created_at,
         CASE WHEN f.match_id IS NULL AND g.match_id IS NOT NULL THEN 'deleted'
              WHEN f.match_id IS NULL THEN 'missing'
              WHEN f.made > r.created_at THEN 'late' END AS reason
  FROM refs r LEFT JOIN first_made f ON f.match_id = r.ref LEFT JOIN gone g ON g.match_id = r.ref
  WHERE r.ref IS NOT NULL)
"""


# ---- problem 7: nested records to flat tables


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    odds = flatten(table(spark, sf, "match_odds"), "payload", tables.ENTRY_COUNTS, ["id"]).select(F.lit("match_odds").alias("src"), "id", "bookmaker", "n_readings")
    detail = flatten(table(spark, sf, "total_handicap"), "odds_detail", tables.DETAIL_COUNTS, ["id", "bookmaker"]).select(F.lit("total_handicap").alias("src"), "id", "bookmaker", "n_readings")
    return odds.unionByName(detail)


def p7_records(spark: SparkSession, sf: str) -> DataFrame:
    """The record table: one row per readable payload."""
    return flatten(table(spark, sf, "match_odds"), "payload", tables.RECORDS, ["id", "schedule_id"])


def p7_entries(spark: SparkSession, sf: str) -> DataFrame:
    """The bookmaker entry table; (id) leads back to the record."""
    return flatten(table(spark, sf, "match_odds"), "payload", tables.ENTRIES, ["id", "schedule_id"])


def p7_readings(spark: SparkSession, sf: str) -> DataFrame:
    """The reading table; (id, entry_no) leads back to the entry."""
    return flatten(table(spark, sf, "match_odds"), "payload", tables.READINGS, ["id", "schedule_id"])


def p7_detail_readings(spark: SparkSession, sf: str) -> DataFrame:
    return flatten(table(spark, sf, "total_handicap"), "odds_detail", tables.DETAIL_READINGS, ["id", "match_id", "bookmaker"])


QUERIES = {
    "p1_found": p1_found,
    "p1_grid": p1_grid,
    "p4_found": p4_found,
    "p5_found": p5_found,
    "p5_flags": p5_flags,
    "p6_found": p6_found,
    "p6_report": p6_report,
    "p6_composite": p6_composite,
    "p7_found": p7_found,
    "p7_records": p7_records,
    "p7_entries": p7_entries,
    "p7_readings": p7_readings,
    "p7_detail_readings": p7_detail_readings,
}

# the texts as SQL sees them: unpacked from JSON strings, whole or not there
_TEXT = "CASE WHEN json_valid({0}) THEN trim(CASE json_type({0}) WHEN 'VARCHAR' THEN json_extract_string({0}, '$') ELSE {0} END, ' \t\r\n') END"
_WHOLE = "CASE WHEN json_valid({0}) AND json_type({0}) IN ('OBJECT', 'ARRAY') THEN CAST({0} AS JSON) END"


def _whole(column: str, source: str, carry: str) -> str:
    """``carry`` and ``j``, the JSON container in a text, however often it is packed into a string (here up to four times)."""
    q = f"SELECT {carry}, trim({column}, ' \t\r\n') AS j FROM {source}"
    for _ in range(4):
        q = f"SELECT {carry}, {_TEXT.format('j')} AS j FROM ({q}) u"
    return f"SELECT {carry}, {_WHOLE.format('j')} AS j FROM ({q}) u"


_OBJECTS = "list_filter({0}, lambda x: json_type(x) = 'OBJECT')"
_INNER = "CASE json_type({0}) WHEN 'ARRAY' THEN json_extract({0}, '$[*]') WHEN 'OBJECT' THEN json_extract({0}, '$.*') ELSE [] END"
_PAYLOADS = f"WITH p AS ({_whole('payload', 'match_odds', 'id, schedule_id')}), "
_BOX = "json_extract(j, '$.bookmakers')"
_ENTRIES = _PAYLOADS + f"""l AS (SELECT id, schedule_id, CASE WHEN json_type(j) = 'ARRAY' THEN json_extract(j, '$[*]') WHEN json_exists(j, '$.bookmakers') THEN coalesce({_INNER.format(_BOX)}, [])
   WHEN json_exists(j, '$.bookmakerName') OR json_exists(j, '$.runningOdds') THEN [j] ELSE [] END AS es FROM p WHERE j IS NOT NULL),
 u AS (SELECT id, schedule_id, unnest(es) AS e, unnest(range(len(es))) AS entry_no FROM l),
 en AS (SELECT id, schedule_id, CAST(entry_no AS INT) AS entry_no, e, coalesce({_INNER.format("json_extract(e, '$.runningOdds')")}, []) AS rs FROM u WHERE json_type(e) = 'OBJECT')"""
_DETAILS = f"""WITH d AS ({_whole('odds_detail', 'total_handicap', 'id, match_id, bookmaker')}),
 l AS (SELECT id, match_id, bookmaker, CASE json_type(j) WHEN 'ARRAY' THEN json_extract(j, '$[*]') ELSE flatten(list_transform(json_extract(j, '$.*'), lambda b: coalesce({_INNER.format('b')}, []))) END AS rs FROM d WHERE j IS NOT NULL)"""
_field = lambda of, path, name: f"json_extract_string({of}, '$.{path}') AS {name}"


def _fields(level, of: str) -> str:
    return ", ".join(_field(of, ".".join(path), name) for name, path in level.fields)


SQL = {
    "p6_found": _P6 + "SELECT src, id, reason FROM judged WHERE reason IS NOT NULL",
    "p6_report": _P6 + "SELECT src, strftime(created_at, '%Y-%m') AS month, reason, CAST(count(*) AS BIGINT) AS n FROM judged WHERE reason IS NOT NULL GROUP BY ALL",
    "p6_composite": """
WITH r AS (SELECT id, match_id AS m, CASE WHEN bookmaker <> 'Lottery Official' THEN bookmaker END AS b FROM sax_encoding),
j AS (SELECT r.*, CASE WHEN m IS NULL THEN '1' ELSE '0' END || CASE WHEN b IS NULL THEN '1' ELSE '0' END AS null_mask,
  m IN (SELECT schedule_id FROM betting_odds WHERE schedule_id IS NOT NULL) AS m_there, b IN (SELECT bookmaker_name FROM betting_odds WHERE bookmaker_name IS NOT NULL) AS b_there,
  EXISTS (SELECT 1 FROM betting_odds o WHERE o.schedule_id = r.m AND o.bookmaker_name = r.b) AS both_there FROM r),
s AS (SELECT unnest(['simple', 'partial', 'full']) AS semantics)
SELECT semantics, id, null_mask FROM j, s WHERE CASE null_mask WHEN '00' THEN NOT both_there WHEN '11' THEN false
  ELSE CASE semantics WHEN 'simple' THEN false WHEN 'full' THEN true ELSE CASE null_mask WHEN '01' THEN NOT m_there ELSE NOT b_there END END END""",
    "p7_found": _ENTRIES + f" SELECT 'match_odds' AS src, id, json_extract_string(e, '$.bookmakerName') AS bookmaker, CAST(len({_OBJECTS.format('rs')}) AS INT) AS n_readings FROM en UNION ALL SELECT 'total_handicap', id, bookmaker, CAST(n AS INT) FROM ({_DETAILS} SELECT id, bookmaker, len({_OBJECTS.format('rs')}) AS n FROM l) x",
    "p7_records": _PAYLOADS + f"r AS (SELECT * FROM p WHERE json_type(j) = 'OBJECT') SELECT id, schedule_id, {_fields(tables.RECORDS.levels[0], 'j')} FROM r",
    "p7_entries": _ENTRIES + f" SELECT id, schedule_id, entry_no, {_fields(tables.ENTRIES.levels[0], 'e')}, CAST(len({_OBJECTS.format('rs')}) AS INT) AS n_readings FROM en",
    "p7_readings": _ENTRIES + f", r AS (SELECT id, schedule_id, entry_no, e, unnest(rs) AS r, CAST(unnest(range(len(rs))) AS INT) AS seq FROM en) SELECT id, schedule_id, entry_no, {_fields(tables.READINGS.levels[0], 'e')}, seq, {_fields(tables.READINGS.levels[1], 'r')} FROM r WHERE json_type(r) = 'OBJECT'",
}
