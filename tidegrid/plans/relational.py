"""Views, filters, joins, aggregates, orders and set operations over the odds tables, as DataFrames of the library's Columns.

``relational_sql`` states each query a second time, as SQL for the oracle.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidegrid.functions import odds
from tidegrid.operators import patterns as pat
from tidegrid.operators.upsert import keep_last
from tidegrid.plans.relational_sql import ORACLE
from tidegrid.session import table

QUERIES: dict = {}
SQL: dict[str, str] = ORACLE
C = F.col


def _query(name: str):
    def add(f):
        QUERIES[name] = f
        return f

    return add


def _simple(name: str, source: str, build) -> None:
    """A query over one table."""
    QUERIES[name] = lambda spark, sf: build(table(spark, sf, source))


def latest(spark: SparkSession, sf: str) -> DataFrame:
    """The latest row of each match (keep-last upsert)."""
    return keep_last(table(spark, sf, "league_matches"), ["match_id"], [C("created_at").desc(), C("id").desc()])


def encoded(spark: SparkSession, sf: str) -> DataFrame:
    """Encodings with the outcome of their match (malformed and missing scores: NULL)."""
    scores = latest(spark, sf).select("match_id", "final_score")
    rows = table(spark, sf, "sax_encoding").select("id", "bookmaker", "match_id", C("sax_interleaved").alias("code")).join(scores, "match_id")
    return rows.withColumn("outcome", odds.outcome(C("final_score"), strict=False))


def scored(spark: SparkSession, sf: str) -> DataFrame:
    return encoded(spark, sf).where("outcome is not null and code <> ''")


def _library(spark: SparkSession, sf: str, length: int, support: int, purity: float) -> DataFrame:
    return pat.pattern_stats(scored(spark, sf).withColumn("pattern", F.substring("code", 1, length)), ["bookmaker"], "pattern", "outcome", support, purity)


def _looked_up(spark: SparkSession, sf: str, support: int, purity: float, how: str) -> DataFrame:
    """Scored encodings with what the library of three-letter patterns says of them."""
    lib = _library(spark, sf, 3, support, purity).select("bookmaker", "pattern", "dominant", C("purity").alias("lib_purity"))
    return scored(spark, sf).withColumn("pattern", F.substring("code", 1, 3)).join(lib, ["bookmaker", "pattern"], how)


def _view_result(score: Column) -> Column:
    return odds.outcome(score, ("主胜", "平局", "客胜"), malformed="平局", missing="平局", strict=False)


def _hda(score: Column) -> Column:
    return odds.outcome(score, ("H", "D", "A"), malformed="D", missing="D", strict=False)


def _prices(df: DataFrame) -> list[Column]:
    return [C(c).cast("double") for c in ("final_win", "final_draw", "final_lose")]


# ---- projections

_simple("ref_p01_view_projection", "betting_odds", lambda d: d.select(C("schedule_id").alias("match_id"), C("bookmaker_name").alias("bookmaker"), "final_win", "final_draw", "final_lose"))
_simple("ref_p02_result_case", "league_matches", lambda d: d.select("match_id", "final_score", _view_result(C("final_score")).alias("result")))
_simple("ref_p03_canonical_key", "total_handicap", lambda d: d.select("id", "match_id", odds.canonical_bookmaker(C("bookmaker")).alias("bookmaker")))
_simple("ref_p04_alias", "total_handicap", lambda d: d.select("id", odds.bookmaker_alias(C("bookmaker")).alias("bookmaker")))
_simple("ref_p05_slug", "betting_odds", lambda d: d.select("id", odds.slug(C("bookmaker_name")).alias("slug")))
_simple("ref_p06_upload_record", "sax_encoding", lambda d: d.where(odds.any_code(C("sax_interleaved"), C("sax_delta"))).select("bookmaker", "match_id", "season", "sax_interleaved", "sax_delta", "home_mean", "draw_mean", "away_mean", "running_odds_count"))
_simple("ref_p08_defaults", "league_matches", lambda d: d.select("id", F.coalesce(F.nullif("league_id", F.lit(0)), F.lit(-1)).alias("league_id"), odds.team_name(C("home_team_name"), C("home_team_id")).alias("home_team_name")))

# ---- filters

_simple("ref_f01_equality", "betting_odds", lambda d: d.where(C("bookmaker_name") == "Bet 365").select("id", "schedule_id", "final_win"))
_simple("ref_f02_price_range", "betting_odds", lambda d: d.where(C("final_win").between(F.lit("1.80").cast("decimal(5,2)"), F.lit("2.20").cast("decimal(5,2)"))).select("id", "schedule_id", "final_win"))
_simple("ref_f03_not_null", "league_matches", lambda d: d.where(C("final_score").isNotNull()).select("id", "match_id", "final_score"))
_simple("ref_f04_whitelist", "betting_odds", lambda d: d.where(C("bookmaker_name").isin(odds.WHITELIST)).select("id", "bookmaker_name"))
_simple("ref_f05_valid_prices", "betting_odds", lambda d: d.where(reduce(lambda a, b: a & b, [p > 0 for p in _prices(d)])).select("id", "final_win", "final_draw", "final_lose"))
_simple("ref_f06_min_length", "events", lambda d: d.groupBy("user_id").agg(F.count(F.lit(1)).alias("n")).where("n >= 2"))
_simple("ref_f10_nonempty_code", "sax_encoding", lambda d: d.where(odds.any_code(C("sax_interleaved"))).select("id", "sax_interleaved"))
_simple("ref_f17_minute_dedupe", "events", lambda d: d.groupBy("user_id", F.date_trunc("minute", "ts").alias("minute")).agg(F.min("event_id").alias("first_event")))


@_query("ref_f07_all_valid")
def f07(spark: SparkSession, sf: str) -> DataFrame:
    bad = F.count_if(reduce(lambda a, b: a | b, [C(c).isNull() for c in ("final_win", "final_draw", "final_lose")]))
    rows = table(spark, sf, "betting_odds").where("schedule_id is not null").groupBy("schedule_id").agg(F.count(F.lit(1)).alias("n_rows"), bad.alias("n_bad"))
    return rows.withColumn("used", (C("n_bad") == 0).cast("int"))


@_query("ref_f11_min_support")
def f11(spark: SparkSession, sf: str) -> DataFrame:
    return encoded(spark, sf).groupBy("code").agg(F.count(F.lit(1)).alias("n")).where("n >= 5")


@_query("ref_f12_purity")
def f12(spark: SparkSession, sf: str) -> DataFrame:
    found = pat.pattern_stats(scored(spark, sf).withColumnRenamed("code", "pattern"), ["bookmaker"], "pattern", "outcome", 3, 0.65)
    return found.select("bookmaker", "pattern", "total", F.round("purity", 6).alias("purity"))


def _lines(spark: SparkSession, sf: str, name: str, value: str) -> DataFrame:
    return F.broadcast(table(spark, sf, "handicap_lines").select(C("line_name").alias(name), C("line_value").alias(value)))  # 29 rows, fixed


@_query("ref_f14_line_present")
def f14(spark: SparkSession, sf: str) -> DataFrame:
    """The training filter: a line that is neither unknown nor level, and a score."""
    with_score = latest(spark, sf).where("final_score is not null").select("match_id")
    rows = table(spark, sf, "total_handicap").select("id", "match_id", "handicap").join(_lines(spark, sf, "handicap", "line_value"), "handicap").where("line_value <> 0")
    return rows.join(with_score, "match_id", "left_semi").select("id", "line_value")


@_query("ref_f15_skip_existing")
def f15(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "league_matches").select("id", "match_id").join(table(spark, sf, "total_handicap").select("match_id"), "match_id", "left_anti").select("id", "match_id")


@_query("ref_f16_predicate_text")
def f16(spark: SparkSession, sf: str) -> DataFrame:
    """A predicate typed as text: only its known parts are taken, as a real filter and order."""
    text = "select * from betting_odds where bookmaker_name = 'Bet 365' and final_win between 1.5 and 1.9 order by final_win desc"
    return pat.typed_query(table(spark, sf, "betting_odds"), text, ["final_win", "final_draw", "final_lose"], tie="id", limit=100).select("id", "bookmaker_name", "final_win")


# ---- joins


@_query("ref_j01_matches_odds")
def j01(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "betting_odds").select(C("schedule_id").alias("match_id"), "bookmaker_name", "final_win", "final_draw", "final_lose")
    m = table(spark, sf, "league_matches").select("match_id", "league_name", "season", "final_score")
    return m.join(o, "match_id").select("match_id", "league_name", "season", "bookmaker_name", "final_win", "final_draw", "final_lose", "final_score", _view_result(C("final_score")).alias("result"))


def _odds_encoding(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "betting_odds").select(C("schedule_id").alias("match_id"), C("bookmaker_name").alias("bookmaker"), "final_win")
    s = table(spark, sf, "sax_encoding").select("id", "match_id", "bookmaker", "sax_interleaved", "sax_delta")
    return o.join(s, ["match_id", "bookmaker"])


@_query("ref_j02_odds_encoding")
def j02(spark: SparkSession, sf: str) -> DataFrame:
    return _odds_encoding(spark, sf).select(C("match_id").alias("schedule_id"), C("bookmaker").alias("bookmaker_name"), "final_win", "sax_interleaved", "sax_delta")


@_query("ref_j03_encoding_results")
def j03(spark: SparkSession, sf: str) -> DataFrame:
    return _odds_encoding(spark, sf).join(table(spark, sf, "league_matches").select("match_id", "final_score"), "match_id", "left").select("id", "bookmaker", "match_id", "sax_interleaved", "final_win", "final_score")


@_query("ref_j04_encoding_handicap")
def j04(spark: SparkSession, sf: str) -> DataFrame:
    """The four-way view: prices and encodings with results and, under the canonical bookmaker, lines."""
    m = table(spark, sf, "league_matches").select("match_id", "final_score")
    h = table(spark, sf, "total_handicap").select("match_id", odds.canonical_bookmaker(C("bookmaker")).alias("bookmaker"), C("handicap").alias("init_handicap"), "final_handicap", "init_odds_home", "final_odds_home")
    return _odds_encoding(spark, sf).join(m, "match_id", "left").join(h, ["match_id", "bookmaker"], "left").drop("sax_delta")


@_query("ref_j05_attach_score")
def j05(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "sax_encoding").select("id", "match_id").join(latest(spark, sf).select("match_id", "final_score"), "match_id", "left").select("id", "match_id", "final_score")


@_query("ref_j06_common_matches")
def j06(spark: SparkSession, sf: str) -> DataFrame:
    def one(bookmaker: str, name: str) -> DataFrame:
        return table(spark, sf, "sax_encoding").where((C("bookmaker") == bookmaker) & C("match_id").isNotNull()).groupBy("match_id").agg(F.min("sax_interleaved").alias(name))

    return one("Bet 365", "code_a").join(one("Easybets", "code_b"), "match_id")


@_query("ref_j07_library_lookup")
def j07(spark: SparkSession, sf: str) -> DataFrame:
    return _looked_up(spark, sf, 5, 0.5, "left").select("id", C("dominant").alias("prediction"), "outcome")


@_query("ref_j10_team_names")
def j10(spark: SparkSession, sf: str) -> DataFrame:
    m = table(spark, sf, "league_matches")
    names = m.where("home_team_name is not null").groupBy("home_team_id").agg(F.max_by("home_team_name", F.struct("created_at", "id")).alias("name"))
    return m.select("id", "home_team_id").join(names, "home_team_id", "left").select("id", odds.team_name(C("name"), C("home_team_id")).alias("home_name"))


@_query("ref_j15_sources_by_id")
def j15(spark: SparkSession, sf: str) -> DataFrame:
    """One pass over the keys of the three sources instead of a join for each."""
    tagged = [table(spark, sf, name).select(C(key).alias("match_id"), F.lit(name).alias("src")) for name, key in (("league_matches", "match_id"), ("match_odds", "schedule_id"), ("total_handicap", "match_id"))]
    has = lambda name: F.max((C("src") == name).cast("int"))
    seen = reduce(DataFrame.unionByName, tagged).groupBy("match_id").agg(has("league_matches").alias("listed"), has("match_odds").alias("has_odds"), has("total_handicap").alias("has_handicap"))
    return seen.where("listed = 1").drop("listed")


# ---- aggregates


@_query("ref_a01_outcome_rates")
def a01(spark: SparkSession, sf: str) -> DataFrame:
    """Outcomes per bookmaker in a price range; a malformed score counts as lost, as the analyst's tally has it."""
    o = table(spark, sf, "betting_odds").where(C("final_win").between(1.5, 2.5)).select(C("schedule_id").alias("match_id"), "bookmaker_name")
    m = table(spark, sf, "league_matches").where("final_score is not null").select("match_id", odds.outcome(C("final_score"), malformed="away", strict=False).alias("r"))
    t = o.join(m, "match_id").groupBy("bookmaker_name").agg(F.count(F.lit(1)).alias("total"), *[F.count_if(C("r") == r).alias(a) for r, a in (("home", "wins"), ("draw", "draws"), ("away", "losses"))])
    return t.withColumn("win_pct", odds.percentage(C("wins"), C("total")))


@_query("ref_a03_pattern_stats")
def a03(spark: SparkSession, sf: str) -> DataFrame:
    return _library(spark, sf, 4, 3, 0.0).select("bookmaker", "pattern", "total", "home", "draw", "away", F.round("purity", 6).alias("purity"), "dominant")


@_query("ref_a04_strategy_summary")
def a04(spark: SparkSession, sf: str) -> DataFrame:
    s = pat.strategy_summary(_library(spark, sf, 4, 3, 0.0), ["bookmaker"])
    return s.select("bookmaker", "n_patterns", "supported", *[F.round(c, 6).alias(c) for c in ("top_purity", "top_coverage")], "n_pure", F.round("pure_coverage", 6).alias("pure_coverage"))


@_query("ref_a05_coverage_of_all")
def a05(spark: SparkSession, sf: str) -> DataFrame:
    ranked = pat.ranked(_library(spark, sf, 4, 3, 0.0), ["bookmaker"], [C("total").desc(), C("purity").desc(), C("pattern")]).where("r <= 20").groupBy("bookmaker").agg(F.sum("total").alias("covered"))
    n = scored(spark, sf).groupBy("bookmaker").agg(F.count(F.lit(1)).alias("matches"))
    return ranked.join(n, "bookmaker").select("bookmaker", F.round(C("covered") / C("matches"), 6).alias("coverage"))


@_query("ref_a06_two_level_patterns")
def a06(spark: SparkSession, sf: str) -> DataFrame:
    """Coarse patterns that are pure enough, and fine ones within the coarse patterns that are not."""
    rows = scored(spark, sf).withColumn("coarse", F.substring("code", 1, 2)).withColumn("fine", F.substring("code", 1, 4))
    return pat.two_levels(rows, ["bookmaker"], "coarse", "fine", "outcome", 5, 0.7, 0.65).select("level", "bookmaker", "pattern", "total", F.round("purity", 6).alias("purity"), "dominant")


@_query("ref_a07_library_accuracy")
def a07(spark: SparkSession, sf: str) -> DataFrame:
    right = F.count_if(C("dominant") == C("outcome"))
    return _looked_up(spark, sf, 5, 0.45, "left").groupBy("bookmaker").agg(F.count(F.lit(1)).alias("matches"), F.count("dominant").alias("covered"), right.alias("right_ones"), F.count_if(C("lib_purity") >= 0.70).alias("high_confidence"))


@_query("ref_a08_fusion")
def a08(spark: SparkSession, sf: str) -> DataFrame:
    lib = _library(spark, sf, 3, 5, 0.45).select("bookmaker", "pattern", "dominant")
    one = scored(spark, sf).groupBy("bookmaker", "match_id").agg(F.min("code").alias("code"), F.min("outcome").alias("outcome")).withColumn("pattern", F.substring("code", 1, 3)).join(lib, ["bookmaker", "pattern"], "left")
    return pat.fusion(one.where("bookmaker = 'Bet 365'"), one.where("bookmaker = 'Easybets'"), "match_id", "dominant", "outcome")


_simple("ref_a09_tallies", "league_matches", lambda d: d.groupBy("league_name", "season").agg(F.count(F.lit(1)).alias("n")))


@_query("ref_a10_top_words")
def a10(spark: SparkSession, sf: str) -> DataFrame:
    """The five most frequent words per bookmaker; of equally frequent ones those seen first."""
    words = table(spark, sf, "sax_encoding").where("sax_interleaved is not null").groupBy("bookmaker", C("sax_interleaved").alias("code")).agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first_seen"))
    return pat.ranked(words, ["bookmaker"], [C("n").desc(), C("first_seen")]).where("r <= 5").select("bookmaker", "code", "n")


@_query("ref_a11_profile")
def a11(spark: SparkSession, sf: str) -> DataFrame:
    """Clusters (here of a bookmaker's words by their first letter): size, most frequent prefixes, mean of the prices that are not 0."""
    priced = table(spark, sf, "betting_odds").groupBy(C("schedule_id").alias("match_id"), C("bookmaker_name").alias("bookmaker")).agg(*[F.max_by(c, "id").alias(c) for c in ("final_win", "final_draw", "final_lose")])
    rows = table(spark, sf, "sax_encoding").where("sax_interleaved <> ''").select("id", "bookmaker", "match_id", C("sax_interleaved").alias("code"), F.substring("sax_interleaved", 1, 1).alias("cluster"))
    return pat.cluster_profile(rows.join(priced, ["match_id", "bookmaker"], "left"), ["bookmaker", "cluster"], "code", ["final_win", "final_draw", "final_lose"], prefix=8, top=5)


@_query("ref_a12_prefix_rates")
def a12(spark: SparkSession, sf: str) -> DataFrame:
    """Win rates of eight-letter prefixes with ten rows or more; rows without a result count in the total."""
    return pat.prefix_rates(encoded(spark, sf).where("code is not null"), "code", "outcome", prefix=8, least=10)


_simple("ref_a13_series_stats", "events", lambda d: d.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 3).alias("mean"), F.round(F.stddev_pop("value"), 3).alias("dev")))
_simple("ref_a14_length_percentiles", "events", lambda d: pat.length_percentiles(d.groupBy("user_id").agg(F.count(F.lit(1)).cast("double").alias("n")), [], "n").select("p25", "p50", "p75", "p90", F.round("mean", 6).alias("mean"), C("longest").cast("bigint").alias("longest")))
_simple("ref_a19_recommendation", "sax_encoding", lambda d: pat.recommended(pat.length_percentiles(d.select("bookmaker", C("running_odds_count").cast("double").alias("n")), ["bookmaker"], "n"), ["bookmaker"]))
_simple("ref_a21_pooled", "events", lambda d: d.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 6).alias("mean"), F.round(F.stddev_pop("value"), 6).alias("dev"), F.min("value").alias("low"), F.max("value").alias("high")))


@_query("ref_a24_accuracy")
def a24(spark: SparkSession, sf: str) -> DataFrame:
    return _looked_up(spark, sf, 5, 0.0, "inner").groupBy("bookmaker").agg(F.round(F.avg((C("dominant") == C("outcome")).cast("double")), 6).alias("accuracy"))


@_query("ref_a25_threshold_accuracy")
def a25(spark: SparkSession, sf: str) -> DataFrame:
    """Accuracy of predictions at least so sure; each row counts for every threshold it reaches."""
    reached = F.explode(F.filter(F.array(*[F.lit(t) for t in (0.3, 0.4, 0.5, 0.6, 0.7)]), lambda t: C("lib_purity") >= t)).alias("threshold")
    return _looked_up(spark, sf, 3, 0.0, "inner").select(reached, (C("dominant") == C("outcome")).cast("double").alias("hit")).groupBy("threshold").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("hit"), 6).alias("accuracy"))


_simple("ref_a26_label_tallies", "league_matches", lambda d: d.select(_hda(C("final_score")).alias("r")).agg(*[F.count_if(C("r") == r).alias(r.lower()) for r in "HDA"]))
_simple("ref_a27_row_count", "betting_odds", lambda d: d.agg(F.count(F.lit(1)).alias("n")))


@_query("ref_a28_best_strategy")
def a28(spark: SparkSession, sf: str) -> DataFrame:
    """The pattern length whose twenty best patterns are purest, cover most and are most often very pure."""
    rows = scored(spark, sf).select("outcome", F.explode(F.array(*[F.struct(F.lit(n).alias("strategy"), F.substring("code", 1, n).alias("pattern")) for n in (2, 3, 4, 5)])).alias("s")).select("outcome", "s.*")
    return pat.best_strategy(pat.strategy_summary(pat.pattern_stats(rows, ["strategy"], "pattern", "outcome", 5, 0.0), ["strategy"]), "strategy")


_simple("ref_a29_bookmakers", "betting_odds", lambda d: d.select("bookmaker_name").distinct())

# ---- sequences


@_query("ref_w01_previous_gap")
def w01(spark: SparkSession, sf: str) -> DataFrame:
    at = F.unix_seconds(C("ts").cast("timestamp"))
    gap = at - F.lag(at).over(Window.partitionBy("user_id").orderBy(at, "event_id"))
    return table(spark, sf, "events").select("event_id", F.round(gap / 3600, 6).alias("gap_hours"))


@_query("ref_w02_change_runs")
def w02(spark: SparkSession, sf: str) -> DataFrame:
    prev = F.lag("event_type").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return table(spark, sf, "events").select("user_id", (prev.isNotNull() & (prev != C("event_type"))).alias("changed")).groupBy("user_id").agg(F.count_if("changed").alias("changes"))


@_query("ref_w05_cycle_predictor")
def w05(spark: SparkSession, sf: str) -> DataFrame:
    """H, D, A in turn within each league, however large it is: positions are counted in blocks of ids."""
    at = pat.position(table(spark, sf, "league_matches").select("id", "league_id"), ["league_id"], "id")
    return at.select("id", F.element_at(F.array(F.lit("H"), F.lit("D"), F.lit("A")), (F.pmod(C("position"), F.lit(3)) + 1).cast("int")).alias("predicted"))


@_query("ref_w06_lag_predictor")
def w06(spark: SparkSession, sf: str) -> DataFrame:
    """The label after the previous match's in the league; the first match's own."""
    rows = pat.previous(table(spark, sf, "league_matches").select("id", "league_id", _hda(C("final_score")).alias("r")), ["league_id"], "id", "r")
    after = F.when(C("previous") == "H", "D").when(C("previous") == "D", "A").when(C("previous") == "A", "H")
    return rows.select("id", F.coalesce(after, C("r")).alias("predicted"))


@_query("ref_w07_pattern_rank")
def w07(spark: SparkSession, sf: str) -> DataFrame:
    return pat.ranked(_library(spark, sf, 4, 3, 0.0), ["bookmaker"], pat.purest()).where("r <= 20").select("bookmaker", "pattern", "r")


QUERIES["ref_w09_keep_last"] = lambda spark, sf: latest(spark, sf).select("id", "match_id", "final_score")

# ---- orders and limits (limits are the feature here)


@_query("ref_t01_latest_odds")
def t01(spark: SparkSession, sf: str) -> DataFrame:
    m = table(spark, sf, "league_matches").select("match_id", "created_at", C("id").alias("lm_id"))
    o = table(spark, sf, "betting_odds").select(C("schedule_id").alias("match_id"), "bookmaker_name", "id")
    return m.join(o, "match_id").orderBy(C("created_at").desc(), "bookmaker_name", "id", "lm_id").limit(100).select("match_id", "bookmaker_name", "id")


@_query("ref_t04_multi_key")
def t04(spark: SparkSession, sf: str) -> DataFrame:
    found = _library(spark, sf, 4, 3, 0.0).orderBy(C("purity").desc(), C("total").desc(), "bookmaker", "pattern").limit(20)
    return found.select("bookmaker", "pattern", "total", F.round("purity", 6).alias("purity"))


_simple("ref_t06_limit", "league_matches", lambda d: d.select("match_id", "id").orderBy("match_id", "id").limit(100))
_simple("ref_t07_dynamic_order", "betting_odds", lambda d: d.where("final_win is not null").orderBy(C("final_win").desc(), "id").limit(50).select("id", "final_win"))
_simple("ref_t10_numeric_order", "league_matches", lambda d: d.where("season is not null").select("season", "id").orderBy(F.substring("season", 1, 4).try_cast("int"), "id").limit(20))

# ---- sets


@_query("ref_u01_union_all")
def u01(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "betting_odds")
    return o.where(C("final_win").between(1.8, 2.0)).select("id", "schedule_id").unionByName(o.where(C("init_win").between(1.8, 2.0)).select("id", "schedule_id"))


@_query("ref_u03_union")
def u03(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "betting_odds").select(C("bookmaker_name").alias("name")).distinct().union(table(spark, sf, "sax_encoding").select("bookmaker").distinct()).distinct()


@_query("ref_u04_intersect")
def u04(spark: SparkSession, sf: str) -> DataFrame:
    of = lambda b: table(spark, sf, "sax_encoding").where(C("bookmaker") == b).select("match_id")
    return of("Bet 365").intersect(of("Easybets"))


@_query("ref_u05_except")
def u05(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "league_matches").select("match_id").subtract(table(spark, sf, "total_handicap").select("match_id"))


# ---- scalar functions

_simple("ref_r08_score_goals", "league_matches", lambda d: d.select("id", *[g.alias(a) for g, a in zip(odds.goals(C("final_score"), strict=False), ("home_goals", "away_goals"))]))
_simple("ref_r09_labels", "league_matches", lambda d: d.select("id", odds.outcome(C("final_score"), strict=False).alias("outcome"), _hda(C("final_score")).alias("hda"), odds.outcome(C("final_score"), ("胜", "平", "负"), strict=False).alias("short")))
_simple("ref_r14_prefix", "sax_encoding", lambda d: d.select("id", F.substring("sax_interleaved", 1, 8).alias("prefix"), F.concat("sax_interleaved", "sax_delta").alias("code")))
_simple("ref_m01_implied", "betting_odds", lambda d: d.select("id", F.round(odds.implied(C("final_win").cast("double")), 6).alias("p")))
_simple("ref_m02_margin_free", "betting_odds", lambda d: d.select("id", *[F.round(p, 6).alias(a) for p, a in zip(odds.margin_free(*_prices(d)), ("p_home", "p_draw", "p_away"))], F.round(odds.overround(*_prices(d)), 6).alias("overround")))
_simple("ref_m03_two_way", "betting_odds", lambda d: d.select("id", *[F.round(p, 9).alias(a) for p, a in zip(odds.two_way(C("final_win").cast("double"), C("final_lose").cast("double")), ("p_home", "p_away"))]))


@_query("ref_m05_cover")
def m05(spark: SparkSession, sf: str) -> DataFrame:
    h, a = odds.goals(C("final_score"), strict=False)
    rows = table(spark, sf, "total_handicap").select("id", "match_id", "final_handicap").join(latest(spark, sf).select("match_id", h.alias("h"), a.alias("a")), "match_id")
    return rows.join(_lines(spark, sf, "final_handicap", "v"), "final_handicap", "left").select("id", odds.cover(C("h"), C("a"), C("v")).alias("cover"))


@_query("ref_m06_rule_prediction")
def m06(spark: SparkSession, sf: str) -> DataFrame:
    """Prediction and reasons of each row: by its line's move and water, else by how often the home side won with its opening line."""
    lines = table(spark, sf, "total_handicap").select("id", "match_id", "handicap", "final_handicap", "init_odds_home", "final_odds_home")
    lines = lines.join(_lines(spark, sf, "handicap", "iv"), "handicap", "left").join(_lines(spark, sf, "final_handicap", "fv"), "final_handicap", "left")
    won = lines.select("match_id", "handicap").join(latest(spark, sf).select("match_id", odds.outcome(C("final_score"), strict=False).alias("outcome")).where("outcome is not null"), "match_id")
    rates = F.broadcast(won.join(_lines(spark, sf, "handicap", "iv"), "handicap").groupBy("iv").agg(F.avg((C("outcome") == "home").cast("double")).alias("rate")))  # a row per listed line
    direction, water = odds.line_move(C("iv"), C("fv")), odds.water_change(C("init_odds_home").cast("double"), C("final_odds_home").cast("double"))
    rows = lines.join(rates, "iv", "left").withColumns({"direction": direction, "water": water})
    return rows.select("id", odds.rule_prediction(C("direction"), C("water"), C("rate")).alias("prediction"), odds.rule_reasons(C("direction"), C("water"), C("rate")).alias("reasons"))


@_query("ref_m12_support_threshold")
def m12(spark: SparkSession, sf: str) -> DataFrame:
    return _library(spark, sf, 2, 1, 0.0).select("bookmaker", "pattern", "total", odds.support_threshold(C("total")).alias("threshold"))


@_query("ref_x23_truncated_match")
def x23(spark: SparkSession, sf: str) -> DataFrame:
    """What the library says of a code by its longest known prefix of four, three or two letters."""
    found = scored(spark, sf)
    for n in (4, 3, 2):
        found = found.withColumn(f"pattern{n}", F.substring("code", 1, n)).join(_library(spark, sf, n, 5, 0.5).select("bookmaker", C("pattern").alias(f"pattern{n}"), C("dominant").alias(f"says{n}")), ["bookmaker", f"pattern{n}"], "left")
    return found.select("id", F.coalesce("says4", "says3", "says2").alias("prediction"), F.when(C("says4").isNotNull(), 4).when(C("says3").isNotNull(), 3).when(C("says2").isNotNull(), 2).alias("letters"))


@_query("ref_x24_majority_vote")
def x24(spark: SparkSession, sf: str) -> DataFrame:
    """The outcome that most bookmakers' libraries predict for a match (ties: home, draw, away), if at least two do so."""
    said = _looked_up(spark, sf, 5, 0.45, "inner").groupBy("match_id", "bookmaker").agg(F.min("dominant").alias("says"))
    votes = said.groupBy("match_id").agg(*[F.count_if(C("says") == o).alias(o) for o in ("home", "draw", "away")])
    return votes.where(F.greatest("home", "draw", "away") >= 2).select("match_id", pat.dominant().alias("prediction"), F.greatest("home", "draw", "away").alias("votes"))
