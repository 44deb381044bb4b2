"""Series kernels, similarity search, profiling, as-of and upsert queries, each with an independent DuckDB twin."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidegrid.functions import odds, series, trajectories
from tidegrid.operators import asof, density, profile, skew, upsert
from tidegrid.operators.reading_lists import reading_lists
from tidegrid.plans import odds_tables
from tidegrid.session import table

WORD, ALPHABET, LENGTH = 8, 7, 32
QUERIES: dict = {}
SQL: dict[str, str] = {}


def _query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


# ---- arrays: embeddings as series of 64 values, three parallel series of the lines of an order


def _vectors(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("x"))


_V = "SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings"


def _d_z(x: str) -> str:
    mean = f"(list_sum({x}) / len({x}))"
    dev = f"sqrt(list_sum(list_transform({x}, lambda u: (u - {mean}) * (u - {mean}))) / len({x}))"
    return f"list_transform({x}, lambda v: CASE WHEN {dev} = 0 THEN v - {mean} ELSE (v - {mean}) / {dev} END)"


def _d_paa(x: str, t: int) -> str:
    return f"list_transform(range(0, {t}), lambda i: list_sum({x}[CAST(floor(i * (len({x}) / {t}.0)) AS INT) + 1 : CAST(floor((i + 1) * (len({x}) / {t}.0)) AS INT)]) / (CAST(floor((i + 1) * (len({x}) / {t}.0)) AS INT) - CAST(floor(i * (len({x}) / {t}.0)) AS INT)))"


def _d_letters(x: str, marks: list[float]) -> str:
    inside = " + ".join(f"CASE WHEN v >= {b!r} THEN 1 ELSE 0 END" for b in marks)
    return f"array_to_string(list_transform({x}, lambda v: chr(97 + {inside})), '')"


_GAUSS = series.gaussian_breakpoints(ALPHABET)


def _flat(df: DataFrame, key: str, x: Column, digits: int = 4) -> DataFrame:
    return df.select(key, F.posexplode(x).alias("i", "v")).select(key, "i", (F.round("v", digits) + F.lit(0.0)).alias("v"))


def _d_flat(key: str, source: str, x: str) -> str:
    return f"SELECT {key}, CAST(i AS INT) AS i, round(y[i + 1], 4) + 0.0 AS v FROM (SELECT {key}, y, unnest(range(0, len(y))) AS i FROM (SELECT {key}, {x} AS y FROM ({source}) s) a) b"


@_query("ref_x02_zscore", _d_flat("vec_id", _V, _d_z("x")))
def x02(spark: SparkSession, sf: str) -> DataFrame:
    return _flat(_vectors(spark, sf), "vec_id", series.zscore(F.col("x")))


@_query("ref_x03_paa", _d_flat("vec_id", _V, _d_paa("x", 7)))
def x03(spark: SparkSession, sf: str) -> DataFrame:
    return _flat(_vectors(spark, sf), "vec_id", series.paa(F.col("x"), 7))


@_query("ref_x04_upsample", _d_flat("vec_id", _V, "list_transform(range(0, 100), lambda i: x[CAST(floor(i * ((len(x) - 1) / 99.0)) AS INT) + 1] + (x[least(CAST(floor(i * ((len(x) - 1) / 99.0)) AS INT) + 2, len(x))] - x[CAST(floor(i * ((len(x) - 1) / 99.0)) AS INT) + 1]) * (i * ((len(x) - 1) / 99.0) - floor(i * ((len(x) - 1) / 99.0))))"))
def x04(spark: SparkSession, sf: str) -> DataFrame:
    return _flat(_vectors(spark, sf), "vec_id", series.upsample(F.col("x"), 100))


@_query("ref_x05_gather", _d_flat("vec_id", _V, "list_transform(range(0, 10), lambda i: x[CASE WHEN i = 9 THEN len(x) ELSE CAST(floor(i * ((len(x) - 1) / 9.0)) AS INT) + 1 END])"))
def x05(spark: SparkSession, sf: str) -> DataFrame:
    return _flat(_vectors(spark, sf), "vec_id", series.gather(F.col("x"), 10))


_WORDS = f"SELECT vec_id, label, {_d_letters('p', _GAUSS)} AS word FROM (SELECT vec_id, label, {_d_paa('z', WORD)} AS p FROM (SELECT vec_id, label, {_d_z('r')} AS z FROM (SELECT vec_id, label, {_d_paa('x', LENGTH)} AS r FROM ({_V}) a) b) c) d"


def _words(spark: SparkSession, sf: str) -> DataFrame:
    return _vectors(spark, sf).select("vec_id", "label", series.sax_word(F.col("x"), WORD, _GAUSS, LENGTH).alias("word"))


@_query("ref_x07_sax_word", f"SELECT vec_id, word FROM ({_WORDS}) w")
def x07(spark: SparkSession, sf: str) -> DataFrame:
    return _words(spark, sf).select("vec_id", "word")


@_query("ref_x08_sax_pick", f"SELECT vec_id, {_d_letters('p', _GAUSS)} AS word FROM (SELECT vec_id, list_transform(range(0, 8), lambda i: z[CASE WHEN i = 7 THEN len(z) ELSE CAST(floor(i * ((len(z) - 1) / 7.0)) AS INT) + 1 END]) AS p FROM (SELECT vec_id, {_d_z('x')} AS z FROM ({_V}) a) b) c")
def x08(spark: SparkSession, sf: str) -> DataFrame:
    return _vectors(spark, sf).select("vec_id", series.sax_pick(series.zscore(F.col("x")), WORD, _GAUSS, 64).alias("word"))


@_query("ref_flagship_word_purity", f"SELECT substring(word, 1, 2) AS pattern, count(*) AS total, CAST(max(n) AS BIGINT) AS top, round(max(n) / sum(n), 6) AS purity FROM (SELECT word, label, count(*) OVER (PARTITION BY substring(word, 1, 2), label) AS n FROM ({_WORDS}) w) x GROUP BY substring(word, 1, 2)".replace("max(n) / sum(n)", "max(n) / count(*)"))
def flagship(spark: SparkSession, sf: str) -> DataFrame:
    """SAX words of all vectors, grouped by their first letters: how purely does a pattern tell the label?"""
    counted = _words(spark, sf).groupBy(F.substring("word", 1, 2).alias("pattern"), "label").agg(F.count(F.lit(1)).alias("n"))
    return counted.groupBy("pattern").agg(F.sum("n").alias("total"), F.max("n").alias("top"), F.round(F.max("n") / F.sum("n"), 6).alias("purity"))


def _lines(spark: SparkSession, sf: str) -> DataFrame:
    """Three parallel series per order; an order has few lines, so its arrays are small."""
    rows = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount"))).alias("r"))
    return rows.select("l_orderkey", *[F.col(f"r.{c}").alias(a) for c, a in (("l_quantity", "h"), ("l_extendedprice", "d"), ("l_discount", "a"))])


_L = "SELECT l_orderkey, list(l_quantity ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount) AS h, list(l_extendedprice ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount) AS d, list(l_discount ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount) AS a FROM lineitem GROUP BY l_orderkey"


@_query("ref_y02_interleave", _d_flat("l_orderkey", _L, "flatten(list_transform(range(1, len(h) + 1), lambda i: [h[i], d[i], a[i]]))"))
def y02(spark: SparkSession, sf: str) -> DataFrame:
    return _flat(_lines(spark, sf), "l_orderkey", series.interleave(F.col("h"), F.col("d"), F.col("a")))


@_query("ref_y03_delta", _d_flat("l_orderkey", _L, "list_transform(range(1, len(h) + 1), lambda i: h[i] - a[i])"))
def y03(spark: SparkSession, sf: str) -> DataFrame:
    return _flat(_lines(spark, sf), "l_orderkey", series.delta(F.col("h"), F.col("a")))


@_query("ref_y04_draw_deviation", _d_flat("l_orderkey", _L, "list_transform(range(1, len(h) + 1), lambda i: d[i] - (h[i] + a[i]) / 2)"))
def y04(spark: SparkSession, sf: str) -> DataFrame:
    return _flat(_lines(spark, sf), "l_orderkey", series.draw_deviation(F.col("h"), F.col("d"), F.col("a")))


def _d_up(x: str, n: int) -> str:
    at = f"(i * ((len({x}) - 1) / {n - 1}.0))"
    return f"list_transform(range(0, {n}), lambda i: {x}[CAST(floor{at} AS INT) + 1] + ({x}[least(CAST(floor{at} AS INT) + 2, len({x}))] - {x}[CAST(floor{at} AS INT) + 1]) * ({at} - floor{at}))"


def _d_pick(x: str, n: int) -> str:
    return f"list_transform(range(0, {n}), lambda i: {x}[CASE WHEN i = {n - 1} THEN len({x}) ELSE CAST(floor(i * ((len({x}) - 1) / {n - 1}.0)) AS INT) + 1 END])"


def _d_length(x: str, n: int) -> str:
    return f"CASE WHEN len({x}) = {n} THEN {x} WHEN len({x}) < {n} THEN {_d_up(x, n)} ELSE {_d_paa(x, n)} END"


def _d_stages(source: str, *stages: dict[str, str]) -> str:
    """Nested selects: each stage adds columns to those before."""
    for k, stage in enumerate(stages):
        source = "SELECT *, " + ", ".join(f"{e} AS {a}" for a, e in stage.items()) + f" FROM ({source}) stage_{k}"
    return source


_SERIES = {"j": "flatten(list_transform(range(1, len(h) + 1), lambda i: [h[i], d[i], a[i]]))", "e": "list_transform(range(1, len(h) + 1), lambda i: h[i] - a[i])", "w": "list_transform(range(1, len(h) + 1), lambda i: d[i] - (h[i] + a[i]) / 2)"}
_X10_MARKS = series.gaussian_breakpoints(3)
_X10 = _d_stages(
    f"SELECT * FROM ({_L}) l WHERE len(h) >= 2", _SERIES, {f"{c}1": _d_length(c, 12 if c == "j" else 4) for c in "hdajew"}, {f"{c}2": _d_z(f"{c}1") for c in "hdajew"},
    {f"{c}3": _d_paa(f"{c}2", 4) for c in "hdajew"}, {f"{c}4": _d_letters(f"{c}3", _X10_MARKS) for c in "hdajew"},
)


@_query("ref_x10_strategies", f"SELECT l_orderkey, unnest(['home_only', 'draw_only', 'away_only', 'interleaved', 'delta', 'delta_draw', 'individual']) AS strategy, unnest([h4, d4, a4, j4, e4, e4 || w4, h4 || d4 || a4]) AS code FROM ({_X10}) x")
def x10(spark: SparkSession, sf: str) -> DataFrame:
    """Words of all strategies at once: interleaved, delta, delta_draw, individual and single sides."""
    h, d, a = F.col("h"), F.col("d"), F.col("a")
    w, bps = 4, _X10_MARKS
    one = {n: series.sax_word(x, w, bps, w) for n, x in (("home_only", h), ("draw_only", d), ("away_only", a))}
    codes = one | {"interleaved": series.sax_word(series.interleave(h, d, a), w, bps, 3 * w), "delta": series.sax_word(series.delta(h, a), w, bps, w), "delta_draw": F.concat(series.sax_word(series.delta(h, a), w, bps, w), series.sax_word(series.draw_deviation(h, d, a), w, bps, w)), "individual": F.concat(*one.values())}
    strategies = F.explode(F.array(*[F.struct(F.lit(n).alias("strategy"), c.alias("code")) for n, c in codes.items()])).alias("s")
    return _lines(spark, sf).where(F.size("h") >= 2).select("l_orderkey", strategies).select("l_orderkey", "s.strategy", "s.code")


_BATCH = _d_stages(
    f"SELECT * FROM ({_L}) l WHERE len(h) >= 2", {f"{c}1": _d_pick(c, 20) for c in "hda"}, {f"{c}2": _d_z(f"{c}1") for c in "hda"},
    {"j2": "flatten(list_transform(range(1, 21), lambda i: [h2[i], d2[i], a2[i]]))", "e2": "list_transform(range(1, 21), lambda i: h2[i] - a2[i])"},
    {f"{c}3": _d_pick(f"{c}2", 6) for c in "hdaje"}, {f"{c}4": _d_letters(f"{c}3", series.gaussian_breakpoints(4)) for c in "hdaje"},
)


@_query("ref_x11_batch_resample", _d_flat("l_orderkey", f"SELECT l_orderkey, h2 AS x FROM ({_BATCH}) b", "x"))
def x11(spark: SparkSession, sf: str) -> DataFrame:
    return _flat(_lines(spark, sf).where(F.size("h") >= 2), "l_orderkey", series.batch_resample(F.col("h")))


@_query("ref_x12_batch_individual", f"SELECT l_orderkey, h4 AS sax_home, d4 AS sax_draw, a4 AS sax_away, round(list_sum(h) / len(h), 3) AS home_mean, round(sqrt(list_sum(list_transform(h, lambda u: (u - list_sum(h) / len(h)) * (u - list_sum(h) / len(h)))) / len(h)), 3) AS home_dev, len(h) AS n FROM ({_BATCH}) b")
def x12(spark: SparkSession, sf: str) -> DataFrame:
    """One word per side from twenty picked points, with mean and deviation of the raw series."""
    words = series.batch_words(F.col("h"), F.col("d"), F.col("a"), 6, series.gaussian_breakpoints(4))
    mean, dev = series.mean_dev(F.col("h"))
    return _lines(spark, sf).where(F.size("h") >= 2).select("l_orderkey", *[words[c].alias(c) for c in ("sax_home", "sax_draw", "sax_away")], mean.alias("home_mean"), dev.alias("home_dev"), F.size("h").cast("bigint").alias("n"))


@_query("ref_x13_batch_joint", f"SELECT l_orderkey, j4 AS sax_interleaved, e4 AS sax_delta, CAST(NULL AS VARCHAR) AS no_delta FROM ({_BATCH}) b")
def x13(spark: SparkSession, sf: str) -> DataFrame:
    """The interleaved word and the difference's, which the interleaved-only strategy leaves out."""
    both, only = (series.batch_words(F.col("h"), F.col("d"), F.col("a"), 6, series.gaussian_breakpoints(4), joint) for joint in (False, True))
    return _lines(spark, sf).where(F.size("h") >= 2).select("l_orderkey", both["sax_interleaved"].alias("sax_interleaved"), both["sax_delta"].alias("sax_delta"), only["sax_delta"].alias("no_delta"))


@_query("ref_x09_free_word", f"SELECT vec_id, {_d_letters('p', _GAUSS)} AS word FROM (SELECT vec_id, {_d_paa('z', WORD)} AS p FROM (SELECT vec_id, {_d_z('x')} AS z FROM ({_V}) a) b) c")
def x09(spark: SparkSession, sf: str) -> DataFrame:
    return _vectors(spark, sf).select("vec_id", series.sax_free(F.col("x"), WORD, _GAUSS).alias("word"))


@_query("ref_w04_change_points", f"""WITH RECURSIVE s AS (SELECT vec_id, x, 0 AS i, x[1] AS prev, false AS hit FROM ({_V}) v
  UNION ALL SELECT vec_id, x, i + 1, CASE WHEN abs(x[i + 1] - prev) > 0.1 THEN x[i + 1] ELSE prev END, abs(x[i + 1] - prev) > 0.1 FROM s WHERE i < len(x))
  SELECT vec_id, CAST(row_number() OVER (PARTITION BY vec_id ORDER BY i) - 1 AS INT) AS k, i - 1 AS i FROM s WHERE hit""")
def w04(spark: SparkSession, sf: str) -> DataFrame:
    return _vectors(spark, sf).select("vec_id", F.posexplode(series.change_points(F.col("x"), F.get("x", F.lit(0)), 0.1)).alias("k", "i"))


# ---- distances and search


def _d_costs(k: int) -> str:
    """The search distance's squared costs as a SQL list, stated from its rule: bounds, top letter 3, neighbours."""
    b = series.DISTANCE_BREAKPOINTS[k]
    out = []
    for r in range(k):
        for c in range(k):
            x, y = sorted((r, c))
            if y - x <= 1:
                out.append(0.0 if x == y else 0.1**2 if x == 0 else ((b[x] - b[x - 1]) / 2) ** 2)
            else:
                out.append(((3.0 if y == k - 1 else b[y]) - b[x]) ** 2)
    return "[" + ", ".join(map(repr, out)) + "]"


_ALL_COSTS = "[" + ", ".join(_d_costs(k) for k in range(3, 9)) + "]"


def _d_mindist(a: str, b: str, word: str, k: str | None = None) -> str:
    costs, size = (f"{_ALL_COSTS}[{k} - 2]", k) if k else (_d_costs(ALPHABET), str(ALPHABET))
    return f"CASE WHEN coalesce(least(length({a}), length({b})), 0) = 0 THEN CAST('inf' AS DOUBLE) ELSE sqrt(list_sum(list_transform(range(1, least(length({a}), length({b}), {word}) + 1), lambda i: {costs}[(ascii(substring({a}, i, 1)) - 97) * {size} + ascii(substring({b}, i, 1)) - 97 + 1])) / {word}) END"


_INIT, _FINAL = ("init_win", "init_draw", "init_lose"), ("final_win", "final_draw", "final_lose")
#: The prices that must be within the tolerance, by mode.
MODES = {"init": _INIT, "final": _FINAL, "both": _FINAL + _INIT, "mean": ("home_mean", "draw_mean", "away_mean")}
_PRICED = "SELECT s.id, s.bookmaker, s.match_id, s.sax_interleaved AS ci, s.sax_delta AS cd, " + ", ".join(f"CAST(b.{c} AS DOUBLE) AS {c}" for c in _INIT + _FINAL) + ", " + ", ".join(f"CAST(s.{c} AS DOUBLE) AS {c}" for c in MODES["mean"]) + " FROM sax_encoding s JOIN (SELECT * FROM betting_odds QUALIFY row_number() OVER (PARTITION BY schedule_id, bookmaker_name ORDER BY id DESC) = 1) b ON b.schedule_id = s.match_id AND b.bookmaker_name = s.bookmaker WHERE s.sax_interleaved <> ''"


def _priced(spark: SparkSession, sf: str, mode: str) -> DataFrame:
    """Encodings with the prices of the mode: means of their own, others of the bookmaker's latest row for the match."""
    of_rows, of_means = ([F.col(c).cast("double").alias(c) for c in MODES[mode]], []) if mode != "mean" else ([F.lit(1).alias("there")], [F.col(c).cast("double").alias(c) for c in MODES[mode]])
    b = table(spark, sf, "betting_odds").where("schedule_id is not null")
    last = b.groupBy(F.col("schedule_id").alias("match_id"), F.col("bookmaker_name").alias("bookmaker")).agg(F.max_by(F.struct(*of_rows), "id").alias("p"))
    s = table(spark, sf, "sax_encoding").where("sax_interleaved <> ''").select("id", "bookmaker", "match_id", F.col("sax_interleaved").alias("ci"), F.col("sax_delta").alias("cd"), *of_means)
    return s.join(last, ["match_id", "bookmaker"]).select(*s.columns, "p.*")


def _word_settings(spark: SparkSession, sf: str) -> DataFrame:
    """Word lengths and alphabet of each bookmaker, as all its stored words have them; the cost tables go from 3 to 8 letters."""
    ci, cd = F.col("sax_interleaved"), F.col("sax_delta")
    top = F.ascii(F.array_max(F.split(F.concat_ws("", ci, cd), ""))) - 96
    return table(spark, sf, "sax_encoding").groupBy("bookmaker").agg(F.max(F.length(ci)).alias("wi"), F.max(F.length(cd)).alias("wd"), F.greatest(F.least(F.max(top), F.lit(8)), F.lit(3)).alias("k"))


def handicap_words(spark: SparkSession, sf: str, word: int = 8, alphabet: int = 4) -> DataFrame:
    """The handicap codes of each row of total_handicap with two readings or more, under the canonical bookmaker."""
    lists = reading_lists(table(spark, sf, "total_handicap"), "odds_detail", odds_tables.DETAIL_READINGS, ["id", "match_id", "bookmaker"], ["home", "away"], text="line_text")
    codes = trajectories.handicap_codes(F.col("records"), word, series.gaussian_breakpoints(alphabet))
    return lists.select("id", "match_id", odds.canonical_bookmaker(F.col("bookmaker")).alias("bookmaker"), codes.alias("hc")).where("hc is not null")


def _search(spark: SparkSession, sf: str, mode: str = "final", pct: float = 5.0, far: float = 0.5, top: int = 10, handicap: bool = False) -> DataFrame:
    """Every row whose id is divisible by 50 against all rows of its bookmaker: price bands, distance, nearest ``top``.

    The bands are an equi-join on log-price buckets; the top is taken by rank, which Spark limits before the shuffle.
    """
    rows = _priced(spark, sf, mode)
    if handicap:
        words = handicap_words(spark, sf).groupBy("match_id", "bookmaker").agg(F.max_by(F.struct("hc.sax_home", "hc.sax_away", "hc.sax_diff"), "id").alias("hc"))
        rows = rows.join(words, ["match_id", "bookmaker"], "left")
    prices, extra = MODES[mode], ["hc"] if handicap else []
    targets = rows.where("id % 50 = 0").join(_word_settings(spark, sf), "bookmaker").select("bookmaker", "wi", "wd", "k", *[F.col(c).alias(f"t_{c}") for c in ("id", "match_id", "ci", "cd", *prices, *extra)])
    pairs = asof.band_join(targets, rows.select("id", "bookmaker", "match_id", "ci", "cd", *prices, *extra), ["bookmaker"], [(f"t_{p}", p) for p in prices], pct).where("id <> t_id")
    di = series.mindist(F.col("t_ci"), F.col("ci"), F.col("wi"), F.col("k"))
    dd = series.mindist(F.col("t_cd"), F.col("cd"), F.col("wd"), F.col("k"))
    dh = F.when(F.col("t_hc").isNotNull() & F.col("hc").isNotNull(), trajectories.handicap_distance(F.col("t_hc"), F.col("hc"), 8, 4)) if handicap else None
    judged = pairs.withColumn("dist", trajectories.combined_distance(di, dd, dh)).where(F.col("dist") <= far)
    return judged.withColumn("r", F.row_number().over(Window.partitionBy("t_id").orderBy("dist", "id"))).where(F.col("r") <= top)


def _d_search(mode: str) -> str:
    band = " AND ".join(f"b.{c} > 0 AND t.{c} > 0 AND abs(b.{c} - t.{c}) <= t.{c} * 0.05" for c in MODES[mode])
    return f"""WITH p AS ({_PRICED}), s AS (SELECT bookmaker, max(length(sax_interleaved)) AS wi, max(length(sax_delta)) AS wd, CAST(greatest(least(max(ascii(list_aggregate(string_split(concat_ws('', sax_interleaved, sax_delta), ''), 'max')) - 96), 8), 3) AS INT) AS k FROM sax_encoding GROUP BY bookmaker),
 pairs AS (SELECT t.id AS t_id, t.match_id AS t_match, b.id, b.match_id, {_d_mindist('t.ci', 'b.ci', 's.wi', 's.k')} AS di, CASE WHEN length(b.cd) > 0 AND length(t.cd) > 0 THEN {_d_mindist('t.cd', 'b.cd', 's.wd', 's.k')} END AS dd
  FROM p t JOIN p b ON t.bookmaker = b.bookmaker AND t.id <> b.id AND {band} JOIN s ON s.bookmaker = t.bookmaker WHERE t.id % 50 = 0),
 far AS (SELECT *, coalesce((di + dd) / 2, di) AS dist FROM pairs),
 ranked AS (SELECT *, row_number() OVER (PARTITION BY t_id ORDER BY dist, id) AS r FROM far WHERE dist <= 0.5)"""


@_query("ref_j12_similar_matches", _d_search("final") + " SELECT t_id, id, match_id, round(dist, 6) AS dist FROM ranked WHERE r <= 10")
def j12(spark: SparkSession, sf: str) -> DataFrame:
    return _search(spark, sf).select("t_id", "id", "match_id", F.round("dist", 6).alias("dist"))


@_query("ref_f08_both_prices", _d_search("both") + " SELECT t_id, id, match_id, round(dist, 6) AS dist FROM ranked WHERE r <= 10")
def f08_both(spark: SparkSession, sf: str) -> DataFrame:
    """Opening and closing prices within the tolerance, all six."""
    return _search(spark, sf, "both").select("t_id", "id", "match_id", F.round("dist", 6).alias("dist"))


@_query("ref_f08_mean_prices", _d_search("mean") + " SELECT t_id, id, match_id, round(dist, 6) AS dist FROM ranked WHERE r <= 10")
def f08_mean(spark: SparkSession, sf: str) -> DataFrame:
    return _search(spark, sf, "mean").select("t_id", "id", "match_id", F.round("dist", 6).alias("dist"))


_T03 = "SELECT t_id, id, src, r FROM (SELECT *, row_number() OVER (PARTITION BY t_id ORDER BY dist, id, src) AS r FROM both_lists) x WHERE r <= 20"


@_query("ref_t03_merged_top", f"WITH both_lists AS (SELECT 'init' AS src, t_id, id, round(dist, 9) AS dist FROM ({_d_search('init')} SELECT * FROM ranked WHERE r <= 10) a UNION ALL SELECT 'final', t_id, id, round(dist, 9) FROM ({_d_search('final')} SELECT * FROM ranked WHERE r <= 10) b) {_T03.replace('SELECT t_id, id, src, r FROM', 'SELECT t_id, id, src, CAST(r AS INT) AS r FROM')}")
def t03(spark: SparkSession, sf: str) -> DataFrame:
    """The ten nearest by opening and by closing prices together (duplicates stay), the twenty nearest of them."""
    lists = [_search(spark, sf, m).select(F.lit(m).alias("src"), "t_id", "id", F.round("dist", 9).alias("dist")) for m in ("init", "final")]
    return lists[0].unionByName(lists[1]).withColumn("r", F.row_number().over(Window.partitionBy("t_id").orderBy("dist", "id", "src"))).where("r <= 20").select("t_id", "id", "src", "r")


@_query("ref_x21_with_handicap")
def x21(spark: SparkSession, sf: str) -> DataFrame:
    """The search with the handicap's distance at 0.4 where both matches have handicap codes."""
    return _search(spark, sf, handicap=True).select("t_id", "id", "match_id", F.round("dist", 6).alias("dist"))


@_query("ref_x17_handicap_codes")
def x17(spark: SparkSession, sf: str) -> DataFrame:
    return handicap_words(spark, sf).select("id", "match_id", "bookmaker", "hc.*")


@_query("ref_x14_event_time")
def x14(spark: SparkSession, sf: str) -> DataFrame:
    """Each stored trajectory brought to 16 to 20 event-time points of margin-free probabilities, and its two words."""
    lists = reading_lists(table(spark, sf, "match_odds"), "payload", odds_tables.READING_PRICES, ["id", "schedule_id", "bookmaker"], ["home", "draw", "away"], kickoff="match_time")
    ok = F.filter("records", lambda r: (r["home"] > 0) & (r["draw"] > 0) & (r["away"] > 0))
    probabilities = F.transform(ok, lambda r: F.struct(r["t"].alias("t"), *[p.alias(c) for p, c in zip(odds.margin_free(r["home"], r["draw"], r["away"]), "hda")]))
    points = lists.select("id", "schedule_id", "bookmaker", trajectories.event_time(probabilities, F.col("kickoff")).alias("s")).where("s is not null")
    z = {c: series.zscore(F.col(f"s.{c}")) for c in "hda"}
    words = points.select("id", "schedule_id", "bookmaker", F.size("s").alias("n_points"), *[z[c].alias(c) for c in "hda"])
    return words.select("id", "schedule_id", "bookmaker", "n_points", series.sax_pick(series.interleave(F.col("h"), F.col("d"), F.col("a")), WORD, _GAUSS, 96).alias("sax_interleaved"), series.sax_pick(series.delta(F.col("h"), F.col("a")), WORD, _GAUSS, LENGTH).alias("sax_delta"))


@_query("ref_c3_batch_codes")
def c3(spark: SparkSession, sf: str) -> DataFrame:
    """The batch stage over the stored trajectories: words of every entry with two whole readings or more, with its statistics."""
    lists = reading_lists(table(spark, sf, "match_odds"), "payload", odds_tables.READING_PRICES, ["id", "schedule_id", "season", "bookmaker"], ["home", "draw", "away"])
    rows = lists.withColumn("ok", F.filter("records", lambda r: (r["home"] > 0) & (r["draw"] > 0) & (r["away"] > 0))).where(F.size("ok") >= 2)
    rows = rows.select("id", "schedule_id", "season", "bookmaker", "ok.home", "ok.draw", "ok.away")
    words = series.batch_words(F.col("home"), F.col("draw"), F.col("away"), 6, series.gaussian_breakpoints(4))
    stats = [x.alias(f"{c}_{n}") for c in ("home", "draw", "away") for x, n in zip(series.mean_dev(F.col(c)), ("mean", "std"), strict=True)]
    return rows.select("id", "schedule_id", "season", "bookmaker", *[w.alias(n) for n, w in words.items()], *stats, F.size("home").alias("running_odds_count"))


@_query("ref_a02_neighbour_rates", _d_search("final") + """, sc AS (SELECT match_id, try_cast(split_part(final_score, '-', 1) AS INT) AS hg, try_cast(split_part(final_score, '-', 2) AS INT) AS ag FROM league_matches WHERE len(string_split(final_score, '-')) = 2 OR final_score IS NULL OR true QUALIFY row_number() OVER (PARTITION BY match_id ORDER BY created_at DESC, id DESC) = 1),
 o AS (SELECT r.t_id, r.t_match, CASE WHEN len(string_split(l.final_score, '-')) = 2 THEN hg - ag END AS gd FROM ranked r LEFT JOIN sc ON sc.match_id = r.match_id LEFT JOIN (SELECT match_id, final_score FROM league_matches QUALIFY row_number() OVER (PARTITION BY match_id ORDER BY created_at DESC, id DESC) = 1) l ON l.match_id = r.match_id WHERE r.r <= 10),
 t AS (SELECT t_id, t_match, count(gd) AS valid, count(*) FILTER (gd > 0) AS home, count(*) FILTER (gd = 0) AS draw, count(*) FILTER (gd < 0) AS away FROM o GROUP BY 1, 2),
 h AS (SELECT t.match_id, i.line_value AS iv, f.line_value AS fv, CAST(init_odds_home AS DOUBLE) AS a, CAST(final_odds_home AS DOUBLE) AS b FROM total_handicap t LEFT JOIN handicap_lines i ON i.line_name = t.handicap LEFT JOIN handicap_lines f ON f.line_name = t.final_handicap QUALIFY row_number() OVER (PARTITION BY t.match_id ORDER BY t.id DESC) = 1),
 j AS (SELECT t.*, CASE WHEN valid > 0 THEN home / valid ELSE 0 END AS rate, coalesce(sign(fv - iv), 0) AS d, CASE WHEN a <> 0 AND b <> 0 THEN b - a ELSE 0 END AS w FROM t LEFT JOIN h ON h.match_id = t.t_match)
 SELECT t_id, valid, home, draw, away, round(rate, 6) AS home_rate, CASE WHEN d > 0 OR (d = 0 AND (w < -0.1 OR (w <= 0.1 AND rate > 0.45))) THEN '主胜' ELSE '主队不胜' END AS prediction FROM j""")
def a02(spark: SparkSession, sf: str) -> DataFrame:
    """Outcome rates of each target's neighbours and the rule prediction from them and from the target's line; malformed scores do not count."""
    latest = upsert.keep_last(table(spark, sf, "league_matches").select("match_id", "final_score", "created_at", "id"), ["match_id"], [F.col("created_at").desc(), F.col("id").desc()])
    near = _search(spark, sf).select("t_id", "t_match_id", "match_id").join(latest.select("match_id", odds.outcome(F.col("final_score")).alias("outcome")), "match_id", "left")
    tally = near.groupBy("t_id", "t_match_id").agg(F.count("outcome").alias("valid"), *[F.count_if(F.col("outcome") == o).alias(o) for o in ("home", "draw", "away")])
    value = lambda c, a: F.broadcast(table(spark, sf, "handicap_lines").select(F.col("line_name").alias(c), F.col("line_value").alias(a)))  # noqa: E731 (29 rows, fixed)
    lines = table(spark, sf, "total_handicap").groupBy(F.col("match_id").alias("t_match_id")).agg(F.max_by(F.struct("handicap", "final_handicap", F.col("init_odds_home").cast("double").alias("a"), F.col("final_odds_home").cast("double").alias("b")), "id").alias("x"))
    lines = lines.select("t_match_id", "x.*").join(value("handicap", "iv"), "handicap", "left").join(value("final_handicap", "fv"), "final_handicap", "left")
    rate = odds.ratio(F.col("home"), F.col("valid"))
    said = odds.rule_prediction(odds.line_move(F.col("iv"), F.col("fv")), odds.water_change(F.col("a"), F.col("b")), rate)
    return tally.join(lines, "t_match_id", "left").select("t_id", "valid", "home", "draw", "away", F.round(rate, 6).alias("home_rate"), said.alias("prediction"))


@_query("ref_x18_mindist", f"SELECT a.vec_id AS a, b.vec_id AS b, round({_d_mindist('a.word', 'b.word', str(WORD))}, 6) AS dist FROM ({_WORDS}) a JOIN ({_WORDS}) b ON a.label = b.label AND a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id")
def x18(spark: SparkSession, sf: str) -> DataFrame:
    """Distances of every fiftieth vector's word to those of all others of its label; the stated queries are the small side."""
    w = _words(spark, sf)
    t = w.where("vec_id % 50 = 0").select("label", F.col("vec_id").alias("a"), F.col("word").alias("wa"))
    return skew.salted_join(w.select("label", F.col("vec_id").alias("b"), "word"), t, ["label"]).where("a <> b").select("a", "b", F.round(series.mindist(F.col("wa"), F.col("word"), WORD, ALPHABET), 6).alias("dist"))


_EPS = 0.3
_COST_C = "[" + ", ".join(repr(0.0 if abs(r - c) <= 1 else ([*series.DISTANCE_BREAKPOINTS[ALPHABET], 3.0][max(r, c)] - [*series.DISTANCE_BREAKPOINTS[ALPHABET], 3.0][min(r, c)]) ** 2) for r in range(ALPHABET) for c in range(ALPHABET)) + "]"


@_query("ref_j14_near_words", f"WITH w AS (SELECT DISTINCT word AS w FROM ({_WORDS}) v) SELECT a.w AS a, b.w AS b, round(d, 6) AS dist FROM (SELECT *, sqrt(list_sum(list_transform(range(1, {WORD + 1}), lambda i: {_COST_C}[(ascii(substring(a.w, i, 1)) - 97) * {ALPHABET} + ascii(substring(b.w, i, 1)) - 96])) / {WORD}) AS d FROM w a JOIN w b ON a.w < b.w) x WHERE d <= {_EPS}".replace("SELECT a.w AS a, b.w AS b, round", "SELECT wa AS a, wb AS b, round").replace("(SELECT *, sqrt", "(SELECT a.w AS wa, b.w AS wb, sqrt"))
def j14(spark: SparkSession, sf: str) -> DataFrame:
    """The distance matrix of all different words as far as it is within a bound: i < j, by shared segments instead of all pairs."""
    w = _words(spark, sf).select(F.col("word").alias("w")).distinct()
    return density.near_words(w, WORD, ALPHABET, _EPS).select("a", "b", F.round("dist", 6).alias("dist"))


@_query("ref_f08_tolerance", "SELECT t.id AS t_id, b.id FROM betting_odds t JOIN betting_odds b ON t.bookmaker_name = b.bookmaker_name AND t.id <> b.id AND t.id % 50 = 0 AND b.final_win > 0 AND t.final_win > 0 AND abs(CAST(b.final_win AS DOUBLE) - CAST(t.final_win AS DOUBLE)) <= CAST(t.final_win AS DOUBLE) * 0.01")
def f08(spark: SparkSession, sf: str) -> DataFrame:
    """Rows of the same bookmaker within one percent of the price of every fiftieth row."""
    rows = table(spark, sf, "betting_odds").select("id", "bookmaker_name", F.col("final_win").cast("double").alias("w"))
    t = rows.where("id % 50 = 0").select(F.col("id").alias("t_id"), "bookmaker_name", F.col("w").alias("tw"))
    return asof.band_join(t, rows, ["bookmaker_name"], [("tw", "w")], 1.0).where("id <> t_id").select("t_id", "id")


@_query("ref_j13_first_match", f"WITH w AS ({_WORDS}), c AS (SELECT substring(word, 1, 4) AS code, count(*) AS n, min(vec_id) AS seen FROM w GROUP BY substring(word, 1, 4)) SELECT c.code, lib.code AS library FROM c JOIN (SELECT * FROM c WHERE n >= 3) lib ON hamming(c.code, lib.code) <= 1 QUALIFY row_number() OVER (PARTITION BY c.code ORDER BY c.code <> lib.code, lib.seen) = 1")
def j13_first(spark: SparkSession, sf: str) -> DataFrame:
    """The library code that a code means: itself, else the first in library order (first seen) that differs in one place."""
    c = _words(spark, sf).groupBy(F.substring("word", 1, 4).alias("code")).agg(F.count(F.lit(1)).alias("n"), F.min("vec_id").alias("seen"))
    lib = c.where("n >= 3").select(F.col("code").alias("library"), F.col("seen").alias("order"))
    return asof.hamming_one(c.select("code"), lib, "code", "library").groupBy("code").agg(F.min_by("library", F.struct(F.col("code") != F.col("library"), "order")).alias("library"))


@_query("ref_r15_hamming", f"SELECT a.vec_id AS a, b.vec_id AS b, CAST(hamming(a.word, b.word) AS INT) AS places FROM ({_WORDS}) a JOIN ({_WORDS}) b ON b.vec_id = a.vec_id + 1")
def r15(spark: SparkSession, sf: str) -> DataFrame:
    """Differing places between each vector's word and the next one's."""
    w = _words(spark, sf)
    other = w.select((F.col("vec_id") - 1).alias("a"), F.col("vec_id").alias("b"), F.col("word").alias("wb"))
    return w.select(F.col("vec_id").alias("a"), "word").join(other, "a").select("a", "b", series.hamming(F.col("word"), F.col("wb")).alias("places"))


@_query("ref_j13_soft_match", f"WITH w AS ({_WORDS}), c AS (SELECT substring(word, 1, 4) AS code, count(*) AS n FROM w GROUP BY substring(word, 1, 4)), lib AS (SELECT code FROM c WHERE n >= 3) SELECT c.code, lib.code AS library FROM c JOIN lib ON hamming(c.code, lib.code) <= 1")
def j13(spark: SparkSession, sf: str) -> DataFrame:
    """Codes and the library codes that differ from them in at most one place."""
    c = _words(spark, sf).groupBy(F.substring("word", 1, 4).alias("code")).agg(F.count(F.lit(1)).alias("n"))
    lib = c.where("n >= 3").select(F.col("code").alias("library"))
    return asof.hamming_one(c.select("code"), lib, "code", "library")


# ---- profile


@_query("ref_a15_moments", "SELECT event_type, count(value) AS n, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS dev, round((avg(value * value * value) - 3 * avg(value) * avg(value * value) + 2 * avg(value) * avg(value) * avg(value)) / power(stddev_pop(value), 3), 5) AS skew, round(kurtosis_pop(value), 5) AS excess FROM events GROUP BY event_type")
def a15(spark: SparkSession, sf: str) -> DataFrame:
    m = profile.moments(table(spark, sf, "events"), ["event_type"], "value")
    return m.select("event_type", "n", F.round("mean", 6).alias("mean"), F.round("dev", 6).alias("dev"), F.round("skew", 5).alias("skew"), F.round("excess", 5).alias("excess"))


_M = "SELECT event_type, count(value) AS n, (avg(value * value * value) - 3 * avg(value) * avg(value * value) + 2 * avg(value) * avg(value) * avg(value)) / power(stddev_pop(value), 3) AS b1, kurtosis_pop(value) AS b2 FROM events GROUP BY event_type"
_A16 = _d_stages(
    _M, {"y": "b1 * sqrt((n + 1.0) * (n + 3.0) / (6.0 * (n - 2.0)))", "beta": "3.0 * (n * n + 27.0 * n - 70.0) * (n + 1.0) * (n + 3.0) / ((n - 2.0) * (n + 5.0) * (n + 7.0) * (n + 9.0))", "e": "3.0 * (n - 1.0) / (n + 1.0)", "v": "24.0 * n * (n - 2.0) * (n - 3.0) / (power(n + 1.0, 2) * (n + 3.0) * (n + 5.0))", "s": "6.0 * (n * n - 5.0 * n + 2.0) / ((n + 7.0) * (n + 9.0)) * sqrt(6.0 * (n + 3.0) * (n + 5.0) / (n * (n - 2.0) * (n - 3.0)))"},
    {"w2": "sqrt(2.0 * (beta - 1.0)) - 1.0", "big": "6.0 + 8.0 / s * (2.0 / s + sqrt(1.0 + 4.0 / (s * s)))", "x": "(b2 + 3.0 - e) / sqrt(v)"},
    {"zs": "asinh(y * sqrt((w2 - 1.0) / 2.0)) / sqrt(ln(w2) / 2.0)", "zk": "((1.0 - 2.0 / (9.0 * big)) - cbrt((1.0 - 2.0 / big) / (1.0 + x * sqrt(2.0 / (big - 4.0))))) / sqrt(2.0 / (9.0 * big))"},
    {"p": "exp(-(zs * zs + zk * zk) / 2.0)"},
)


@_query("ref_a16_normality", f"SELECT event_type, n, round(p, 6) AS p_value, p > 0.05 AS gaussian FROM ({_A16}) x")
def a16(spark: SparkSession, sf: str) -> DataFrame:
    return profile.moments(table(spark, sf, "events"), ["event_type"], "value").select("event_type", "n", F.round("p_value", 6).alias("p_value"), "gaussian")


_A17 = "WITH m AS (" + " UNION ALL ".join(f"SELECT event_type, {k} AS k, quantile_cont(value, {[i / k for i in range(1, k)]}) AS b FROM events GROUP BY event_type" for k in range(3, 11)) + """),
 c AS (SELECT e.event_type, m.k, len(list_filter(m.b, lambda x: x <= e.value)) AS bin, count(*) AS n FROM events e JOIN m ON m.event_type = e.event_type WHERE e.value IS NOT NULL GROUP BY ALL),
 h AS (SELECT event_type, k, -sum(n / t * log2(n / t)) AS entropy FROM (SELECT *, sum(n) OVER (PARTITION BY event_type, k) AS t FROM c) x GROUP BY event_type, k)"""


@_query("ref_a17_entropy", _A17 + " SELECT event_type, k, round(entropy, 6) AS entropy, round(entropy / log2(k), 6) AS efficiency FROM h")
def a17(spark: SparkSession, sf: str) -> DataFrame:
    e = profile.entropy(table(spark, sf, "events").where("value is not null"), ["event_type"], "value")
    return e.select("event_type", "k", F.round("entropy", 6).alias("entropy"), F.round("efficiency", 6).alias("efficiency"))


@_query("ref_a18_breakpoints", "SELECT event_type, round(quantile_cont(value, 0.25), 6) AS b1, round(quantile_cont(value, 0.5), 6) AS b2, round(quantile_cont(value, 0.75), 6) AS b3 FROM events GROUP BY event_type")
def a18(spark: SparkSession, sf: str) -> DataFrame:
    b = profile.breakpoints(table(spark, sf, "events"), ["event_type"], "value", 4)
    return b.select("event_type", *[F.round(F.get("breakpoints", F.lit(i)), 6).alias(f"b{i + 1}") for i in range(3)])


@_query("ref_a20_alphabet_choice", _A17 + " SELECT event_type, k AS alphabet_size FROM h QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY round(entropy / log2(k), 9) DESC, k) = 1")
def a20(spark: SparkSession, sf: str) -> DataFrame:
    """The alphabet with the highest efficiency, the smallest of equals."""
    e = profile.entropy(table(spark, sf, "events").where("value is not null"), ["event_type"], "value")
    return e.groupBy("event_type").agg(F.max_by("k", F.struct(F.round("efficiency", 9), -F.col("k"))).alias("alphabet_size"))


@_query("ref_a22_weighted_mean", "SELECT user_id, round(sum(value * w) / sum(w), 6) AS mean FROM (SELECT user_id, value, CASE WHEN gap <= 0 THEN 0.1 ELSE gap END AS w FROM (SELECT user_id, value, (epoch(ts) - epoch(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id))) / 3600 AS gap FROM events) a WHERE gap IS NOT NULL) b GROUP BY user_id")
def a22(spark: SparkSession, sf: str) -> DataFrame:
    """Mean weighted by the hours since the previous reading; the first reading has no weight."""
    at = F.unix_micros(F.col("ts").cast("timestamp")) / 3.6e9
    gap = at - F.lag(at).over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    rows = table(spark, sf, "events").select("user_id", "value", gap.alias("gap")).where("gap is not null").withColumn("w", F.when(F.col("gap") <= 0, 0.1).otherwise(F.col("gap")))
    return rows.groupBy("user_id").agg(F.round(F.sum(F.col("value") * F.col("w")) / F.sum("w"), 6).alias("mean"))


# ---- as-of, upserts, samples


@_query("ref_j11_asof", "SELECT p.event_id, r.value AS last_view FROM (SELECT * FROM events WHERE event_type = 'purchase') p ASOF LEFT JOIN (SELECT user_id, ts, value FROM events WHERE event_type = 'view') r ON p.user_id = r.user_id AND p.ts > r.ts")
def j11(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    left = e.where("event_type = 'purchase'").select("event_id", "user_id", "ts")
    right = e.where("event_type = 'view'").select("user_id", "ts", F.col("value").alias("last_view"))
    return asof.asof_backward(left, right, "user_id", "ts", "last_view").select("event_id", "last_view")


@_query("ref_k01_upsert_overwrite", "WITH old AS (SELECT id, match_id, final_score FROM league_matches WHERE created_at < TIMESTAMP '2020-01-01'), new AS (SELECT id, match_id, final_score FROM (SELECT *, row_number() OVER (PARTITION BY match_id ORDER BY created_at DESC, id DESC) AS r FROM league_matches WHERE created_at >= TIMESTAMP '2018-01-01') x WHERE r = 1) SELECT * FROM new UNION ALL SELECT * FROM old WHERE match_id NOT IN (SELECT match_id FROM new)")
def k01(spark: SparkSession, sf: str) -> DataFrame:
    """Two deliveries of the match table that overlap in time: the later written over the earlier."""
    m = table(spark, sf, "league_matches").select("id", "match_id", "final_score", "created_at")
    return upsert.overwrite(m.where("created_at < '2020-01-01'"), m.where("created_at >= '2018-01-01'"), ["match_id"], [F.col("created_at").desc(), F.col("id").desc()]).drop("created_at")


@_query("ref_k02_insert_absent", "WITH old AS (SELECT id, match_id, bookmaker FROM total_handicap WHERE created_at < TIMESTAMP '2020-01-01'), new AS (SELECT id, match_id, bookmaker FROM (SELECT *, row_number() OVER (PARTITION BY match_id, bookmaker ORDER BY created_at DESC, id DESC) AS r FROM total_handicap t WHERE created_at >= TIMESTAMP '2018-01-01' AND NOT EXISTS (SELECT 1 FROM old WHERE old.match_id = t.match_id AND old.bookmaker = t.bookmaker)) x WHERE r = 1) SELECT * FROM old UNION ALL SELECT * FROM new")
def k02(spark: SparkSession, sf: str) -> DataFrame:
    h = table(spark, sf, "total_handicap").select("id", "match_id", "bookmaker", "created_at")
    return upsert.insert_absent(h.where("created_at < '2020-01-01'"), h.where("created_at >= '2018-01-01'"), ["match_id", "bookmaker"], [F.col("created_at").desc(), F.col("id").desc()]).drop("created_at")


@_query("ref_s21_match_ids", "SELECT match_id FROM league_matches")
def s21(spark: SparkSession, sf: str) -> DataFrame:
    """The ids of all matches: one column is read."""
    return table(spark, sf, "league_matches").select("match_id")


@_query("ref_t08_seeded_sample", "SELECT id, match_id FROM league_matches ORDER BY md5(CAST(id AS VARCHAR) || '-42'), id LIMIT 100")
def t08(spark: SparkSession, sf: str) -> DataFrame:
    """One hundred rows drawn by a seeded hash (a sampling operator)."""
    return table(spark, sf, "league_matches").select("id", "match_id").orderBy(_draw("id"), "id").limit(100)


def _draw(key: str, seed: int = 42) -> Column:
    return F.md5(F.concat(F.col(key).cast("string"), F.lit(f"-{seed}")))


@_query("ref_t09_stratified_split", "SELECT vec_id, label, CASE WHEN row_number() OVER (PARTITION BY label ORDER BY md5(CAST(vec_id AS VARCHAR) || '-42')) <= floor(count(*) OVER (PARTITION BY label) * 0.8 + 0.5) THEN 'train' ELSE 'test' END AS part FROM embeddings")
def t09(spark: SparkSession, sf: str) -> DataFrame:
    """A seeded split that takes four fifths of each label, to the row."""
    return stratified_split(table(spark, sf, "embeddings").select("vec_id", "label"), "vec_id", "label", 0.8)


def stratified_split(rows: DataFrame, key: str, label: str, share: float) -> DataFrame:
    """``part``: train for the first ``share`` of each label's rows in the order of a seeded hash.

    Ranks are counted within slices of the hash, plus the slices before, so that no label is ordered in one task.
    """
    drawn = rows.withColumn("draw", _draw(key)).withColumn("slice", F.substring("draw", 1, 2))
    sizes = drawn.groupBy(label, "slice").agg(F.count(F.lit(1)).alias("size"))
    ahead = Window.partitionBy(label).orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.select(label, "slice", F.coalesce(F.sum("size").over(ahead), F.lit(0)).alias("before"), F.sum("size").over(Window.partitionBy(label)).alias("all"))
    own = drawn.withColumn("own", F.row_number().over(Window.partitionBy(label, "slice").orderBy("draw")))
    rank = F.col("before") + F.col("own") <= F.floor(F.col("all") * share + 0.5)
    return own.join(before, [label, "slice"]).select(*rows.columns, F.when(rank, "train").otherwise("test").alias("part"))


_WORDS_OF_LINES = ", ".join(f"('{w}', {v}e0)" for w, v in [*odds.LINE_WORDS.items(), *(("受" + w, -v) for w, v in (odds.LINE_WORDS | odds.RECEIVING_WORDS).items())])
@_query("ref_r10_line_words", f"WITH w(name, v) AS (VALUES {_WORDS_OF_LINES}) SELECT t.id, t.handicap, v AS line, coalesce(v, 0) AS line_or_level FROM total_handicap t LEFT JOIN w ON w.name = replace(replace(trim(t.handicap, ' '), '受让', '受'), '二', '两')")
def r10(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "total_handicap").select("id", "handicap", odds.line_value(F.col("handicap")).alias("line"), odds.line_value(F.col("handicap"), 0.0).alias("line_or_level"))
