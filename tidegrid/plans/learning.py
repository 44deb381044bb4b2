"""Clustering, classification, source round trips and streaming as queries."""

from __future__ import annotations

import uuid

from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegrid.sources import match_files
from tidegrid.streaming.incremental import daily_counts
from tidegrid.session import shared_dir, table, written

#: Bound of labelled rows the classifier (L04) is fitted on; all held-out rows are scored. Scaler and k-means take all rows.
FIT_ROWS = 200_000


def _fit_part(df: DataFrame, key: str) -> DataFrame:
    share = min(1.0, FIT_ROWS / max(df.count(), 1))
    return df.where(F.pmod(F.xxhash64(key, F.lit(42)), F.lit(1 << 20)) < int(share * (1 << 20)))


#: Letters of each word that k-means compares.
ORDINALS = 8


def ordinals(code, word: int):
    """The first ``word`` letters as numbers; zeros for a NULL or shorter code."""
    some = F.transform(F.sequence(F.lit(1), F.lit(word)), lambda i: (F.ascii(F.substring(code, i, F.lit(1))) - 97).cast("double"))
    return F.when(F.length(code) >= word, some).otherwise(F.array_repeat(F.lit(0.0), word))


def kmeans_vectors(spark: SparkSession, sf: str) -> DataFrame:
    """k-means (k from the row count, 4 to 10; best of ten seeds) on the ordinals of both words; each cluster's size, most
    frequent prefixes and mean prices."""
    from tidegrid.operators.patterns import cluster_profile

    rows = table(spark, sf, "sax_encoding").select("id", F.col("sax_interleaved").alias("code"), "sax_delta", "home_mean").where("code <> ''")
    x = rows.select("*", array_to_vector(F.concat(ordinals(F.col("code"), ORDINALS), ordinals(F.col("sax_delta"), ORDINALS))).alias("features"))
    k = max(4, min(10, x.count() // 50))
    fits = [KMeans(k=k, seed=42 + s, maxIter=20).fit(x) for s in range(10)]
    best = min(fits, key=lambda m: m.summary.trainingCost)
    return cluster_profile(best.transform(x), ["prediction"], "code", ["home_mean"])


def dbscan_words(spark: SparkSession, sf: str) -> DataFrame:
    """Density clusters of the vectors' words; sizes, -1 being noise."""
    from tidegrid.operators.density import dbscan
    from tidegrid.plans.kernels import ALPHABET, WORD, _words

    return dbscan(_words(spark, sf), "vec_id", "word", WORD, ALPHABET, 0.3, 3).groupBy("cluster").agg(F.count(F.lit(1)).alias("n"))


def kmeans_prices(spark: SparkSession, sf: str) -> DataFrame:
    """Standardised means and reading counts of encodings (NULL as 0), clustered; sizes per cluster."""
    columns = ["home_mean", "draw_mean", "away_mean", "running_odds_count"]
    x = table(spark, sf, "sax_encoding").select("id", *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in columns])
    stages = [VectorAssembler(inputCols=columns, outputCol="raw"), StandardScaler(inputCol="raw", outputCol="features", withMean=True), KMeans(k=6, seed=42)]
    return Pipeline(stages=stages).fit(x).transform(x).groupBy("prediction").agg(F.count(F.lit(1)).alias("n"))


FEATURES = ["eu_home", "eu_draw", "eu_away", "asian_handicap", "asian_home", "asian_away", "eu_implied_home", "eu_implied_away"]


def _cover_rows(spark: SparkSession, sf: str) -> DataFrame:
    """id, label (the home side covers its line) and the eight features, NULL as 0; level lines are left out, as in training."""
    from tidegrid.functions import odds
    from tidegrid.operators.upsert import keep_last

    lines = F.broadcast(table(spark, sf, "handicap_lines").select(F.col("line_name").alias("handicap"), F.col("line_value").alias("asian_handicap")))  # 29 rows, fixed
    scores = keep_last(table(spark, sf, "league_matches").select("id", "match_id", "final_score", "created_at"), ["match_id"], [F.col("created_at").desc(), F.col("id").desc()])
    h, a = odds.goals(F.col("final_score"))
    prices = table(spark, sf, "betting_odds").where("bookmaker_name = 'Bet 365' and schedule_id is not null").groupBy(F.col("schedule_id").alias("match_id"))
    prices = prices.agg(F.max_by(F.struct(*[F.col(c).cast("double").alias(n) for c, n in (("init_win", "eu_home"), ("init_draw", "eu_draw"), ("init_lose", "eu_away"))]), "id").alias("p")).select("match_id", "p.*")
    x = table(spark, sf, "total_handicap").select("id", "match_id", "handicap", F.col("init_odds_home").cast("double").alias("asian_home"), F.col("init_odds_away").cast("double").alias("asian_away")).join(lines, "handicap")
    x = x.where("asian_handicap <> 0").join(scores.select("match_id", h.alias("h"), a.alias("a")), "match_id").join(prices, "match_id", "left")
    implied = odds.two_way(F.col("eu_home"), F.col("eu_away"))
    x = x.withColumns({"eu_implied_home": implied[0], "eu_implied_away": implied[1], "label": odds.cover(F.col("h"), F.col("a"), F.col("asian_handicap")).cast("double")}).where("label >= 0")
    return x.select("id", "label", *[F.coalesce(c, F.lit(0.0)).alias(c) for c in FEATURES])


def _fitted(spark: SparkSession, sf: str) -> tuple[str, DataFrame]:
    """The folder of the saved model and the held-out rows (a fifth of each label)."""
    from tidegrid.plans.kernels import stratified_split

    rows = written(stratified_split(VectorAssembler(inputCols=FEATURES, outputCol="features").transform(_cover_rows(spark, sf)), "id", "label", 0.8), "cover")
    train = _fit_part(rows.where("part = 'train'"), "id").withColumn("held", F.pmod(F.xxhash64("id", F.lit(7)), F.lit(5)) == 0)
    # up to 200 rounds; they end when the held-out part of the training rows stops getting better
    model = GBTClassifier(maxIter=200, maxDepth=4, seed=42, validationIndicatorCol="held", validationTol=0.001).fit(train)
    place = f"{shared_dir(spark).rstrip('/')}/cover-{uuid.uuid4().hex}"
    model.write().overwrite().save(place)
    return place, rows.where("part = 'test'")


def cover_classifier(spark: SparkSession, sf: str) -> DataFrame:
    """Does the home side cover its line? Boosted trees, saved and loaded again; accuracy of the threshold 0.5 on held-out rows."""
    place, test = _fitted(spark, sf)
    scored = GBTClassificationModel.load(place).transform(test).withColumn("p", F.get(vector_to_array("probability"), F.lit(1)))
    return scored.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg((F.col("label") == (F.col("p") > 0.5).cast("double")).cast("double")), 6).alias("accuracy"))


def cover_importance(spark: SparkSession, sf: str) -> DataFrame:
    """The classifier's features by importance."""
    place, _ = _fitted(spark, sf)
    found = GBTClassificationModel.load(place).featureImportances.toArray().tolist()
    return spark.createDataFrame(list(zip(FEATURES, found, strict=True)), "feature string, importance double").orderBy(F.desc("importance"), "feature")


def page_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """Every row of total_handicap written as a summary page, its opening prices in one of the four places, and read back."""
    from tidegrid.functions.odds import MASKED
    from tidegrid.sources import handicap_pages

    t = table(spark, sf, "total_handicap")
    escaped = lambda c: F.replace(F.replace(F.replace(F.coalesce(c, F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    price = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    opening, closing = [price("init_odds_home"), escaped(F.col("handicap")), price("init_odds_away")], [price("final_odds_home"), escaped(F.col("final_handicap")), price("final_odds_away")]
    td = lambda text, own="": F.concat(F.lit(f"<td{own}>"), text if not isinstance(text, str) else F.lit(text), F.lit("</td>"))
    empty = F.concat(*[td("")] * 3)
    kinds = {0: " title='t'", 1: f" oddstype='{handicap_pages.LAST}'", 2: f" oddstype='{handicap_pages.CURRENT}'", 3: ""}
    cells = {k: F.concat(*[td(x, own) for x in opening]) for k, own in kinds.items()}
    place = F.when(F.col("init_odds_home").isNull() | F.col("init_odds_away").isNull(), 3).otherwise(F.pmod("id", F.lit(4)))
    first, second = F.when(place == 0, cells[0]).when(place == 3, cells[3]).otherwise(empty), F.when(place == 1, cells[1]).when(place == 2, cells[2]).otherwise(empty)
    masked = F.coalesce(*[F.when(F.col("bookmaker") == k, F.lit(v[0])) for k, v in MASKED.items()])
    page = F.concat(F.lit("<table id='odds'><tr bgcolor='#FFFFFF'>"), td("1"), td(masked), td(""), first, second, F.concat(*[td(x) for x in closing]), F.lit("</tr></table>"))
    pages = t.select(F.concat(F.col("id").cast("string"), F.lit("_total.html")).alias("file"), F.encode(page, "UTF-8").alias("content"))
    return handicap_pages.summary(pages, "utf-8").drop("file").withColumnRenamed("match_id", "id")


def script_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """Every row of betting_odds written as a match script and read back by the source."""
    o = table(spark, sf, "betting_odds").where("schedule_id is not null")

    def price(c: str):
        return F.coalesce(F.col(c).cast("string"), F.lit(""))

    blank = F.lit("")
    at = {i: c for c, i in match_files.PRICE_AT.items()}
    fields = [F.lit("0"), F.col("id").cast("string"), F.col("bookmaker_name"), *[price(at[i]) if i in at else blank for i in range(3, 20)]]
    text = F.concat(F.lit("var ScheduleID="), F.col("schedule_id").cast("string"), F.lit(';\nvar game=Array("'), F.concat_ws("|", *fields), F.lit('");'))
    return match_files.betting_odds(o.select(text.alias("text")))


QUERIES = {"ref_l01_kmeans_words": kmeans_vectors, "ref_l02_kmeans_prices": kmeans_prices, "ref_l03_dbscan": dbscan_words, "ref_l04_cover_classifier": cover_classifier, "ref_l06_importance": cover_importance, "ref_s11_page_round_trip": page_round_trip, "ref_s04_script_round_trip": script_round_trip, "ref_stream_daily_counts": daily_counts}
SQL = {
    "ref_s04_script_round_trip": "SELECT schedule_id, bookmaker_name, " + ", ".join(f"nullif({c}, 0) AS {c}" for c in match_files.PRICE_AT) + " FROM betting_odds WHERE schedule_id IS NOT NULL",
    "ref_s11_page_round_trip": "SELECT id, bookmaker, " + ", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in ("init_odds_home", "init_odds_away", "final_odds_home", "final_odds_away")) + ", " + ", ".join(f"nullif(regexp_replace({c}, '^[\\s\u3000\u00a0]+|[\\s\u3000\u00a0]+$', '', 'g'), '') AS {c}" for c in ("handicap", "final_handicap")) + " FROM total_handicap WHERE bookmaker IN ('bet365', 'easybets', 'macau')",
    "ref_stream_daily_counts": "SELECT date_trunc('day', ts) AS day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2",
}
