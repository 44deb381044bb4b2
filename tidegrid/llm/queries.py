"""Queries of the problems tagged llm (2, 3, 8, 9, 10)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegrid.llm import canonical, clusters, mixing, packing, residue, tokens
from tidegrid.session import table, written


def _mapped(spark: SparkSession, sf: str, operator=canonical.map_values) -> DataFrame:
    lines = [tuple(r) for r in table(spark, sf, "handicap_lines").select("line_id", "line_name", "line_value", "line_name_en").collect()]  # the reference list
    return operator(table(spark, sf, "total_handicap"), "id", ["handicap", "final_handicap"], canonical.line_matcher(lines), frozenset(x[1] for x in lines))


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    return _mapped(spark, sf).select("id", "field", "line_id")


def p2_unlisted(spark: SparkSession, sf: str) -> DataFrame:
    """Values that mean no listed line, with how often each was entered."""
    return _mapped(spark, sf).where("line_id = -1").groupBy("field", "value").agg(F.count(F.lit(1)).alias("n"))


def p2_candidates(spark: SparkSession, sf: str) -> DataFrame:
    """All lines within the distance of each value, with the distance; -1 for a value without any."""
    return _mapped(spark, sf, canonical.map_candidates)


def _clusters(spark: SparkSession, sf: str) -> DataFrame:
    return clusters.clusters(table(spark, sf, "sax_encoding"), "id", "bookmaker", ["sax_interleaved", "sax_delta"], "home_mean")


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    return _clusters(spark, sf).where("id <> cluster").select(F.col("cluster").alias("first_id"), F.col("id").alias("member_id"))


def p3_clusters(spark: SparkSession, sf: str) -> DataFrame:
    """Each cluster's size and most typical members."""
    return clusters.described(written(_clusters(spark, sf), "members"))


def _tokens(spark: SparkSession, sf: str, carry: list[str]) -> DataFrame:
    return written(tokens.count_tokens(table(spark, sf, "documents"), "text", carry), "tokens")


def p8_packing(spark: SparkSession, sf: str) -> DataFrame:
    """Where each document, or piece of one, lies, for every capacity."""
    return packing.pack(_tokens(spark, sf, ["doc_id"]), table(spark, sf, "pack_sizes"))


def p8_report(spark: SparkSession, sf: str) -> DataFrame:
    packs = table(spark, sf, "pack_sizes")
    return packing.report(packing.pack(_tokens(spark, sf, ["doc_id"]), packs), packs)


def p9_mixture(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.mixture(_tokens(spark, sf, ["doc_id", "source"]), table(spark, sf, "mix_targets"))


#: Token budget of p9_budget.
BUDGET = 1_000_000


def p9_budget(spark: SparkSession, sf: str) -> DataFrame:
    """The mixture cut at a total budget: sources that run out within their repeats give less, as reported."""
    docs, targets = _tokens(spark, sf, ["doc_id", "source"]), table(spark, sf, "mix_targets")
    return mixing.shares(docs, targets, mixing.mixture(docs, targets, BUDGET))


def p9_shares(spark: SparkSession, sf: str) -> DataFrame:
    docs, targets = _tokens(spark, sf, ["doc_id", "source"]), table(spark, sf, "mix_targets")
    return mixing.shares(docs, targets, mixing.mixture(docs, targets))


def p10_found(spark: SparkSession, sf: str) -> DataFrame:
    """Documents with residue in place of their own content."""
    return residue.excluded(table(spark, sf, "documents").select("doc_id", "text"), "doc_id", "text").withColumnRenamed("id", "doc_id")


QUERIES = {"p2_found": p2_found, "p2_unlisted": p2_unlisted, "p2_candidates": p2_candidates, "p3_found": p3_found, "p3_clusters": p3_clusters, "p8_packing": p8_packing, "p8_report": p8_report, "p9_mixture": p9_mixture, "p9_shares": p9_shares, "p9_budget": p9_budget, "p10_found": p10_found}
SQL: dict[str, str] = {}
