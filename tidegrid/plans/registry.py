"""All core queries and their SQL, by name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidegrid.plans import kernels, learning, odds_queries, relational

_MODULES = [odds_queries, relational, kernels, learning]

QUERIES = {k: f for m in _MODULES for k, f in m.QUERIES.items()}
SQL = {k: s for m in _MODULES for k, s in m.SQL.items()}


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    return QUERIES["ref_flagship_word_purity"](spark, sf)
