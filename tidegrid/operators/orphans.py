"""References to records that do not exist.

References may have several columns, some NULL. Rows are told apart by their null mask (which reference columns are NULL)
and each mask is anti-joined on its non-null columns only, as the declared match semantics ask:

* ``simple``: a reference with any NULL is not checked;
* ``partial``: its non-null columns must occur together in some target row; all NULL is not checked;
* ``full``: all NULL is not checked, some NULL is itself a broken reference, no NULL is looked up.

Targets are brought to one row per distinct key before the join (map-side first); hot reference keys are joined apart
(``operators.skew``), so neither a key with a third of all rows nor one with many target rows gathers in a task.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import product

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegrid.operators.skew import join_unique


def _by_mask(rows: DataFrame, refs: list[str], match: str) -> Iterator[tuple[str, DataFrame, list[str]]]:
    """The null masks to be checked: the mask, its rows, and the columns to look up (none: each row is broken)."""
    if match not in ("simple", "partial", "full"):
        raise ValueError(match)
    for mask in product((False, True), repeat=len(refs)):
        have = [c for c, null in zip(refs, mask, strict=True) if not null]
        partly = len(have) < len(refs)
        if not have or (match == "simple" and partly):
            continue
        own = rows.where(reduce(lambda a, b: a & b, [F.col(c).isNull() if null else F.col(c).isNotNull() for c, null in zip(refs, mask, strict=True)]))
        yield "".join(str(int(x)) for x in mask), own, [] if match == "full" and partly else have


def orphans(rows: DataFrame, refs: list[str], targets: DataFrame, target_columns: list[str], match: str = "simple") -> DataFrame:
    """The rows whose reference finds no target, with all their columns and ``null_mask`` (``0`` set, ``1`` NULL, per column).

    Defined results: repeated rows stay repeated; target rows with a NULL in a looked-up column match nothing; an empty
    target table makes every checked reference an orphan; an empty ``rows`` gives no row.
    """
    named = targets.select(*[targets[t].alias(c) for t, c in zip(target_columns, refs, strict=True)])
    found = [(join_unique(own, named.select(*keys).distinct(), keys, "left_anti") if keys else own).withColumn("null_mask", F.lit(mask)) for mask, own, keys in _by_mask(rows, refs, match)]
    return reduce(DataFrame.unionByName, found)


def classified(
    rows: DataFrame, refs: list[str], made: str, targets: DataFrame, target_columns: list[str], target_made: str, removed: DataFrame, removed_columns: list[str], match: str = "simple"
) -> DataFrame:
    """Rows with a broken reference and the ``reason``: ``deleted`` (no target, but removed), ``missing`` (neither; with
    ``full`` matching also a reference with some NULLs) or ``late`` (the target's earliest ``target_made`` is after ``made``).

    Targets and removals are one table with a row per key, so each null mask of ``rows`` is joined once, whatever the reason.
    """

    def side(df: DataFrame, columns: list[str], at, there: bool) -> DataFrame:
        return df.select(*[df[t].alias(c) for t, c in zip(columns, refs, strict=True)], at.alias("first_made"), F.lit(there).alias("is_there"), F.lit(not there).alias("was_removed"))

    known = side(targets, target_columns, F.col(target_made), True).unionByName(side(removed, removed_columns, F.lit(None).cast(targets.schema[target_made].dataType), False))
    lost, gone = ~F.coalesce("is_there", F.lit(False)), F.coalesce("was_removed", F.lit(False))
    reason = F.when(lost & gone, "deleted").when(lost, "missing").when(F.col("first_made") > F.col(made), "late")
    found = []
    for _, own, keys in _by_mask(rows, refs, match):
        if keys:
            unique = known.dropna(subset=keys).groupBy(*keys).agg(F.min("first_made").alias("first_made"), F.bool_or("is_there").alias("is_there"), F.bool_or("was_removed").alias("was_removed"))
            met = join_unique(own, unique, keys, "left").withColumn("reason", reason).where("reason is not null")
        else:
            met = own.withColumn("reason", F.lit("missing"))
        found.append(met.select(*rows.columns, "reason"))
    return reduce(DataFrame.unionByName, found)
