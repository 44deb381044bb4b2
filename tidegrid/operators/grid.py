"""Irregular readings onto a regular grid.

Readings are first brought to one per series and slot (map-side first, so a series with a third of all rows shrinks before
it is shuffled). Consecutive slots are paired by ``lead``; only the grid times between a pair are exploded, and filled or
marked by the length of their gap in the same row. No series is ever in one task as a whole: ``lead`` runs within blocks of
``block`` slots of a series, and the pair across a block's end comes from the next block's first slot.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegrid.session import written

#: Grid times made from one row at once; a longer gap is exploded in pieces of this size.
PIECE = 4096


def slot_of(seconds: Column, period: int) -> Column:
    return F.floor(seconds / F.lit(period)).cast("bigint")


def regular_grid(
    df: DataFrame,
    keys: list[str],
    seconds: str,
    period: int,
    values: list[str] = (),
    max_fill: int = 4,
    gaps_only: bool = False,
    boundaries: DataFrame | None = None,
    block: int = 2048,
) -> DataFrame:
    """Columns ``keys``, ``slot``, ``state`` and ``values``: a row per slot of each series from its first to its last reading.

    ``seconds`` holds epoch seconds; a slot is ``floor(seconds / period)``. ``state`` is ``observed`` (the slot's latest
    reading, ties by the largest values), ``filled`` (a gap of at most ``max_fill`` slots: linear between its neighbours,
    NULL where one of them is NULL), ``missing`` (a longer gap: NULL), or with ``boundaries`` (``keys``, ``from_slot``,
    ``to_slot``) ``before`` or ``after`` for the slots to which the series is extended: NULL values.

    Defined results: rows with a NULL in a key or a NULL time are no readings; a series with one slot has no gaps; repeated
    rows count once; other columns, whatever their names, are not read; an empty table gives no row. ``gaps_only`` leaves
    the observed slots out before anything is exploded.
    """
    names = [f"v{i}" for i in range(len(values))]
    k = [f"k{i}" for i in range(len(keys))]
    rows = df.select(*[df[c].alias(a) for c, a in zip(keys, k, strict=True)], df[seconds].cast("double").alias("t"), *[df[v].cast("double").alias(n) for v, n in zip(values, names, strict=True)])
    rows = rows.where(" and ".join(f"{c} is not null" for c in [*k, "t"])).withColumn("slot", slot_of(F.col("t"), period))
    v = F.struct(*[F.col(n) for n in names]) if names else F.lit(True)
    if names:
        slots = rows.groupBy(*k, "slot").agg(F.max(F.struct("t", v.alias("v"))).alias("m")).select(*k, "slot", F.col("m.v").alias("v"))
    else:
        slots = rows.select(*k, "slot").distinct().withColumn("v", v)
    slots = slots.withColumn("kind", F.lit(0))
    if boundaries is not None:
        marks = boundaries.select(*[boundaries[c].alias(a) for c, a in zip(keys, k, strict=True)], F.explode(F.array(F.struct(F.col("from_slot").alias("slot"), F.lit(1).alias("kind")), F.struct((F.col("to_slot")).alias("slot"), F.lit(2).alias("kind")))).alias("b"))
        marks = marks.select(*k, "b.slot", "b.kind").where("slot is not null").distinct()
        marks = marks.join(slots.select(*k, "slot"), [*k, "slot"], "left_anti")
        slots = slots.unionByName(marks, allowMissingColumns=True)
    slots = slots.withColumn("block", F.floor(F.col("slot") / block))
    slots = written(slots, "slots")  # used for the pairs and for the blocks' first slots
    within = Window.partitionBy(*k, "block").orderBy("slot", "kind")
    paired = slots.withColumn("next", F.lead(F.struct("slot", "v", "kind")).over(within))
    firsts = slots.groupBy(*k, "block").agg(F.min(F.struct("slot", "kind", "v")).alias("first"))
    heads = firsts.withColumn("next_head", F.lead("first").over(Window.partitionBy(*k).orderBy("block"))).where("next_head is not null").drop("first")
    paired = paired.join(heads, [*k, "block"], "left")
    following = F.coalesce("next", F.struct(F.col("next_head.slot").alias("slot"), F.col("next_head.v").alias("v"), F.col("next_head.kind").alias("kind")))
    paired = paired.withColumn("next", F.when(F.col("next").isNotNull() | F.col("next_head").isNotNull(), following))
    gap = F.col("next.slot") - F.col("slot") - 1
    first = F.lit(1 if gaps_only else 0)
    paired = paired.withColumn("gap", F.coalesce(gap, F.lit(0))).where((F.col("gap") > 0) | F.lit(not gaps_only))
    pieces = paired.withColumn("from", F.explode(F.sequence(first.cast("bigint"), F.col("gap"), F.lit(PIECE).cast("bigint"))))
    grid = pieces.withColumn("i", F.explode(F.sequence(F.col("from"), F.least(F.col("gap"), F.col("from") + (PIECE - 1)))))
    inside = F.col("i") > 0
    state = (
        F.when(~inside, F.when(F.col("kind") == 0, F.lit("observed")).when(F.col("kind") == 1, F.lit("before")).otherwise(F.lit("after")))
        .when(F.col("kind") == 1, F.lit("before"))
        .when(F.col("next.kind") == 2, F.lit("after"))
        .when(F.col("gap") <= max_fill, F.lit("filled"))
        .otherwise(F.lit("missing"))
    )
    grid = grid.withColumn("state", state)

    def value(n: str) -> Column:
        a, b = F.col(f"v.{n}"), F.col(f"next.v.{n}")
        return F.when(F.col("state") == "observed", a).when(F.col("state") == "filled", a + (b - a) * F.col("i") / (F.col("gap") + 1))

    return grid.select(*[F.col(a).alias(c) for c, a in zip(keys, k, strict=True)], (F.col("slot") + F.col("i")).alias("slot"), "state", *[value(n).alias(c) for c, n in zip(values, names, strict=True)])
