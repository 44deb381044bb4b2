"""Mixing sources to target shares by weighted fair queueing.

Every source's documents are shuffled (by a hash) and repeated whole, round after round, at most ``max_repeats`` times. A
document's virtual finish time is the running token count of its source divided by the source's weight; the mixture is all
documents in order of that time, cut at the total budget. So at every point of the mixture each source has its share, up to
one document, as long as it lasts.

Running counts are made without gathering a source: within ranges of the shuffle hash (``slices``, by default one per
``SLICE_ROWS`` documents), plus the totals of the ranges before, a table of at most ``slices`` rows per source. The same way finds the cut: totals per interval of virtual time.

Defined results: documents with a NULL source, a source without target, or NULL tokens are in no mixture; a target source
without documents stays empty and is reported; a document of 0 tokens costs nothing; ties of time are broken by source, round
and hash; the default budget is the largest at which no source with documents runs out, so that these keep their shares.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Documents of a slice, on average: what one task orders at once; the number of slices grows with the documents.
SLICE_ROWS = 50_000


def running_total(rows: DataFrame, group: list[str], position: str, order: list[str], amount: str, out: str) -> DataFrame:
    """Adds the running sum of ``amount`` per group in the order of ``position`` (a slice number), then ``order``.

    Within a slice by a window, across slices by the totals of the slices before.
    """
    totals = rows.groupBy(*group, position).agg(F.sum(amount).alias("slice_total"))
    ahead = Window.partitionBy(*group).orderBy(position).rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select(*group, position, F.coalesce(F.sum("slice_total").over(ahead), F.lit(0)).alias("slice_before"))
    within = Window.partitionBy(*group, position).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn("in_slice", F.sum(amount).over(within)).join(before, [*group, position]).withColumn(out, F.col("slice_before") + F.col("in_slice")).drop("slice_before", "in_slice")


def mixture(docs: DataFrame, targets: DataFrame, budget: int | None = None, seed: int = 1, slices: int | None = None) -> DataFrame:
    """Rows (mix_rank_tokens, source, doc_id, repeat_no, tokens, finish) of the mixture, ``mix_rank_tokens`` being the tokens
    up to and with the row. ``docs`` (doc_id, source, tokens) is read several times: write it first. ``targets`` (source,
    target_share, max_repeats) is a short list, read by the driver."""
    wanted = {r["source"]: (float(r["target_share"]), int(r["max_repeats"])) for r in targets.where("source is not null and target_share > 0 and max_repeats > 0").collect()}
    spark = docs.sparkSession
    docs = docs.select("doc_id", "source", "tokens").where("source is not null and tokens is not null and doc_id is not null")
    shape = "mix_rank_tokens bigint, source string, doc_id bigint, repeat_no int, tokens bigint, finish double"
    if not wanted:
        return spark.createDataFrame([], shape)
    weights = F.create_map(*[F.lit(x) for s, (w, _) in wanted.items() for x in (s, w)])
    repeats = F.create_map(*[F.lit(x) for s, (_, m) in wanted.items() for x in (s, m)])
    docs = docs.where(F.col("source").isin(list(wanted)))
    have = docs.groupBy("source").agg(F.sum("tokens").alias("t"), F.count(F.lit(1)).alias("n")).collect()  # one row per target
    size = {r["source"]: int(r["t"]) for r in have}
    slices = slices or max(16, -(-sum(r["n"] for r in have) // SLICE_ROWS))
    size = {s: t for s, t in size.items() if t > 0}
    if not size:
        return spark.createDataFrame([], shape)
    # virtual time at which the first source runs out; nothing finishes after the time the budget buys
    runs_out = {s: t * wanted[s][1] / wanted[s][0] for s, t in size.items()}
    end = min(runs_out.values()) if budget is None else max(runs_out.values())
    of = F.create_map(*[F.lit(x) for s, t in size.items() for x in (s, t)])
    shuffled = docs.where(F.col("source").isin(list(size))).withColumn("h", F.xxhash64("doc_id", F.lit(seed))).withColumn("slice", F.floor(F.shiftrightunsigned("h", 33) / F.lit((1 << 31) / slices)))
    summed = running_total(shuffled, ["source"], "slice", ["h", "doc_id"], "tokens", "cumulative")
    needed = F.ceil(F.lit(end) * weights[F.col("source")] / of[F.col("source")])
    rounds = F.sequence(F.lit(0), F.greatest(F.lit(1), F.least(repeats[F.col("source")].cast("bigint"), needed)).cast("int") - 1)
    queued = summed.withColumn("repeat_no", F.explode(rounds))
    queued = queued.withColumn("finish", (F.col("cumulative") + F.col("repeat_no") * of[F.col("source")]) / weights[F.col("source")]).where(F.col("finish") <= F.lit(end))
    width = max(end / slices, 1e-9)
    queued = queued.withColumn("slice", F.floor(F.col("finish") / width))
    if budget is not None:
        # the interval in which the budget is spent bounds what has to be ranked
        totals = queued.groupBy("slice").agg(F.sum("tokens").alias("t")).withColumn("all", F.sum("t").over(Window.orderBy("slice")))
        last = totals.where(F.col("all") >= budget).agg(F.min("slice")).first()[0]
        queued = queued.where(F.col("slice") <= last) if last is not None else queued
    ranked = running_total(queued.withColumn("all_sources", F.lit(0)), ["all_sources"], "slice", ["finish", "source", "repeat_no", "h", "doc_id"], "tokens", "mix_rank_tokens")
    if budget is not None:
        ranked = ranked.where(F.col("mix_rank_tokens") <= budget)
    return ranked.select(F.col("mix_rank_tokens").cast("bigint"), "source", "doc_id", "repeat_no", "tokens", "finish")


def shares(docs: DataFrame, targets: DataFrame, mixed: DataFrame) -> DataFrame:
    """Per target source: what it has, what the mixture took, the share reached and the repeats used."""
    taken = mixed.groupBy("source").agg(F.sum("tokens").alias("mixed_tokens"), F.count(F.lit(1)).alias("mixed_docs"), (F.max("repeat_no") + 1).alias("rounds_used"))
    have = docs.where("tokens is not null").groupBy("source").agg(F.sum("tokens").alias("source_tokens"), F.count(F.lit(1)).alias("source_docs"))
    total = F.sum("mixed_tokens").over(Window.partitionBy(F.lit(0)))
    zero = F.lit(0)
    out = targets.join(have, "source", "left").join(taken, "source", "left").withColumn("all_tokens", total)
    return out.select(
        "source", "target_share", "max_repeats", F.coalesce("source_docs", zero).alias("source_docs"), F.coalesce("source_tokens", zero).alias("source_tokens"), F.coalesce("mixed_docs", zero).alias("mixed_docs"),
        F.coalesce("mixed_tokens", zero).alias("mixed_tokens"), F.coalesce("rounds_used", zero).alias("rounds_used"), F.coalesce(F.col("mixed_tokens") / F.col("all_tokens"), F.lit(0.0)).alias("actual_share"),
    )
