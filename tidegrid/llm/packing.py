"""Filling containers of fixed capacity.

First-fit decreasing: items by falling size, each into the first container with room. The first container with room is found
by a tournament tree over the remaining capacities (each inner node holds the larger of its two), in log time. Items are
packed independently in randomised groups of documents whose expected size in tokens is fixed, so a group fits a task at any
scale and only the last containers of each group stay partly empty.

An item over the capacity, and only such, is split: full containers and a remainder. Defined results: a NULL size is no item;
an item of size 0 takes its place in a container; equal sizes are ordered by item number; the largest item of a group has no
limit; an empty table gives no row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def first_fit_decreasing(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The container of each item, given in falling order of size; each at most ``capacity``."""
    n = len(sizes)
    leaves = 1 << max(int(n - 1).bit_length(), 0)
    tree = [capacity] * (2 * leaves)
    out = np.empty(n, np.int64)
    for k, size in enumerate(sizes.tolist()):
        i = 1
        while i < leaves:
            i *= 2
            if tree[i] < size:
                i += 1
        out[k] = i - leaves
        tree[i] -= size
        i //= 2
        while i:
            a, b = tree[2 * i], tree[2 * i + 1]
            top = a if a > b else b
            if tree[i] == top:
                break
            tree[i] = top
            i //= 2
    return out


def _pack(items: pd.DataFrame, packs: list[tuple[str, int]]) -> Iterator[pd.DataFrame]:
    for name, capacity in packs:
        size = items["tokens"].to_numpy()
        pieces = np.maximum(-(-size // capacity), 1)
        at = np.repeat(np.arange(len(size)), pieces)
        piece = np.arange(len(at)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        length = np.minimum(size[at] - piece * capacity, capacity)
        doc = items["doc_id"].to_numpy()[at]
        order = np.lexsort((piece, doc, -length))
        container = np.empty(len(at), np.int64)
        container[order] = first_fit_decreasing(length[order], capacity)
        yield pd.DataFrame({"pack_name": name, "group_no": items["group_no"].to_numpy()[at], "container_no": container, "doc_id": doc, "piece_no": piece, "first_token": piece * capacity, "n_tokens": length})


def pack(items: DataFrame, packs: DataFrame, group_tokens: int = 4_000_000, seed: int = 1) -> DataFrame:
    """``items`` (doc_id, tokens) into containers of every capacity of ``packs`` (pack_name, capacity_tokens).

    Rows (pack_name, group_no, container_no, doc_id, piece_no, first_token, n_tokens); a container is (pack_name, group_no,
    container_no). ``packs`` is a short list of sizes and is read by the driver. ``items`` is read twice: write it first.
    """
    sizes = [(r[0], int(r[1])) for r in packs.select("pack_name", "capacity_tokens").where("capacity_tokens > 0").collect()]
    items = items.select("doc_id", "tokens").where("tokens is not null")
    total = items.agg(F.sum("tokens")).first()[0] or 0
    groups = max(1, -(-int(total) // group_tokens))
    placed = items.withColumn("group_no", F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(groups)).cast("bigint"))
    schema = "pack_name string, group_no bigint, container_no bigint, doc_id bigint, piece_no bigint, first_token bigint, n_tokens bigint"
    return placed.groupBy("group_no").applyInPandas(lambda pdf: pd.concat(list(_pack(pdf, sizes))) if sizes else pd.DataFrame(columns=[c.split()[0] for c in schema.split(", ")]), schema)


def report(placed: DataFrame, packs: DataFrame) -> DataFrame:
    """Containers, tokens and the share of unused space per capacity."""
    used = placed.groupBy("pack_name", "group_no", "container_no").agg(F.sum("n_tokens").alias("t"))
    total = used.groupBy("pack_name").agg(F.count(F.lit(1)).alias("containers"), F.sum("t").alias("tokens"))
    full = F.col("containers") * F.col("capacity_tokens")
    return packs.join(total, "pack_name").select("pack_name", "capacity_tokens", "containers", "tokens", ((full - F.col("tokens")) / full).alias("unused_share"))
