"""Similarity clusters of encoded records.

Two records of one block are similar if their codes have the same length and differ in at most ``most`` places and their
means differ by at most ``near``. Rows that agree in block, code and cell of the mean are one node first (all of a cell are
mutually similar), so copies cost nothing. Of ``most`` + 1 segments of two similar codes one must be equal, so similar nodes
meet in a bucket of (block, length, segment). All links, and never all pairs of a bucket, come from three linear steps:

* stars: the heaviest node of each bucket and cell is compared with every other one there; who is similar is linked to it and
  takes its name as a provisional label, so a popular record with its variants is one group, whatever its size;
* groups: of each label in a bucket and cell the records with the highest and the lowest mean stand for the group; groups of
  other labels in the same cell and the next one are compared by them, and are linked if these are similar;
* what is left, two groups of which one has several records and whose representatives differ, is compared record by record.

The clusters are the rows linked by similarity. They are built in rounds on this sparse graph (``operators.components``):
every cluster names its best neighbour, by the mean of the edges between them (average linkage), and all mutual best pairs,
each with everything whose chain of names leads to it, merge in parallel, until no edge is left. Every edge is a similar pair,
so no mean falls below the threshold before the clusters are the linked groups. Every cluster with an edge merges in each
round, so their number at least halves and the rounds are logarithmic, however long a chain of records is.

Defined results: rows with a NULL in block, code or mean take no part; repeated rows are rows like any other; ties between
equally good neighbours are broken by a hash of the pair; codes of any length and alphabet; an empty table gives no row; other
columns are not read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegrid.operators.components import linked
from tidegrid.session import written

#: Characters packed into one bigint for the comparison of codes.
_PACK = 7
#: Buckets with at least this share of all nodes are hot: at most (most + 1) / HOT of them, whose heaviest nodes are broadcast.
HOT = 0.01


def nodes_of(df: DataFrame, row_id: str, block: str, codes: list[str], mean: str, near: float, scale: int = 1000) -> tuple[DataFrame, DataFrame]:
    """Rows (id, block, code, mean, cell) and nodes (node, block, code, packed, cell, low, high, n); a node's number is its
    smallest row id. Means are compared in whole units of 1 / ``scale``, in which they are exact."""
    unit = F.round(df[mean] * scale).cast("bigint")
    rows = df.select(df[row_id].alias("id"), df[block].alias("block"), F.concat(*[df[c] for c in codes]).alias("code"), unit.alias("mean"))
    rows = rows.where("id is not null and block is not null and code is not null and mean is not null")
    width = round(near * scale) + 1
    rows = rows.withColumn("cell", F.floor(F.col("mean") / width))
    nodes = rows.groupBy("block", "code", "cell").agg(F.min("id").alias("node"), F.min("mean").alias("low"), F.max("mean").alias("high"), F.count(F.lit(1)).alias("n"))
    return rows, nodes.withColumn("packed", _packed(F.col("code")))


def _packed(code: Column) -> Column:
    """The code's bytes as bigints of seven; NULL for a code with other than ASCII characters."""
    pieces = F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(F.length(code) / _PACK) - 1, F.lit(0)).cast("int")), lambda i: F.coalesce(F.conv(F.hex(F.substring(code, i * _PACK + 1, F.lit(_PACK))), 16, 10).cast("bigint"), F.lit(0).cast("bigint")))
    return F.when(F.octet_length(code) == F.length(code), pieces)


def _places(a: Column, b: Column) -> Column:
    """Differing places of two nodes' codes of equal length: bytes of the packed forms, else characters."""
    low, high = F.lit(0x7F7F7F7F7F7F7F), F.lit(0x80808080808080)

    def lanes(x: Column, y: Column) -> Column:
        d = x.bitwiseXOR(y)
        return F.bit_count((d.bitwiseAND(low) + low).bitwiseOR(d).bitwiseAND(high))

    fast = F.aggregate(F.zip_with(a["packed"], b["packed"], lanes), F.lit(0), lambda s, x: s + x)
    slow = F.size(F.filter(F.zip_with(F.split(a["code"], ""), F.split(b["code"], ""), lambda x, y: ~x.eqNullSafe(y)), lambda d: d))
    return F.when(a["packed"].isNotNull() & b["packed"].isNotNull(), fast).otherwise(slow)


def _judged(pairs: DataFrame, most: int, limit: int) -> DataFrame:
    """(a, b, away) of the pairs of nodes ``x`` and ``y`` that are similar; ``away`` grows with the differences of code and mean."""
    x, y = F.col("x"), F.col("y")
    alike = (x["block"] == y["block"]) & (F.length(x["code"]) == F.length(y["code"])) & (x["node"] != y["node"])
    apart = F.greatest(F.lit(0), x["low"] - y["high"], y["low"] - x["high"])
    near = pairs.where(alike).withColumn("apart", F.when(x["cell"] == y["cell"], F.lit(0)).otherwise(apart)).where(F.col("apart") <= limit)
    near = near.withColumn("places", _places(x, y)).where(F.col("places") <= most)
    return near.select(*[c for c in pairs.columns if c not in ("x", "y")], F.least(x["node"], y["node"]).alias("a"), F.greatest(x["node"], y["node"]).alias("b"), (F.col("places") * 1_000_000 + F.col("apart")).cast("bigint").alias("away"))


_NODE = ("node", "block", "code", "packed", "cell", "low", "high")


def _looked_up(pairs: DataFrame, nodes: DataFrame, sides: dict[str, str]) -> DataFrame:
    """``pairs`` with the node that each column of ``sides`` names, as a struct."""
    for column, name in sides.items():
        pairs = pairs.join(nodes.select(F.col("node").alias(column), F.struct(*_NODE).alias(name)), column)
    return pairs


def _buckets(nodes: DataFrame, most: int, carry: list[str]) -> DataFrame:
    """A row (key, cell, node, carry) per node and segment; keys are hashes, and what meets under one is compared whole."""
    parts, code = most + 1, F.col("code")
    start, stop = (F.floor(F.length(code) * (F.col("k") + d) / parts).cast("int") for d in (0, 1))
    keyed = nodes.select("node", "block", "code", "cell", *carry, F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("k"))
    return keyed.select(F.xxhash64("block", F.length(code), "k", F.substring(code, start + 1, stop - start)).alias("key"), "cell", "node", *carry)


def similar_pairs(nodes: DataFrame, most: int, near: float, scale: int = 1000) -> DataFrame:
    """Pairs (a, b, away) of similar nodes, a < b, each once, that link whatever is linked. ``nodes`` is read several times:
    write it first."""
    limit = round(near * scale)
    keyed = _buckets(nodes, most, ["n"])
    heaviest = keyed.groupBy("key", "cell").agg(F.max_by("node", F.struct("n", -F.col("node"))).alias("pivot"), F.max("n").alias("weight"), F.count(F.lit(1)).alias("met")).where("met > 1")
    heaviest = written(_looked_up(heaviest, nodes, {"pivot": "y"}), "heaviest")
    hot = heaviest.where(F.col("met") >= F.lit(HOT * nodes.count()))
    # a hot bucket's rows meet its one heaviest node where they are; the rest is shuffled by bucket
    few = F.broadcast(hot)
    met = keyed.join(few, ["key", "cell"]).unionByName(keyed.join(F.broadcast(hot.select("key", "cell")), ["key", "cell"], "left_anti").join(heaviest, ["key", "cell"]))
    met = met.where("node <> pivot").groupBy("node", "pivot").agg(F.first("y").alias("y"), F.max("weight").alias("weight"))
    stars = written(_judged(_looked_up(met, nodes, {"node": "x"}), most, limit), "stars")
    label = stars.groupBy("node").agg(F.max_by("pivot", F.struct("weight", -F.col("pivot"))).alias("label"))
    labelled = written(nodes.join(label, "node", "left").withColumn("label", F.coalesce("label", "node")).select(*_NODE, "label"), "labelled")

    in_group = _buckets(labelled, most, ["label", "low", "high"])
    groups = in_group.groupBy("key", "cell", "label").agg(
        F.count(F.lit(1)).alias("m"), F.max_by("node", F.struct("high", "node")).alias("top"), F.max("high").alias("high"), F.min_by("node", F.struct("low", "node")).alias("bottom"), F.min("low").alias("low")
    )
    groups = written(groups, "groups")
    under = groups.select("key", F.col("cell").alias("at"), F.col("label").alias("label_x"), F.col("m").alias("m_x"), F.col("top").alias("node_x"), F.col("high").alias("high_x"))
    over = groups.select("key", "cell", F.explode(F.array(F.col("cell"), F.col("cell") - 1)).alias("at"), F.col("label").alias("label_y"), F.col("m").alias("m_y"), F.col("bottom").alias("node_y"), F.col("low").alias("low_y"))
    same = F.col("cell") == F.col("at")
    meet = under.join(over, ["key", "at"]).where((same & (F.col("label_x") < F.col("label_y"))) | (~same & (F.col("label_x") != F.col("label_y")) & (F.col("low_y") - F.col("high_x") <= limit)))
    meet = written(meet.select("key", "at", "cell", "label_x", "label_y", "node_x", "node_y", (F.col("m_x") + F.col("m_y") > 2).alias("several")), "meet")
    found = _judged(_looked_up(meet.select("node_x", "node_y").distinct(), nodes, {"node_x": "x", "node_y": "y"}), most, limit)
    found = written(found.select("node_x", "node_y", "a", "b", "away"), "found")

    # groups of several records whose representatives are not similar: record by record
    open_ = meet.where("several").join(found.select("node_x", "node_y"), ["node_x", "node_y"], "left_anti").drop("node_x", "node_y", "several")
    members = in_group.select("key", "cell", "label", "node")
    wide = open_.join(members.select("key", F.col("cell").alias("at"), F.col("label").alias("label_x"), F.col("node").alias("node_x")), ["key", "at", "label_x"])
    wide = wide.join(members.select("key", "cell", F.col("label").alias("label_y"), F.col("node").alias("node_y")), ["key", "cell", "label_y"])
    rest = _judged(_looked_up(wide.select("node_x", "node_y").distinct(), nodes, {"node_x": "x", "node_y": "y"}), most, limit)
    return reduce(DataFrame.unionByName, [e.select("a", "b", "away") for e in (stars, found, rest)]).groupBy("a", "b").agg(F.min("away").alias("away"))


def clusters(df: DataFrame, row_id: str, block: str, codes: list[str], mean: str, most: int = 4, near: float = 0.125) -> DataFrame:
    """(id, block, code, mean, cluster) of all rows that take part; a cluster is named by its smallest row id."""
    rows, nodes = nodes_of(df, row_id, block, codes, mean, near)
    nodes = written(nodes, "nodes")
    label = linked(written(similar_pairs(nodes, most, near), "pairs"))
    known = nodes.join(label, "node", "left").select("block", "code", "cell", F.coalesce("cluster", "node").alias("cluster"))
    return rows.join(known, ["block", "code", "cell"]).select("id", "block", "code", "mean", "cluster")


def described(members: DataFrame, top: int = 3, salts: int = 16) -> DataFrame:
    """Size and the ``top`` most typical members of each cluster: those that differ from the cluster's usual code (the most
    frequent character of each place) in fewest places, then lie nearest to its mean, then by id.

    The usual code is counted per place, map-side first, and candidates are ranked within salted parts of a cluster first,
    so a cluster of any size is never gathered or sorted in one task.
    """
    sizes = members.groupBy("block", "cluster").agg(F.count(F.lit(1)).alias("size"), F.avg("mean").alias("middle"))
    alike = members.groupBy("cluster", "code").agg(F.count(F.lit(1)).alias("n"))
    places = alike.select("cluster", "n", F.posexplode(F.split("code", "")).alias("place", "letter"))
    votes = places.groupBy("cluster", "place", "letter").agg(F.sum("n").alias("n"))
    usual = votes.groupBy("cluster", "place").agg(F.max_by("letter", F.struct("n", "letter")).alias("letter"))
    usual = usual.groupBy("cluster").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "letter"))), lambda x: x["letter"]).alias("usual"))
    about = sizes.join(usual, "cluster")
    unlike = F.size(F.filter(F.zip_with(F.split("code", ""), F.col("usual"), lambda x, y: ~x.eqNullSafe(y)), lambda d: d))
    judged = members.join(about.drop("block"), "cluster").withColumn("unlike", unlike).withColumn("off", F.abs(F.col("mean") - F.col("middle")))
    order = ["unlike", "off", "id"]
    part = judged.select("cluster", *order, F.pmod(F.xxhash64("id"), F.lit(salts)).alias("salt"))
    best = part.withColumn("r", F.row_number().over(Window.partitionBy("cluster", "salt").orderBy(*order))).where(F.col("r") <= top)
    best = best.withColumn("r", F.row_number().over(Window.partitionBy("cluster").orderBy(*order))).where(F.col("r") <= top)
    typical = best.groupBy("cluster").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "id"))), lambda x: x["id"]).alias("ids"))
    return sizes.join(typical, "cluster").select("block", "cluster", "size", F.array_join(F.transform("ids", lambda x: x.cast("string")), ",").alias("typical_ids"))
