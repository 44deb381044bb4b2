import math
import random
from collections import defaultdict

import numpy as np
import pytest

from tidegrid.functions import series
from tidegrid.operators import asof, grid, orphans, profile, skew, spikes
from pyspark.sql import functions as F


def test_grid_like_brute_force(spark):
    rng = random.Random(3)
    rows = [(k, rng.choice([None, *range(0, 4000, 7)]) if rng.random() < 0.9 else rng.randrange(10**6), rng.choice([None, 1.0, 2.5, 9.0])) for k in ["a", "b", None, "c"] for _ in range(60)] + [("d", 50, 1.0)] * 3
    df = spark.createDataFrame(rows, "k string, t long, v double").withColumn("slot", F.lit("clash"))
    got = {(r["k"], r["slot"]): (r["state"], r["v"]) for r in grid.regular_grid(df, ["k"], "t", 100, ["v"], max_fill=3, block=5).collect()}
    best = {}
    for k, t, v in rows:
        if k is not None and t is not None:
            key = (t, -math.inf if v is None else v)
            best[(k, t // 100)] = max(best.get((k, t // 100), (-1, 0)), key)
    by = defaultdict(list)
    for k, s in sorted(best):
        by[k].append(s)
    want = {}
    for k, slots in by.items():
        value = lambda s: None if best[(k, s)][1] == -math.inf else best[(k, s)][1]  # noqa: B023, E731
        for s in slots:
            want[(k, s)] = ("observed", value(s))
        for a, b in zip(slots, slots[1:]):
            for s in range(a + 1, b):
                short = b - a - 1 <= 3
                both = value(a) is not None and value(b) is not None
                want[(k, s)] = ("filled" if short else "missing", value(a) + (value(b) - value(a)) * (s - a) / (b - a) if short and both else None)
    assert got.keys() == want.keys()
    for key, (state, v) in want.items():
        assert got[key][0] == state and (v is None and got[key][1] is None or v is not None and got[key][1] == pytest.approx(v)), key
    gaps = {(r["k"], r["slot"]) for r in grid.regular_grid(df, ["k"], "t", 100, gaps_only=True, block=3).collect()}
    assert gaps == {k for k, (s, _) in want.items() if s != "observed"}


def test_grid_boundaries_and_empty(spark):
    df = spark.createDataFrame([("a", 250, 1.0), ("a", 450, 2.0)], "k string, t long, v double")
    ends = spark.createDataFrame([("a", 0, 6), ("z", 1, 2)], "k string, from_slot long, to_slot long")
    got = sorted((r["k"], r["slot"], r["state"]) for r in grid.regular_grid(df, ["k"], "t", 100, ["v"], boundaries=ends).collect())
    assert [x for x in got if x[0] == "a"] == [("a", 0, "before"), ("a", 1, "before"), ("a", 2, "observed"), ("a", 3, "filled"), ("a", 4, "observed"), ("a", 5, "after"), ("a", 6, "after")]
    assert grid.regular_grid(df.limit(0), ["k"], "t", 100, ["v"]).count() == 0


def test_orphans_by_null_mask(spark):
    rows = spark.createDataFrame([(1, 1, "x"), (2, 1, "y"), (3, None, "x"), (4, None, "z"), (5, 9, None), (6, None, None), (7, 1, None), (1, 1, "x")], "id int, a int, b string")
    target = spark.createDataFrame([(1, "x"), (1, "x"), (2, None)], "a int, b string")
    ids = lambda m: sorted(r["id"] for r in orphans.orphans(rows, ["a", "b"], target, ["a", "b"], m).collect())
    assert ids("simple") == [2] and ids("partial") == [2, 4, 5] and ids("full") == [2, 3, 4, 5, 7]
    assert sorted(r["id"] for r in orphans.orphans(rows, ["a"], target.limit(0), ["a"]).collect()) == [1, 1, 2, 5, 7]
    with pytest.raises(ValueError):
        orphans.orphans(rows, ["a"], target, ["a"], "other")


def test_join_unique_with_a_hot_key(spark):
    rows = spark.range(3000).select(F.when(F.col("id") < 1000, F.lit(7)).when(F.col("id") < 1010, None).otherwise(F.col("id")).alias("k"), "id")
    unique = spark.createDataFrame([(7, "hot"), (1500, "cold")], "k long, v string")
    assert skew.hot_keys(rows.where("k is not null"), ["k"]) == [(7,)]
    got = skew.join_unique(rows, unique, ["k"], "left")
    assert got.count() == 3000 and got.where("v = 'hot'").count() == 1000 and got.where("v = 'cold'").count() == 1
    assert skew.join_unique(rows, unique, ["k"], "left_anti").count() == 1999


def test_spikes():
    rules = spikes.SpikeRules()
    base = [2.0, 2.01, 2.0, 1.99, 2.0, 2.02, 2.0, 2.01]
    one = base[:4] + [2.6] + base[4:]
    two = base[:4] + [2.6, 2.5] + base[4:]
    shift = base[:4] + [2.6] * 3 + [2.61, 2.6, 2.59]
    for x, hits in ((one, [4]), (two, [4, 5]), (shift, []), (base, []), ([], []), ([2.0, 9.0], [])):
        v = np.log(np.array(x)) if x else np.zeros(0)
        assert np.flatnonzero(spikes.spike_candidates(v, np.zeros(len(x), int), rules)).tolist() == hits
    prices = np.array([[2.0, 3.0, 4.0]] * 6 + [[2.1, 3.0, 4.0], [0.9, 3, 4], [np.nan, 3, 4], [2, 1001, 4]])
    impossible, stuck, _, _ = spikes.judge_lists(prices, np.zeros(len(prices), int), rules)
    assert np.flatnonzero(impossible).tolist() == [7, 9] and np.flatnonzero(stuck).tolist() == list(range(6))
    assert not spikes.judge_lists(prices[:6], np.array([0, 0, 0, 1, 1, 1]), rules)[1].any()


def test_spike_query_flags_against_the_source(spark):
    import json

    from tidegrid.plans.odds_tables import READING_PRICES

    def payload(home):
        return json.dumps({"bookmakerName": "B", "runningOdds": [{"home": str(h), "draw": 3.1 + 0.01 * (i % 2), "away": "4.0", "time": "05-01 10:00"} for i, h in enumerate(home)]})

    calm = [2.0, 2.01, 2.0, 1.99, 2.0, 2.4, 2.02, 2.0, 2.01, 2.0, 1.99, 2.01]
    wild = [2.0, 2.3, 1.9, 2.2, 1.8, 2.4, 1.9, 2.2, 2.0, 2.3, 1.9, 2.1]
    rows = [(1, 10, payload(calm)), (2, 11, payload(wild)), (3, 12, None), (4, None, payload(calm))]
    df = spark.createDataFrame(rows, "id long, schedule_id long, payload string").withColumn("created_at", F.to_timestamp(F.lit("2024-06-01")))
    got = sorted((r["id"], r["seq"]) for r in spikes.flag_readings(df, "payload", READING_PRICES).collect())
    assert got == [(1, 5), (4, 5)]
    assert spikes.flag_readings(df.limit(0), "payload", READING_PRICES).count() == 0


def test_rates_of_change_are_held_against_the_source(spark):
    import json

    from tidegrid.plans.odds_tables import READING_PRICES

    def payload(minutes, home):
        return json.dumps({"bookmakerName": "B", "runningOdds": [{"home": h, "draw": 3.1, "away": 4.0, "time": f"2024-05-01 {10 + m // 60}:{m % 60:02}"} for m, h in zip(minutes, home)]})

    calm = [2.0 + 0.01 * (i % 2) for i in range(12)]
    jump = [*calm[:6], *(2.3 + 0.01 * (i % 2) for i in range(6))]
    rows = [(1, 10, payload(range(0, 360, 30), jump)), (2, None, payload(range(0, 360, 30), calm)), (3, None, "[]"), (4, 12, payload([0] * 12, jump))]
    df = spark.createDataFrame(rows, "id long, schedule_id long, payload string").withColumn("created_at", F.to_timestamp(F.lit("2024-06-01")))
    got = spikes.flag_readings(df, "payload", READING_PRICES, rates=True)
    assert [(r["id"], r["seq"], r["spike"]) for r in got.where("fast").collect()] == [(1, 6, False)]


def test_sketches_merge_exactly():
    steps = np.abs(np.random.default_rng(1).normal(0, 0.02, 1000))
    whole = np.bincount(spikes.bucket(steps), minlength=spikes.BUCKETS)
    parts = sum(np.bincount(spikes.bucket(p), minlength=spikes.BUCKETS) for p in np.array_split(steps, 7))
    assert (whole == parts).all()


def test_exact_quantiles(spark):
    rng = np.random.default_rng(9)
    data = [("a", float(v)) for v in rng.normal(size=501)] + [("b", 1.0)] * 300 + [("b", 2.0), ("b", 5.0)] + [("c", 3.5), ("c", None), ("d", None)]
    df = spark.createDataFrame(data, "k string, v double")
    qs = [0.0, 0.1, 0.25, 0.5, 0.9, 0.999, 1.0]
    got = {r["k"]: r["quantiles"] for r in profile.exact_quantiles(profile.value_counts(df, ["k"], "v"), ["k"], "v", qs, slices=8).collect()}
    assert got.keys() == {"a", "b", "c"}
    for k, q in got.items():
        assert q == pytest.approx(np.quantile([v for kk, v in data if kk == k and v is not None], qs).tolist())


def test_asof_across_blocks(spark):
    rng = random.Random(5)
    left = [(i, rng.choice("ab"), rng.randrange(5000)) for i in range(200)]
    right = [(rng.choice("ab"), rng.randrange(5000), float(i)) for i in range(60)]
    ts = F.timestamp_seconds("s").alias("ts")
    a = spark.createDataFrame(left, "id int, k string, s int").select("id", "k", ts)
    b = spark.createDataFrame(right, "k string, s int, v double").select("k", ts, "v")
    got = {r["id"]: r["v"] for r in asof.asof_backward(a, b, "k", "ts", "v", block_seconds=300).collect()}
    for i, k, s in left:
        before = [(t, v) for kk, t, v in right if kk == k and t < s]
        assert got[i] == (max(before)[1] if before else None)


def test_band_join_misses_nothing(spark):
    rng = random.Random(2)
    xs = [(i, "k", round(math.exp(rng.uniform(0, 3)), 3)) for i in range(300)]
    df = spark.createDataFrame(xs, "id int, k string, p double")
    got = {(r["t"], r["id"]) for r in asof.band_join(df.select(F.col("id").alias("t"), "k", F.col("p").alias("q")), df, ["k"], [("q", "p")], 5.0).collect()}
    assert got == {(t, i) for t, _, q in xs for i, _, p in xs if abs(p - q) <= q * 0.05}


def test_salted_join_is_the_join(spark):
    many = spark.range(4000).select(F.when(F.col("id") % 3 == 0, F.lit(7)).when(F.col("id") < 20, None).otherwise(F.col("id") % 50).alias("k"), "id")
    few = spark.createDataFrame([(7, "a"), (7, "b"), (8, "c"), (None, "d")], "k long, v string")
    key = lambda df: sorted(map(str, df.select("k", "id", "v").collect()))
    assert key(skew.salted_join(many, few, ["k"], salts=4)) == key(many.join(few, "k"))
    assert skew.salted_join(many.limit(0), few, ["k"]).count() == 0


def np_sax(x, w, bps, length):
    def paa(v, t):
        n = len(v)
        return v if n == t else np.array([v[int(i * (n / t)) : int((i + 1) * (n / t))].mean() if int((i + 1) * (n / t)) > int(i * (n / t)) else v[int(i * (n / t))] for i in range(t)])

    if len(x) < 2:
        return "a" * w
    x = np.array(x, float)
    y = np.interp(np.linspace(0, 1, length), np.linspace(0, 1, len(x)), x) if len(x) < length else paa(x, length)
    z = (y - y.mean()) / y.std() if y.std() > 1e-12 else y - y.mean()
    return "".join(chr(97 + sum(b <= v for b in bps)) for v in paa(z, w))


def test_sax_like_numpy(spark):
    rng = np.random.default_rng(4)
    xs = [rng.normal(size=n).tolist() for n in (1, 2, 5, 13, 32, 33, 47, 64, 100)]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(xs)], "i int, x array<double>")
    bps = series.gaussian_breakpoints(7)
    got = {r["i"]: r["w"] for r in df.select("i", series.sax_word(F.col("x"), 8, bps, 32).alias("w")).collect()}
    assert got == {i: np_sax(x, 8, bps, 32) for i, x in enumerate(xs)}


def test_distance_values(spark):
    df = spark.createDataFrame([("aa", "bb"), ("ab", "ab"), ("", "a"), (None, "a")], "a string, b string")
    got = [r[0] for r in df.select(series.mindist(F.col("a"), F.col("b"), 2, 4)).collect()]
    assert got[0] == pytest.approx(0.1) and got[1] == 0 and got[2] == got[3] == math.inf
    t = series.cost_table(4)
    assert t[1] == 0.01 and t[4 + 2] == pytest.approx(0.67**2 / 4) and math.sqrt(t[3]) == pytest.approx(3.67)
