"""Event-time resampling, handicap codes and distances against plain Python."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tests.test_operators import np_sax
from tidegrid.functions import series, trajectories

K = 1_700_000_000.0 // 60 * 60


def plain_event_time(records, k):
    rows = sorted([r for r in records if None not in r], key=lambda r: r[0])
    if not rows:
        return None
    early = [r for r in rows if r[0] <= k - 48 * 3600]
    if len(early) >= 2:
        w = [(b[0] - a[0]) / 3600 if b[0] > a[0] else 0.1 for a, b in zip(early, early[1:])]
        mean = tuple(sum(r[i] * x for r, x in zip(early[1:], w)) / sum(w) for i in (1, 2, 3))
    else:
        mean = (early or rows)[0][1:]
    prev, changes = mean[0], []
    for r in rows:
        if k - 24 * 3600 < r[0] <= k and abs(r[1] - prev) > 0.001:
            changes.append(r[0])
            prev = r[1]
    picked, minutes = [], set()
    for most, times in ((12, changes), (16, [k - h * 3600 for h in range(24, 0, -2)])):
        for t in times:
            if len(picked) < most and t // 60 not in minutes:
                picked.append(t)
                minutes.add(t // 60)
    grid = sorted({k - 48 * 3600, k - 36 * 3600, k - 24 * 3600, k, *picked})
    out = [rows[0][1:], mean]
    for p in grid[1:]:
        before = [r for r in rows if r[0] < p]
        out.append(before[-1][1:] if before else mean)
    return out


def test_event_time_like_plain_python(spark):
    rng = random.Random(7)
    cases = [[]]
    for n in (1, 2, 3, 8, 20, 60):
        for _ in range(4):
            at = lambda: K - rng.choice([rng.uniform(0, 24), rng.uniform(20, 60), rng.uniform(0, 120)]) * 3600
            cases.append([(rng.choice([None, *[at()] * 9]), round(rng.uniform(0.3, 0.34), 3), 0.3, rng.choice([None, *[0.37] * 20])) for _ in range(n)])
    # accepted changes in different minutes: the lengths 16, 17, ... of the inventory
    for c in (0, 1, 4, 5, 12, 15):
        cases.append([(K - 50 * 3600, 0.5, 0.25, 0.25)] + [(K - 23 * 3600 + 61 * i, 0.51 + 0.01 * i, 0.25, 0.24) for i in range(c)])
    df = spark.createDataFrame(list(enumerate(cases)), "i int, r array<struct<t:double,h:double,d:double,a:double>>")
    got = {r["i"]: r["s"] for r in df.select("i", trajectories.event_time(F.col("r"), F.lit(K)).alias("s")).collect()}
    for i, case in enumerate(cases):
        want = plain_event_time(case, K)
        assert (got[i] is None) == (want is None)
        if want:
            assert len(got[i]) == len(want) and 6 <= len(want) <= 20
            for p, q in zip(got[i], want):
                assert tuple(p) == pytest.approx(q)
    assert [len(got[len(cases) - 6 + j]) for j in range(6)] == [16, 17, 20, 20, 20, 20]


ROWS = [("半球", 1.10, 0.80, 1.0), ("半球", 1.05, 0.85, 2.0), ("半球/一球", 1.00, 0.90, 3.0), ("半球/一球", 0.95, 0.95, 4.0), ("一球", 0.90, 1.00, 5.0)]


def plain_word(x, word, bps, length):
    n = len(x)
    pick = lambda v, k: [v[-1] if i == k - 1 else v[math.floor(i * ((len(v) - 1) / (k - 1)))] for i in range(k)]
    up = lambda v: [v[min(int(p), n - 1)] + (v[min(int(p) + 1, n - 1)] - v[min(int(p), n - 1)]) * (p - int(p)) for p in (i * ((n - 1) / (length - 1)) for i in range(length))]
    y = x if n == length else up(x) if n < length else pick(x, length)
    return "".join(chr(97 + sum(b <= v for b in bps)) for v in pick(y, word))


def test_handicap_codes(spark):
    bps, w = series.gaussian_breakpoints(4), 4
    z = lambda x: [(v - sum(x) / len(x)) / (math.sqrt(sum((u - sum(x) / len(x)) ** 2 for u in x) / len(x)) or 1) for v in x]
    many = [("平手", 1.0 + 0.01 * ((7 * i) % 13), 0.9 - 0.01 * ((5 * i) % 11), float(20 - i)) for i in range(20)]
    cases = [ROWS, [(a, h, x, None) for a, h, x, _ in many], many, ROWS[:1], [("平手", None, 0.9, 1.0), *ROWS[:2]]]
    df = spark.createDataFrame([(i, [(t, h, a, x) for x, h, a, t in c]) for i, c in enumerate(cases)], "i int, r array<struct<t:double,home:double,away:double,line:string>>")
    got = {r["i"]: r["c"] for r in df.select("i", trajectories.handicap_codes(F.col("r"), w, bps).alias("c")).collect()}
    first = got[0]
    assert first["handicap_changes"] == 2 and first["n_readings"] == 5 and first["home_change"] == pytest.approx(-0.2) and first["away_change"] == pytest.approx(0.2)
    assert (first["home_initial"], first["away_initial"], first["home_final"], first["away_final"]) == (1.1, 0.8, 0.9, 1.0)
    assert got[3] is None and got[4]["n_readings"] == 2
    pick = lambda v, k: [v[-1] if i == k - 1 else v[math.floor(i * ((len(v) - 1) / (k - 1)))] for i in range(k)]
    for i, rows in ((0, ROWS), (1, pick(many, 8)), (2, pick(sorted(many, key=lambda r: r[3]), 8))):
        h, a = z([r[1] for r in rows]), z([r[2] for r in rows])
        want = [plain_word(x, w, bps, 32) for x in (h, a, [p - q for p, q in zip(h, a)])]
        assert [got[i]["sax_home"], got[i]["sax_away"], got[i]["sax_diff"]] == want
    raw = df.where("i = 0").select(trajectories.handicap_codes(F.col("r"), w, bps, raw=True).alias("c")).first()["c"]
    assert raw["sax_home"] == plain_word([r[1] for r in ROWS], w, bps, 32) and raw["handicap_changes"] == 2


def test_combined_distance(spark):
    inf = float("inf")
    df = spark.createDataFrame([(1.0, 3.0, 5.0), (1.0, inf, 5.0), (1.0, 3.0, inf), (1.0, None, None)], "i double, d double, h double")
    got = [r[0] for r in df.select(trajectories.combined_distance(F.col("i"), F.col("d"), F.col("h"))).collect()]
    assert got == pytest.approx([0.6 * 2 + 0.4 * 5, 0.6 * 1 + 0.4 * 5, 2.0, 1.0])


def test_words_without_fixed_length(spark):
    rng = random.Random(2)
    xs = [[rng.gauss(0, 1) for _ in range(n)] for n in (1, 3, 7, 8, 21)]
    bps = series.gaussian_breakpoints(5)
    got = {r["i"]: r["w"] for r in spark.createDataFrame(list(enumerate(xs)), "i int, x array<double>").select("i", series.sax_free(F.col("x"), 8, bps).alias("w")).collect()}
    assert got == {i: np_sax(x, 8, bps, 16 if len(x) < 8 else len(x)) for i, x in enumerate(xs)}
