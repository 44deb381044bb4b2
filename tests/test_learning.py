"""Scaler and k-means are fitted on all rows, whatever the classifier's bound."""

from decimal import Decimal

import pytest

from tidegrid.plans import learning


@pytest.fixture(scope="module")
def learn_sf(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("learn")
    # six groups far apart, of 1 to 6 rows: a sample of ten rows lacks some of them
    rows = [(10 * g + i, *[Decimal(g * g)] * 3, 100 * g) for g in range(1, 7) for i in range(g)]
    spark.createDataFrame(rows, "id long, home_mean decimal(6,3), draw_mean decimal(6,3), away_mean decimal(6,3), running_odds_count int").coalesce(1).write.parquet(f"{d}/sax_encoding.parquet")
    return str(d)


def test_kmeans_is_fitted_on_all_rows(spark, sf, learn_sf, monkeypatch):
    whole = {f.__name__: sorted(map(tuple, f(spark, sf).collect())) for f in (learning.kmeans_prices, learning.kmeans_vectors)}
    groups = sorted(map(tuple, learning.kmeans_prices(spark, learn_sf).collect()))
    monkeypatch.setattr(learning, "FIT_ROWS", 10)
    assert {f.__name__: sorted(map(tuple, f(spark, sf).collect())) for f in (learning.kmeans_prices, learning.kmeans_vectors)} == whole
    assert sorted(map(tuple, learning.kmeans_prices(spark, learn_sf).collect())) == groups
    assert sum(n for _, n in groups) == 21


def test_dbscan_like_brute_force(spark):
    import math
    import random

    from tidegrid.functions.series import cost_table
    from tidegrid.operators.density import dbscan

    rng, k, w, eps, least = random.Random(3), 5, 6, 0.4, 3
    bases = ["".join(rng.choice("abcde") for _ in range(w)) for _ in range(6)]
    words = [(i, "".join(c if rng.random() < 0.8 else rng.choice("abcde") for c in rng.choice(bases))) for i in range(120)] + [(200, None), (201, "abc")]
    costs = cost_table(k, "cluster")
    far = lambda a, b: math.sqrt(sum(costs[(ord(x) - 97) * k + ord(y) - 97] for x, y in zip(a, b)) / w)
    rows = [r for r in words if r[1] and len(r[1]) == w]
    near = {i: [j for j, b in rows if far(a, b) <= eps] for i, a in rows}
    core = {i for i in near if len(near[i]) >= least}
    want = {}
    for i in sorted(core):
        todo = [i] if i not in want else []
        while todo:
            j = todo.pop()
            if j not in want:
                want[j] = i
                todo += [x for x in near[j] if x in core]
    got = {r["id"]: r["cluster"] for r in dbscan(spark.createDataFrame(words, "id long, c string"), "id", "c", w, k, eps, least).collect()}
    assert got[200] == got[201] == -1 and len(got) == len(words)
    assert {i: got[i] for i in core} == want
    for i, _ in rows:
        if i not in core:
            assert got[i] in {want[j] for j in near[i] if j in core} or (got[i] == -1 and not any(j in core for j in near[i]))
