"""Any number of blanks between a colon and its value."""

import json

from tests.test_nested import ITEMS
from tidegrid.operators.nested import flatten


def test_many_blanks_before_a_value(spark):
    texts = [(k, '{"rows":%s[{"a":%s1,"deep":%s{"b":%s"x"}}]}' % ((" " * k,) * 4)) for k in (0, 64, 65, 300)]
    assert all(json.loads(t) for _, t in texts)
    got = flatten(spark.createDataFrame(texts, "id int, j string"), "j", ITEMS, ["id"])
    assert sorted((r["id"], r["a"], r["b"]) for r in got.collect()) == [(k, "1", "x") for k, _ in texts]
