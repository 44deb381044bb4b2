"""Words are compared to their last letter, with the costs of their bookmaker's alphabet."""

import math
from decimal import Decimal

import pytest

from tidegrid.functions import series
from tidegrid.plans import registry


def distance(a, b, k):
    costs = series.cost_table(k)
    return math.sqrt(sum(costs[(ord(x) - 97) * k + ord(y) - 97] for x, y in zip(a, b, strict=True)) / len(a))


WORDS = {  # the last two rows of each bookmaker differ from the first in the last letters only, in both words or in one
    "Easybets": [(50, "abcd" * 7 + "ab", "abcdabcdab"), (51, "abcd" * 7 + "bb", "abcdabcdbc"), (52, "abcd" * 7 + "ac", "abcdabcdab")],
    "Bet 365": [(100, "abcdefg" * 3 + "abc", "abcdefga"), (101, "abcdefg" * 3 + "abd", "abcdefga"), (102, "abcdefg" * 3 + "aac", "abcdefgb")],
}


@pytest.fixture(scope="module")
def pair_sf(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("words")
    rows = [(i, b, i, ci, cd) for b, words in WORDS.items() for i, ci, cd in words]
    spark.createDataFrame(rows, "id long, bookmaker string, match_id long, sax_interleaved string, sax_delta string").write.parquet(f"{d}/sax_encoding.parquet")
    price = Decimal("2.00")
    spark.createDataFrame([(i, i, b, price, price, price) for i, b, *_ in rows], "id long, schedule_id long, bookmaker_name string, final_win decimal(5,2), final_draw decimal(5,2), final_lose decimal(5,2)").write.parquet(f"{d}/betting_odds.parquet")
    return str(d)


def test_similar_matches_compare_whole_words(spark, pair_sf):
    found = {(r.t_id, r.id): r.dist for r in registry.QUERIES["ref_j12_similar_matches"](spark, pair_sf).collect()}
    wanted = {}
    for words, k in ((WORDS["Easybets"], 4), (WORDS["Bet 365"], 7)):
        t, ci, cd = words[0]
        for i, oi, od in words[1:]:
            wanted[t, i] = round((distance(ci, oi, k) + distance(cd, od, k)) / 2, 6)
    assert all(v > 0 for v in wanted.values())
    assert found == pytest.approx({p: v for p, v in wanted.items() if v <= 0.5})
    assert len(found) == 4
