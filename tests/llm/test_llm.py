import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from tidegrid.llm import canonical, clusters, mixing, packing, queries, residue, tokens
from tidegrid.session import written

LINES = [(1, "平手", 0.0, "Level"), (2, "平手/半球", 0.25, "Level/Half"), (3, "半球", 0.5, "Half"), (4, "半球/一球", 0.75, "Half/One"), (5, "一球", 1.0, "One"), (9, "两球", 2.0, "Two"), (13, "三球", 3.0, "Three"), (17, "受半球", -0.5, "Receiving Half"), (18, "受半球/一球", -0.75, "Receiving Half/One")]


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_registered_and_running(spark, sf, name):
    assert name in __spark_entry__.queries()
    df = queries.QUERIES[name](spark, sf)
    assert df.collect() is not None


@pytest.mark.parametrize(
    "value, line",
    [
        ("半/一", 4), ("1球", 5), ("ping shou", 1), ("半球盤", 3), ("-0.5", 17), ("+0.5", 3), ("０．５/1", 4), ("-0.5,1", 18), ("主让半球", 3), ("客队让半球", 17), ("受讓半球/一球盤", 18), ("[即] 平 手", 1), ("伴球(初)", 3),
        ("Levvel ball", 1), ("half--one", 4), ("RCEIVING HALF / ONE", 18), ("shou ban qiu", 17), ("二球", 9), ("半\u3000球", 3), ("四球", -1), ("受四球半", -1), ("半场", -1), ("see note", -1), ("大2.5球", -1), ("+5", -1), ("?", -1), ("x" * 10_000, -1),
    ],
)
def test_lines(value, line):
    assert canonical.line_matcher(LINES).entry(value) == line


@pytest.mark.parametrize("value, line", [("半酋/一球", 4), ("受半球/一泅", 18), ("盘口:初盘:即:终:半球", 3), ("半球盘盘终即", 3), ("四球/一球", -1), ("大球/一球", -1), ("半酋", -1), ("半球/一球" + "酋" * 3, -1)])
def test_slips_and_layers(value, line):
    # an ideograph without meaning in a line may stand for another where the value is long enough; a numeral never may
    assert canonical.line_matcher(LINES).entry(value) == line


def test_candidates_and_shards(spark):
    matcher = canonical.line_matcher(LINES)
    typed = ["Levvel ball", "半酋/一球", "levelhalf", "四球", "half/onee", "1球"]
    df = spark.createDataFrame([(i, v) for i, v in enumerate([*typed, "1球", None])], "id long, a string")
    got = {(r["value"], r["line_id"], r["distance"]) for r in canonical.map_candidates(df, "id", ["a"], matcher).collect()}
    want = {(v, e, d) for v in typed for e, d in matcher.candidates(v).items()}
    assert {g for g in got if g[1] >= 0} == want and {g[0] for g in got if g[1] < 0} == {v for v in typed if not matcher.candidates(v)}
    reference = spark.createDataFrame(LINES, "line_id int, line_name string, line_value double, line_name_en string")
    found = canonical.shard_candidates(df.select(F.col("a").alias("value")), reference, canonical.line_matcher, shards=3, salts=2)
    assert {tuple(r) for r in found.collect()} == want
    assert {r["value"]: r["entry"] for r in canonical.nearest_entries(found).collect()} == {v: matcher.entry(v) for v in typed if matcher.candidates(v)}


def test_a_long_list_is_not_broadcast(spark, monkeypatch):
    monkeypatch.setattr(canonical, "BROADCAST_BYTES", 10)
    with pytest.raises(ValueError):
        canonical.map_values(spark.createDataFrame([(1, "x")], "id long, a string"), "id", ["a"], canonical.line_matcher(LINES))


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_trie_search_like_brute_force():
    rng = random.Random(1)
    words = ["".join(rng.choice("abc") for _ in range(rng.randrange(1, 7))) for _ in range(60)]
    trie = canonical.Trie()
    for i, w in enumerate(words):
        trie.add(w, i)
    for _ in range(200):
        q = "".join(rng.choice("abc") for _ in range(rng.randrange(1, 7)))
        for most in (0, 1, 2):
            assert trie.search(q, most) == {i: d for i, w in enumerate(words) if (d := levenshtein(q, w)) <= most}


def test_map_values_edges(spark):
    df = spark.createDataFrame([(1, None, "半球"), (2, " \u3000", "1球"), (2, "1球", "四球"), (None, "1球", None)], "id long, a string, b string").withColumn("value", F.lit(1)).withColumn("field", F.lit(2))
    got = sorted((r["id"] or 0, r["field"], r["line_id"]) for r in canonical.map_values(df, "id", ["a", "b"], canonical.line_matcher(LINES), frozenset(["半球"])).collect())
    assert got == [(0, "a", 5), (2, "a", 5), (2, "b", -1), (2, "b", 5)]
    assert canonical.map_values(df.limit(0), "id", ["a"], canonical.line_matcher(LINES)).count() == 0


def brute_clusters(rows):
    near = lambda p, q: len(p[2]) == len(q[2]) and sum(x != y for x, y in zip(p[2], q[2])) <= 4 and abs(p[3] - q[3]) <= 125 and p[1] == q[1]
    label = {}
    for r in sorted(rows):
        if r[0] in label:
            continue
        label[r[0]], todo = r[0], [r]
        while todo:
            p = todo.pop()
            for q in rows:
                if q[0] not in label and near(p, q):
                    label[q[0]] = r[0]
                    todo.append(q)
    return label


def sample_rows(n, seed=1):
    rng = random.Random(seed)
    bases = ["".join(rng.choice("abcdefg") for _ in range(20)) for _ in range(4)]
    rows = []
    for i in range(n):
        w = list(rng.choice(bases[: 1 + i % 4]))
        for _ in range(rng.choice([0, 1, 1, 2, 3, 7])):
            w[rng.randrange(20)] = rng.choice("abcdefg")
        rows.append((i + 1, rng.choice(["x", "x", "y"]), "".join(w), rng.randrange(1000, 2500, 40)))
    return rows


def cluster_frame(spark, rows):
    df = spark.createDataFrame(rows, "id long, b string, p string, q string, m double")
    return df.withColumn("m", F.col("m").cast("decimal(6,3)")).withColumn("node", F.lit(1))


@pytest.mark.parametrize("seed", [1, 5])
def test_clusters_like_brute_force(spark, seed):
    rows = sample_rows(250, seed)
    data = [(i, b, w[:12], w[12:], m / 1000) for i, b, w, m in rows] + [(900, None, "a", "b", 1.0), (901, "x", None, "b", 1.0), (902, "x", "a", "b", None)]
    df = cluster_frame(spark, data)
    got = {r["id"]: r["cluster"] for r in clusters.clusters(df, "id", "b", ["p", "q"], "m").collect()}
    assert got == brute_clusters(rows)
    assert clusters.clusters(df.limit(0), "id", "b", ["p", "q"], "m").count() == 0


def test_a_long_chain_is_one_cluster(spark):
    # row i has one letter and i units of mean more than row i - 1: each row's best neighbour is the one before it
    chain = [(i, "x", "b" * min(i, 60) + "a" * (60 - min(i, 60)), "b" * max(i - 60, 0) + "a" * (65 - max(i - 60, 0)), (i * (i + 1) // 2 % 100_000) / 1000) for i in range(125)]
    got = [tuple(r) for r in clusters.clusters(cluster_frame(spark, chain), "id", "b", ["p", "q"], "m").select("id", "cluster").collect()]
    assert {c for _, c in got} == {0} and len(got) == 125


def test_codes_of_any_length_and_alphabet(spark):
    long = "ab" * 30_000
    data = [(1, "x", "", "", 1.0), (2, "x", "", "", 1.1), (3, "x", long, "é球", 1.0), (4, "x", long, "e球", 1.0), (5, "x", long[:-6] + "zzzzzz", "é球", 1.0), (6, "y", long, "é球", 1.0), (7, "x", "abcd", "", 1.0), (8, "x", "wxyz", "", 1.0)]
    got = {r["id"]: r["cluster"] for r in clusters.clusters(cluster_frame(spark, data), "id", "b", ["p", "q"], "m").collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 3, 5: 5, 6: 6, 7: 7, 8: 7}


def test_description(spark):
    members = spark.createDataFrame([(1, "x", "aaaa", 1000, 1), (2, "x", "aaab", 1000, 1), (3, "x", "aaaa", 1010, 1), (4, "x", "bbaa", 1000, 1), (5, "y", "cccc", 1, 5)], "id long, block string, code string, mean long, cluster long")
    got = {r["cluster"]: (r["size"], r["typical_ids"]) for r in clusters.described(members).collect()}
    assert got == {1: (4, "1,3,2"), 5: (1, "5")}


def naive_first_fit(sizes, capacity):
    room, out = [], []
    for s in sizes:
        k = next((i for i, r in enumerate(room) if r >= s), None)
        if k is None:
            room.append(capacity)
            k = len(room) - 1
        room[k] -= s
        out.append(k)
    return out


def test_first_fit_like_naive():
    rng = random.Random(3)
    for n in (0, 1, 2, 5, 64, 200):
        sizes = sorted((rng.randrange(0, 101) for _ in range(n)), reverse=True)
        assert packing.first_fit_decreasing(np.array(sizes, dtype=np.int64), 100).tolist() == naive_first_fit(sizes, 100)


def test_packing_whole(spark):
    rng = random.Random(4)
    items = spark.createDataFrame([(i, rng.choice([0, 5, 30, 99, 100, 101, 250, None])) for i in range(300)], "doc_id long, tokens long").withColumn("extra", F.lit(1))
    packs = spark.createDataFrame([("a", 100), ("b", 1000)], "pack_name string, capacity_tokens int")
    placed = packing.pack(items, packs, group_tokens=4000).toPandas()
    want = {r["doc_id"]: r["tokens"] for r in items.where("tokens is not null").collect()}
    for name, capacity in (("a", 100), ("b", 1000)):
        own = placed[placed["pack_name"] == name]
        assert own.groupby("doc_id")["n_tokens"].sum().to_dict() == want
        assert own.groupby(["group_no", "container_no"])["n_tokens"].sum().max() <= capacity
        assert all(len(g) == 1 for d, g in own.groupby("doc_id") if want[d] <= capacity)
    assert packing.pack(items.limit(0), packs).count() == 0


def test_tokens_of_the_public_tokenizer(spark):
    df = spark.createDataFrame([(1, "Hello world"), (2, ""), (3, None), (4, "<|endoftext|> 你好")], "doc_id long, text string")
    got = {r["doc_id"]: r["tokens"] for r in tokens.count_tokens(df, "text", ["doc_id"]).collect()}
    e = tokens.encoding(tokens.VOCABULARY)
    assert got == {1: 2, 2: 0, 3: None, 4: len(e.encode_ordinary("<|endoftext|> 你好"))}
    assert e.decode(e.encode_ordinary("Ein längerer Text, 你好.\n")) == "Ein längerer Text, 你好.\n"


def test_mixture_is_fair(spark):
    rng = random.Random(6)
    docs = [(i, rng.choice(["big"] * 8 + ["mid", "mid", "small"]), rng.randrange(1, 50)) for i in range(3000)] + [(9001, None, 5), (9002, "other", 5), (9003, "big", None)]
    df = spark.createDataFrame(docs, "doc_id long, source string, tokens long")
    targets = spark.createDataFrame([("big", 0.5, 1), ("mid", 0.3, 2), ("small", 0.15, 4), ("none", 0.05, 3)], "source string, target_share double, max_repeats int")
    mixed = mixing.mixture(df, targets, slices=16).toPandas().sort_values("mix_rank_tokens")
    assert (mixed["tokens"].cumsum() == mixed["mix_rank_tokens"]).all()
    assert mixed["finish"].is_monotonic_increasing
    share = mixed.groupby("source")["tokens"].sum() / mixed["tokens"].sum()
    for s, w in (("big", 0.5), ("mid", 0.3), ("small", 0.15)):
        assert share[s] == pytest.approx(w / 0.95, abs=0.01)
    times = mixed.groupby(["source", "doc_id"]).size()
    assert times["big"].max() == 1 and times["mid"].max() <= 2 and times["small"].max() <= 4 and not mixed.duplicated(["doc_id", "repeat_no"]).any()
    half = mixing.mixture(df, targets, budget=10_000, slices=16).toPandas()
    whole = mixed[mixed["mix_rank_tokens"] <= 10_000]
    assert sorted(zip(half["doc_id"], half["repeat_no"])) == sorted(zip(whole["doc_id"], whole["repeat_no"]))
    report = {r["source"]: r for r in mixing.shares(df, targets, mixing.mixture(df, targets)).collect()}
    assert report["none"]["mixed_tokens"] == 0 and report["none"]["actual_share"] == 0 and report["big"]["rounds_used"] == 1
    assert mixing.mixture(df.limit(0), targets).count() == 0


def test_passages_leave_quotes_and_listings_out():
    text = "\\title{A}\n\\author{B. C}\n\\begin{abstract}${ABSTRACT}\\end{abstract}\n\\section{Data}\n% lorem ipsum\nSaid ``Error 404 Not Found''.\n\\begin{verbatim}\n<p>[[abstract]]</p>\n\\end{verbatim}\n\\verb|<<TITLE>>|\n"
    found = dict(residue.passages(text))
    assert found["abstract"] == "${ABSTRACT}" and "404" not in found["body"] and "abstract" not in found["body"] and "TITLE" not in found["body"] and "lorem" not in found["body"]
    assert residue.features("${ABSTRACT}", "abstract") == {"@place"} and residue.features("\\input{x}", "body") is None and residue.features("\\label{a}\n\\input{parts/x", "body") is None


def test_residue_on_held_out_records(spark):
    rng = random.Random(8)
    nouns, verbs = [f"noun{chr(97 + i)}" for i in range(20)], ["shows", "limits", "governs", "measures"]
    prose = lambda: " ".join(f"The {rng.choice(nouns)} {rng.choice(verbs)} a {rng.choice(nouns)} of the sample." for _ in range(4))
    bad = ["${body}", "[INSERT text HERE]", "Lorem ipsum dolor sit amet magna.", "Error 404 Not Found", "Error 404 page gone, contact the desk", "Contact the desk about the page gone."]
    rows = []
    for i in range(400):
        body = rng.choice(bad) if i % 10 == 0 else prose() + (" Pages said ``Error 404 Not Found'' once." if i % 7 == 0 else "")
        rows.append((i, f"\\section{{Data}}\n{body}\n"))
    rows += [(1000, None), (1001, ""), (1002, "x " * 200_000), (1003, "\\section{")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("kinds", F.lit("clash"))
    model = residue.fit(written(residue.feature_table(df.where("doc_id < 200"), "doc_id", "text")))
    table = residue.feature_table(df.where("doc_id >= 200"), "doc_id", "text")
    got = {r["id"] for r in residue.scored(table, model).collect()}
    want = {i for i in range(200, 400) if i % 10 == 0}
    assert len(got & want) >= 0.9 * len(want) and got - want == set()
    assert residue.scored(table.limit(0), model).count() == 0
    assert residue.excluded(df.limit(0), "doc_id", "text").count() == 0
    kinds = {r["id"]: r["kinds"] for r in residue.scored(table, model, evidence=True).collect()}
    assert kinds.keys() == got and set(kinds.values()) == {"body"}
