import json

from hypothesis import given, settings
from hypothesis import strategies as st

from tidegrid.operators.nested import CHUNK_BYTES, Level, NestedTable, Way, extract, flatten
from tidegrid.plans import odds_tables

ITEMS = NestedTable((Level("n", (Way(("rows", "*"), array=False), Way(("*",), array=True)), (("a", ("a",)), ("b", ("deep", "b")))),))

text = st.text(alphabet=st.characters(codec="utf-8", exclude_categories=("Cs",)), max_size=12)
value = st.one_of(st.none(), st.booleans(), st.integers(-1000, 1000), text)
item = st.fixed_dictionaries({}, optional={"a": value, "deep": st.fixed_dictionaries({}, optional={"b": value, "x": st.lists(value, max_size=2)}), "other, {": value})
document = st.one_of(st.lists(st.one_of(item, value), max_size=4), st.fixed_dictionaries({"rows": st.lists(item, max_size=3)}))


def as_text(v):
    return None if v is None else v if isinstance(v, str) else json.dumps(v, ensure_ascii=False)


def brute(texts):
    out = []
    for k, t in enumerate(texts):
        try:
            o = json.loads(t) if t else None
            while isinstance(o, str):
                o = json.loads(o)
        except ValueError:
            continue
        rows = o.get("rows", []) if isinstance(o, dict) else o if isinstance(o, list) else []
        out += [(k, i, as_text(r.get("a")), as_text((r.get("deep") or {}).get("b"))) for i, r in enumerate(rows) if isinstance(r, dict)]
    return out


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(document, st.integers(0, 2), st.integers(0, 3), st.booleans()), max_size=6))
def test_like_json(docs):
    texts = []
    for doc, wraps, cut, pretty in docs:
        t = json.dumps(doc, ensure_ascii=pretty, indent=2 if pretty else None)
        for _ in range(wraps):
            t = json.dumps(t)
        texts.append(t[: len(t) - 2] if cut == 3 else t)
    doc, columns = extract(texts, ITEMS)
    assert list(zip(doc.tolist(), *[c.to_pylist() for c in columns])) == brute(texts)


def test_edges(spark):
    long = json.dumps([{"a": "x" * (CHUNK_BYTES + 10)}, {"a": 'quote " and \\ slash', "a ": 1}])
    rows = [(1, None), (2, ""), (3, "null"), (4, "[]"), (5, '[{"a": 1}'), (6, '[{"a": 1}}'), (7, long), (8, '[{"a":1,"a":2}]'), (8, '[{"a":1,"a":2}]'), (9, '[{"\\u0061": "\\u00e9"}, null, {"a": null}]')]
    df = spark.createDataFrame(rows, "id int, j string").withColumnsRenamed({"id": "n_id"}).selectExpr("n_id", "j", "1 AS c0", "2 AS n")
    got = sorted((r["n_id"], r["n"], r["a"]) for r in flatten(df, "j", ITEMS, ["n_id"]).collect())
    assert got == [(7, 0, "x" * (CHUNK_BYTES + 10)), (7, 1, 'quote " and \\ slash'), (8, 0, "2"), (8, 0, "2"), (9, 0, "é"), (9, 2, None)]
    assert flatten(df.limit(0), "j", ITEMS, ["n_id"]).count() == 0


def test_layouts():
    reading = {"home": "1.5", "draw": 3, "away": "封", "time": "t", "returnRate": {"home": "0.9"}}
    entry = {"bookmakerName": "B", "runningOdds": [reading, reading]}
    texts = [json.dumps(x) for x in ({"bookmakers": [entry, {"bookmakerName": "C"}]}, {"bookmakers": {"7": entry}}, entry, {"hometeam": "h"})] + [json.dumps(json.dumps(entry))]
    doc, columns = extract(texts, odds_tables.ENTRY_COUNTS)
    assert list(zip(doc.tolist(), columns[1].to_pylist(), columns[2].to_pylist())) == [(0, "B", 2), (0, "C", 0), (1, "B", 2), (2, "B", 2), (4, "B", 2)]
    doc, columns = extract(texts, odds_tables.READINGS)
    assert columns[5].to_pylist()[0] == "封" and columns[8].to_pylist()[0] == "0.9" and len(doc) == 8
