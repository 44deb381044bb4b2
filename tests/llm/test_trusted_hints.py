"""Rare trusted phrases reach the fit sample and their words the model."""

import pytest

from tidegrid.llm import residue

PHRASES = ["Titel der Arbeit", "Título del artículo", "Titre de l'article", "Prénom", "Vorname", "作者姓名", "论文标题", "Paper title", "403 Forbidden", "504 Gateway", "Fehler 404", "ENABLE JAVASCRIPT: activate javascript", "nombre y apellido", "Your keywords here", "template: please delete"]


@pytest.mark.parametrize("phrase", PHRASES)
def test_every_trusted_phrase_has_a_hint(phrase):
    assert residue._TRUST.search(phrase.lower())
    assert any(h in phrase.lower() for h in residue.TRUSTED_HINTS)


def articles(n):
    return [(i, f"\\section{{Data}}\nthe model of article {i % 50} gives a result for sample {i % 7}\n") for i in range(n)]


def test_words_of_few_trusted_records_are_learned(spark):
    # five trusted records among six hundred documents, in any language: their other words become evidence
    bad = [(1000 + i, "\\section{Data}\nTitel der Arbeit Musterzeile\n") for i in range(5)] + [(2000, "\\section{Data}\nMusterzeile\n")]
    df = spark.createDataFrame(articles(600) + bad, "id long, text string")
    assert {r["id"] for r in residue.excluded(df, "id", "text").collect()} == {i for i, _ in bad}


def test_every_phrase_is_searched_in_every_text(spark):
    bad = [(1000 + i, f"\\section{{Data}}\n{p}\n") for i, p in enumerate(PHRASES)]
    df = spark.createDataFrame(articles(300) + bad, "id long, text string")
    table = residue.feature_table(df, "id", "text").where("exists(trusted, x -> x)")
    assert {r["id"] for r in table.collect()} == {i for i, _ in bad}


@pytest.mark.parametrize("left_out", ["lorem ipsum", "javascript", "template"])
def test_family_without_its_phrase_is_found_by_its_words(spark, monkeypatch, left_out):
    # a trusted phrase is forgotten; records of its family that share words with other trusted records are still found
    family = {"lorem ipsum": "Lorem ipsum dolor sit amet dummy", "javascript": "Please enable JavaScript to view this page", "template": "Template text, please delete these instructions"}[left_out]
    others = [p for p in residue.TRUSTED if left_out not in p]
    monkeypatch.setattr(residue, "_TRUST", __import__("re").compile("|".join(others), residue.re.S))
    bad = [(1000 + i, f"\\section{{Data}}\n{family} {tail}\n") for i, tail in enumerate(["", "Error 404", "error 404", "http 403"] * 3)]
    df = spark.createDataFrame(articles(400) + bad, "id long, text string")
    # the worker has its own module, so the forgotten phrase is taken out of the table instead
    table = residue.feature_table(df, "id", "text")
    rows = [(r["id"], r["kinds"], [bool(residue._TRUST.search(dict(df_bad)[r["id"]].lower())) if r["id"] >= 1000 else t for t in r["trusted"]], r["features"]) for df_bad in [bad] for r in table.collect()]
    from tidegrid.session import written

    table = written(spark.createDataFrame(rows, table.schema))
    got = {r["id"] for r in residue.scored(table, residue.fit(table)).collect()}
    assert got == {i for i, _ in bad}
