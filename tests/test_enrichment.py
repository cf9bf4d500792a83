"""Barcodes for products without one: the shapes that such jobs meet."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from shelfscope import catalog
from shelfscope.operators import enrichment as E
from shelfscope.operators import matching as M
from tests.conftest import SMALL

PRODUCT = "id long, sku string, brand string, mpn string, ean string, title string"


def rows_of(spark, *rows):
    return spark.createDataFrame([(i, e, t, p) for i, (e, t, p) in enumerate(rows, 1)], "id long, ean string, title string, price string")


def products_of(spark, *rows):
    return spark.createDataFrame([(i, f"S{i}", *r) for i, r in enumerate(rows, 1)], PRODUCT)


def by_angle(**angles):
    """An encoder that puts texts with a word at an angle in degrees."""

    def encode(df):
        a = F.coalesce(*(F.when(F.lower("title").contains(w), F.lit(np.deg2rad(d))) for w, d in angles.items()), F.lit(np.deg2rad(170)))
        return df.withColumn("vector", F.array(F.cos(a), F.sin(a)))

    return encode


def done(spark, rows, products, **how):
    report, updates = E.enrich(rows, products, **how)
    return {r["source_title"]: r for r in report.collect()}, sorted(map(tuple, updates.collect()))


def test_unique_exact_title(spark):
    products = products_of(spark, ("Knipex", "87", None, "Knipex Cobra 250"), ("Wera", None, "4013288000001", "Kraftform 7"))
    report, updates = done(spark, rows_of(spark, ("4003773022022.0", " Knipex  COBRA-250 ", "10.5"), ("4003773022022", "Knipex  COBRA-250", "10.5"), ("4013288999999", "Kraftform 7", None), (None, "x", "1"), ("123", "x", "1")), products, encode=by_angle(cobra=0))
    assert updates == [(1, "4003773022022")] and set(report) == {"Knipex  COBRA-250", "Kraftform 7"}
    r = report["Knipex  COBRA-250"]
    assert tuple(r[c] for c in E.REPORT) == ("matched", "1", "S1", "", "4003773022022", "1.00", "exact_title", "Knipex  COBRA-250", "Knipex Cobra 250", "10.5")
    assert (report["Kraftform 7"]["status"], report["Kraftform 7"]["product_id"]) == ("ambiguous", ""), "a product with a barcode is no target"
    after = {r["id"]: r["ean"] for r in M.apply_eans(products, E.enrich(rows_of(spark, ("4003773022022", "Knipex Cobra 250", "")), products, by_angle(cobra=0))[1]).collect()}
    assert after == {1: "4003773022022", 2: "4013288000001"}


def test_exact_title_of_the_named_brand(spark):
    products = products_of(spark, ("Acme", None, None, "Acme hammer"), ("Bolt", None, None, "acme  HAMMER"), ("Cut", None, None, "saw"), ("Dot", None, None, "saw"))
    report, updates = done(spark, rows_of(spark, ("40000001", "Acme Hammer", ""), ("40000002", "Saw", "")), products, encode=by_angle(nothing=0))
    assert updates == [(1, "40000001")] and report["Saw"]["status"] == "ambiguous"


@pytest.mark.parametrize("second, token, kind", [(60, "250", "vector_strict"), (4, "250", ""), (60, "999", "")])
def test_strict_vectors(spark, second, token, kind):
    """Near, well ahead of the next, and with the model tokens of the title."""
    products = products_of(spark, (None, "M250", None, "first tool"), (None, None, None, "second tool"))
    report, updates = done(spark, rows_of(spark, ("40000001", f"query tool {token}", "")), products, encode=by_angle(query=10, first=8, second=10 + second))
    r = report[f"query tool {token}"]
    assert (r["status"], r["match_type"]) == (("matched", kind) if kind else ("ambiguous", "")) and updates == ([(1, "40000001")] if kind else [])
    assert r["confidence"] == ("1.00" if kind else "")


def test_the_verifier_sees_open_shortlists_only(spark, tmp_path):
    products = products_of(spark, (None, None, None, "first tool"), (None, None, None, "second tool"), (None, None, None, "exact tool"))
    log = tmp_path / "prompts"

    def answers(prompts, candidates):
        with log.open("a") as f:
            f.writelines(p.replace("\n", " ") + "\n" for p in prompts)
        return pd.Series(['{"match_index": 2, "confidence": 0.9}'] * len(prompts))

    rows = rows_of(spark, ("40000001", "exact tool", ""), ("40000002", "query tool", ""), ("40000003", "remote tool", ""))
    report, updates = done(spark, rows, products, encode=by_angle(query=10, first=8, second=13, exact=90, remote=170), answers=answers)
    assert (report["query tool"]["status"], report["query tool"]["match_type"], report["query tool"]["product_id"]) == ("matched", "vector_llm", "2")
    assert report["remote tool"]["status"] == "ambiguous", "a pick that is not near enough does not count"
    assert updates == [(2, "40000002"), (3, "40000001")] and len(log.read_text().splitlines()) == 2


def test_conflicts(spark):
    products = products_of(spark, (None, None, None, "one"), (None, None, None, "two"), (None, None, None, "three"))
    rows = rows_of(spark, ("40000001", "one", ""), ("40000001", "two", ""), ("40000002", "three", ""), ("40000003", "Three", ""), ("40000003", "lost", ""))
    report, updates = done(spark, rows, products, encode=by_angle(zero=0))
    assert updates == [(3, "40000002")]
    assert {t: (r["status"], r["match_type"], r["confidence"]) for t, r in report.items()} == {
        "one": ("duplicate_ean_conflict", "", ""), "two": ("duplicate_ean_conflict", "", ""), "three": ("matched", "exact_title", "1.00"), "Three": ("product_conflict", "exact_title", "1.00"), "lost": ("ambiguous", "", "")}


def test_equal_titles_and_equal_targets_are_asked_once(spark):
    """The nearest targets are those of all, by score and then id as text, though equal texts have one vector."""
    encoded, degrees = [], dict(query=10, first=8, second=13, third=40)
    one = by_angle(**degrees)

    def encode(df):
        encoded.append(sorted(r["title"] for r in df.collect()))
        return one(df)

    titles = ["second tool"] * 3 + ["first tool"] * 2 + ["third tool"] + ["second tool"] * 8
    products = products_of(spark, *((None, None, None, t) for t in titles))
    rows = spark.createDataFrame([("query tool", "query tool"), ("third query", "third query")], "id string, title string")
    got = E.shortlists(rows, products, spark.createDataFrame([], "row_id string, brand string"), encode, 5).collect()
    near = lambda at: sorted((-round(float(np.cos(np.deg2rad(at - degrees[t.split()[0]]))), 6), str(i)) for i, t in enumerate(titles, 1))[:5]
    for title, at in (("query tool", 10), ("third query", 10)):
        assert sorted((-r["score"], str(r["product_id"])) for r in got if r["row_id"] == title) == near(at)
    assert sorted(encoded) == [["first tool", "second tool", "third tool"], ["query tool", "third query"]]

    del encoded[:]
    report, updates = E.enrich(rows_of(spark, *((f"4000000{n}", "query tool", "") for n in range(3))), products, encode)
    assert sorted(r["status"] for r in report.collect()) == ["ambiguous"] * 3 and updates.count() == 0
    assert sorted(encoded) == [["first tool", "second tool", "third tool"], ["query tool"]]


def test_report_files_and_empty_tables(spark, tmp_path):
    products = products_of(spark, (None, None, None, "one"))
    report, _ = E.enrich(rows_of(spark, ("40000001", "one", "5")), products)
    E.write_report(report, str(tmp_path / "r"))
    back = spark.read.option("header", True).csv(str(tmp_path / "r"))
    assert back.columns == E.REPORT and back.first()["new_ean"] == "40000001"
    report, updates = E.enrich(rows_of(spark, ("40000001", "one", "5")), products.where("false"))
    assert report.first()["status"] == "no_match" and updates.count() == 0
    assert E.enrich(rows_of(spark, (None, "x", "")), products)[0].count() == 0


def test_enrichment_of_the_market(spark):
    rows = catalog.queries()["ean_enrichment"](spark, SMALL).collect()
    n = {(r["status"], r["match_type"]): r["n"] for r in rows}
    assert n[("matched", "exact_title")] > 0 and sum(n.values()) > n[("matched", "exact_title")]
