import pytest
from pyspark.sql import functions as F

from shelfscope.functions import normalise as N

CASES = [
    (N.norm_mpn, "  gbh-18.v 21 ", "GBH18V21"),
    (N.norm_brand, " Knipex GmbH ", "KNIPEX"),
    (N.norm_brand, "  ", None),
    (N.norm_brand, None, None),
    (N.fold, "Žltý kľúč ÀÉß", "Zlty kluc AEß"),
    (N.norm_ean, "4003773025559.0", "4003773025559"),
    (N.norm_ean, "4003773025559.5", None),
    (N.norm_ean, "1234567", None),
    (N.strict_ean, "1234567890", None),
    (N.norm_title, " Kliešte  COBRA-250 ", "klieste cobra 250"),
    (N.parse_price, "od 1 234,50 €", "1234.50"),
    (N.parse_price, "1,234.50 EUR", "1234.50"),
    (N.parse_price, "n/a", None),
    (N.parse_stock, "Nie je skladom", "false"),
    (N.parse_stock, "Skladom 5 ks", "true"),
    (N.parse_stock, "?", None),
    (N.norm_query, "4003 773-025559", "4003773025559"),
    (N.query_kind, "87-03-250", "mpn"),
    (N.query_kind, "kliešte", "text"),
    (N.mpn_from_slug, "https://x.test/klieste-250-knipex-8701250.htm", "8701250"),
]


@pytest.mark.parametrize(("f", "value", "want"), CASES)
def test_column(spark, f, value, want):
    df = spark.createDataFrame([(value,)], "x string")
    assert df.select(f(F.col("x")).cast("string").alias("y")).first()["y"] == want


def test_codes(spark):
    df = spark.createDataFrame([("KNIPEX 87-03-250 cobra 8703250 840/1-Z 123456 4003773025559",)], "t string")
    row = df.select(N.mpn_candidates(F.col("t")).alias("c"), N.ean13_candidates(F.col("t")).alias("e")).first()
    assert row["c"] == ["8703250", "123456", "840/1Z"] and row["e"] == ["4003773025559"]


@pytest.mark.parametrize(("gap", "want"), [(-11.0, "A"), (-10.0, "A"), (-5.0, "B"), (-2.0, "B"), (0.0, "C"), (2.0, "C"), (5.0, "D"), (10.0, "D"), (11.0, "E"), (None, "M")])
def test_gap_bucket(spark, gap, want):
    assert spark.createDataFrame([(gap,)], "g double").select(N.gap_bucket(F.col("g")).alias("b")).first()["b"] == want


def test_url_and_verdict(spark):
    df = spark.createDataFrame([("/p/1/?a=1#x", '```json\n{"match_index": 1, "confidence": 0.81}\n```', '{"match_index":1,"confidence":0.80}')], "u string, a string, b string")
    row = df.select(N.canon_url(F.col("u"), "https://x.test").alias("u"), N.parse_verdict(F.col("a"), F.lit(1)).alias("a"), N.parse_verdict(F.col("b"), F.lit(1)).alias("b")).first()
    assert row["u"] == "https://x.test/p/1" and row["a"]["match_index"] == 1 and row["b"] is None


def test_hash_embedding_is_a_unit_vector(spark):
    df = spark.createDataFrame([("cobra pliers 250",), ("",)], "t string").select(N.hash_embed([F.col("t")], 16).alias("v"))
    a, b = (r["v"] for r in df.collect())
    assert abs(sum(x * x for x in a) - 1) < 1e-5 and not any(b)


def test_model_tokens(spark):
    df = spark.createDataFrame([("Cobra 250mm", "pliers cobra 250 mm", None), ("Cobra 180mm", "cobra 250", "X")], "t string, o string, m string")
    assert [r[0] for r in df.select(N.model_tokens_present(F.col("t"), F.col("o"), F.col("m"))).collect()] == [True, False]


def test_code_of_a_title(spark):
    df = spark.createDataFrame([("Wera (x) 840/1-Z bit", "Wera (x)"), ("Knipex 87 03 250", "KNIPEX"), ("hammer", None)], "t string, b string")
    assert [r[0] for r in df.select(N.mpn_from_title(F.col("t"), F.col("b"))).collect()] == [None, "87 03 250", None]
