import json
from decimal import Decimal as Dec

import pytest
from pyspark.sql import functions as F

from shelfscope.functions import normalise as N
from shelfscope.plans import fixtures as X
from shelfscope.sources import extract as E
from shelfscope.sources import files as S
from shelfscope.streaming import ingest
from shelfscope.operators import upsert as U
from tests.conftest import SMALL


def test_catalogue(spark, tmp_path):
    path = tmp_path / "c.csv"
    path.write_text("sku,brand,mpn,ean,title,category,price_eur,cost_eur,stock\nA,b,m,,t,c,1.50,,3\nB,,,,t,,x,,\n")
    good, bad = S.read_catalogue(spark, str(path), strict=False)
    assert [(r["sku"], r["price_eur"], r["ean"], r["stock"]) for r in good.collect()] == [("A", Dec("1.50"), None, 3)]
    assert [r["bad"] for r in bad.collect()] == ["price_eur"]
    with pytest.raises(Exception, match="line 3: bad price_eur"):
        S.read_catalogue(spark, str(path))[0].collect()
    path.write_text("sku,brand\nA,b\n")
    with pytest.raises(ValueError, match="missing columns: category, cost_eur"):
        S.read_catalogue(spark, str(path))


def test_feed(spark, tmp_path):
    item = "<SHOPITEM><ITEM_ID>1</ITEM_ID><PRODUCTNAME>{}</PRODUCTNAME><PRODUCT>p</PRODUCT><MANUFACTURER>{}</MANUFACTURER><EAN>4003773025559</EAN><PRICE_VAT>{}</PRICE_VAT><URL>u</URL>{}</SHOPITEM>"
    (tmp_path / "f.xml").write_text("<SHOP>" + item.format("n", "Knipex", "28,61", "<DELIVERY_DATE>0</DELIVERY_DATE>") + item.format("", "Wera", "5", "") + item.format("n", "Wera", "", "") + "</SHOP>")
    rows = S.read_product_feed(spark, str(tmp_path / "f.xml"), "s1").orderBy("price_eur").collect()
    assert [(r["title"], r["price_eur"], r["in_stock"]) for r in rows] == [("p", Dec("5.00"), None), ("n", Dec("28.61"), True)]
    assert S.read_product_feed(spark, str(tmp_path / "f.xml"), "s1", S.slug_to_brand("knipex")).count() == 1


def test_offers_identifiers_and_reference_prices(spark, tmp_path):
    (tmp_path / "o.csv").write_text("ean,title,seller,seller_url,price_eur,delivery_eur,scraped_at\n4003773025559.0,t,s,u,1.5,x,2024-01-01 00:00:00\n")
    row = S.read_offers(spark, str(tmp_path / "o.csv")).first()
    assert row["ean"] == "4003773025559" and row["delivery_eur"] is None and row["box_price_eur"] is None
    (tmp_path / "i.csv").write_text("ean,title,price_sk\n40000001,a,1\n40000001,a,2\n40000001,b,3\nx,c,4\n")
    assert S.read_identifier_rows(spark, str(tmp_path / "i.csv")).count() == 2
    assert [r["price_sk"] for r in S.read_identifier_rows(spark, str(tmp_path / "i.csv"), "ean").collect()] == ["1"]
    assert {r["ean"]: r["reference_price"] for r in S.read_reference_prices(spark, str(tmp_path / "i.csv"), "ean", "price_sk").collect()}["40000001"] == Dec("3.00")


def test_jsonld(spark):
    data = {"@type": "ItemList", "itemListElement": [{"item": {"@type": "Product", "name": "Pliers", "brand": {"name": "Knipex"}, "sku": "4003773025559", "gtin8": "", "offers": [{"price": "24,90", "priceCurrency": "EUR", "availability": "https://schema.org/InStock"}]}}]}
    html = f'<script type="application/ld+json">{{bad</script><script type="application/ld+json">{json.dumps(data)}</script>'
    row = E.extract_jsonld(spark.createDataFrame([("u", html), ("v", None)], "url string, html string")).collect()
    assert [(r["title"], r["brand"], r["ean"], r["price"], r["in_stock"]) for r in row] == [("Pliers", "Knipex", "4003773025559", Dec("24.90"), True)]


def test_jsonld_equals_the_walk(spark):
    """Variants give what a walk through the JSON gives, at depths within and beyond what Spark opens."""
    one = {"@type": "Product", "name": " Pliers ", "brand": ["Knipex", "x"], "sku": 17, "mpn": {"name": "87-01"}, "gtin8": "40000001", "offers": {"price": 24.9, "priceCurrency": "EUR", "url": "https://a/1"}}
    two = {"@type": ["Thing", "Product"], "name": {"x": 1}, "brand": {"name": {"deep": 1}}, "offers": [], "isRelatedTo": one}
    bodies = [one, two, [one, two], {"@graph": [{"@type": "WebPage"}, one]}, {"@type": "ItemList", "itemListElement": [{"item": one}, {"item": two}]}, [[[[[[[one, 5, None]]]]]]], {"@type": "Offer", "itemOffered": two}, 5, "x", None, []]
    texts = [json.dumps(b) for b in bodies] + ["{bad", ""]
    scripts = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "page string, body string")
    found, deep = E._opened(scripts)
    got = E._rows_of_variants(found).unionByName(E._walked(deep.select("page", F.to_json("v").alias("body"))))
    assert deep.count() == 1 and sorted(map(str, got.collect())) == sorted(map(str, E._walked(scripts).collect())) and got.count() == 9


def test_fields_specs_and_links(spark):
    html = '<title>X | Shop</title><meta property="og:title" content="Cobra | Shop"><span itemprop="price" content="9.5"></span><table><tr><th>Značka:</th><td> Wera </td></tr></table><a href="/p/1/?q=1">a</a><a href="/p/1">b</a><a href="mailto:x">c</a>'
    pages = spark.createDataFrame([("u", html)], "url string, html string")
    row = E.extract_microdata(pages).first()
    assert row["title"] == "Cobra" and row["price"] == Dec("9.50")
    assert E.brand_of_specs(E.extract_specs(pages)).first()["brand"] == "Wera"
    links = E.extract_links(pages, "^/p/", base="https://x.test")
    assert [r["link"] for r in links.collect()] == ["https://x.test/p/1"]
    assert E.frontier(links, spark.createDataFrame([("https://x.test/p/1",)], "url string")).count() == 0


def test_cards_and_data_layers(spark):
    card = '<div class="x product"><a class="name" href="/p/1">Cobra <b>250</b></a><br><span class="manufacturer">Knipex</span><span class="code">87 01 250</span><p class="price-final"><strong>24,90</strong> €</p><span class="availability-amount">skladom</span></div>'
    layer = '{"currencyCode": "EUR", "products": [{"name": "a", "price": 48}]} "product_code": "K1" "product_brand": "Wera" "ecomm_prodid": "77" <h1> Title </h1>'
    item = '"price": 12.5, "priceCurrency": "EUR" "availability": "https://schema.org/InStock"'
    pages = spark.createDataFrame([("a", card + card.replace("Cobra", "Other")), ("b", layer), ("c-p9/", item), ("d", None), ("e", "")], "url string, html string")
    rows = {r["url"]: r for r in E.extract_cards(pages).collect()}
    assert set(rows) == {"a"} and tuple(rows["a"])[1:6] == ("/p/1", "Cobra250", "Knipex", "87 01 250", Dec("24.90"))
    rows = {r["url"]: r for r in E.extract_datalayer(pages).collect()}
    assert (rows["b"]["price"], rows["b"]["mpn"], rows["b"]["brand"], rows["b"]["competitor_sku"], rows["b"]["title"]) == (Dec("48.00"), "K1", "Wera", "77", "Title")
    assert (rows["c-p9/"]["price"], rows["c-p9/"]["competitor_sku"], rows["c-p9/"]["in_stock"]) == (Dec("12.50"), "9", True)
    told = spark.createDataFrame([("b", Dec("9.00")), ("e", Dec("8.00"))], "url string, price decimal(10,2)")
    assert {r["url"]: r["price"] for r in E.with_shown_price(told, E.extract_datalayer(pages)).collect()} == {"b": Dec("48.00"), "e": Dec("8.00")}


def test_stream_is_idempotent(spark, tmp_path):
    rows = X.listings(spark, SMALL)
    drop, root = str(tmp_path / "drop"), str(tmp_path / "t")
    rows.repartition(3).write.parquet(drop)
    U.write_version(rows.limit(0), root)
    for k in range(2):
        ingest.ingest(spark, drop, root, str(tmp_path / f"c{k}"), rows.schema.simpleString()[7:-1].replace(":", " "), files=1).awaitTermination()
        assert U.read_version(spark, root).count() == rows.count()


def test_lines_do_not_depend_on_splits(spark, tmp_path):
    head = ",".join(S.CATALOGUE)
    for name in ("b", "a"):
        good = [f"{name}{i},x,m,e,title {i},c,1.5,1,2" for i in range(300)]
        (tmp_path / f"{name}.csv").write_text("\n".join([head, *good[:250], f"{name}bad,x,m,e,,c,1.5,1,2", *good[250:]]))
    was = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("1k", "128m"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            ok, bad = S.read_catalogue(spark, str(tmp_path), strict=False)
            assert [r["line"] for r in bad.collect()] == [252, 252] and ok.count() == 600
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", was)


def test_alerts_and_reports_have_their_columns(spark, tmp_path):
    rows = spark.createDataFrame([("s", "t" * 70, "raise", 1.5, None, 1.0, 2.0, None, "extra")], "sku string, title string, playbook string, current_price double, suggested_price double, min_price double, median_price double, rationale string, more string").coalesce(1)
    S.write_alerts(rows, str(tmp_path / "a"))
    line = json.loads(next((tmp_path / "a").glob("*.json")).read_text())
    assert list(line) == list(S.ALERT) and line["title"] == "t" * 60 and line["current_price"] == 1.5 and line["rationale"] is None
    S.write_enrichment_report(spark.createDataFrame([("x", 0.5, None)], "status string, confidence double, sku string").coalesce(1), str(tmp_path / "r"))
    text = next((tmp_path / "r").glob("*.csv")).read_text().splitlines()
    assert text == [",".join(S.ENRICHMENT), "x,,,,,0.50,,,,"]


def test_rates_and_slugs(spark):
    rows = spark.createDataFrame([(Dec("25.00"), " czk "), (Dec("3.00"), "EUR"), (Dec("3.00"), None), (Dec("3.00"), "USD"), (None, "CZK")], "price decimal(10,2), currency string")
    rates = spark.createDataFrame([("CZK", 25.0), ("CZK", 30.0), ("USD", 0.0)], "currency string, per_eur double")
    assert [r["price_eur"] for r in N.with_eur(rows, rates).collect()] == [Dec("1.00"), Dec("3.00"), None, None, None]
    urls = spark.createDataFrame([("https://a.test/p/cobra-250/?x=1",), ("https://a.test/",), (None,)], "url string")
    assert [r[0] for r in urls.select(N.slug_sku(F.col("url"), "WEB-")).collect()] == ["WEB-COBRA-250", None, None]
