"""Tables from crawled pages (url, html): structured data, fields, links."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfscope.functions import normalise as N
from shelfscope.plans.scratch import written

PRODUCT = "name string, brand string, sku string, mpn string, ean string, price string, currency string, availability string, url string"


def _products(node: object) -> Iterator[dict]:
    if isinstance(node, list):
        for x in node:
            yield from _products(x)
    elif isinstance(node, dict):
        kind = node.get("@type")
        if kind == "Product" or isinstance(kind, list) and "Product" in kind:
            yield node
        else:
            for x in node.values():
                yield from _products(x)


def _text(x: object) -> str | None:
    x = x.get("name") if isinstance(x, dict) else x[0] if isinstance(x, list) and x else x
    return str(x).strip() or None if x is not None and not isinstance(x, dict | list) else None


#: Levels of lists and objects that Spark opens; what lies deeper is walked in Python.
LEVELS = 5


def _is_product(v: str) -> Column:
    named = F.expr(f"try_variant_get({v}, '$[\"@type\"]', 'string') = 'Product'")
    listed = F.expr(f"array_contains(try_variant_get({v}, '$[\"@type\"]', 'array<string>'), 'Product')")
    return F.coalesce(named, F.lit(False)) | F.coalesce(listed, F.lit(False))


def _opened(scripts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Products (page, v) of scripts (page, body) down to LEVELS of lists and objects, and the nodes (page, v) below these."""
    spark = scripts.sparkSession
    nodes = scripts.select("page", F.try_parse_json("body").alias("v")).where("v IS NOT NULL")
    found = None
    for level in range(LEVELS + 1):
        # a level is written, as the next would parse all scripts again
        nodes = written(nodes.select("page", "v", _is_product("v").alias("product")), f"jsonld-{level}")
        here = nodes.where("product").select("page", "v")
        found = here if found is None else found.unionByName(here)
        rest = nodes.where("NOT product").select("page", "v")
        rest = rest.where("schema_of_variant(v) LIKE 'OBJECT%' OR schema_of_variant(v) LIKE 'ARRAY%'")
        if level == LEVELS or not rest.take(1):
            return found, rest
        nodes = spark.sql("SELECT n.page, c.value AS v FROM {rest} AS n, LATERAL variant_explode(n.v) AS c", rest=rest)
        nodes = nodes.where("v IS NOT NULL")
    raise AssertionError


def _field(v: str, path: str) -> Column:
    """Text of a field: of an object its name, of a list its first entry; blank is null."""
    kind = F.expr(f"schema_of_variant(try_variant_get({v}, '{path}', 'variant'))")
    text = lambda p: F.expr(f"try_variant_get({v}, '{p}', 'string')")
    plain = lambda p: F.when(~F.expr(f"coalesce(schema_of_variant(try_variant_get({v}, '{p}', 'variant')), '') RLIKE '^(OBJECT|ARRAY)'"), text(p))
    return N.blank_to_null(F.when(kind.startswith("OBJECT"), plain(f"{path}.name")).when(kind.startswith("ARRAY"), plain(f"{path}[0]")).otherwise(text(path)))


def _rows_of_variants(found: DataFrame) -> DataFrame:
    offers = F.expr("schema_of_variant(try_variant_get(v, '$.offers', 'variant'))")
    rows = found.withColumn("o", F.when(offers.startswith("ARRAY"), F.expr("try_variant_get(v, '$.offers[0]', 'variant')")).when(offers.startswith("OBJECT"), F.expr("try_variant_get(v, '$.offers', 'variant')")))
    names = {"name": "name", "brand": "brand", "sku": "sku", "mpn": "mpn"}
    ean = F.coalesce(*(_field("v", f"$.{k}") for k in ("gtin13", "gtin8", "gtin")))
    return rows.select(
        "page",
        *(_field("v", f"$.{k}").alias(n) for n, k in names.items()),
        ean.alias("ean"),
        _field("o", "$.price").alias("price"),
        _field("o", "$.priceCurrency").alias("currency"),
        _field("o", "$.availability").alias("availability"),
        F.coalesce(_field("v", "$.url"), _field("o", "$.url")).alias("url"),
    )


def _walked(scripts: DataFrame) -> DataFrame:
    """Rows of the products at any depth of scripts (page, body), in Python."""
    import json

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for page, body in zip(batch["page"], batch["body"], strict=True):
                try:
                    data = json.loads(body)
                except ValueError:
                    continue
                for p in _products(data):
                    offer = p.get("offers")
                    offer = offer[0] if isinstance(offer, list) and offer else offer if isinstance(offer, dict) else {}
                    offer = offer if isinstance(offer, dict) else {}
                    ean = next((_text(p.get(k)) for k in ("gtin13", "gtin8", "gtin") if _text(p.get(k))), None)
                    rows.append((page, _text(p.get("name")), _text(p.get("brand")), _text(p.get("sku")), _text(p.get("mpn")), ean, _text(offer.get("price")), _text(offer.get("priceCurrency")), _text(offer.get("availability")), _text(p.get("url") or offer.get("url"))))
            yield pd.DataFrame(rows, columns=["page", *(x.split(" ")[0] for x in PRODUCT.split(", "))])

    return scripts.mapInPandas(run, f"page string, {PRODUCT}")


def extract_jsonld(pages: DataFrame, sku_as_mpn: bool = False, strip_sku_prefix: bool = False, fallback_brand: str | None = None) -> DataFrame:
    """Products of a page's ld+json scripts, at any depth; scripts that are no JSON are skipped.

    Scripts are cut out, parsed and opened by Spark as variants: lists, item lists, graphs and nested objects down to LEVELS.
    Only what nests deeper is walked in Python.
    """
    pattern = r"(?is)<script[^>]*type=[\"']application/ld\+json[\"'][^>]*>(.*?)</script>"
    scripts = pages.select(F.col("url").alias("page"), F.explode(F.regexp_extract_all("html", F.lit(pattern), F.lit(1))).alias("body"))
    found, deep = _opened(scripts)
    found = _rows_of_variants(found).unionByName(_walked(deep.select("page", F.to_json("v").alias("body"))))
    sku = F.regexp_replace("sku", "^[A-Z]{2,5}-", "") if strip_sku_prefix else F.col("sku")
    brand = F.when(F.col("brand").isNull() | (F.upper("brand") == "EDE"), F.lit(fallback_brand)).otherwise(F.col("brand")) if fallback_brand else F.col("brand")
    return found.select(
        F.coalesce("url", "page").alias("url"),
        F.col("name").alias("title"),
        brand.alias("brand"),
        F.col("sku").alias("competitor_sku"),
        F.coalesce("mpn", sku if sku_as_mpn else F.lit(None).cast("string")).alias("mpn"),
        F.coalesce(N.strict_ean(F.col("ean")), N.strict_ean(F.col("sku"))).alias("ean"),
        N.parse_price(F.col("price")).alias("price"),
        "currency",
        N.parse_stock(F.regexp_replace("availability", "^.*/", "")).alias("in_stock"),
    )


def _first(html: Column, pattern: str) -> Column:
    return N.blank_to_null(F.regexp_extract(html, pattern, 1))


def _itemprop(html: Column, name: str) -> Column:
    value = rf"(?is)<[^>]*itemprop=[\"']{name}[\"'][^>]*(?:content|href)=[\"']([^\"']*)[\"']"
    return F.coalesce(_first(html, value), _first(html, rf"(?is)<[^>]*itemprop=[\"']{name}[\"'][^>]*>([^<]*)<"))


def extract_microdata(pages: DataFrame) -> DataFrame:
    """Title of og:title up to ' | ', and price, EAN, product id and availability of itemprops."""
    h = F.col("html")
    title = F.coalesce(_first(h, r"(?is)<meta[^>]*property=[\"']og:title[\"'][^>]*content=[\"']([^\"']*)[\"']"), _first(h, r"(?is)<title[^>]*>(.*?)</title>"))
    return pages.select(
        "url",
        F.trim(F.substring_index(title, " | ", 1)).alias("title"),
        N.parse_price(_itemprop(h, "price")).alias("price"),
        N.strict_ean(_itemprop(h, "gtin13")).alias("ean"),
        _itemprop(h, "productID").alias("competitor_sku"),
        N.parse_stock(F.regexp_replace(_itemprop(h, "availability"), "^.*/", "")).alias("in_stock"),
    )


def extract_datalayer(pages: DataFrame) -> DataFrame:
    """Values that pages push for their analytics: EUR price (that after the currency, else that of the item), code, brand,
    shop's id (else that of the url), EAN, heading and availability."""
    h = F.col("html")
    after = _first(h, r'(?s)"currencyCode"\s*:\s*"EUR".*?"price"\s*:\s*"?([0-9.,]+)')
    item = _first(h, r'"price"\s*:\s*([0-9.]+)\s*,\s*"priceCurrency"\s*:\s*"EUR"')
    return pages.select(
        "url",
        F.coalesce(N.parse_price(after), N.parse_price(item)).alias("price"),
        _first(h, r'"product_code"\s*:\s*"([^"]*)"').alias("mpn"),
        _first(h, r'"product_brand"\s*:\s*"([^"]*)"').alias("brand"),
        F.trim(_first(h, r"(?is)<h1[^>]*>\s*([^<]+)")).alias("title"),
        F.coalesce(_first(h, r'"ecomm_prodid"\s*:\s*"([0-9]+)"'), _first(F.col("url"), r"-p([0-9]+)/")).alias("competitor_sku"),
        N.strict_ean(_first(h, r'(?s)class="ean value">\s*<span>\s*([0-9]{8,13})\s*</span>')).alias("ean"),
        N.parse_stock(_first(h, r'"availability"\s*:\s*"https?://schema\.org/(\w+)"')).alias("in_stock"),
    )


def with_shown_price(listings: DataFrame, shown: DataFrame) -> DataFrame:
    """listings with the price that a page's data layer shows, where it shows one."""
    d = shown.where("price IS NOT NULL").groupBy("url").agg(F.min("price").alias("__shown"))
    return listings.join(d, "url", "left").withColumn("price", F.coalesce("__shown", "price")).select(*listings.columns)


#: Classes of the parts of a product card.
CARD = {"name": "title", "manufacturer": "brand", "code": "mpn", "price-final": "price", "availability-amount": "availability"}


def extract_cards(pages: DataFrame) -> DataFrame:
    """The first product card of each page: title, link, brand, part number, price and stock by the classes of its elements,
    nested markup included. Pages without a card give no row.

    Pages are parted by Spark; the parser walks one page at a time, in Arrow batches.
    """
    from html.parser import HTMLParser

    class Card(HTMLParser):
        def __init__(self):
            super().__init__()
            self.open, self.cards, self.found = [], 0, {}

        def handle_starttag(self, tag, attrs):
            own = dict(attrs)
            classes = (own.get("class") or "").split()
            self.cards += "product" in classes
            part = next((CARD[c] for c in classes if c in CARD), self.open[-1][1] if self.open else None)
            if self.cards == 1 and "name" in classes:
                self.found.setdefault("href", own.get("href"))
            if tag not in ("br", "img", "input", "link", "meta", "hr", "wbr", "source"):
                self.open.append((tag, part))

        def handle_endtag(self, tag):
            at = next((i for i in range(len(self.open) - 1, -1, -1) if self.open[i][0] == tag), None)
            if at is not None:
                del self.open[at:]

        def handle_data(self, data):
            part = self.open[-1][1] if self.open else None
            if self.cards == 1 and part and data.strip():
                self.found[part] = self.found.get(part, "") + data.strip()

    names = ["href", *CARD.values()]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for url, html in zip(batch["url"], batch["html"], strict=True):
                card = Card()
                card.feed(html)
                card.close()
                if card.cards:
                    rows.append((url, *(card.found.get(x) for x in names)))
            yield pd.DataFrame(rows, columns=["url", *names])

    found = pages.where("html IS NOT NULL").select("url", "html").mapInPandas(run, ", ".join(f"{x} string" for x in ("url", *names)))
    return found.select("url", N.blank_to_null(F.col("href")).alias("href"), "title", "brand", "mpn", N.parse_price(F.col("price")).alias("price"), N.parse_stock(F.col("availability")).alias("in_stock"))


def extract_specs(pages: DataFrame, pattern: str = r"(?is)<t[hd][^>]*>\s*([^<]+?)\s*:?\s*</t[hd]>\s*<td[^>]*>\s*([^<]+?)\s*</td>") -> DataFrame:
    """Label to value rows of a page; labels folded and in lower case; the first value of a label counts."""
    pairs = F.arrays_zip(F.regexp_extract_all("html", F.lit(pattern), F.lit(1)).alias("k"), F.regexp_extract_all("html", F.lit(pattern), F.lit(2)).alias("v"))
    rows = pages.select("url", F.posexplode(pairs).alias("at", "p")).select("url", "at", N.fold(F.lower(F.trim("p.k"))).alias("label"), F.trim("p.v").alias("value"))
    return rows.groupBy("url", "label").agg(F.min_by("value", "at").alias("value"))


def brand_of_specs(specs: DataFrame) -> DataFrame:
    return specs.where(F.col("label").isin("znacka", "vyrobca")).groupBy("url").agg(F.min_by("value", "label").alias("brand"))


def extract_links(pages: DataFrame, keep: str = "", drop: str = "$^", base: str = "") -> DataFrame:
    """Distinct canonical links of pages whose path matches keep and not drop."""
    found = F.explode(F.regexp_extract_all("html", F.lit(r"(?is)<a\s[^>]*?href=[\"']([^\"'#][^\"']*)[\"']"), F.lit(1)))
    links = pages.select(found.alias("href")).where(~F.col("href").rlike("^(?i)(mailto|javascript|tel):"))
    links = links.where(F.col("href").rlike(keep) & ~F.col("href").rlike(drop)) if keep else links.where(~F.col("href").rlike(drop))
    return links.select(N.canon_url(F.col("href"), base).alias("link")).where("link <> ''").distinct()


def extract_sitemap(pages: DataFrame) -> DataFrame:
    locs = F.regexp_extract_all("html", F.lit(r"(?is)<loc>\s*(.*?)\s*</loc>"), F.lit(1))
    robots = F.regexp_extract_all("html", F.lit(r"(?im)^\s*sitemap:\s*(\S+)"), F.lit(1))
    return pages.select(F.explode(F.concat(locs, robots)).alias("link")).distinct()


def frontier(links: DataFrame, visited: DataFrame) -> DataFrame:
    return links.join(visited.select(F.col("url").alias("link")).distinct(), "link", "left_anti")


def enrich_listings(listings: DataFrame, details: DataFrame) -> DataFrame:
    """Fills missing ean, mpn and brand from details by url, and a missing sku from EAN, else part number."""
    d = details.groupBy("url").agg(*(F.min(c).alias(f"d_{c}") for c in ("ean", "mpn", "brand")))
    out = listings.join(d, "url", "left").withColumns({c: F.coalesce(N.blank_to_null(F.col(c)), f"d_{c}") for c in ("ean", "mpn", "brand")})
    if "competitor_sku" in listings.columns:
        out = out.withColumn("competitor_sku", F.coalesce("competitor_sku", "ean", "mpn"))
    return out.select(*listings.columns)


def resolve_hits(hits: DataFrame, products: DataFrame | None = None, least: int = 2) -> DataFrame:
    """Per product and store the hit (product_id, store, strategy, hit_title, url) of the first strategy whose title shares
    two tokens with the product's. Without products, hits bring its title as product_title."""
    columns = [c for c in hits.columns if c != "product_title"]
    if products is not None:
        hits = hits.select(*columns).join(products.select(F.col("id").alias("product_id"), F.col("title").alias("product_title")), "product_id")
    tokens = lambda c: N.title_tokens(F.col(c), "loose")
    ok = hits.where(F.size(F.array_intersect(tokens("product_title"), tokens("hit_title"))) >= least).select(*columns)
    first = Window.partitionBy("product_id", "store").orderBy("strategy", "url")
    return ok.withColumn("__n", F.row_number().over(first)).where("__n = 1").drop("__n")
