"""Readers and writers of catalogue, feed, marketplace and export files. Schemas are explicit."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shelfscope.functions import normalise as N

# Columns that a catalogue file must have.
CATALOGUE = ["sku", "brand", "mpn", "ean", "title", "category", "price_eur", "cost_eur", "stock"]


def _csv(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """All columns as text, blanks as null, with the position of each row, which sorts as the rows do: file, where its split
    begins, number inside the split. It does not depend on how splits are packed into tasks."""
    df = spark.read.option("header", True).option("sep", sep).csv(path)
    names = {c: c.strip().lstrip("\ufeff") for c in df.columns}
    place = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("n"))
    return df.select(*(N.blank_to_null(F.col(f"`{c}`")).alias(n) for c, n in names.items()), place.alias("position"))


def _with_line(df: DataFrame) -> DataFrame:
    """Adds line, the number of a row in its file (the header is line 1; empty lines don't count): rows of earlier splits are
    counted once, a row per split."""
    splits = df.groupBy(F.col("position.file").alias("__f"), F.col("position.split").alias("__s")).agg(F.count("*").alias("__rows"), F.min("position.n").alias("__from"))
    before = F.coalesce(F.sum("__rows").over(Window.partitionBy("__f").orderBy("__s").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    splits = splits.withColumn("__before", before)
    out = df.join(splits, (F.col("position.file") == F.col("__f")) & (F.col("position.split") == F.col("__s")))
    return out.withColumn("line", F.col("__before") + F.col("position.n") - F.col("__from") + 2).drop("__f", "__s", "__rows", "__from", "__before")


def read_catalogue(spark: SparkSession, path: str, strict: bool = True) -> tuple[DataFrame, DataFrame]:
    """Catalogue rows, and rows that can't be read with their line and the names of their bad columns. strict: the first of
    these fails the job that reads the catalogue. Missing columns fail at once."""
    df = _csv(spark, path)
    if missing := sorted(set(CATALOGUE) - set(df.columns)):
        raise ValueError(f"missing columns: {', '.join(missing)}")
    price, cost, stock = F.col("price_eur").try_cast("decimal(10,2)"), F.col("cost_eur").try_cast("decimal(10,2)"), F.col("stock").try_cast("int")
    checks = {"sku": F.col("sku").isNull(), "title": F.col("title").isNull(), "price_eur": F.col("price_eur").isNotNull() & price.isNull(), "cost_eur": F.col("cost_eur").isNotNull() & cost.isNull(), "stock": F.col("stock").isNotNull() & stock.isNull()}
    df = _with_line(df).withColumn("bad", F.concat_ws(",", *(F.when(c, F.lit(k)) for k, c in checks.items())))
    typed = df.withColumns({"price_eur": price, "cost_eur": cost, "stock": stock})
    if strict:
        fail = F.when(F.col("bad") == "", F.col("sku")).otherwise(F.raise_error(F.concat(F.lit("line "), F.col("line").cast("string"), F.lit(": bad "), F.col("bad"))).cast("string"))
        return typed.withColumn("sku", fail).select(*CATALOGUE), df.where("bad <> ''")
    return typed.where("bad = ''").select(*CATALOGUE), df.where("bad <> ''")


def read_product_feed(spark: SparkSession, path: str, competitor_id: str, brand: str | None = None) -> DataFrame:
    """Listings of an XML feed, one per SHOPITEM with title, price and url; of one brand if given."""
    names = ("ITEM_ID", "PRODUCTNAME", "PRODUCT", "MANUFACTURER", "PRODUCTNO", "EAN", "PRICE_VAT", "URL", "DELIVERY_DATE", "CATEGORYTEXT")
    df = spark.read.format("xml").option("rowTag", "SHOPITEM").schema(", ".join(f"{n} string" for n in names)).load(path)
    text = {n: N.blank_to_null(F.col(n)) for n in names}
    rows = df.select(
        F.lit(competitor_id).alias("competitor_id"),
        text["ITEM_ID"].alias("competitor_sku"),
        text["MANUFACTURER"].alias("brand"),
        text["PRODUCTNO"].alias("mpn"),
        text["EAN"].alias("ean"),
        text["CATEGORYTEXT"].alias("category"),
        F.coalesce(text["PRODUCTNAME"], text["PRODUCT"]).alias("title"),
        F.replace(text["PRICE_VAT"], F.lit(","), F.lit(".")).try_cast("decimal(10,2)").alias("price_eur"),
        (text["DELIVERY_DATE"] == "0").alias("in_stock"),
        text["URL"].alias("url"),
    ).where("title IS NOT NULL AND price_eur IS NOT NULL AND url IS NOT NULL")
    return rows.where(F.lower("brand") == brand.lower()) if brand else rows


def slug_to_brand(slug: str) -> str:
    return slug.replace("-", " ").title()


def read_offers(spark: SparkSession, path: str) -> DataFrame:
    """Marketplace offers; numbers and times that can't be read are null, as is a missing box price."""
    df = _csv(spark, path)
    if "box_price_eur" not in df.columns:
        df = df.withColumn("box_price_eur", F.lit(None).cast("string"))
    number = lambda c: F.replace(F.col(c), F.lit(","), F.lit(".")).try_cast("decimal(10,2)").alias(c)
    return df.select(N.norm_ean(F.col("ean")).alias("ean"), "title", "seller", "seller_url", number("price_eur"), number("delivery_eur"), number("box_price_eur"), F.try_to_timestamp("scraped_at").alias("scraped_at"), "position")


def read_identifier_rows(spark: SparkSession, path: str, dedupe: str = "pair") -> DataFrame:
    """Rows with an EAN and a title: the first per EAN and title, or with dedupe='ean' per EAN."""
    df = _csv(spark, path)
    price = F.col("our_price_sk") if "our_price_sk" in df.columns else F.col("price_sk") if "price_sk" in df.columns else F.lit(None).cast("string")
    rows = df.select(N.norm_ean(F.col("ean")).alias("ean"), "title", price.alias("price_sk"), "position").where("ean IS NOT NULL AND title IS NOT NULL")
    first = Window.partitionBy(*(["ean", "title"] if dedupe == "pair" else ["ean"])).orderBy("position")
    return rows.withColumn("__n", F.row_number().over(first)).where("__n = 1").drop("__n")


def read_reference_prices(spark: SparkSession, path: str, ean_col: str, price_col: str) -> DataFrame:
    """Price per EAN (text before the first point); the last row counts."""
    df = _csv(spark, path).select(F.substring_index(ean_col, ".", 1).alias("ean"), N.parse_price(F.col(price_col)).alias("price"), "position")
    return df.where("ean IS NOT NULL").groupBy("ean").agg(F.max_by("price", "position").alias("reference_price"))


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).select("url", "html")


def load_registry(spark: SparkSession, path: str) -> DataFrame:
    """Stores (store, name, url, weight, own) of a YAML file with the lists `competitors` and `own_stores`."""
    import yaml

    data = yaml.safe_load(Path(path).read_text())
    stores = data.get("competitors") if isinstance(data, dict) else None
    if not isinstance(stores, list):
        raise ValueError("competitors must be a list")
    own = set(data.get("own_stores") or [])
    rows = [(s["id"], s.get("name"), s.get("url"), float(s.get("weight", 1.0)), bool(s.get("own_store")) or s["id"] in own) for s in stores]
    return spark.createDataFrame(rows, "store string, name string, url string, weight double, own boolean")


def load_thresholds(path: str) -> dict:
    import yaml

    data = yaml.safe_load(Path(path).read_text())
    if not isinstance(data, dict):
        raise ValueError("thresholds must be a mapping")
    return {"raise_gap": data["raise"]["min_gap_below_next"], "hold_gap": data["hold"]["max_gap_to_median"], "drop_gap": data["drop"]["min_gap_above_median"], "drop_stores": data["drop"]["min_competitors"], "move": data["investigate"]["min_day_on_day_move"]}


# --- sinks -----------------------------------------------------------------------------------------------------------


def wide_prices(latest: DataFrame, products: DataFrame, stores: list[str], own: list[str]) -> DataFrame:
    """A row per product that has a price: its columns, then price and url per store, ours first."""
    order = [*[s for s in stores if s in own], *sorted(s for s in stores if s not in own)]
    wide = latest.groupBy("product_id").pivot("competitor_id", order).agg(F.first("price_eur").alias("price"), F.first("url").alias("url"))
    out = products.join(wide, products["id"] == wide["product_id"]).drop("product_id")
    return out.select(*products.columns, *(F.col(f"`{s}_{k}`") for s in order for k in ("price", "url")))


def export_wide_prices(latest: DataFrame, products: DataFrame, stores: list[str], own: list[str], path: str) -> None:
    wide_prices(latest, products, stores, own).write.mode("overwrite").option("header", True).csv(path)


def comparison_table(merged: DataFrame, opponents: list[str]) -> DataFrame:
    money = lambda c: F.coalesce(F.format_string("%.2f", F.col(c).cast("double")), F.lit("—"))
    text = lambda c: F.when(F.col(c).isNull(), "—").otherwise(money(c))
    gap = lambda c: F.when(F.col(c).isNull() | F.col("ref_price").isNull(), "—").otherwise(F.format_string("%.1f", F.coalesce(N.delta_pct(F.col(c), F.col("ref_price")), F.lit(0.0))))
    cells = [x for o in opponents for x in (text(o).alias(o), gap(o).alias(f"{o} %"))]
    return merged.select(F.col("brand").alias("BRAND"), F.col("title").alias("PRODUCT"), text("ref_price").alias("PRICE"), *cells, F.concat_ws("/", "wins", "n_opponents").alias("WIN RATIO"))


def export_comparison_tsv(merged: DataFrame, opponents: list[str], path: str) -> None:
    comparison_table(merged, opponents).write.mode("overwrite").option("header", True).option("sep", "\t").csv(path)


#: Columns of an enrichment report and of an alert, in the order of the files.
ENRICHMENT = ("status", "product_id", "sku", "old_ean", "new_ean", "confidence", "match_type", "source_title", "product_title", "source_price")
ALERT = ("sku", "title", "playbook", "current_price", "suggested_price", "min_price", "median_price", "rationale")


def write_enrichment_report(df: DataFrame, path: str) -> None:
    """One row per source row in the columns of ENRICHMENT; columns that df lacks are empty, confidence has two digits."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")) if c in df.columns else F.lit("")
    number = F.coalesce(F.format_string("%.2f", F.col("confidence").try_cast("double")), F.lit("")) if "confidence" in df.columns else F.lit("")
    number = F.when(text("confidence") == "", "").otherwise(number)
    rows = df.select(*((number if c == "confidence" else text(c)).alias(c) for c in ENRICHMENT))
    rows.write.mode("overwrite").option("header", True).option("emptyValue", "").csv(path)


def write_alerts(df: DataFrame, path: str) -> None:
    """A JSON line per alert in the columns of ALERT: titles end at 60 characters, prices are numbers with two digits, what is
    missing is null in every record."""
    money = [c for c in ALERT if c.endswith("_price")]
    rows = df.select(*(F.substring("title", 1, 60).alias(c) if c == "title" else F.col(c).cast("decimal(10,2)").alias(c) if c in money else F.col(c) for c in ALERT))
    rows.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def age_hours(ts: Column, as_of: Column) -> Column:
    return (F.unix_timestamp(as_of.cast("timestamp")) - F.unix_timestamp(ts.cast("timestamp"))) / 3600
