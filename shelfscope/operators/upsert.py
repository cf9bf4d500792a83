"""Merges. Parquet has no MERGE: a merged table is written as a new numbered version, or as dated partitions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shelfscope.functions import normalise as N


def upsert(target: DataFrame, source: DataFrame, keys: list[str], fill: list[str] = [], keep: list[str] = [], newest: list | None = None) -> DataFrame:  # noqa: B006
    """target with the rows of source merged in on keys. Columns in fill take the new value if there is one, columns in keep
    the old one if the row exists, all others the new one. Of rows with equal keys in source the first by `newest` counts;
    rows with a null key are appended."""
    blank = " OR ".join(f"{k} IS NULL" for k in keys)
    columns = target.columns
    order = newest or [F.xxhash64(*source.columns)]
    one = source.where(f"NOT ({blank})").withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__n = 1").drop("__n")
    t = target.where(f"NOT ({blank})").select(*(F.col(c).alias(f"t_{c}") for c in columns), F.lit(True).alias("t_there"))
    s = one.select(*(F.col(c).alias(f"s_{c}") for c in columns), F.lit(True).alias("s_there"))
    on = None
    for k in keys:
        on = (F.col(f"t_{k}") == F.col(f"s_{k}")) if on is None else on & (F.col(f"t_{k}") == F.col(f"s_{k}"))

    def value(c: str) -> F.Column:
        old, new = F.col(f"t_{c}"), F.col(f"s_{c}")
        if c in keys or c in fill:
            return F.coalesce(new, old)
        if c in keep:
            return F.when(F.col("t_there"), old).otherwise(new)
        return F.when(F.col("s_there"), new).otherwise(old)

    merged = t.join(s, on, "full_outer").select(*(value(c).alias(c) for c in columns))
    return merged.unionByName(target.where(blank)).unionByName(source.where(blank).select(*columns))


def upsert_listings(target: DataFrame, batch: DataFrame) -> DataFrame:
    """On store and url: identifiers are only filled, currency and id stay, the rest is new. Newest row of a batch wins."""
    ids = [c for c in ("competitor_sku", "brand", "mpn", "ean") if c in target.columns]
    stay = [c for c in ("id", "currency") if c in target.columns]
    return upsert(target, batch, ["competitor_id", "url"], ids, stay, [F.desc("scraped_at"), "price_eur", "title", F.coalesce("ean", F.lit("")), F.coalesce("mpn", F.lit("")), F.coalesce("brand", F.lit(""))])


def ingest_listings(target: DataFrame, batch: DataFrame, products: DataFrame, rules: list[tuple[str, list[str]]] | None = None) -> DataFrame:
    """upsert_listings of a batch whose blank brands are filled first, from products or else earlier listings of the same
    barcode, and whose missing categories are those that rules find in the titles."""
    from shelfscope.operators.matching import backfill_brand

    batch = backfill_brand(batch, products, target)
    if rules and "category" in batch.columns:
        batch = batch.withColumn("category", F.coalesce(N.blank_to_null(F.col("category")), N.classify_category(F.col("title"), F.col("brand"), rules)))
    return upsert_listings(target, batch)


def upsert_catalogue(target: DataFrame, rows: DataFrame) -> DataFrame:
    return upsert(target, rows, ["sku"], keep=["id"])


def upsert_matches(target: DataFrame, rows: DataFrame) -> DataFrame:
    """Matches by listing, all columns replaced. Of a listing that the batch has more than once the surest match counts, then
    that of the lowest product."""
    best = Window.partitionBy("listing_id").orderBy(F.desc("confidence"), "product_id", F.xxhash64(*rows.columns))
    one = rows.withColumn("__n", F.row_number().over(best)).where("__n = 1").select(*target.columns)
    return target.join(one.select("listing_id"), "listing_id", "left_anti").unionByName(one)


def upsert_offers(target: DataFrame, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Marketplace offers on EAN and seller, and how many rows are inserted and updated."""
    new = rows.select("ean", "seller").distinct().join(target.select("ean", "seller", F.lit(1).alias("old")), ["ean", "seller"], "left")
    return upsert(target, rows, ["ean", "seller"]), new.agg(F.count_if(F.col("old").isNull()).alias("inserted"), F.count_if(F.col("old").isNotNull()).alias("updated"))


def upsert_products_from_own(products: DataFrame, own_listings: DataFrame) -> DataFrame:
    """Products with identifiers filled and prices refreshed from our own listings (found by EAN, else brand and part
    number, else title), and new products for the rest, numbered by a hash of their url."""
    from shelfscope.operators.matching import normalised

    l, p = normalised(own_listings), normalised(products)  # noqa: E741
    by = lambda keys, name: p.where(" AND ".join(f"{k} IS NOT NULL" for k in keys)).groupBy(*keys).agg(F.max("id").alias(name))
    p, l = p.withColumn("t", F.lower("title")), l.withColumn("t", F.lower("title"))  # noqa: E741
    l = l.join(by(["nean"], "p1"), "nean", "left").join(by(["nbrand", "nmpn"], "p2"), ["nbrand", "nmpn"], "left").join(by(["t"], "p3"), "t", "left")  # noqa: E741
    l = l.withColumn("found", F.coalesce("p1", "p2", "p3"))  # noqa: E741
    row = F.struct("brand", "mpn", "nean", "price_eur", "title", "id")
    known = l.where("found IS NOT NULL").groupBy(F.col("found").alias("id")).agg(F.max_by(row, F.struct("scraped_at", "id")).alias("r"))
    out = products.join(known, "id", "left")
    out = out.withColumns({"brand": F.coalesce("brand", "r.brand"), "mpn": F.coalesce("mpn", "r.mpn"), "ean": F.coalesce("ean", "r.nean"), "price_eur": F.coalesce("r.price_eur", "price_eur")}).select(*products.columns)
    new = l.where("found IS NULL").groupBy(F.coalesce("nean", F.concat_ws("|", "nbrand", "nmpn", "t")).alias("k")).agg(F.max_by(row, F.struct("scraped_at", "id")).alias("r"))
    new = new.select((F.pmod(F.xxhash64("k"), F.lit(1 << 52)) + F.lit(1 << 52)).alias("id"), F.concat(F.lit("derived-"), F.md5("k")).alias("sku"), "r.brand", "r.mpn", F.col("r.nean").alias("ean"), "r.title", "r.price_eur")
    return out.unionByName(new.select(*(c for c in products.columns if c in new.columns)), allowMissingColumns=True)


def write_dated(df: DataFrame, path: str, date: str = "snapshot_date") -> None:
    """Replaces the dates that df has."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(date).parquet(path)


def _versions(spark: SparkSession, root: str) -> list[int]:
    """Numbers of the complete versions of a table: Spark's writer leaves its mark in a folder when all of it is there."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    base = hadoop.Path(root)
    fs = base.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(base):
        return []
    names = [x.getPath().getName() for x in fs.listStatus(base)]
    return sorted(int(n[1:]) for n in names if n[:1] == "v" and n[1:].isdigit() and fs.exists(hadoop.Path(f"{root}/{n}/_SUCCESS")))


def write_version(df: DataFrame, root: str) -> int:
    """Writes the next version of a table beside those there are and returns its number. A version counts once it is whole,
    so a reader finds the one before until then; a writer that dies leaves a part that nobody reads."""
    version = max(_versions(df.sparkSession, root), default=0) + 1
    df.write.mode("overwrite").parquet(f"{root}/v{version:09d}")
    return version


def read_version(spark: SparkSession, root: str) -> DataFrame:
    """The latest whole version of a table."""
    found = _versions(spark, root)
    if not found:
        raise FileNotFoundError(f"no version in {root}")
    return spark.read.parquet(f"{root}/v{found[-1]:09d}")
