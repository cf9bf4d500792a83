"""Incremental ingest: a drop folder of listing files, merged batch by batch, and matching of what is new."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from shelfscope.operators.matching import MATCH, layered_match, unmatched
from shelfscope.operators.tables import Table
from shelfscope.operators.upsert import read_version, upsert_listings, upsert_matches, write_version
from shelfscope.plans.scratch import written


def _dropped(spark: SparkSession, drop: str, schema: str, files: int) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(drop)


def ingest(spark: SparkSession, drop: str, root: str, checkpoint: str, schema: str, files: int = 50) -> StreamingQuery:
    """Merges new files of drop into the listings at root until none are left. A batch that runs again changes nothing, as
    rows merge by store and url. Every batch writes the table anew: for small tables; `ingest_and_match` is for large ones."""

    def merge(batch: DataFrame, _: int) -> None:
        write_version(upsert_listings(read_version(spark, root), batch), root)

    return _dropped(spark, drop, schema, files).writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def create_tables(spark: SparkSession, root: str, listings: DataFrame, matches: DataFrame, buckets: int = 256) -> None:
    """The bucketed tables of `ingest_and_match`: listings by store and url, matches by listing."""
    Table(spark, f"{root}/listings").create(listings, ["competitor_id", "url"], buckets)
    Table(spark, f"{root}/matches").create(matches.select(*MATCH, "status"), ["listing_id"], buckets)


def merge_and_match(spark: SparkSession, root: str, products: DataFrame, batch: DataFrame, number: int, stream: str = "listings") -> None:
    """One batch of listings: merged into the table of listings, then those of its rows that have no match are matched. Both
    tables read and write only the buckets that the batch touches, and both note the batch, so that a batch that comes again,
    whole or after it was cut off between the two, leaves the same tables."""
    listings, matches = Table(spark, f"{root}/listings"), Table(spark, f"{root}/matches")
    batch = written(batch, "batch")
    listings.merge(batch, upsert_listings, stream, number)
    keys = batch.select("competitor_id", "url").distinct()
    now = listings.read(buckets=listings.touched(keys)).join(keys, ["competitor_id", "url"], "left_semi")
    ids = now.select(F.col("id").alias("listing_id"))
    todo = unmatched(now, matches.read(buckets=matches.touched(ids)))
    found = written(layered_match(todo, products).select(*MATCH, "status"), "new-matches")
    matches.merge(found, upsert_matches, stream, number)


def ingest_and_match(spark: SparkSession, drop: str, root: str, checkpoint: str, schema: str, products: DataFrame, files: int = 50) -> StreamingQuery:
    """Merges new files of drop into the tables at root and matches the new listings, until no files are left."""

    def step(batch: DataFrame, number: int) -> None:
        merge_and_match(spark, root, products, batch, number)

    return _dropped(spark, drop, schema, files).writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def match_new(spark: SparkSession, listings_root: str, matches_root: str, products: DataFrame) -> DataFrame:
    """Matches listings that have none yet, adds them to the table of matches and returns them."""
    old = read_version(spark, matches_root)
    new = layered_match(unmatched(read_version(spark, listings_root), old), products)
    write_version(old.unionByName(new.select(*old.columns)), matches_root)
    return new


def windowed_prices(listings: DataFrame, late: str = "1 day", width: str = "1 day") -> DataFrame:
    """Streaming or batch: least price and listings per store and window of scraped_at; later rows are dropped."""
    rows = listings.withWatermark("scraped_at", late) if listings.isStreaming else listings
    return rows.groupBy(F.window("scraped_at", width).alias("w"), "competitor_id").agg(F.count("*").alias("n"), F.min("price_eur").alias("low")).select(F.col("w.start").alias("start"), "competitor_id", "n", "low")
