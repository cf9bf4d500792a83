"""Bucketed tables, and the stream that merges and matches."""

import pytest
from pyspark.sql import functions as F

from shelfscope.operators import matching as M
from shelfscope.operators import upsert as U
from shelfscope.operators.tables import Table
from shelfscope.plans import fixtures as X
from shelfscope.streaming import ingest
from tests.conftest import SMALL


def listings_of(spark):
    return X.listings(spark, SMALL).withColumn("scraped_at", F.col("scraped_at").cast("timestamp"))


def folders(table, version=None):
    return table.manifest(version)["folders"]


def test_a_small_merge_rewrites_touched_buckets_only(spark, tmp_path):
    rows = listings_of(spark)
    table = Table(spark, str(tmp_path / "t"))
    table.create(rows, ["competitor_id", "url"], 128)
    before = folders(table)
    batch = rows.orderBy("id").limit(50).withColumn("title", F.lit("new"))
    some = table.touched(batch)
    assert len(some) <= 50 and table.merge(batch, U.upsert_listings) == 2
    after = folders(table)
    assert {int(b) for b in after if after[b] != before.get(b)} == set(some) and set(after) == set(before)
    want = U.upsert_listings(rows, batch)
    assert table.read().exceptAll(want).count() == 0 == want.exceptAll(table.read()).count()
    assert table.read(1).exceptAll(rows).count() == 0 and table.read().where("title = 'new'").count() == 50
    assert table.read(buckets=some[:1]).count() < table.read().count()


def test_repeated_batches_and_odd_keys(spark, tmp_path):
    kind = "competitor_id string, url string, title string"
    table = Table(spark, str(tmp_path / "t"))
    table.create(spark.createDataFrame([("a", "u", "old")], kind), ["competitor_id", "url"], 8)
    batch = spark.createDataFrame([("a", "u", "new"), ("a", None, "x"), ("a", None, "x"), (None, None, "y")], kind)
    how = lambda old, new: U.upsert(old, new, ["competitor_id", "url"])
    assert table.merge(batch, how, "s", 0) == 2 and table.merge(batch, how, "s", 0) == 2
    assert sorted(r["title"] for r in table.read().collect()) == ["new", "x", "x", "y"], "rows without a key are appended"
    assert table.merge(batch.where("false"), how, "s", 1) == 3 and table.read().count() == 4
    assert table.manifest()["streams"] == {"s": 1}
    with pytest.raises(RuntimeError):
        table._publish({}, 3)
    with pytest.raises(FileNotFoundError):
        Table(spark, str(tmp_path / "none")).read()


def tables_of(spark, root):
    return [sorted(map(tuple, Table(spark, f"{root}/{t}").read().collect()), key=str) for t in ("listings", "matches")]


def test_a_replayed_batch_changes_nothing(spark, tmp_path, monkeypatch):
    rows, products = listings_of(spark), X.products(spark, SMALL)
    none = M.layered_match(rows, products).limit(0)
    parts = [rows.where(F.pmod(F.xxhash64("id"), F.lit(3)) == k) for k in range(3)]
    for name, steps in (("once", [0, 1, 2]), ("again", [0, 1, 1, 2])):
        ingest.create_tables(spark, str(tmp_path / name), rows.limit(0), none, 16)
        for k in steps:
            ingest.merge_and_match(spark, str(tmp_path / name), products, parts[k], k)
    # a batch that dies after the listings are merged
    root = str(tmp_path / "cut")
    ingest.create_tables(spark, root, rows.limit(0), none, 16)
    ingest.merge_and_match(spark, root, products, parts[0], 0)
    with monkeypatch.context() as m:
        m.setattr(ingest, "layered_match", lambda *a: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            ingest.merge_and_match(spark, root, products, parts[1], 1)
    for k in (1, 2):
        ingest.merge_and_match(spark, root, products, parts[k], k)
    once = tables_of(spark, tmp_path / "once")
    assert once == tables_of(spark, tmp_path / "again") == tables_of(spark, root)
    assert len(once[0]) == rows.count()
    want = M.layered_match(rows, products).select(*M.MATCH, "status")
    assert once[1] == sorted(map(tuple, want.collect()), key=str)


def test_a_stream_that_is_started_again(spark, tmp_path):
    rows, products = listings_of(spark), X.products(spark, SMALL)
    drop, root = str(tmp_path / "drop"), str(tmp_path / "t")
    ingest.create_tables(spark, root, rows.limit(0), M.layered_match(rows, products).limit(0), 8)
    schema = rows.schema.simpleString()[7:-1].replace(":", " ")
    for k in range(2):
        rows.where(F.pmod(F.xxhash64("id"), F.lit(2)) == k).coalesce(1).write.mode("append").parquet(drop)
        ingest.ingest_and_match(spark, drop, root, str(tmp_path / "c"), schema, products, files=1).awaitTermination()
    listings, matches = tables_of(spark, root)
    assert len(listings) == rows.count() and len(matches) == M.layered_match(rows, products).count()
    assert Table(spark, f"{root}/listings").manifest()["streams"] == {"listings": 1}


def test_late_rows_of_a_stream_are_dropped(spark, tmp_path):
    kind = "competitor_id string, price_eur decimal(10,2), scraped_at timestamp"
    drop = str(tmp_path / "drop")
    days = [("a", 5, "2024-01-01 10:00:00"), ("a", 4, "2024-01-01 11:00:00")], [("b", 9, "2024-01-09 00:00:00")], [("a", 1, "2024-01-01 12:00:00"), ("b", 8, "2024-01-09 05:00:00")], [("b", 7, "2024-01-20 00:00:00")]
    out = {}
    for k, rows in enumerate(days):
        part = spark.createDataFrame(rows, "competitor_id string, price int, at string")
        part.select("competitor_id", F.col("price").cast("decimal(10,2)").alias("price_eur"), F.to_timestamp("at").alias("scraped_at")).coalesce(1).write.mode("append").parquet(drop)
        stream = ingest.windowed_prices(spark.readStream.schema(kind).parquet(drop))
        q = stream.writeStream.outputMode("append").foreachBatch(lambda df, _: out.update({(r["competitor_id"], str(r["start"])[:10]): (r["n"], int(r["low"])) for r in df.collect()})).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        q.awaitTermination()
    assert out == {("a", "2024-01-01"): (2, 4), ("b", "2024-01-09"): (2, 8)}
