"""Latest prices, market snapshots, actions and alerts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Thresholds of the four actions.
THRESHOLDS = {"raise_gap": 0.08, "hold_gap": 0.05, "drop_gap": 0.15, "drop_stores": 2, "move": 0.20}


def latest_per_store(offers: DataFrame, as_of: str, days: int | None = None) -> DataFrame:
    """Newest offer per product and store up to as_of, and not older than days before it."""
    rows = offers.where(F.col("scraped_at") <= F.lit(as_of).cast("timestamp"))
    if days is not None:
        rows = rows.where(F.col("scraped_at") >= F.lit(as_of).cast("timestamp") - F.expr(f"interval {days} days"))
    new = Window.partitionBy("product_id", "competitor_id").orderBy(F.desc("scraped_at"), F.desc("listing_id"))
    return rows.withColumn("__n", F.row_number().over(new)).where("__n = 1").drop("__n")


def latest_prices(offers: DataFrame, as_of: str, min_conf: float = 0.85, include: list[str] | None = None, exclude: list[str] | None = None) -> DataFrame:
    rows = offers.where(F.col("confidence") >= min_conf)
    if include is not None:
        rows = rows.where(F.col("competitor_id").isin(include))
    if exclude is not None:
        rows = rows.where(~F.col("competitor_id").isin(exclude))
    return latest_per_store(rows, as_of)


def build_snapshot(offers: DataFrame, products: DataFrame, as_of: str, own: list[str], min_conf: float = 0.85) -> DataFrame:
    """Market per product with a rival's price. Our price is our newest one, else the catalogue's; our rank is one more
    than the number of cheaper rivals; equally cheap stores rank by name."""
    new = latest_prices(offers, as_of, min_conf)
    mine = F.col("competitor_id").isin(own)
    own_price = new.where(mine).groupBy("product_id").agg(F.max_by("price_eur", F.struct("scraped_at", "listing_id")).alias("our_price"))
    rivals = new.where(~mine).join(own_price, "product_id", "left").join(products.select(F.col("id").alias("product_id"), F.col("price_eur").alias("list_price")), "product_id", "left")
    rivals = rivals.withColumn("own_price", F.coalesce("our_price", "list_price"))
    price = F.col("price_eur")
    return rivals.groupBy("product_id").agg(
        F.lit(as_of).cast("date").alias("snapshot_date"),
        F.first("own_price").alias("own_price"),
        F.count("*").alias("competitor_count"),
        F.min("price_eur").alias("min_price"),
        F.median(price.cast("double")).cast("decimal(12,3)").alias("median_price"),
        F.max("price_eur").alias("max_price"),
        F.when(F.first("own_price").isNotNull(), F.count_if(price < F.col("own_price")) + 1).alias("own_rank"),
        F.min_by("competitor_id", F.struct("price_eur", "competitor_id")).alias("cheapest_competitor"),
    )


def previous_snapshot(snapshots: DataFrame) -> DataFrame:
    """Adds the median of a product's snapshot before this one."""
    return snapshots.withColumn("prev_median", F.lag("median_price").over(Window.partitionBy("product_id").orderBy("snapshot_date")))


def classify(snapshots: DataFrame, thresholds: dict[str, float] = THRESHOLDS) -> DataFrame:
    """Adds action and suggested_price to snapshots with prev_median; the first action that fires, null for none."""
    t = thresholds
    own, median, low, prev = (F.col(c).cast("double") for c in ("own_price", "median_price", "min_price", "prev_median"))
    known = own.isNotNull() & median.isNotNull() & low.isNotNull()
    action = (
        F.when((prev > 0) & (F.abs(median - prev) / prev >= t["move"]), "investigate")
        .when(known & (low > 0) & ((low - own) / low >= t["raise_gap"]), "raise")
        .when(known & (median > 0) & ((own - median) / median >= t["drop_gap"]) & (F.col("competitor_count") >= t["drop_stores"]), "drop")
        .when(known & (median > 0) & (F.abs(own - median) / median <= t["hold_gap"]), "hold")
    )
    price = F.when(F.col("action") == "raise", F.bround(F.col("min_price") * F.lit("0.99").cast("decimal(3,2)"), 2)).when(F.col("action") == "drop", F.bround("median_price", 2)).otherwise(F.col("own_price"))
    return snapshots.withColumn("action", action).withColumn("suggested_price", price.cast("decimal(10,2)"))


def rationale() -> F.Column:
    """Sentence for a classified snapshot."""
    own, median, low, prev = (F.col(c).cast("double") for c in ("own_price", "median_price", "min_price", "prev_median"))
    text = lambda c: F.col(c).cast("string")
    return (
        F.when(F.col("action") == "raise", F.format_string("Ours is %.1f%% below the next store (%s). The price can rise up to %s EUR.", (low - own) / low * 100, F.col("cheapest_competitor"), text("min_price")))
        .when(F.col("action") == "drop", F.format_string("Ours is %.1f%% above the market median (%s EUR) of %d stores. A lower price is advised.", (own - median) / median * 100, text("median_price"), F.col("competitor_count")))
        .when(F.col("action") == "hold", F.format_string("Ours is within %.1f%% of the market median (%s EUR). No change is needed.", F.abs(own - median) / median * 100, text("median_price")))
        .when(F.col("action") == "investigate", F.format_string("The market median moved by %.1f%% (from %s to %s EUR). Look into the stores' prices.", F.abs(median - prev) / prev * 100, text("prev_median"), text("median_price")))
    )


def recommend(snapshots: DataFrame, date: str | None = None) -> DataFrame:
    """Pending recommendations of the snapshots (of one date, or all) that have an action."""
    rows = classify(previous_snapshot(snapshots)).where("action IS NOT NULL")
    if date:
        rows = rows.where(F.col("snapshot_date") == F.lit(date).cast("date"))
    return rows.select("product_id", "snapshot_date", F.col("action").alias("playbook"), F.col("own_price").alias("current_price"), "suggested_price", rationale().alias("rationale"), F.lit("pending").alias("status"))


def alerts(recs: DataFrame, products: DataFrame, snapshots: DataFrame, date: str, actions: tuple[str, ...] = ("investigate",)) -> DataFrame:
    p = products.select(F.col("id").alias("product_id"), "sku", "title")
    s = snapshots.select("product_id", "snapshot_date", "min_price", "median_price")
    rows = recs.where((F.col("status") == "pending") & F.col("playbook").isin(*actions) & (F.col("snapshot_date") == F.lit(date).cast("date")))
    rows = rows.join(p, "product_id", "left").join(s, ["product_id", "snapshot_date"], "left")
    return rows.select(F.coalesce("sku", F.col("product_id").cast("string")).alias("sku"), F.substring("title", 1, 60).alias("title"), "playbook", "current_price", "suggested_price", "min_price", "median_price", "rationale")


def market_position(snapshots: DataFrame) -> DataFrame:
    """Newest snapshot per product as rank r/(n+1) and gap to the median in percent."""
    new = Window.partitionBy("product_id").orderBy(F.desc("snapshot_date"))
    rows = snapshots.withColumn("__n", F.row_number().over(new)).where("__n = 1")
    gap = F.bround((F.col("own_price").cast("double") - F.col("median_price").cast("double")) / F.col("median_price").cast("double") * 100, 4)
    return rows.select("product_id", F.concat(F.col("own_rank").cast("string"), F.lit("/"), (F.col("competitor_count") + 1).cast("string")).alias("position"), gap.alias("gap_pct"))


def price_history(snapshots: DataFrame, as_of: str, days: int = 30) -> DataFrame:
    day = F.lit(as_of).cast("date")
    return snapshots.where(F.col("snapshot_date").between(F.date_sub(day, days), day)).select("product_id", "snapshot_date", "own_price", "min_price", "median_price", "max_price")


def run_daily(offers: DataFrame, products: DataFrame, history: DataFrame, date: str, own: list[str]) -> tuple[DataFrame, DataFrame]:
    """Snapshot of a date and its recommendations, given earlier snapshots."""
    snap = build_snapshot(offers, products, date, own)
    return snap, recommend(history.where(F.col("snapshot_date") < F.lit(date).cast("date")).unionByName(snap), date)
