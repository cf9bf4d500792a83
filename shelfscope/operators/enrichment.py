"""Barcodes for products that have none, from rows of titles with barcodes: brand, exact title, vectors, verifier, claims, report."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfscope.functions import embed
from shelfscope.functions import normalise as N
from shelfscope.operators import matching as M
from shelfscope.operators.neighbours import knn
from shelfscope.plans.scratch import written
from shelfscope.sources.files import ENRICHMENT, write_enrichment_report

REPORT = list(ENRICHMENT)


def source_rows(rows: DataFrame) -> DataFrame:
    """id, ean, title, price of rows (id, ean, title, price as text) with a barcode and a title; of equal pairs of both the first
    by id."""
    clean = rows.select("id", N.norm_ean(F.col("ean")).alias("ean"), F.trim("title").alias("title"), F.coalesce(F.trim(F.col("price").cast("string")), F.lit("")).alias("price"))
    clean = clean.where("ean IS NOT NULL AND title <> ''")
    first = clean.groupBy("ean", "title").agg(F.min_by(F.struct("id", "price"), "id").alias("r"))
    return first.select("r.id", "ean", "title", "r.price")


def exact_titles(rows: DataFrame, targets: DataFrame, brands: DataFrame) -> DataFrame:
    """row_id, product_id of rows whose normal title exactly one target has, among those of the brand that the title names, if it
    names one (brands: row_id, brand)."""
    t = targets.select(F.col("id").alias("product_id"), N.norm_brand(F.col("brand")).alias("p_brand"), N.norm_title(F.col("title")).alias("t")).where("t <> ''")
    asked = rows.select(F.col("id").alias("row_id"), N.norm_title(F.col("title")).alias("t")).join(brands, "row_id", "left")
    # products of equal title and brand are one row before the join
    per_brand = t.groupBy("t", "p_brand").agg(F.min("product_id").alias("product_id"), F.count("*").alias("n"))
    met = asked.join(per_brand, "t").where("brand IS NULL OR brand = p_brand")
    return met.groupBy("row_id").agg(F.sum("n").alias("n"), F.min("product_id").alias("product_id")).where("n = 1").select("row_id", "product_id")


def shortlists(rows: DataFrame, targets: DataFrame, brands: DataFrame, encode: Callable[[DataFrame], DataFrame] = embed.encoded, k: int = 40) -> DataFrame:
    """row_id, product_id, score, title, p_title, p_mpn, p_brand: the k nearest targets of each title, or those of them that have
    the brand that the title names, if any has. Of equal scores the lowest ids as text come first."""
    none = F.lit(None).cast("string")
    # targets of equal texts have one vector, that of their lowest id as text (head); no more than k of them can be among the k nearest
    texts, text_id = ["brand", "mpn", "ean", "title"], F.col("id").cast("string")
    alike = Window.partitionBy(*texts)
    like = targets.select("id", *texts, F.row_number().over(alike.orderBy(text_id)).alias("place"), F.min(text_id).over(alike).alias("head"))
    like = written(like.where(F.col("place") <= k), "enrich-alike")
    pool = encode(like.where("place = 1").select("id", *texts)).select(F.struct(F.lit("product").alias("side"), text_id.alias("id")).alias("id"), F.lit(1).alias("block"), "vector")
    asked = encode(rows.select(F.struct(F.lit("row").alias("side"), F.col("id").cast("string").alias("id")).alias("id"), F.col("id").alias("row_id"), none.alias("brand"), none.alias("mpn"), none.alias("ean"), "title"))
    asked = written(asked.select("id", "row_id", F.lit(1).alias("block"), "vector"), "enrich-rows")
    near = knn(asked, written(pool, "enrich-pool"), k, None).select("query_id", F.col("pool_id.id").alias("head"), "score")
    # a head unfolds to its targets, if those of better ones are fewer than k
    near = near.join(like.groupBy("head").agg(F.count("*").alias("n")), "head")
    up_to = Window.partitionBy("query_id").orderBy(F.desc("score")).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    near = near.withColumn("better", F.sum("n").over(up_to) - F.sum("n").over(Window.partitionBy("query_id", "score"))).where(F.col("better") < k)
    near = near.join(like.select("head", F.col("id").alias("product_id")), "head")
    first = Window.partitionBy("query_id").orderBy(F.desc("score"), F.col("product_id").cast("string"))
    near = near.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= k)
    near = near.join(asked.select(F.col("id").alias("query_id"), "row_id"), "query_id")
    p = targets.select(F.col("id").alias("product_id"), F.col("title").alias("p_title"), F.col("mpn").alias("p_mpn"), F.col("brand").alias("raw_brand"), N.norm_brand(F.col("brand")).alias("p_brand"))
    met = near.select("row_id", "product_id", "score").join(p, "product_id").join(rows.select(F.col("id").alias("row_id"), "title"), "row_id").join(brands, "row_id", "left")
    return M.restrict_by_brand(met).drop("brand")


def asked_verifier(short: DataFrame, answers: Callable[[pd.Series, pd.Series], pd.Series]) -> DataFrame:
    """row_id, product_id, score, llm_confidence, title, p_title, p_mpn: what a verifier picks from the shortlists, best first."""
    row = F.struct((-F.col("score")).alias("order"), "product_id", "score", F.struct(F.col("raw_brand").alias("brand"), F.col("p_mpn").alias("mpn"), F.lit(None).cast("string").alias("ean"), F.col("p_title").alias("title")).alias("r"))
    lists = short.groupBy("row_id", "title").agg(F.sort_array(F.collect_list(row)).alias("c"))  # k entries at most
    none = F.lit(None).cast("string")
    said = F.struct(none.alias("brand"), none.alias("mpn"), none.alias("ean"), F.col("title").alias("title"))
    cands = lists.select(F.col("row_id").alias("listing_id"), N.match_prompt(said, F.transform("c", lambda c: c["r"])).alias("prompt"), F.transform("c", lambda c: F.struct(c["product_id"].alias("pool_id"), c["score"].alias("score"))).alias("candidates"))
    hits = M.verify(cands, answers).select(F.col("listing_id").alias("row_id"), F.col("pool_id").alias("product_id"), "llm_confidence")
    return hits.join(short, ["row_id", "product_id"])


def enrich(rows: DataFrame, products: DataFrame, encode: Callable[[DataFrame], DataFrame] = embed.encoded, answers: Callable[[pd.Series, pd.Series], pd.Series] | None = None, k: int = 40) -> tuple[DataFrame, DataFrame]:
    """The report of rows (id, ean, title, price), a row each in the columns of REPORT, and the updates (product_id, ean).

    Targets are products with a title and without a barcode. A row takes the one target of its title (of the brand that the
    title names), else its nearest one if that is near, well ahead and has the title's model tokens, else what the verifier
    picks; rows with candidates but no pick are ambiguous, others no_match. All this hangs on the title alone, so a title is asked
    once for all of its rows. Then barcodes claim products, in the order of ids, and a barcode in conflict has no update. Nothing
    is written to products: `matching.apply_eans` does, a dry run ends here.
    """
    rows = written(source_rows(rows), "enrich-source")
    targets = products.where("ean IS NULL AND title IS NOT NULL")
    titles = written(rows.select(F.col("title").alias("id"), "title").distinct(), "enrich-titles")
    brands = written(M.detect_brand(titles, targets), "enrich-brands")
    exact = written(exact_titles(titles, targets, brands), "enrich-exact")
    rest = titles.join(exact.select(F.col("row_id").alias("id")), "id", "left_anti")
    short = written(shortlists(rest, targets, brands, encode, k), "enrich-short")
    strict = written(M.strict_accept(short), "enrich-strict")
    picked = strict.select("row_id", "product_id", "match_type", "confidence")
    if answers is not None:
        open_ = short.join(strict.select("row_id"), "row_id", "left_anti")
        picked = picked.unionByName(M.verified_accept(asked_verifier(open_, answers)))
    found = exact.select("row_id", "product_id", F.lit("exact_title").alias("match_type"), F.lit(1.0).alias("confidence")).unionByName(picked)
    had = short.select("row_id").distinct().withColumn("had", F.lit(True))
    all_ = rows.join(found.withColumnRenamed("row_id", "title"), "title", "left").join(had.withColumnRenamed("row_id", "title"), "title", "left")
    all_ = written(all_, "enrich-found")
    claims = written(M.resolve_claims(all_.select("id", "ean", "product_id")).select("id", "claim", "of_ean"), "enrich-claims")
    p = targets.select(F.col("id").alias("product_id"), "sku", F.col("title").alias("product_title"))
    out = all_.join(claims, "id").join(p, "product_id", "left")
    alone = F.when(F.col("product_id").isNotNull(), "matched").when(F.col("had"), "ambiguous").otherwise("no_match")
    status = F.when(F.col("claim").isin("ok", "none"), alone).otherwise(F.col("claim"))
    text = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    said = lambda c: F.when(F.col("of_ean"), "").otherwise(text(c))
    report = out.select(
        "id",
        status.alias("status"),
        text(F.col("product_id")).alias("product_id"),
        text(F.col("sku")).alias("sku"),
        F.lit("").alias("old_ean"),
        F.col("ean").alias("new_ean"),
        said(F.format_string("%.2f", F.when(F.col("product_id").isNotNull(), F.col("confidence")))).alias("confidence"),
        said(F.col("match_type")).alias("match_type"),
        F.col("title").alias("source_title"),
        text(F.col("product_title")).alias("product_title"),
        F.col("price").alias("source_price"),
    )
    report = report.withColumn("confidence", F.when(F.col("product_id") == "", "").otherwise(F.col("confidence")))
    updates = out.where("claim = 'ok'").select("product_id", "ean").distinct()
    return report, updates


def write_report(report: DataFrame, path: str) -> None:
    """The report as CSV files with a header, in the order of its rows."""
    write_enrichment_report(report.orderBy("id"), path)


def status_counts(report: DataFrame) -> DataFrame:
    return report.groupBy("status", "match_type").agg(F.count("*").alias("n"), F.count_distinct("new_ean").alias("eans"))

