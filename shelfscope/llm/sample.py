"""Bounded samples of labelled rows, for fitting classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def remainder(doc_id: Column, mod: int) -> Column:
    """crc32(doc_id as text) mod `mod`; null for a null id."""
    return F.crc32(doc_id.cast("string")) % mod


def labelled(docs: DataFrame, labels: DataFrame, label: str, fold: Column, per_class: int) -> DataFrame:
    """docs with column y (0 or 1), for at most per_class rows of each label, those with the least hashes of doc_id.

    Only labels of 0 or 1 and rows for which fold holds count. The sample's size is fixed, so its ids are sent to every
    task; the documents are not shuffled.
    """
    known = labels.select(F.col("doc_id").alias("__id"), F.col(label).cast("int").alias("y")).where(F.col("y").isin(0, 1) & F.col("__id").isNotNull())
    known = known.where(fold)
    order = (F.xxhash64("__id"), F.col("__id"))
    some = known.where("y = 0").orderBy(*order).limit(per_class).unionByName(known.where("y = 1").orderBy(*order).limit(per_class))
    return docs.join(F.broadcast(some), docs["doc_id"] == some["__id"]).drop("__id")
