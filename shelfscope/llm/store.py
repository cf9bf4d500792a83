"""Where intermediate tables go: the shared folder that the cluster names in spark.checkpoint.dir."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfscope.plans.scratch import new_path, shared_folder, written  # noqa: F401  used by all operators of this package

#: A word, in every operator of this package: a run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def sorted_files(df: DataFrame, *order: Column) -> DataFrame:
    """df as column r (a struct) with part and index: rows are sorted by `order` into files of the shared folder, part is a
    file's place among them and index a row's place in its file. Expressions of order see the columns of df. Rows that order
    does not tell apart are split between files by where they came from, so no task gets all of them."""
    names = [f"o{i}" for i in range(len(order))]
    rows = df.select(F.struct("*").alias("r"), *(c.alias(n) for c, n in zip(order, names, strict=True)), F.monotonically_increasing_id().alias("from"))
    rows = written(rows, "rows").orderBy(*names, "from").select("r")
    path = new_path(df.sparkSession, "ordered")
    rows.write.option("maxRecordsPerFile", 0).parquet(path)
    files = df.sparkSession.read.schema(rows.schema).parquet(path)
    return files.select("r", F.regexp_extract(F.col("_metadata.file_name"), r"part-(\d+)", 1).cast("int").alias("part"), F.col("_metadata.row_index").alias("index"))


def before_parts(files: DataFrame, **sums: Column) -> tuple[DataFrame, dict[str, int]]:
    """part and, for each of sums, its sum over all files before (a row per file), and the sums over all of them."""
    rows = files.groupBy("part").agg(*(F.sum(c).cast("long").alias(n) for n, c in sums.items())).orderBy("part").collect()
    out, so_far = [], dict.fromkeys(sums, 0)
    for r in rows:
        out.append((r["part"], *so_far.values()))
        so_far = {n: so_far[n] + r[n] for n in sums}
    return files.sparkSession.createDataFrame(out, "part int" + "".join(f", {n} long" for n in sums)), so_far


def n_words(text: str | Column) -> Column:
    """Number of words of a text column; null counts as empty."""
    return F.coalesce(F.regexp_count(F.col(text) if isinstance(text, str) else text, F.lit(WORD)), F.lit(0)).cast("long")


def extended(df: DataFrame, **columns: str) -> T.StructType:
    """df's schema with more columns."""
    out = T.StructType(list(df.schema.fields))
    for name, kind in columns.items():
        out = out.add(name, kind)
    return out


#: Bytes of a batch of texts on its way to a Python worker.
BATCH = 2 << 20


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """What is run inside (not only planned) goes to Python workers in batches of at most about BATCH bytes. Spark's own limit
    is 10 000 rows, of texts some 25 MB, which JVM and worker each hold more than once, for every task."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key, None)
    spark.conf.set(key, str(BATCH))
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def hand_back() -> None:
    """Gives the system the memory that this process has freed, which allocators would keep."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc alone has it
    if trim:
        trim(0)


def leaving_nothing(run: Callable[[Iterator], Iterator], *clear: Callable[[], None]) -> Callable[[Iterator], Iterator]:
    """run for the batches of a task, after which the worker clears what it kept and hands its memory back. Workers live on
    from stage to stage beside the JVM, so what one stage leaves stands in the way of the next."""

    def whole(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            for f in clear:
                f()
            hand_back()

    return whole
