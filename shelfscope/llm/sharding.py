"""Sharding by a keyed permutation of global row numbers.

Rows get numbers from 0 in a stated order, a Feistel network with cycle walking permutes the numbers, and a row's permuted
number gives its shard (number mod shards) and slot (number div shards). So counts of shards differ by one at most, slots
have no gaps, a shuffle is named by its seed alone, and both ways can be computed: `place_of` says where a row number goes,
`row_at` which row number fills a slot, without any table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import before_parts, sorted_files

SEED = 13
ROUNDS = 6
LOW32 = np.uint64(0xFFFFFFFF)
#: Odd multipliers of the round function, which works modulo 2**32.
FIRST, SECOND, STEP = 0x2C1B3C6D, 0x297A2D39, 0x1E3779B9


def _mixed(x: np.ndarray, key: int) -> np.ndarray:
    """The round function: 32 bits from a half and a key. Needs no inverse."""
    x = (x + np.uint64(key)) & LOW32
    x = ((x ^ (x >> np.uint64(16))) * np.uint64(FIRST)) & LOW32
    x = ((x ^ (x >> np.uint64(15))) * np.uint64(SECOND)) & LOW32
    return x ^ (x >> np.uint64(16))


def keys(seed: int) -> list[int]:
    return [(seed * 0x9E3779B1 + r * STEP) & 0xFFFFFFFF for r in range(1, ROUNDS + 1)]


def halves(n: int) -> tuple[int, int]:
    """Bits of the low and of the high half of the least power of two (4 at least) that holds n numbers."""
    bits = max(2, (n - 1).bit_length())
    return bits // 2, bits - bits // 2


def _feistel(x: np.ndarray, n: int, seed: int, back: bool) -> np.ndarray:
    low, high = halves(n)
    lo, hi = x & np.uint64((1 << low) - 1), x >> np.uint64(low)
    steps = list(enumerate(keys(seed)))
    for r, key in steps[::-1] if back else steps:
        if r % 2:
            lo = lo ^ (_mixed(hi, key) & np.uint64((1 << low) - 1))
        else:
            hi = hi ^ (_mixed(lo, key) & np.uint64((1 << high) - 1))
    return (hi << np.uint64(low)) | lo


def permuted(x: np.ndarray, n: int, seed: int = SEED, back: bool = False) -> np.ndarray:
    """The permutation of 0..n-1 (n up to 2**62) that seed names, or its inverse. Numbers that leave the range walk on along
    their cycle until they are back in it; fewer than half of all numbers are outside, so a walk takes two steps on average."""
    out = _feistel(np.asarray(x, np.uint64), n, seed, back)
    while (away := np.flatnonzero(out >= np.uint64(n))).size:
        out[away] = _feistel(out[away], n, seed, back)
    return out.astype(np.int64)


def place_of(row: np.ndarray, n: int, shards: int, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """Shard and slot of row numbers."""
    p = permuted(row, n, seed)
    return p % shards, p // shards


def row_at(shard: np.ndarray, slot: np.ndarray, n: int, shards: int, seed: int = SEED) -> np.ndarray:
    """Row numbers at slots of shards, for slots that exist."""
    return permuted(np.asarray(slot, np.int64) * shards + np.asarray(shard, np.int64), n, seed, back=True)


def numbered(df: DataFrame, *by: str) -> tuple[DataFrame, int]:
    """df as column r (a struct) with row, its place from 0 in the order of the columns `by` (nulls first), and the number of
    rows. Ties go by a hash of the whole row; rows that are alike are interchangeable, and one that holds a third of all rows
    is split between tasks by where they came from. The rows are sorted into files of the shared folder, and a row's number is
    its index in its file after the rows of the files before: no task numbers more than a file, and a lost executor repeats
    its files only. Columns of map type are no part of the tie. Read narrow columns: the whole row is sorted."""
    plain = [c for c, kind in df.dtypes if "map<" not in kind and kind not in ("variant", "void")]
    files = sorted_files(df, *map(F.col, by), F.xxhash64(*plain))
    parts, n = before_parts(files, before=F.lit(1))
    return files.join(F.broadcast(parts), "part").select("r", (F.col("before") + F.col("index")).alias("row")), n["before"]


def placed(docs: DataFrame, shards: int = 8, seed: int = SEED, by: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """docs with shard (from 0) and slot (gapless from 0 in each shard): the same for any partitioning or order of the rows.

    Null ids come first, repeated rows and ties are rows of their own, texts are not looked at unless they break a tie, an
    empty table gives an empty one, and columns of docs named shard and slot are replaced. Equal texts are not held together:
    counts that differ by one at most leave no room for groups of any size.
    """
    rows, n = numbered(docs.drop("shard", "slot"), *by)

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for row in batches:
            yield pa.array(permuted(row.to_numpy(zero_copy_only=False), n, seed))

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    place = F.arrow_udf(run, "long")(F.col("row"))
    rows = rows.select("r", place.alias("place"))
    return rows.select("r.*", (F.col("place") % shards).cast("int").alias("shard"), F.expr(f"place div {shards}L").alias("slot"))


def write_shards(rows: DataFrame, path: str, block: int = 1 << 20) -> None:
    """Writes placed rows as path/shard=S/block=B, each block the rows of `block` slots in their order."""
    rows = rows.withColumn("block", F.expr(f"slot div {block}L"))
    rows.repartition("shard", "block").sortWithinPartitions("shard", "block", "slot").write.partitionBy("shard", "block").parquet(path)


def read_slots(spark: SparkSession, path: str, shard: int, first: int, last: int, block: int = 1 << 20) -> DataFrame:
    """Slots first to last (exclusive) of one shard; only their blocks are read."""
    rows = spark.read.parquet(path).where((F.col("shard") == shard) & F.col("block").between(first // block, max(first, last - 1) // block))
    return rows.where((F.col("slot") >= first) & (F.col("slot") < last)).drop("block")


def shard_digest(docs: DataFrame, shards: int = 8) -> DataFrame:
    """doc_id, size (bytes of the text plus 1), text_crc32, law, shard, slot and grown_shard (null, as the law is `rows`) of
    all rows. Null texts have size 1 and the check sum of no bytes; other columns are not read."""
    raw = F.coalesce(F.col("text").cast("binary"), F.lit(b""))
    narrow = docs.select(F.col("doc_id"), (F.octet_length(raw) + 1).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"))
    out = placed(narrow, shards)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
