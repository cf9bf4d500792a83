"""Top-k searches inside blocks: nearest vectors and products that share title tokens. Both stop early by exact bounds.

Vectors: blocks of more than `tile` vectors are cut into cells around pivots, a sample of their own vectors. A query searches
its own cell first; its k-th score there (or the floor) then rules out every cell whose pivot is too far away: by the triangle
inequality of angles no vector of a cell of radius r can be nearer than angle(query, pivot) - r. What is compared is a matrix
of queries times a matrix of vectors, of which only the best k leave the task: there is no row per pair.

Tokens: inverted lists are keyed by brand and token, and a listing asks for its rarest tokens first. A product that a listing
has not met after r tokens can share only the rest, so once the k-th overlap exceeds that, the frequent tokens are never read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from shelfscope.functions import normalise as N
from shelfscope.plans.scratch import written

#: Vectors of a side that meet in one task.
TILE = 4096
#: Pivots, and large blocks, of a search: tiles grow rather than these.
PIVOTS = 1 << 16
#: Rows of a batch that leaves a task.
STEP = 2048
#: Slack of angle bounds, far above rounding errors and far below differences that matter.
SLACK = 1e-6


def _matrix(vectors: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Unit vectors as rows."""
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    m = flat.reshape(len(vectors), -1)
    return m / np.sqrt((m * m).sum(1, keepdims=True))


def _by_id(table: pa.Table, name: str) -> pa.Table:
    """table in the order of an id column, which may be a struct."""
    flat, todo = {}, [table[name].combine_chunks()]
    while todo:
        x = todo.pop(0)
        todo, flat = (x.flatten() + todo, flat) if pa.types.is_struct(x.type) else (todo, flat | {str(len(flat)): x})
    return table.take(pc.sort_indices(pa.table(flat), sort_keys=[(c, "ascending") for c in flat]))


def _best(q: pa.Table, p: pa.Table, k: int, floor: float | None, schema: pa.Schema, step: int = 512) -> pa.Table:
    """query_id, pool_id, score of the best k of p for each of q; ties go to the lowest pool_id."""
    empty = schema.empty_table()
    if not q.num_rows or not p.num_rows:
        return empty
    p = _by_id(p, "pool_id")
    pool, out = _matrix(p["vector"]), []
    own = pc.index_in(q["query_id"].cast(p["pool_id"].type), p["pool_id"]).to_numpy(zero_copy_only=False) if not pa.types.is_struct(p["pool_id"].type) else _places(q["query_id"], p["pool_id"])
    for at in range(0, q.num_rows, step):
        score = np.round(_matrix(q["vector"].slice(at, step)) @ pool.T, 6)
        mine = own[at : at + step]
        there = np.flatnonzero(~np.isnan(mine.astype(float)))
        score[there, mine[there].astype(int)] = -np.inf
        if floor is not None:
            score[score < floor] = -np.inf
        n = min(k, score.shape[1])
        # all that tie with the n-th are looked at, the lowest ids of them kept
        nth = -np.partition(-score, n - 1, axis=1)[:, n - 1]
        row, col = np.nonzero((score >= nth[:, None]) & (score > -np.inf))
        order = np.lexsort((col, -score[row, col], row))
        row, col = row[order], col[order]
        first = np.searchsorted(row, row)
        keep = np.arange(len(row)) - first < k
        row, col = row[keep], col[keep]
        out.append(pa.Table.from_arrays([q["query_id"].take(pa.array(at + row)), p["pool_id"].take(pa.array(col)), pa.array(score[row, col])], names=schema.names))
    return pa.concat_tables(out).cast(schema) if out else empty


def _places(ids: pa.ChunkedArray, pool: pa.ChunkedArray) -> np.ndarray:
    at = {str(x): i for i, x in enumerate(pool.to_pylist())}
    return np.array([at.get(str(x), np.nan) for x in ids.to_pylist()], float)


def _dealt(batch: pa.RecordBatch, pick: pa.Array, cell: pa.Array, step: int = STEP):
    """The picked rows of a batch with their cells, a few at a time: a query may ask for every cell, so rows grow by their number."""
    for at in range(0, len(pick), step):
        yield pa.RecordBatch.from_arrays([*(c.take(pick.slice(at, step)) for c in batch.columns), cell.slice(at, step)], [*batch.schema.names, "cell"])


def _sides(df: DataFrame, name: str) -> DataFrame:
    """Rows that can have neighbours: of a block, with a vector of finite numbers that is not zero."""
    rows = df.select(F.col("id").alias(name), F.struct(F.col("block").alias("block"), F.size("vector").alias("dim")).alias("block"), F.transform("vector", lambda x: x.cast("double")).alias("vector"))
    length = F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x)
    return rows.where(F.col("block.block").isNotNull() & F.coalesce((length > 0) & (length < float("inf")), F.lit(False)))


def _met(q: DataFrame, p: DataFrame, keys: list[str], k: int, floor: float | None) -> DataFrame:
    """query_id, pool_id, score: the best k of each query among the vectors of equal keys."""
    out = T.StructType([q.schema["query_id"], p.schema["pool_id"], T.StructField("score", T.DoubleType())])
    schema = to_arrow_schema(out)

    def best(left: pa.Table, right: pa.Table) -> pa.Table:
        return _best(left, right, k, floor, schema)

    return q.groupBy(*keys).cogroup(p.groupBy(*keys)).applyInArrow(best, out)


def _ranked(met: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "pool_id")
    return met.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def knn(queries: DataFrame, pool: DataFrame, k: int = 5, floor: float | None = 0.9, tile: int = TILE) -> DataFrame:
    """query_id, pool_id, score, rank: the k nearest pool vectors by cosine (rounded to six digits, at least floor if given) of
    each query in its block (id, block, vector on both sides), itself left out; ties go to the lowest pool id. Ids are unique
    on both sides.

    Null blocks, null or zero vectors and vectors with null or non-finite numbers have no neighbours; vectors of different
    lengths are not compared. Exact at every size: bounds only skip what cannot be among the best k.
    """
    spark = queries.sparkSession
    q, p = _sides(queries, "query_id"), _sides(pool, "pool_id")
    sizes = q.select("block", F.lit(1).alias("q"), F.lit(0).alias("p")).unionByName(p.select("block", F.lit(0).alias("q"), F.lit(1).alias("p")))
    sizes = sizes.groupBy("block").agg(F.sum("q").alias("q"), F.sum("p").alias("p"))
    least, most = F.least("q", "p"), F.greatest("q", "p")
    top, total = sizes.where(least > 0).agg(F.max(most), F.sum(most)).first()
    if top is None or top <= tile:
        return _ranked(_met(q, p, ["block"], k, floor), k)
    tile = max(tile, total // PIVOTS)
    large = sizes.where((least > 0) & (most > tile)).select("block", F.expr(f"cast(ceil(q / {tile}) as int)").alias("q_parts"))
    large = written(large, "large-blocks")  # at most total / tile rows
    small = _met(q.join(F.broadcast(large), "block", "left_anti"), p.join(F.broadcast(large), "block", "left_anti"), ["block"], k, floor)
    q = written(q.join(F.broadcast(large.select("block")), "block"), "large-queries")
    p = p.join(F.broadcast(large.select("block")), "block")
    pivots: dict[tuple, list] = {}
    for r in p.where(F.pmod(F.xxhash64("pool_id", F.lit(7)), F.lit(tile)) == 0).select("block", "vector").collect():  # one in `tile`
        pivots.setdefault(tuple(r["block"]), []).append(r["vector"])
    sent = spark.sparkContext.broadcast({b: (m := np.array(v)) / np.sqrt((m * m).sum(1, keepdims=True)) for b, v in pivots.items()})

    def nearest(batches):
        """Adds cell and its cosine; a block without pivots is one cell."""
        for batch in batches:
            blocks = [tuple(b.values()) for b in batch.column("block").to_pylist()]
            cell, near = np.zeros(len(blocks), np.int32), np.full(len(blocks), -1.0)
            for b in set(blocks):
                rows = np.flatnonzero([x == b for x in blocks])
                if b in sent.value:
                    cos = _matrix(batch.column("vector").take(pa.array(rows))) @ sent.value[b].T
                    cell[rows], near[rows] = cos.argmax(1), cos.max(1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell), pa.array(near)], [*batch.schema.names, "cell", "near"])

    kind = lambda df: ", ".join(f"{c} {t}" for c, t in df.dtypes)
    p = written(p.mapInArrow(nearest, f"{kind(p)}, cell int, near double"), "cells")
    cells = p.groupBy("block", "cell").agg(F.count("*").alias("n"), F.min("near").alias("near")).collect()  # at most the pivots
    radius: dict[tuple, dict[int, float]] = {}
    for r in cells:
        radius.setdefault(tuple(r["block"]), {})[r["cell"]] = float(np.arccos(np.clip(r["near"], -1, 1)))
    reach = spark.sparkContext.broadcast(radius)
    salts = spark.createDataFrame([(tuple(r["block"]), r["cell"], -(-r["n"] // tile)) for r in cells], f"block {dict(p.dtypes)['block']}, cell int, salts int")
    p = p.join(F.broadcast(salts), ["block", "cell"]).withColumn("salt", F.pmod(F.xxhash64("pool_id"), F.col("salts")).cast("int")).drop("salts")

    def asked(df: DataFrame, own: bool) -> DataFrame:
        """A row per query and cell to be searched: its own cell, or the others that may hold a vector as near as `bound`."""

        def run(batches):
            for batch in batches:
                blocks = [tuple(b.values()) for b in batch.column("block").to_pylist()]
                bound = batch.column("bound").to_numpy(zero_copy_only=False)
                rows, cells = [], []
                for b in set(blocks):
                    there = np.flatnonzero([x == b for x in blocks])
                    names = np.array(sorted(reach.value.get(b, {})), np.int64)
                    if b not in sent.value or not len(names):
                        rows.append(there if own and len(names) else there[:0])
                        cells.append(np.zeros(len(rows[-1]), np.int64))
                        continue
                    angle = np.arccos(np.clip(_matrix(batch.column("vector").take(pa.array(there))) @ sent.value[b][names].T, -1, 1))
                    mine = angle.argmin(1)
                    if own:
                        rows.append(there)
                        cells.append(names[mine])
                        continue
                    away = np.maximum(angle - np.array([reach.value[b][c] for c in names.tolist()]), 0)
                    wanted = np.cos(np.maximum(away - SLACK, 0)) + SLACK >= bound[there][:, None]
                    wanted[np.arange(len(there)), mine] = False
                    i, j = np.nonzero(wanted)
                    rows.append(there[i])
                    cells.append(names[j])
                pick = pa.array(np.concatenate(rows) if rows else np.zeros(0, np.int64))
                yield from _dealt(batch, pick, pa.array((np.concatenate(cells) if cells else np.zeros(0)).astype(np.int32)))

        return written(df.mapInArrow(run, f"{kind(df)}, cell int"), "asked")

    def searched(ask: DataFrame) -> DataFrame:
        """Queries of a cell are dealt into parts, each of which meets each part of the cell's vectors."""
        counts = ask.groupBy("block", "cell").agg(F.expr(f"cast(ceil(count(*) / {tile}) as int)").alias("parts"))
        counts = written(counts, "asked-cells")
        side = ask.join(F.broadcast(counts), ["block", "cell"]).join(F.broadcast(salts), ["block", "cell"])
        side = side.withColumn("part", F.pmod(F.xxhash64("query_id"), F.col("parts")).cast("int")).withColumn("salt", F.explode(F.expr("sequence(0, salts - 1)")))
        other = p.join(F.broadcast(counts), ["block", "cell"]).withColumn("part", F.explode(F.expr("sequence(0, parts - 1)")))
        keys = ["block", "cell", "part", "salt"]
        return _met(side.select(*keys, "query_id", "vector"), other.select(*keys, "pool_id", "vector"), keys, k, floor)

    lowest = -2.0 if floor is None else floor
    near = written(_ranked(searched(asked(q.withColumn("bound", F.lit(lowest)), True)), k).drop("rank"), "near")
    bounds = near.groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("score")).otherwise(lowest).alias("bound"))
    rest = q.join(bounds, "query_id", "left").select(*q.columns, F.coalesce("bound", F.lit(lowest)).alias("bound"))
    return _ranked(small.unionByName(near).unionByName(searched(asked(rest, False))), k)


# --- tokens


def _by_tokens(df: DataFrame, side: str) -> tuple[DataFrame, DataFrame]:
    """Rows (id, group) and groups (group, brand, tokens): rows of equal brand and token set are one group."""
    rows = df.select(F.col("id").alias(f"{side}_id"), N.norm_brand(F.col("brand")).alias(f"{side}_brand"), F.sort_array(F.array_distinct(N.title_tokens(F.col("title")))).alias("tokens")).where(F.size("tokens") > 0)
    rows = written(rows.withColumn(f"{side}_group", F.sha2(F.to_json(F.struct(F.col(f"{side}_brand"), "tokens")), 256)), f"{side}_tokens")
    return rows.select(f"{side}_id", f"{side}_group"), rows.select(f"{side}_group", f"{side}_brand", "tokens").dropDuplicates([f"{side}_group"])


def _lists(groups: DataFrame) -> DataFrame:
    """Inverted lists: a product under its brand (none: an empty one) and, for listings without brand, under every brand."""
    under = F.array(F.struct(F.lit(False).alias("any"), F.coalesce("product_brand", F.lit("")).alias("brand")), F.struct(F.lit(True).alias("any"), F.lit("").alias("brand")))
    return groups.select("product_group", F.col("tokens").alias("p_tokens"), F.explode(under).alias("bucket"), "tokens").select("product_group", "p_tokens", "bucket", F.explode("tokens").alias("token"))


def _asked(groups: DataFrame, first: str, last: str) -> DataFrame:
    """The buckets and tokens that listings ask for: places first to last (from 1, both counted) of their tokens."""
    b = F.col("listing_brand")
    named = F.array(F.struct(F.lit(False).alias("any"), b.alias("brand")), F.struct(F.lit(False).alias("any"), F.lit("").alias("brand")))
    under = F.when(b.isNull() | (b == ""), F.array(F.struct(b.isNull().alias("any"), F.lit("").alias("brand")))).otherwise(named)
    rows = groups.select("listing_group", F.col("tokens").alias("l_tokens"), "least", F.explode(under).alias("bucket"), F.expr(f"slice(tokens, {first}, greatest(0, {last} - {first} + 1))").alias("t"))
    return rows.select("listing_group", "l_tokens", "least", "bucket", F.explode("t").alias("token"))


def _overlaps(asked: DataFrame, lists: DataFrame) -> DataFrame:
    """listing_group, product_group, shared: every pair once, at the rarest token that both have."""
    both = asked.join(lists, ["bucket", "token"]).withColumn("same", F.array_intersect("l_tokens", "p_tokens"))
    return both.where((F.col("same")[0] == F.col("token")) & (F.size("same") >= F.col("least"))).select("listing_group", "product_group", F.size("same").cast("long").alias("shared"))


def token_candidates(listings: DataFrame, products: DataFrame, k: int = 40, least: int = 2) -> DataFrame:
    """listing_id, product_id, shared, rank: products that share `least` title tokens with a listing and do not contradict its
    brand; the best k per listing by shared, then the lowest id. Ids are unique on both sides. Rows without tokens have none.

    Listings and products of equal brand and token set are searched once. A listing asks for the rarer half of its tokens
    first; the k-th overlap found, t, leaves only its len - t + 1 rarest tokens to be asked for, as a product without any of
    them shares less than t. Of a group of products no more than its k lowest ids can be among the best k.
    """
    (l_rows, l), (p_rows, p) = _by_tokens(listings, "listing"), _by_tokens(products, "product")  # noqa: E741
    lists = written(_lists(p), "token-lists")
    often = lists.where("bucket.any").groupBy("token").agg(F.count("*").alias("often"))
    order = l.select("listing_group", F.explode("tokens").alias("token")).join(often, "token").groupBy("listing_group").agg(F.sort_array(F.collect_list(F.struct("often", "token"))).alias("o"))
    l = written(l.drop("tokens").join(order, "listing_group").withColumn("tokens", F.col("o.token")).drop("o"), "token-order")  # noqa: E741
    half = "cast(ceil(size(tokens) / 2) as int)"
    first = p_rows.withColumn("place", F.row_number().over(Window.partitionBy("product_group").orderBy("product_id"))).where(F.col("place") <= k).drop("place")
    rank = F.row_number().over(Window.partitionBy("listing_group").orderBy(F.desc("shared"), "product_id"))

    def best(pairs: DataFrame) -> DataFrame:
        return pairs.join(first, "product_group").withColumn("rank", rank).where(F.col("rank") <= k).select("listing_group", "product_id", "shared")

    near = written(best(_overlaps(_asked(l.withColumn("least", F.lit(least)), "1", half), lists)), "token-near")
    bound = near.groupBy("listing_group").agg(F.when(F.count("*") >= k, F.min("shared")).otherwise(F.lit(least)).alias("bound"))
    rest = l.join(bound, "listing_group", "left").withColumn("least", F.greatest(F.coalesce("bound", F.lit(least)), F.lit(least)).cast("int"))
    more = best(_overlaps(_asked(rest, f"{half} + 1", "size(tokens) - least + 1"), lists))
    done = near.unionByName(more).withColumn("rank", rank).where(F.col("rank") <= k)
    return l_rows.join(done, "listing_group").select("listing_id", "product_id", "shared", "rank")
