"""Embedding near-dedup with a robust-pruned flat graph.

Vectors are compared only within a label. Equal vectors are one entry. Entries go to the shards of their nearest pivots, so
shards overlap; each shard builds a graph whose adjacency lists are pruned so that they keep near and far directions;
the lists of all shards are united. A search walks greedily from the shard's medoid, and from the entry itself, towards
the query and then widens over neighbours near the threshold. Found pairs are verified in double precision, recall is
audited against brute force on a bounded set of queries, more of them where pairs are sparse, and shards overlap more if it is low. If it is still low at the
largest overlap, all cells of pivots that can hold a pair are compared block against block, which misses nothing.
"""

from __future__ import annotations

import logging

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .store import written

log = logging.getLogger(__name__)

THRESHOLD = 0.93
#: Entries that a shard aims at; above twice CAP it is cut into blocks, and every pair of blocks is a task.
AIM, CAP, PIVOTS = 800, 2048, 256
DEGREE, POOL, FAR, ALPHA = 20, 40, 16, 1.2
#: Nodes within so much below the threshold are walked through.
SLACK = 0.1
#: Queries of the audit, and the recall under which shards overlap twice as much.
AUDIT, RECALL = 200, 0.995
#: True pairs that an audit should meet, and queries that it takes for them at most.
AUDIT_PAIRS, AUDIT_MOST = 50, 12_800
#: Shards that an entry goes to at most; beyond, cells are compared exactly.
WIDEST = 8


def entries(vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All rows (vec_id, key), key null where a vector or its label can't be compared, and the entries (key, block, v, n):
    block holds label and length, n counts the rows that are equal."""
    v = F.col("embedding")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    norm = F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    ok = F.coalesce(F.col("label").isNotNull() & ~bad & (norm > 0), F.lit(False))
    block = F.concat_ws(":", F.col("label").cast("string"), F.size(v).cast("string"))
    key = F.when(ok, F.md5(F.concat_ws("|", block, F.array_join(v, ",")).cast("binary")))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), key.alias("key"), block.alias("block"), v.alias("v"))
    rows = written(rows, "vectors")
    found = rows.where("key is not null").groupBy("key").agg(F.first("block").alias("block"), F.first("v").alias("v"), F.count("*").alias("n"))
    return rows.select("vec_id", "key"), written(found, "entries")


def unit(v: pd.Series) -> np.ndarray:
    x = np.array(v.tolist(), np.float64)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def placed(entry: DataFrame, overlap: int) -> tuple[DataFrame, DataFrame]:
    """The rows (key, block, v, shard, angle), angle being that between an entry and the shard's pivot, and the pivots
    (block, salt, p, p_key). Pivots are the entries with the least hashes, about one for AIM entries and PIVOTS at most;
    entries of a label meet them in groups of about CAP rows. Shards are places in the order of p_key; a label with less
    than two pivots is one shard with angle 0."""
    sizes = entry.groupBy("block").agg(F.count("*").alias("n_block"))
    e = entry.select("key", "block", "v").join(sizes.select(F.col("block").alias("__b"), "n_block"), F.col("block") == F.col("__b")).drop("__b")
    wanted = F.least(F.ceil(F.col("n_block") / AIM), F.lit(PIVOTS))
    hashed = F.pmod(F.xxhash64("key"), F.lit(1 << 31))
    e = e.withColumns({"salts": F.ceil(F.col("n_block") / CAP).cast("int"), "pivot": (wanted > 1) & (hashed * F.col("n_block") < wanted * F.lit(1 << 31))})
    e = written(e, "placed")
    pivots = e.where("pivot").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).select("block", "salt", F.col("v").alias("p"), F.col("key").alias("p_key"))
    own = e.withColumn("salt", F.pmod(F.xxhash64("key", F.lit(1)), F.col("salts")).cast("int")).select("key", F.col("block").alias("own"), "v", F.col("salt").alias("own_salt"))

    def nearest(own: pd.DataFrame, pivots: pd.DataFrame) -> pd.DataFrame:
        own = own.rename(columns={"own": "block"})
        if own.empty or len(pivots) < 2:
            return own.assign(shard=0, angle=0.0)[["key", "block", "v", "shard", "angle"]]
        pivots = pivots.sort_values("p_key")
        k = min(overlap, len(pivots))
        cos = unit(own["v"]) @ unit(pivots["p"]).T
        top = np.argsort(-cos, axis=1, kind="stable")[:, :k]
        angle = np.arccos(np.clip(np.take_along_axis(cos, top, 1), -1, 1))
        return pd.concat([own.assign(shard=top[:, i], angle=angle[:, i])[["key", "block", "v", "shard", "angle"]] for i in range(k)])

    both = own.groupBy("own", "own_salt").cogroup(pivots.groupBy("block", "salt"))
    return written(both.applyInPandas(nearest, f"key string, block string, v {dict(entry.dtypes)['v']}, shard int, angle double"), "shards"), pivots


def assigned(entry: DataFrame, overlap: int) -> DataFrame:
    """key, block, v, shard, i, j: the entries of each shard, those of one that is too large in pairs of blocks."""
    rows, _ = placed(entry, overlap)
    # shards that are still too large: blocks of CAP, in pairs
    size = rows.groupBy("block", "shard").agg(F.count("*").alias("m")).select(F.col("block").alias("__b"), F.col("shard").alias("__s"), F.when(F.col("m") > 2 * CAP, F.ceil(F.col("m") / CAP)).otherwise(1).cast("int").alias("cuts"))
    cut = rows.join(size, (F.col("block") == F.col("__b")) & (F.col("shard") == F.col("__s"))).withColumn("i", F.pmod(F.xxhash64("key", F.lit(2)), F.col("cuts")).cast("int"))
    cut = cut.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)))
    return cut.select("key", "block", "v", "shard", F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j"))


def pruned(x: np.ndarray, seed: int = 1) -> list[np.ndarray]:
    """Adjacency of the rows of x (unit vectors): of the POOL nearest and FAR others, nearest first, one is kept unless a
    kept one is ALPHA times nearer to it than the row is. Edges run both ways."""
    m = len(x)
    if m <= 1:
        return [np.zeros(0, np.int64)] * m
    others = np.random.default_rng(seed).integers(0, m, (m, FAR))
    s = (x @ x.T).astype(np.float32)
    np.fill_diagonal(s, -2)
    k = min(POOL, m - 1)
    heads, tails = [], []
    for lo in range(0, m, 256):
        rows = np.arange(lo, min(m, lo + 256))
        each = np.arange(len(rows))
        pool = np.sort(np.concatenate([np.argpartition(-s[rows], k - 1, axis=1)[:, :k], others[rows]], 1), 1)
        alive = pool != rows[:, None]
        alive[:, 1:] &= pool[:, 1:] != pool[:, :-1]
        order = np.argsort(np.where(alive, -s[rows[:, None], pool], np.inf), axis=1, kind="stable")
        pool, alive = np.take_along_axis(pool, order, 1), np.take_along_axis(alive, order, 1)
        far = np.sqrt(np.maximum(2 - 2 * s[rows[:, None], pool], 0))
        between = np.sqrt(np.maximum(2 - 2 * s[pool[:, :, None], pool[:, None, :]], 0))
        for _ in range(DEGREE):
            c = alive.argmax(1)
            has = alive[each, c]
            if not has.any():
                break
            heads.append(rows[has])
            tails.append(pool[each, c][has])
            alive &= ALPHA * between[each, c] > far
            alive[each, c] = False
    a, b = np.divmod(np.unique(np.concatenate(heads + tails) * m + np.concatenate(tails + heads)), m)
    return np.split(b, np.cumsum(np.bincount(a, minlength=m))[:-1])


def found(x: np.ndarray, q: int, graph: list[np.ndarray], medoid: int, threshold: float) -> np.ndarray:
    """Rows of x within the threshold of row q that the walk reaches."""
    at, best = medoid, float(x[medoid] @ x[q])
    while len(graph[at]):
        s = x[graph[at]] @ x[q]
        if s.max() <= best:
            break
        at, best = int(graph[at][s.argmax()]), float(s.max())
    seen = np.zeros(len(x), bool)
    front = np.unique([at, q])
    seen[front] = True
    hits = [front]
    while len(front):
        step = np.unique(np.concatenate([graph[i] for i in front]))
        step = step[~seen[step]]
        seen[step] = True
        front = step[x[step] @ x[q] >= threshold - SLACK]
        hits.append(front)
    all_ = np.concatenate(hits)
    all_ = all_[all_ != q]
    return all_[x[all_] @ x[q] >= threshold]


def search(cells: DataFrame, threshold: float) -> DataFrame:
    """Verified pairs (a, b) of keys, a < b."""
    by = ("block", "shard", "i", "j")
    # lists hold short codes of keys; if two keys share one, lists hold a neighbour too many, and pairs are verified
    cells = cells.withColumn("code", F.xxhash64("key"))

    def build(cell: pd.DataFrame) -> pd.DataFrame:
        cell = cell.drop_duplicates("key").sort_values("key")
        codes = cell["code"].to_numpy()
        return pd.DataFrame({"code": codes, "near": [codes[h] for h in pruned(unit(cell["v"]))]})

    lists = cells.groupBy(*by).applyInPandas(build, "code long, near array<long>")
    lists = lists.groupBy("code").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near"))
    lists = written(lists.select(F.col("code").alias("__code"), "near"), "graph")

    def walk(cell: pd.DataFrame) -> pd.DataFrame:
        cell = cell.drop_duplicates("key").sort_values("key").reset_index(drop=True)
        keys, codes, x = cell["key"].to_numpy(), cell["code"].to_numpy(), unit(cell["v"])
        order = np.argsort(codes, kind="stable")
        sorted_codes = codes[order]
        graph = []
        for near in cell["near"]:
            at = np.minimum(np.searchsorted(sorted_codes, near), len(codes) - 1) if len(near) else np.zeros(0, np.int64)
            graph.append(np.sort(order[at[sorted_codes[at] == near]]))
        medoid = int((x @ x.mean(0)).argmax())
        pairs = set()
        for q in range(len(x)):
            pairs.update((min(q, r), max(q, r)) for r in found(x, q, graph, medoid, threshold).tolist())
        pairs = np.array(sorted(pairs), np.int64).reshape(-1, 2)
        return pd.DataFrame({"a": keys[pairs[:, 0]], "b": keys[pairs[:, 1]]})

    whole = cells.join(lists, cells["code"] == lists["__code"]).select("key", "code", "block", "v", "near", *by[1:])
    return written(whole.groupBy(*by).applyInPandas(walk, "a string, b string").distinct(), "pairs")


def exact(entry: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """others (a, others: rows of the other entries within the threshold) and links (a, b), which connect what pairs connect.

    Entries lie in the cell of their nearest pivot. Angles obey the triangle inequality, so two cells can hold a pair only
    if their pivots are no further apart than the threshold's angle and both radii; all such cells are compared, in blocks
    of about CAP. A comparison gives a row per entry, not per pair: counts add up, and its groups become stars.
    """
    rows, pivots = placed(entry, 1)
    n = entry.select(F.col("key").alias("__n"), "n")
    rows = rows.join(n, rows["key"] == n["__n"]).drop("__n")
    size = written(rows.groupBy("block", "shard").agg(F.count("*").alias("m"), F.max("angle").alias("far")), "cells")
    reach = float(np.arccos(threshold)) + 1e-6

    def meeting(pivots: pd.DataFrame, size: pd.DataFrame) -> pd.DataFrame:
        size = size.sort_values("shard")
        shard, far, cuts = size["shard"].to_numpy(), size["far"].to_numpy(), -(-size["m"].to_numpy() // CAP)
        if len(pivots) > 1 and len(size):
            p = unit(pivots.sort_values("p_key")["p"])[shard]
            i, j = np.nonzero(np.triu(np.arccos(np.clip(p @ p.T, -1, 1)) <= reach + far[:, None] + far[None, :]))
        else:
            i = j = np.arange(len(size))
        return pd.DataFrame({"block": size["block"].iloc[0] if len(size) else None, "i": shard[i], "j": shard[j], "i_cuts": cuts[i], "j_cuts": cuts[j]})

    both = pivots.where("salt = 0").groupBy("block").cogroup(size.groupBy("block"))
    met = both.applyInPandas(meeting, "block string, i int, j int, i_cuts int, j_cuts int")
    met = met.withColumn("i_cut", F.explode(F.sequence(F.lit(0), F.col("i_cuts") - 1))).withColumn("j_cut", F.explode(F.sequence(F.lit(0), F.col("j_cuts") - 1)))
    met = written(met.where("i < j OR i_cut <= j_cut").select(F.col("block").alias("__b"), "i", "i_cut", "j", "j_cut"), "meeting")
    cuts = size.select(F.col("block").alias("__cb"), F.col("shard").alias("__cs"), F.ceil(F.col("m") / CAP).alias("cuts"))
    rows = rows.join(cuts, (F.col("block") == F.col("__cb")) & (F.col("shard") == F.col("__cs")))
    rows = written(rows.withColumn("cut", F.pmod(F.xxhash64("key", F.lit(2)), F.col("cuts")).cast("int")).select("key", "block", "v", "n", "shard", "cut"), "cut")
    by = ("block", "i", "i_cut", "j", "j_cut")
    at = lambda x: rows.join(met, (F.col("block") == F.col("__b")) & (F.col("shard") == F.col(x)) & (F.col("cut") == F.col(f"{x}_cut"))).select("key", "v", "n", *by, F.lit(x).alias("side"))
    sides = at("i").unionByName(at("j").where("i <> j OR i_cut <> j_cut"))

    def compare(cell: pd.DataFrame) -> pd.DataFrame:
        cell = cell.sort_values("key")
        left, right = cell[cell["side"] == "i"], cell[cell["side"] == "j"]
        own = bool(cell["i"].iloc[0] == cell["j"].iloc[0] and cell["i_cut"].iloc[0] == cell["j_cut"].iloc[0])
        right = left if own else right
        if left.empty or right.empty:
            return pd.DataFrame({"a": [], "others": [], "top": []})
        x, y = unit(left["v"]), unit(right["v"])
        hit = np.concatenate([x[k : k + 256] @ y.T >= threshold for k in range(0, len(x), 256)])
        if own:
            np.fill_diagonal(hit, False)
        l_key, r_key = left["key"].to_numpy(), right["key"].to_numpy()
        l_top, r_top = np.full(len(x), -1), np.full(len(y), -1)
        for root in np.flatnonzero(hit.any(1)):
            front = np.array([root]) if l_top[root] < 0 else np.zeros(0, int)
            l_top[front] = root
            while len(front):
                far = np.flatnonzero(hit[front].any(0) & (r_top < 0))
                r_top[far] = root
                front = np.flatnonzero(hit[:, far].any(1) & (l_top < 0))
                l_top[front] = root
        l_n, r_n = (np.concatenate([hit[k : k + 256] @ right["n"].to_numpy() for k in range(0, len(x), 256)]), np.zeros(len(y), int) if own else left["n"].to_numpy() @ hit)
        l, r = l_top >= 0, r_top >= 0  # noqa: E741
        return pd.DataFrame({"a": np.concatenate([l_key[l], r_key[r]]), "others": np.concatenate([l_n[l], r_n[r]]), "top": l_key[np.concatenate([l_top[l], r_top[r]])]})

    found = written(sides.groupBy(*by).applyInPandas(compare, "a string, others long, top string"), "compared")
    return written(found.groupBy("a").agg(F.sum("others").alias("others")), "others"), found.select("a", F.col("top").alias("b")).where("a <> b").distinct()


def truth(entry: DataFrame, threshold: float, queries: int) -> DataFrame:
    """Pairs (q, other, n: the rows of other) of at most `queries` entries q, those with the least hashes, by brute force:
    every entry is held against the queries of its label."""
    some = entry.select("key", "block", "v").orderBy(F.xxhash64("key", F.lit(3)), "key").limit(queries).toPandas()
    by = {b: (g["key"].to_numpy(), unit(g["v"])) for b, g in some.groupby("block")}

    def against(batches):
        for batch in batches:
            for block, own in batch.groupby("block"):
                if block in by:
                    keys, q = by[block]
                    i, j = np.nonzero(unit(own["v"]) @ q.T >= threshold)
                    yield pd.DataFrame({"q": keys[j], "other": own["key"].to_numpy()[i], "n": own["n"].to_numpy()[i]})

    return entry.select("key", "block", "v", "n").mapInPandas(against, "q string, other string, n long").where("q <> other")


def recall(entry: DataFrame, pairs: DataFrame, threshold: float = THRESHOLD, queries: int = AUDIT, most: int = AUDIT_MOST) -> tuple[float | None, int]:
    """Share of the true pairs of the audited entries that were found, and how many true pairs there were.

    Where pairs are sparse, few entries have any, and none says nothing about recall: four times as many entries are audited
    until AUDIT_PAIRS true pairs are met, all entries are audited or `most` are. Without any true pair the share is None if
    entries are left that were not audited, else 1."""
    total = entry.count()
    while True:
        true = truth(entry, threshold, queries).select(F.least("q", "other").alias("a"), F.greatest("q", "other").alias("b")).distinct()
        got = true.join(pairs.select(F.col("a").alias("x"), F.col("b").alias("y")), (F.col("a") == F.col("x")) & (F.col("b") == F.col("y")), "left")
        n, hit = got.agg(F.count("*"), F.count("x")).first()
        if n >= AUDIT_PAIRS or queries >= min(total, most):
            return (hit / n if n else 1.0 if queries >= total else None), n
        queries = min(4 * queries, most)


def counted(entry: DataFrame, others: DataFrame, threshold: float = THRESHOLD, queries: int = AUDIT) -> float:
    """Share of the rows near the audited entries that others counts; 1 if there are none."""
    true = truth(entry, threshold, queries).groupBy("q").agg(F.sum("n").alias("n"))
    got = true.join(others, true["q"] == others["a"], "left").agg(F.sum("n"), F.sum(F.least("n", F.coalesce("others", F.lit(0))))).first()
    return got[1] / got[0] if got[0] else 1.0


def deduped(vectors: DataFrame, threshold: float = THRESHOLD, overlap: int = 2) -> DataFrame:
    """vec_id, n_links, component_id and kept for every row.

    Vectors that are null, zero or hold null or non-finite components, and those with a null label, link with nothing.
    Lengths of vectors may differ; only equal lengths are compared. Equal vectors link. A component's id is its least
    vec_id that is not null; rows with a null vec_id count as links. Other columns are not read; an empty table gives an
    empty one.
    """
    rows, entry = entries(vectors)
    while True:
        pairs = search(assigned(entry, overlap), threshold)
        share, n = recall(entry, pairs, threshold)
        log.info("overlap %d: recall %s over %d pairs", overlap, share, n)
        if share is None:
            log.warning("recall is not measured: no audited vector has a near one")
        enough = share is None or share >= RECALL
        if enough or overlap >= WIDEST:
            break
        overlap *= 2
    if enough:
        n = entry.select(F.col("key").alias("__n"), "n")
        ends = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        degree = ends.join(n, ends["b"] == n["__n"]).groupBy("a").agg(F.sum("n").alias("others"))
    else:
        degree, pairs = exact(entry, threshold)
        share = counted(entry, degree, threshold)
        if share < RECALL:
            raise RuntimeError(f"recall {share:.4f} is below {RECALL} after the exact comparison")
    tops = written(components(pairs), "components")
    low = rows.where("key is not null").groupBy("key").agg(F.min("vec_id").alias("low"), F.count("*").alias("same"))
    known = low.join(degree, low["key"] == degree["a"], "left").join(tops, low["key"] == tops["node"], "left").withColumn("top", F.coalesce("component", "key"))
    ids = known.groupBy("top").agg(F.min("low").alias("component_id")).select(F.greatest("top", "top").alias("__top"), "component_id")
    known = known.join(ids, known["top"] == ids["__top"])
    known = written(known.select(F.col("key").alias("__key"), (F.coalesce("others", F.lit(0)) + F.col("same") - 1).alias("n_links"), "component_id"), "known")
    out = rows.join(known, rows["key"] == known["__key"], "left")
    component = F.when(F.col("key").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))
