"""Top-k searches against brute force, with bounds, ties, skew and odd rows."""

from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfscope.functions import normalise as N
from shelfscope.operators import matching as M
from shelfscope.operators import neighbours


def nearest(q, p, k, floor):
    want = {}
    for i, b, v in q:
        scored = []
        for j, c, w in p:
            if b is not None and b == c and i != j and len(v) == len(w) and any(v) and any(w):
                s = np.round(np.dot(v, w) / np.linalg.norm(v) / np.linalg.norm(w), 6)
                if floor is None or s >= floor:
                    scored.append((-s, j))
        for rank, (s, j) in enumerate(sorted(scored)[:k], 1):
            want[i, rank] = (j, -s)
    return want


def same(got, want):
    got = {(r["query_id"], r["rank"]): (r["pool_id"], r["score"]) for r in got}
    assert {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in want.items()}
    assert all(abs(got[k][1] - v[1]) < 2e-6 for k, v in want.items())


def rows(rng, n, dim=4):
    """Half of the vectors lie around few centres, a third of all in one block, some are equal, zero or shorter."""
    centres = rng.normal(size=(3, dim))
    out = []
    for i in range(n):
        v = rng.normal(size=dim) if i % 2 else centres[rng.integers(3)] + 0.05 * rng.normal(size=dim)
        v = centres[0] if i % 9 == 0 else np.zeros(dim) if i % 31 == 0 else v[:3] if i % 17 == 0 else v
        out.append((f"r{i:04d}", [None, "a", "b", "c", "c"][min(4, rng.integers(7))], [float(x) for x in v]))
    return out


@pytest.mark.parametrize("floor", [None, 0.9])
@pytest.mark.parametrize("tile", [neighbours.TILE, 16])
def test_knn_equals_brute_force(spark, floor, tile):
    rng = np.random.default_rng(tile)
    q = rows(rng, 400)
    kind = "id string, block string, vector array<double>"
    df = spark.createDataFrame(q, kind)
    same(neighbours.knn(df, df, 4, floor, tile).collect(), nearest(q, q, 4, floor))
    few = [(f"x{i}", "c", v) for i, (_, _, v) in enumerate(rows(rng, 40))]
    same(neighbours.knn(spark.createDataFrame(few, kind), df, 3, floor, tile).collect(), nearest(few, q, 3, floor))


def test_bounds_skip_cells(spark, monkeypatch):
    """Vectors on a circle, many cells: few cells are asked for beside a query's own."""
    asked = []
    real = neighbours.written
    monkeypatch.setattr(neighbours, "written", lambda df, name: (out := real(df, name), asked.append((name, out)))[0])
    n = 4000
    vectors = [(i, 1, [float(np.cos(i / n)), float(np.sin(i / n))]) for i in range(n)]
    df = spark.createDataFrame(vectors, "id long, block long, vector array<double>")
    got = {(r["query_id"], r["rank"]): r["score"] for r in neighbours.knn(df, df, 2, None, 100).collect()}
    assert len(got) == 2 * n and min(got.values()) > 0.999999
    cells = [out.count() for name, out in asked if name == "asked"]
    assert cells[0] == n and cells[1] < 4 * n


def test_knn_of_odd_rows(spark):
    kind = "id long, block string, vector array<double>"
    df = spark.createDataFrame([(1, "a", None), (2, "a", [float("nan"), 1.0]), (3, "a", [float("inf"), 1.0]), (4, "a", [None, 1.0]), (5, "a", [1.0, 1.0]), (6, "a", []), (8, None, [1.0, 1.0]), (7, "a", [2.0, 2.0])], kind)
    got = sorted((r["query_id"], r["pool_id"], r["score"]) for r in neighbours.knn(df, df, 5, None).collect())
    assert got == [(5, 7, 1.0), (7, 5, 1.0)]
    assert neighbours.knn(df.where("false"), df, 5, None).count() == 0 and neighbours.knn(df, df.where("false"), 5, None, 1).count() == 0


def test_a_large_block_in_bounded_memory(spark):
    n = 50_000
    df = spark.range(n).select(F.col("id"), F.lit(1).alias("block"), F.transform(F.sequence(F.lit(0), F.lit(7)), lambda j: F.cos(F.xxhash64("id", j).cast("double"))).alias("vector"))
    some = df.where("id % 50 = 0")
    got = neighbours.knn(some, df, 3, None)
    got = {(r["query_id"], r["rank"]): r["score"] for r in got.collect()}
    v = np.array([r["vector"] for r in df.orderBy("id").collect()])
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    score = v[::50] @ v.T
    score[np.arange(len(score)), np.arange(0, n, 50)] = -2
    want = -np.sort(-score, axis=1)[:, :3]
    assert got == pytest.approx({(50 * i, k + 1): want[i, k] for i in range(len(want)) for k in range(3)}, abs=2e-6)


def shared(listings, products, k):
    words = lambda t: {w for w in N_TOKENS(t) if len(w) >= 3 and not w.isdigit()}
    want = set()
    for i, b, t in listings:
        b = b.upper() if b else None
        found = sorted((-len(words(t) & words(u)), j) for j, c, u in products if (not b or not c or b == c.upper()) and len(words(t) & words(u)) >= 2)
        want |= {(i, j, -n, r) for r, (n, j) in enumerate(found[:k], 1)}
    return want


def N_TOKENS(title):
    return (title or "").lower().split()


@pytest.mark.parametrize("k", [1, 3, 40])
def test_token_candidates_equal_brute_force(spark, k):
    rng = np.random.default_rng(k)
    vocabulary = [f"word{chr(97 + i)}" for i in range(20)]
    p = np.array([1 / (i + 1) for i in range(20)])
    title = lambda: " ".join(rng.choice(vocabulary, rng.integers(0, 9), p=p / p.sum()))
    brand = lambda: [None, "acme", "bolt", "cut"][rng.integers(4)]
    listings = [(1000 + i, brand(), title()) for i in range(150)] + [(2000 + i, "acme", "worda wordb wordc") for i in range(50)] + [(3000, None, None), (3001, "nobody", "worda wordb")]
    products = [(i, brand(), title()) for i in range(200)] + [(500 + i, "acme", "wordc wordb worda") for i in range(60)] + [(999, "bolt", None)]
    kind = "id long, brand string, title string"
    got = M.token_candidates(spark.createDataFrame(listings, kind), spark.createDataFrame(products, kind), k).collect()
    assert {tuple(r) for r in got} == shared(listings, products, k) and len(got) == len({tuple(r) for r in got})


def test_join_rows_of_tokens_stay_flat_when_brands_double(spark):
    """A listing with a brand meets its own brand's products only, before the join."""
    kind = "id long, brand string, title string"
    rows = {}
    for brands in (5, 10):
        listings = [(i, f"brand{i % brands}", "worda wordb wordc wordd") for i in range(10 * brands)]
        products = [(i, f"brand{i % brands}", f"worda wordb wordc wordd word{i}x") for i in range(10 * brands)]
        (_, l), (_, p) = (neighbours._by_tokens(spark.createDataFrame(x, kind), s) for x, s in ((listings, "listing"), (products, "product")))
        lists, asked = neighbours._lists(p), neighbours._asked(l.withColumn("least", F.lit(2)), "1", "2")
        rows[brands] = asked.join(lists, ["bucket", "token"]).count() / l.count()
    assert rows[10] == rows[5]


def test_brands_agree_with_normal_forms(spark):
    one = spark.createDataFrame([(1, " Acme GmbH ", "worda wordb")], "id long, brand string, title string")
    assert defaultdict(int, {r["listing_id"]: r["shared"] for r in M.token_candidates(one, one.withColumn("brand", N.norm_brand(F.col("brand")))).collect()})[1] == 2


def test_rows_leave_a_task_in_small_batches():
    import pyarrow as pa

    from shelfscope.operators import neighbours

    batch = pa.RecordBatch.from_pydict({"x": [10, 11]})
    pick, cell = pa.array([0] * 5 + [1] * 4), pa.array(range(9), pa.int32())
    out = list(neighbours._dealt(batch, pick, cell, 4))
    assert [b.num_rows for b in out] == [4, 4, 1]
    assert pa.Table.from_batches(out).to_pydict() == {"x": [10] * 5 + [11] * 4, "cell": list(range(9))}
