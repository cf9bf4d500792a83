import datetime as dt
import random
from collections import Counter, defaultdict
from decimal import Decimal as Dec

import pytest
from pyspark.sql import functions as F

from shelfscope.operators import analytics as A
from shelfscope.operators import matching as M
from shelfscope.operators import pricing as R
from shelfscope.operators import search as D
from shelfscope.operators import upsert as U

PRODUCT = "id long, sku string, brand string, mpn string, ean string, title string, price_eur decimal(10,2)"
LISTING = "id string, competitor_id string, url string, brand string, mpn string, ean string, title string, price_eur decimal(10,2), in_stock boolean, scraped_at timestamp"


def products(spark, *rows):
    return spark.createDataFrame([(i, f"S{i}", b, m, e, t, Dec("10.00")) for i, b, m, e, t in rows], PRODUCT)


def listings(spark, *rows):
    return spark.createDataFrame([(i, "s1", f"u{i}", b, m, e, t, Dec("9.00"), True, dt.datetime(2024, 1, 1)) for i, b, m, e, t in rows], LISTING)


def test_layers(spark):
    p = products(spark, (1, "Knipex", "8603180", "4003773025559", "pliers"), (2, "Wera", "123456", None, "driver"), (3, None, "8703250", "4000000000001", "tongs"), (4, "Wera", "123456", None, "driver"))
    ls = listings(
        spark,
        ("ean", "Other", "999", "4003773025559.0", "x"),
        ("code", "knipex gmbh", "86-03-180", None, "x"),
        ("bare", None, "86 03 180", None, "x"),
        ("title", "WERA", None, None, "driver 123456"),
        ("unknown", "Nobody", None, None, "tongs 87-03-250"),
        ("none", "Wera", None, None, "driver"),
    )
    got = {r["listing_id"]: (r["product_id"], r["match_type"], float(r["confidence"])) for r in M.layered_match(ls, p).collect()}
    assert got == {"ean": (1, "exact_ean", 1.0), "code": (1, "exact_mpn", 1.0), "bare": (1, "mpn_no_brand", 0.9), "title": (2, "regex_mpn_title", 0.9), "unknown": (3, "regex_mpn_no_brand", 0.78)}


def test_order_of_input_does_not_matter(spark):
    p = products(spark, *((i, "B", "123456", None, "t") for i in range(9)))
    ls = listings(spark, *((f"l{i}", "B", None, None, "t 123456") for i in range(9)))
    one = M.layered_match(ls, p).orderBy("listing_id").collect()
    assert one == M.layered_match(ls.repartition(7), p.repartition(3)).orderBy("listing_id").collect() and {r["product_id"] for r in one} == {0}


def test_ean_phase_derives_products(spark):
    p = products(spark, (1, "A", "M1", None, "t"))
    ls = listings(spark, ("a", "A", "m-1", "40000001", "x"), ("b", None, None, "40000002", "y"), ("c", "B", None, "40000002", "z"), ("d", None, None, "NOEAN-1", "q"))
    matches, new = M.ean_phase(ls, p)
    got = {r["listing_id"]: r["product_id"] for r in matches.collect()}
    only = new.collect()
    assert set(got) == {"a", "b", "c"} and got["a"] == 1 and got["b"] == got["c"] == only[0]["id"] and only[0]["title"] == "z" and len(only) == 1


def test_review(spark):
    m = spark.createDataFrame([("1", "vector_llm", 0.97, "pending"), ("2", "vector_llm", 0.90, "pending"), ("3", "regex", 0.99, "pending"), ("4", "vector_llm", 0.99, "rejected")], "listing_id string, match_type string, similarity double, status string")
    assert [r["status"] for r in M.auto_approve(m, "2024-01-02").orderBy("listing_id").collect()] == ["approved", "pending", "pending", "rejected"]
    d = spark.createDataFrame([("1", "approved"), ("2", "approved"), ("2", "approved"), ("4", "approved")], "listing_id string, status string")
    done = M.review(m, d, "2024-01-01", "me")
    assert done.where("reviewer = 'me'").count() == 2 and done.count() == 4


def test_claims(spark):
    rows = spark.createDataFrame([(1, "e1", 10), (2, "e2", 10), (3, "e3", 20), (4, "e3", 21), (5, "e4", None)], "id long, ean string, product_id long")
    assert [r["claim"] for r in M.resolve_claims(rows).orderBy("id").collect()] == ["ok", "product_conflict", "duplicate_ean_conflict", "duplicate_ean_conflict", "none"]


def claimed_in_order(rows):
    """The claims of rows (id, ean, product_id), one after the other."""
    left = Counter(e for _, e, _ in rows if e)
    claims, state, seen = {}, {}, defaultdict(list)
    for i, ean, p in sorted(rows):
        if not ean:
            state[i] = "none"
            continue
        state[i] = "none" if p is None else "product_conflict" if claims.get(p, ean) != ean else "ok"
        seen[ean].append((i, p))
        left[ean] -= 1
        if left[ean]:
            continue
        named = {p for i, p in seen[ean] if state[i] == "ok"}
        if len(named) > 1:
            state |= {i: "duplicate_ean_conflict" for i, _ in seen[ean]}
        elif named and claims.get(min(named), ean) != ean:
            state |= {i: "product_conflict" for i, _ in seen[ean]}
        elif named:
            claims[min(named)] = ean
    return state


@pytest.mark.parametrize("eans, items", [(12, 6), (40, 15)])
def test_claims_equal_the_loop(spark, eans, items):
    rng = random.Random(eans)
    rows = [(i, rng.choice([None, *(f"e{k}" for k in range(eans))]), rng.choice([None, *range(items)])) for i in range(80)]
    got = {r["id"]: r["claim"] for r in M.resolve_claims(spark.createDataFrame(rows, "id long, ean string, product_id long")).collect()}
    assert got == claimed_in_order(rows) and (eans == 12 or {"ok", "product_conflict", "duplicate_ean_conflict"} < set(got.values()))


def test_a_held_product_does_not_count(spark):
    """An EAN with the products {held, free} keeps the free one."""
    rows = [(1, "e1", 10), (2, "e2", 10), (3, "e2", 20), (4, "e3", 20), (5, "e3", 30)]
    got = [r["claim"] for r in M.resolve_claims(spark.createDataFrame(rows, "id long, ean string, product_id long")).orderBy("id").collect()]
    assert got == ["ok", "product_conflict", "ok", "product_conflict", "ok"]
    assert [r["claim"] for r in M.resolve_claims(spark.createDataFrame([(1, "e", None)], "id long, ean string, product_id long")).collect()] == ["none"]


def test_barcodes_come_before_part_numbers(spark):
    row = "id long, brand string, mpn string, ean string, title string, price_eur decimal(10,2)"
    products = spark.createDataFrame([(1, "Bosch", "GBH18", "4000000000001", "drill", None)], row)
    listings = spark.createDataFrame([(1, None, "GBH18", "4999999999999", "other drill", None), (2, "Makita", "X77", "4888888888888", "saw", None), (3, "Makita", "X77", None, "saw", None), (4, None, "GBH18", None, "drill", None), (5, None, None, None, "unbranded orphan", None)], row)
    matches, new = M.run_matching(listings, products)
    got = {r["listing_id"]: (r["product_id"], r["match_type"]) for r in matches.collect()}
    born = {r["ean"]: r["id"] for r in new.collect()}
    assert got[1] == (born["4999999999999"], "exact_ean") and got[2] == (born["4888888888888"], "exact_ean")
    assert got[3] == (born["4888888888888"], "exact_mpn"), "a derived product takes part in the layers"
    assert got[4][1] == "mpn_no_brand" and 5 not in got and set(born) == {"4999999999999", "4888888888888"}
    counts = M.run_counts(listings, matches).first().asDict()
    assert counts == {"exact": 3, "regex": 1, "vector_llm": 0, "pending": 0, "skipped": 1}


def test_a_run_never_asks_about_unbranded_or_lonely_listings(spark):
    row = "id long, brand string, mpn string, ean string, title string, price_eur decimal(10,2)"
    products = spark.createDataFrame([(1, None, None, "4003773022022", "known product", None), (2, "Acme", None, None, "Alpha catalogue product", None)], row)
    listings = spark.createDataFrame([(1, None, None, "4003773022022", "no brand, same barcode", None), (2, "Acme", None, None, "Beta competitor listing", None), (3, None, None, None, "no brand", None)], row)

    def never(prompts, candidates):
        raise AssertionError("asked")

    def far(pool):
        return pool.withColumn("vector", F.when(F.col("id.kind") == "product", F.array(F.lit(1.0), F.lit(0.0))).otherwise(F.array(F.lit(0.0), F.lit(1.0))))

    for only in (False, True):
        matches, new = M.run_matching(listings, products, None, far, never, vectors_only=only)
        counts = M.run_counts(listings, matches).first().asDict()
        assert counts == {"exact": int(not only), "regex": 0, "vector_llm": 0, "pending": 0, "skipped": 3 - int(not only)} and new.count() == 0


def test_strict_and_verified(spark):
    c = spark.createDataFrame([(1, 7, 0.95, "cobra 250", "cobra 250", None), (1, 8, 0.80, "cobra 250", "x", None), (2, 7, 0.95, "cobra 180", "cobra 250", None), (3, 7, 0.94, "cobra", "cobra", None), (3, 8, 0.92, "cobra", "cobra", None)], "row_id long, product_id long, score double, title string, p_title string, p_mpn string")
    assert [(r["row_id"], r["product_id"]) for r in M.strict_accept(c).collect()] == [(1, 7)]
    v = c.withColumn("llm_confidence", F.lit(0.81))
    assert {r["row_id"] for r in M.verified_accept(v.where("product_id = 7")).collect()} == {1, 3}


def test_fuzzy_match_with_a_failing_verifier(spark):
    rows = spark.createDataFrame([(i, "B", [1.0, 0.01 * i], "b", None, None, f"t {i}") for i in range(4)], "id long, block string, vector array<double>, brand string, mpn string, ean string, title string")
    got = M.fuzzy_match(rows.where("id = 0"), rows).collect()
    assert len(got) == 1 and got[0]["pool_id"] == 1 and got[0]["status"] == "approved"

    def fails(prompts, candidates):
        raise OSError("no service")

    assert M.fuzzy_match(rows.where("id = 0"), rows, fails).count() == 0


def test_matching_runs(spark):
    row = "id long, brand string, mpn string, ean string, title string, price_eur decimal(10,2)"
    products = spark.createDataFrame([(1, "Knipex", "87", "4003773025559", "cobra", None), (5, "Knipex", None, None, "pliers wrench", None)], row)
    listings = spark.createDataFrame([(1, "Knipex", None, "4003773025559", "a", None), (2, "Knipex", None, None, "b", None), (3, "Knipex", None, None, "c", None), (4, "Knipex", None, None, "d", None), (6, None, None, "4006381333931", "e", None), (7, None, None, None, "f", None)], row)
    vectors = spark.createDataFrame([("product", 1, [0.0, 0.0, 1.0]), ("product", 5, [1.0, 0.0, 0.0]), ("listing", 2, [1.0, 0.1, 0.0]), ("listing", 3, [0.0, 1.0, 0.0]), ("listing", 4, [0.0, 1.0, 0.3])], "kind string, id long, vector array<double>")

    def run(**how):
        matches, new = M.run_matching(listings, products, **how)
        return {r["listing_id"]: (r["product_id"], r["match_type"], r["status"]) for r in matches.collect()}, {r["id"]: r["title"] for r in new.collect()}

    plain, new = run()
    assert plain[1] == (1, "exact_ean", "approved") and set(plain) == {1, 6} and plain[6][1] == "exact_ean" and new == {plain[6][0]: "e"}
    both, new = run(vectors=vectors, answers=M.best_similarity)
    assert both[2] == (5, "vector_llm", "approved") and both[3][0] == both[4][0] not in (1, 5) and both[3][2] == "pending"
    assert new == {both[3][0]: "c", both[6][0]: "e"} and set(both) == {1, 2, 3, 4, 6}
    only, new = run(vectors=vectors, answers=M.best_similarity, vectors_only=True)
    assert set(only) == {2, 3, 4} and new == {both[3][0]: "c"}
    assert run(vectors_only=True) == ({}, {})
    done = spark.createDataFrame([(1, 1)], "listing_id long, product_id long")
    assert set(run(matches=done)[0]) == {6} and set(run(matches=done, force=True)[0]) == {1, 6}
    assert M.pooled(products, listings).where("id.id = 1").count() == 2
    texts = lambda df: df.withColumn("id", F.concat(F.lit("x"), F.col("id").cast("string")))
    of_text = vectors.where("kind = 'product'").withColumn("id", F.col("id").cast("string")).unionByName(texts(vectors.where("kind = 'listing'")))
    got = M.run_matching(texts(listings), products, None, of_text, M.best_similarity)[0].collect()
    found = {r["listing_id"]: r["product_id"] for r in got}
    assert set(found) == {"x1", "x2", "x3", "x4", "x6"} and found["x2"] == 5 and found["x3"] == found["x4"]
    updates = spark.createDataFrame([(1, "40000001"), (5, "50000009"), (5, "40000001")], "product_id long, ean string")
    assert [tuple(r) for r in M.ean_updates(products, updates).collect()] == [(5, "40000001")]


def test_fuzzy_clusters(spark):
    angles = {1: 0.0, 2: 0.2, 3: 0.4, 9: 2.0}
    import math

    rows = spark.createDataFrame([(i, "B", [math.cos(a), math.sin(a)], "b", None, None, f"t {i}") for i, a in angles.items()], "id long, block string, vector array<double>, brand string, mpn string, ean string, title string")
    got = {r["listing_id"]: r["cluster_id"] for r in M.fuzzy_clusters(rows, rows).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 9: 9}
    hits = spark.createDataFrame([(1, 2), (2, 3), (7, 8)], "listing_id long, pool_id long")
    shared = {r["listing_id"]: r["product_id"] for r in M.share_products(hits, spark.createDataFrame([(3, 55)], "listing_id long, product_id long")).collect()}
    assert shared[1] == shared[2] == 55 and shared[7] == shared[8] > 1 << 53 and set(shared) == {1, 2, 7, 8}


SNAP = "product_id long, snapshot_date date, own_price decimal(10,2), competitor_count long, min_price decimal(10,2), median_price decimal(12,3), max_price decimal(10,2), own_rank long, cheapest_competitor string"


@pytest.mark.parametrize(
    ("own", "low", "median", "prev", "n", "want"),
    [("100", "110", "120", None, 3, ("raise", "108.90")), ("120", "90", "100", None, 2, ("drop", "100.00")), ("120", "90", "100", None, 1, None), ("102", "100", "100", None, 1, ("hold", "102.00")), (None, "90", "100", "80", 1, ("investigate", None)), ("110", "105", "100", None, 1, None), (None, "90", "100", None, 1, None)],
)
def test_actions(spark, own, low, median, prev, n, want):
    d = lambda x: Dec(x) if x else None
    rows = [(1, dt.date(2024, 1, 2), d(own), n, d(low), d(median), d(median), 1, "s1")]
    rows += [(1, dt.date(2024, 1, 1), d(own), n, d(low), d(prev), d(prev), 1, "s1")] if prev else []
    got = R.recommend(spark.createDataFrame(rows, SNAP), "2024-01-02").collect()
    assert [(r["playbook"], str(r["suggested_price"]) if r["suggested_price"] is not None else None) for r in got] == ([want] if want else [])
    assert all(r["rationale"] for r in got)


def offers(spark, rows):
    return spark.createDataFrame([(i, k, s, Dec(p)) for i, k, s, p in rows], "product_id long, key string, store string, price decimal(10,2)")


def test_position(spark):
    o = offers(spark, [(1, "E1", "r", "100"), (1, "E1", "x", "80"), (2, "E2", "r", "50"), (2, "E2", "x", "100"), (2, "E2", "own", "1"), (3, "E3", "r", "9"), (4, "E4", "r", "500"), (4, "E4", "x", "100")])
    got = {r["key"]: (r["gap"], r["bucket"], r["outlier"], r["n_rivals"]) for r in A.sku_position(o, "r", ["own"]).collect()}
    assert got == {"E1": (25.0, "E", False, 1), "E2": (-50.0, "A", False, 1), "E3": (None, "M", False, 0), "E4": (400.0, "E", True, 1)}


def test_wins_losses_and_ties_make_all_comparisons(spark):
    o = offers(spark, [(p, str(p), s, str(10 + (p * i) % 3)) for p in range(20) for i, s in enumerate("abc") if (p + i) % 4])
    h = A.head_to_head(o, "a").collect()
    assert h and all(r["ref_cheaper"] + r["rival_cheaper"] + r["same"] == r["overlap"] for r in h)
    total = A.lower_price_rate(o).agg(F.sum("comparisons"), F.sum("wins")).first()
    assert total[1] <= total[0] / 2


def test_filters(spark):
    m = spark.createDataFrame([("t1", "A", 2, 2), ("t2", "B", 0, 2), ("t3", "A", 1, 2)], "title string, brand string, wins long, n_opponents long")
    names = lambda df: sorted(r["title"] for r in df.collect())
    assert names(A.filter_compare(m, "stronger")) == ["t1"] and names(A.filter_compare(m, "weaker")) == ["t2"]
    assert names(A.filter_compare(m, "all", ["A"])) == ["t1", "t3"] and names(A.filter_compare(m, "all", [])) == []
    assert names(A.page(m, ["title"], 2, 2)) == ["t3"]


def test_upsert_fills_identifiers_and_is_idempotent(spark):
    first, second = listings(spark, ("a", None, None, None, "old")), listings(spark, ("a", "B", "M", None, "new"))
    one = U.upsert_listings(first, second)
    assert one.collect() == U.upsert_listings(one, second).collect() and one.first()["brand"] == "B" and one.first()["title"] == "new"
    assert U.upsert_listings(one, first).first()["brand"] == "B"
    blank = first.withColumn("url", F.lit(None).cast("string"))
    assert U.upsert_listings(one, blank).count() == 2


def test_ingest_fills_brands_and_categories_first(spark):
    row = "id long, competitor_id string, url string, brand string, mpn string, ean string, title string, category string, price_eur decimal(10,2), in_stock boolean, scraped_at timestamp"
    at = dt.datetime(2024, 1, 1)
    new = lambda i, b, e, c=None: (i, "s1", f"u{i}", b, None, e, "steel pliers", c, None, True, at)
    target = spark.createDataFrame([new(1, "Wera", "4003773022023"), new(9, "  ", "4003773022024")], row)
    batch = spark.createDataFrame([new(2, None, "4003773022022"), new(3, " ", "4003773022023"), new(4, None, "NOEAN-4003773022022"), new(5, "Own", "4003773022022", "kept"), new(6, None, "4003773022024")], row)
    p = products(spark, (1, "Knipex", None, "4003773022022", "t"))
    out = {r["id"]: (r["brand"], r["category"]) for r in U.ingest_listings(target, batch, p, [("Steel", [r"\bsteel\b"])]).collect()}
    assert out[2] == ("Knipex", "Steel") and out[3] == ("Wera", "Steel") and out[4] == (None, "Steel") and out[5] == ("Own", "kept") and out[6] == (None, "Steel") and len(out) == 7


def test_versions_and_dates(spark, tmp_path):
    root = str(tmp_path / "t")
    U.write_version(spark.range(3), root)
    U.write_version(U.read_version(spark, root).where("id > 0"), root)
    assert U.read_version(spark, root).count() == 2
    path, d = str(tmp_path / "d"), lambda n, day: spark.range(n).withColumn("snapshot_date", F.lit(day).cast("date"))
    U.write_dated(d(3, "2024-01-01"), path)
    U.write_dated(d(2, "2024-01-02"), path)
    U.write_dated(d(1, "2024-01-01"), path)
    assert spark.read.parquet(path).count() == 3


def test_offer_matrix(spark):
    rows = [("e", "t", "a", Dec("5"), None, None, 1), ("e", "t", "a", Dec("4"), Dec("2"), Dec("1"), 2), ("e", None, "b", Dec("9"), None, None, 3), ("e", "t", "c", None, None, None, 4)]
    got = {r["seller"]: (r["total"] and float(r["total"]), r["cheapest"], r["dearest"]) for r in A.offer_matrix(spark.createDataFrame(rows, "ean string, title string, seller string, price_eur decimal(10,2), delivery_eur decimal(10,2), box_price_eur decimal(10,2), position long")).collect()}
    assert got == {"a": (5.0, True, False), "b": (9.0, False, True), "c": (None, False, False)}


def test_review_keeps_earlier_stamps(spark):
    m = spark.createDataFrame([("a", 1, "vector_llm", 0.99, "pending"), ("b", 2, "vector_llm", 0.91, "pending"), ("c", 3, "vector_llm", 0.9, "rejected")], "listing_id string, product_id long, match_type string, similarity double, status string")
    one = M.review(m, spark.createDataFrame([("b", "approved"), ("b", "approved"), ("c", "approved")], "listing_id string, status string"), "2024-01-01", "ann")
    assert one.where("updated").count() == 1
    two = M.auto_approve(one.drop("updated"), "2024-02-02")
    got = {r["listing_id"]: (r["status"], str(r["reviewed_at"])[:10], r["reviewer"], r["updated"]) for r in two.collect()}
    assert got == {"a": ("approved", "2024-02-02", "auto", True), "b": ("approved", "2024-01-01", "ann", False), "c": ("rejected", "None", None, False)}
    assert {r["status"]: r["n"] for r in M.review_counts(two).collect()} == {"approved": 2, "rejected": 1}


def test_gap_of_a_rival_is_seen_from_the_reference(spark):
    rows = spark.createDataFrame([(1, "k", "us", 100.0), (1, "k", "x", 120.0)], "product_id long, key string, store string, price double")
    assert A.head_to_head(rows, "us").first()["median_gap"] == 20.0


def test_matches_of_a_batch_count_once(spark):
    schema = "listing_id string, product_id long, match_type string, confidence double, status string"
    old = spark.createDataFrame([("a", 1, "exact_ean", 1.0, "approved"), ("z", 9, "exact_ean", 1.0, "approved")], schema)
    new = spark.createDataFrame([("a", 5, "mpn_no_brand", 0.9, "approved"), ("a", 4, "exact_mpn", 1.0, "approved")], schema)
    assert sorted((r["listing_id"], r["product_id"]) for r in U.upsert_matches(old, new).collect()) == [("a", 4), ("z", 9)]


def test_a_version_that_is_not_whole_is_not_read(spark, tmp_path):
    root = str(tmp_path / "t")
    with pytest.raises(FileNotFoundError):
        U.read_version(spark, root)
    assert U.write_version(spark.range(3), root) == 1
    (tmp_path / "t" / "v000000002").mkdir()  # a writer that died
    assert U.read_version(spark, root).count() == 3
    assert U.write_version(spark.range(5), root) == 2 and U.read_version(spark, root).count() == 5


def test_search_cascade(spark):
    """Layers in their order: only approved matches, the newest listing, the preferred product of an EAN, words of listings."""
    p = spark.createDataFrame([(1, "A-1", "Bosch", "111 222", "40000001", "Red drill set"), (2, "A-2", "Bosch", "333 444", "40000001", "Red drill set large"), (3, "A-3", None, None, None, "Plain saw")], "id long, sku string, brand string, mpn string, ean string, title string")
    listings = spark.createDataFrame(
        [("l1", "us", "S-9", None, None, None, "Own thing", "2024-01-01"), ("l2", "x", "X-7", None, "555-666", "40000999", "Odd saw blade", "2024-02-01"), ("l3", "x", "X-7", None, None, None, "Odd saw", "2024-03-01"), ("l4", "x", "Y-1", None, None, None, "Never approved words", "2024-03-01")],
        "id string, competitor_id string, competitor_sku string, brand string, mpn string, ean string, title string, scraped_at string",
    )
    matches = spark.createDataFrame([("l1", 1, "approved"), ("l2", 3, "approved"), ("l3", 2, "approved"), ("l4", 3, "pending")], "listing_id string, product_id long, status string")
    asked = [("ean", "40000001"), ("listing_ean", "40000999"), ("sku", "a-2"), ("mpn", "333 444"), ("listing_sku", "x-7"), ("listing_mpn", "555-666"), ("text", "drill red"), ("phrase", "plain saw"), ("listing_text", "blade odd"), ("none", "never words"), ("nothing", "zebra")]
    got = {r["query_id"]: (r["product_id"], r["how"]) for r in D.lookup(spark.createDataFrame(asked, "query_id string, query string"), p, listings, matches, "us").collect()}
    # product 1 has our store's match, so it is the preferred one of the EAN that 1 and 2 share
    assert got == {"ean": (1, "ean"), "listing_ean": (3, "listing_ean"), "sku": (1, "sku"), "mpn": (1, "mpn"), "listing_sku": (1, "listing_sku"), "listing_mpn": (3, "listing_mpn"), "text": (1, "text"), "phrase": (3, "text"), "listing_text": (3, "listing_text")}


def test_listings_that_agree_are_matched_once(spark):
    kind = "id string, brand string, mpn string, ean string, title string"
    products = spark.createDataFrame([(1, "Acme", "AB-1", None, "Acme saw"), (2, "Acme", None, None, "saw AB-12")], "id long, brand string, mpn string, ean string, title string")
    rows = [("a", "acme", "AB 1", None, "x"), ("b", "acme", "AB 1", None, "x"), ("c", "acme", None, "AB 1", "x"), ("d", None, None, None, None), ("e", "a", "cme", None, "x")]
    listings = spark.createDataFrame(rows, kind)
    found = M.identity_matches(listings, products)
    assert found.count() == 1
    assert {(r["listing_id"], r["product_id"], r["match_type"]) for r in M.matches_of(listings, found).collect()} == {("a", 1, "exact_mpn"), ("b", 1, "exact_mpn")}
    assert listings.select(M.identity()).distinct().count() == 4


def test_newest_listings_are_found_before_texts_are_made(spark):
    from shelfscope.plans import fixtures
    from tests.conftest import SMALL

    plan = fixtures.listings(spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()
    below = plan[plan.index("Window") :]
    assert "l_shipdate" in below and "https://" not in below


def test_sure_conflicts_do_not_wait(spark, monkeypatch):
    n, rounds, write = 12, [], M.written
    rows = [(i, f"e{i:02d}", i) for i in range(n)] + [(n + i, f"e{i:02d}", i + 1) for i in range(n)]
    monkeypatch.setattr(M, "written", lambda df, name: rounds.append(name) or write(df, name))
    got = M.resolve_claims(spark.createDataFrame(rows, "id long, ean string, product_id long")).collect()
    assert {r["id"]: r["claim"] for r in got} == claimed_in_order(rows) == dict.fromkeys(range(2 * n), "duplicate_ean_conflict")
    assert rounds.count("claims-ready") == 1


def test_barcodes_of_a_claimed_product_do_not_wait(spark, monkeypatch):
    """Many barcodes of one product take a few rounds, not one each."""
    n, rounds, write = 12, [], M.written
    rows = [(i, f"e{i:02d}", 1) for i in range(n)] + [(n + i, f"e{i:02d}", [1, 2, None][i % 3]) for i in range(0, n, 2)]
    monkeypatch.setattr(M, "written", lambda df, name: rounds.append(name) or write(df, name))
    got = M.resolve_claims(spark.createDataFrame(rows, "id long, ean string, product_id long")).collect()
    assert {r["id"]: r["claim"] for r in got} == claimed_in_order(rows)
    assert rounds.count("claims-ready") <= 3


def test_a_run_makes_its_listings_once(spark, monkeypatch):
    names, write = [], M.written
    monkeypatch.setattr(M, "written", lambda df, name: names.append(name) or write(df, name))
    kind = "brand string, mpn string, ean string, title string, price_eur decimal(10,2)"
    products = spark.createDataFrame([(1, "s", "Acme", "AB-1", None, "saw", None)], f"id long, sku string, {kind}")
    listings = spark.createDataFrame([("a", "acme", "AB1", None, "x", None), ("b", "acme", "AB1", None, "x", None)], f"id string, {kind}")
    have = M.layered_match(listings.where("id = 'a'"), products)
    assert [r["listing_id"] for r in M.run_matching(listings, products, have)[0].collect()] == ["b"]
    assert "run-todo" in names


def test_codes_are_looked_up_in_one_join(spark, monkeypatch):
    from shelfscope.operators import search as D

    plans, write = {}, D.written
    monkeypatch.setattr(D, "written", lambda df, name: plans.setdefault(name, df._jdf.queryExecution().optimizedPlan().toString()) and write(df, name))
    kind = "sku string, brand string, mpn string, ean string, title string"
    products = spark.createDataFrame([(1, "S1", "Acme", "AB-1", "4000000000001", "red saw"), (2, "S2", "Acme", "AB-2", None, "blue saw")], f"id long, {kind}")
    listings = spark.createDataFrame([("l", "s1", "Acme", "CD-9", None, "green axe", None)], "id string, competitor_id string, brand string, mpn string, ean string, title string, scraped_at timestamp")
    matches = spark.createDataFrame([("l", 2, "approved")], "listing_id string, product_id long, status string")
    asked = [("a", "s1"), ("b", "CD 9"), ("c", "4000000000001"), ("d", "saw blue"), ("e", "saw blue"), ("f", "axe"), ("g", "nothing")]
    out = D.lookup(spark.createDataFrame(asked, "query_id string, query string"), products, listings, matches, "s0").collect()
    want = {("a", 1, "sku"), ("b", 2, "listing_mpn"), ("c", 1, "ean"), ("d", 2, "text"), ("e", 2, "text"), ("f", 2, "listing_text")}
    assert {(r["query_id"], r["product_id"], r["how"]) for r in out} == want and len(out) == 6
    assert plans["codes-found"].count("Join ") == 2


def test_newest_of_a_product_and_texts(spark):
    from shelfscope.operators import search as D

    linked = spark.createDataFrame([("a", 1, "t", "1"), ("b", 1, "t", "2"), ("c", 1, "t", None), ("d", 2, "t", "1"), ("e", 1, None, None)], "listing_id string, product_id long, title string, scraped_at string")
    assert {r["listing_id"] for r in D.newest_of(linked, ["title"]).collect()} == {"b", "d", "e"}


def test_words_are_made_only_for_queries_that_are_left(spark, monkeypatch):
    from shelfscope.operators import search as D

    names, words = [], D._with_all_words
    monkeypatch.setattr(D, "_with_all_words", lambda asked, rows, key: names.append(key) or words(asked, rows, key))
    products = spark.createDataFrame([(1, "S1", "Acme", "AB-1", None, "red saw")], "id long, sku string, brand string, mpn string, ean string, title string")
    listings = spark.createDataFrame([("l", "s1", "Acme", None, None, "green axe", None)], "id string, competitor_id string, brand string, mpn string, ean string, title string, scraped_at timestamp")
    matches = spark.createDataFrame([("l", 1, "approved")], "listing_id string, product_id long, status string")
    for query, looked, how in (("s1", [], "sku"), ("saw red", ["product_id"], "text"), ("axe", ["product_id", "listing_id"], "listing_text")):
        del names[:]
        got = D.lookup(spark.createDataFrame([("q", query)], "query_id string, query string"), products, listings, matches, "s0").collect()
        assert [(r["product_id"], r["how"]) for r in got] == [(1, how)] and names == looked


def test_rivals_are_ranked_once_a_product(spark):
    """The newest listing of a store counts, ties go by time and id, and queries of one product have the same rivals."""
    from shelfscope.operators import search as D

    offers = [("a", 1, "s1", 5.0, "2024-01-01"), ("b", 1, "s1", 9.0, "2024-02-01"), ("c", 1, "s2", 9.0, "2024-03-01"), ("d", 1, "s3", 9.0, "2024-03-01"), ("e", 1, "s0", 1.0, "2024-03-01"), ("f", 2, "s1", 3.0, "2024-01-01")]
    offers = spark.createDataFrame(offers, "listing_id string, product_id long, competitor_id string, price_eur double, scraped_at string")
    found = spark.createDataFrame([("x", 1), ("y", 1), ("z", 3)], "query_id string, product_id long")
    out = D.rivals_of(found, offers, ["s0"], 2)
    assert sorted((r["query_id"], r["rank"], r["listing_id"]) for r in out.collect()) == [(q, n, i) for q in "xy" for n, i in ((1, "c"), (2, "d"))]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "query_id" not in plan[plan.index("Window") :].split("\n")[0]
