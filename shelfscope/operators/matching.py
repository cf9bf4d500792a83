"""Linking listings to products: layered equi-joins, candidates and verification.

products: id, sku, brand, mpn, ean, title, ... — listings: id, competitor_id, brand, mpn, ean, title, ... Every layer gives
(listing_id, product_id, match_type, confidence); ties go to the highest product id in identifier layers and to the lowest
one where codes are read from titles.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfscope.functions import normalise as N
from shelfscope.operators.neighbours import knn, token_candidates  # noqa: F401  part of matching
from shelfscope.plans.scratch import written

MATCH = ["listing_id", "product_id", "match_type", "confidence"]


def normalised(df: DataFrame) -> DataFrame:
    """Adds nbrand, nmpn and nean."""
    return df.withColumns({"nbrand": N.norm_brand(F.col("brand")), "nmpn": N.norm_mpn(F.col("mpn")), "nean": N.norm_ean(F.col("ean"))})


def _hit(kind: str | Column, confidence: float | Column) -> list[Column]:
    kind = F.lit(kind) if isinstance(kind, str) else kind
    confidence = F.lit(confidence) if isinstance(confidence, float) else confidence
    return [F.col("listing_id"), F.col("product_id"), kind.alias("match_type"), confidence.cast("decimal(3,2)").alias("confidence")]


def _by(listings: DataFrame, products: DataFrame, keys: list[str], kind: str, confidence: float) -> DataFrame:
    one = products.where(" AND ".join(f"{k} IS NOT NULL" for k in keys)).groupBy(*keys).agg(F.max("id").alias("product_id"))
    return listings.withColumnRenamed("id", "listing_id").join(one, keys).select(*_hit(kind, confidence))


def match_ean(listings: DataFrame, products: DataFrame) -> DataFrame:
    return _by(listings, products, ["nean"], "exact_ean", 1.0)


def match_brand_mpn(listings: DataFrame, products: DataFrame) -> DataFrame:
    return _by(listings, products, ["nbrand", "nmpn"], "exact_mpn", 1.0)


def match_mpn(listings: DataFrame, products: DataFrame) -> DataFrame:
    return _by(listings.where("nbrand IS NULL"), products, ["nmpn"], "mpn_no_brand", 0.9)


def with_block(listings: DataFrame, products: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Adds the brand bucket: a listing whose brand has no products, or that has none, meets brandless products."""
    known = products.select(F.col("nbrand").alias("__known")).distinct()
    out = listings.join(known, F.col("nbrand") == F.col("__known"), "left")
    return out.withColumn("block", F.coalesce("__known", F.lit(""))).drop("__known"), products.withColumn("block", F.coalesce("nbrand", F.lit("")))


#: Layers by kind of key: place in the cascade and match type; those of part numbers in titles depend on the brands.
KINDS = {"ean": (1, "exact_ean", 1.0), "brand_mpn": (2, "exact_mpn", 1.0), "mpn": (3, "mpn_no_brand", 0.9), "title_ean": (4, "regex_ean_title", 0.93), "title_mpn": (4, None, None), "own_mpn": (4, None, None)}


def _key(kind: str, code: Column, block: Column | str = "") -> Column:
    return F.struct(F.lit(kind).alias("kind"), (F.lit(block) if isinstance(block, str) else block).alias("block"), code.alias("code"))


def _keys(kind: str, codes: Column, block: Column) -> Column:
    return F.transform(codes, lambda c: _key(kind, c, block))


def _both(brand: Column, mpn: Column) -> Column:
    return F.concat(brand, F.lit("\x01"), mpn)


def _exploded(rows: DataFrame, keys: list[Column], *columns: str) -> DataFrame:
    """columns, kind, block, code per key that has a code."""
    every = F.array_distinct(F.filter(F.concat(*keys), lambda k: k["code"].isNotNull()))
    return rows.select(*columns, F.explode(every).alias("key")).select(*columns, "key.*")


def title_keys(products: DataFrame) -> list[Column]:
    """Keys of a product that listing titles, or a listing's part number in its own title, can hit."""
    b = F.col("block")
    bare = F.when(F.col("nmpn").isNull(), N.mpn_candidates(F.col("title"))).otherwise(F.array().cast("array<string>"))
    return [F.array(_key("title_ean", F.trim("ean"), b), _key("title_mpn", F.col("nmpn"), b)), _keys("own_mpn", F.coalesce(bare, F.array().cast("array<string>")), b)]


def listing_title_keys(listings: DataFrame) -> list[Column]:
    b, none = F.col("block"), F.array().cast("array<string>")
    eans = F.when(N.blank_to_null(F.col("ean")).isNull(), N.ean13_candidates(F.col("title")))
    codes = F.when(F.col("nmpn").isNull(), N.mpn_candidates(F.col("title")))
    return [_keys("title_ean", F.coalesce(eans, none), b), _keys("title_mpn", F.coalesce(codes, none), b), F.array(_key("own_mpn", F.col("nmpn"), b))]


def _exact_keys(listing: bool) -> Column:
    mpn = F.when(F.col("nbrand").isNull(), F.col("nmpn")) if listing else F.col("nmpn")
    return F.array(_key("ean", F.col("nean")), _key("brand_mpn", _both(F.col("nbrand"), F.col("nmpn"))), _key("mpn", mpn))


def _hits(listings: DataFrame, products: DataFrame, l_keys: list[Column], p_keys: list[Column]) -> DataFrame:
    """listing_id, product_id, match_type, confidence, layer by one join of keys. Products of equal kind, block, code and (where
    it decides the confidence) brand are one row before the join: the highest id of identifiers, the lowest of titles."""
    exact = F.col("kind").isin("ean", "brand_mpn", "mpn")
    p = _exploded(products.select("*", F.col("nbrand").alias("p_brand")), p_keys, "id", "p_brand").withColumn("p_brand", F.when(F.col("kind").isin("title_mpn", "own_mpn"), F.col("p_brand")))
    p = p.groupBy("kind", "block", "code", "p_brand").agg(F.min("id").alias("low"), F.max("id").alias("high"))
    p = p.select("kind", "block", "code", "p_brand", F.when(exact, F.col("high")).otherwise(F.col("low")).alias("product_id"))
    l = _exploded(listings.withColumnRenamed("id", "listing_id"), l_keys, "listing_id", "nbrand")  # noqa: E741
    same = F.col("nbrand") == F.col("p_brand")
    kind, sure, layer = (F.create_map(*(x for k, v in KINDS.items() for x in (F.lit(k), F.lit(v[i])))) for i in (1, 2, 0))
    kind, sure, layer = (F.element_at(m, F.col("kind")) for m in (kind, sure, layer))
    of_brand = F.when(same, F.lit(0.9)).when(F.col("nbrand").isNull() | F.col("p_brand").isNull(), F.lit(0.78)).otherwise(F.lit(0.72))
    kind = F.coalesce(kind, F.when(same, F.lit("regex_mpn_title")).otherwise(F.lit("regex_mpn_no_brand")))
    return l.join(p, ["kind", "block", "code"]).select(*_hit(kind, F.coalesce(sure, of_brand)), layer.alias("layer"))


def _best(hits: DataFrame, blocking: bool) -> DataFrame:
    """One hit per listing: that of the first layer (without blocking: the surest), then the surest, then the lowest id."""
    order = ["layer", (-F.col("confidence")).alias("sure")] if blocking else [(-F.col("confidence")).alias("sure"), "layer"]
    best = hits.groupBy("listing_id").agg(F.min_by(F.struct("product_id", "match_type", "confidence"), F.struct(*order, "product_id", "match_type")).alias("m"))
    return best.select("listing_id", "m.product_id", "m.match_type", "m.confidence")


def _blocked(listings: DataFrame, products: DataFrame, blocking: str | None) -> tuple[DataFrame, DataFrame]:
    return with_block(listings, products) if blocking else (listings.withColumn("block", F.lit("")), products.withColumn("block", F.lit("")))


def match_titles(listings: DataFrame, products: DataFrame, blocking: str | None = "brand") -> DataFrame:
    """Codes read from titles: barcodes, part numbers in listing titles, listing part numbers in product titles."""
    l, p = _blocked(listings, products, blocking)  # noqa: E741
    return _best(_hits(l, p, listing_title_keys(l), title_keys(p)), True)


#: What a listing is matched by. Listings that agree in all of it are matched once.
IDENTITY = ["brand", "mpn", "ean", "title"]


def identity() -> Column:
    """Digest of a listing's IDENTITY; lengths part its texts."""
    part = lambda c: F.coalesce(F.concat(F.length(c).cast("string"), F.lit(":"), F.col(c)), F.lit("-"))
    return F.unhex(F.md5(F.concat(*map(part, IDENTITY))))


def identity_matches(listings: DataFrame, products: DataFrame, blocking: str | None = "brand", status: str = "approved") -> DataFrame:
    """who (see identity), product_id, match_type, confidence, status: the match of each distinct IDENTITY of the listings."""
    rows = listings.select(*IDENTITY).distinct().withColumn("id", identity())
    products = products.repartition("id")  # a file of few row groups would be unfolded to keys by one task
    l, p = _blocked(normalised(rows), normalised(products), blocking)  # noqa: E741
    hits = _hits(l, p, [_exact_keys(True), *listing_title_keys(l)], [_exact_keys(False), *title_keys(p)])
    return _best(hits, bool(blocking)).withColumnRenamed("listing_id", "who").withColumn("status", F.lit(status))


def matches_of(listings: DataFrame, found: DataFrame) -> DataFrame:
    """The matches of listings, from those of their identities."""
    return listings.select(F.col("id").alias("listing_id"), identity().alias("who")).join(found, "who").select(*MATCH, "status")


def layered_match(listings: DataFrame, products: DataFrame, blocking: str | None = "brand", status: str = "approved") -> DataFrame:
    """One match per listing. With blocking the first layer that hits wins; without, the highest confidence does. All layers
    are one join: each side is normalised once and exploded into its keys."""
    return matches_of(listings, identity_matches(listings, products, blocking, status))


def unmatched(listings: DataFrame, matches: DataFrame) -> DataFrame:
    return listings.join(matches.select(F.col("listing_id").alias("id")), "id", "left_anti")


def remaining(eans: DataFrame, done: DataFrame, mode: str = "resume") -> DataFrame:
    """EANs still to do: not in done, or with mode skip_found not with a seller there."""
    have = done if mode == "resume" else done.where("seller IS NOT NULL")
    return eans.join(have.select("ean").distinct(), "ean", "left_anti")


def ean_phase(listings: DataFrame, products: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Matches of all listings with an EAN, and the products derived for unknown ones.

    An unknown EAN takes the product of equal brand and part number, if there is one; else its listing with most of these
    two filled (least id first) stands for a new product, whose id is made of the EAN's length and digits, so reruns agree.
    """
    l, p = normalised(listings).where("nean IS NOT NULL"), normalised(products)  # noqa: E741
    filled = F.when(F.col("nbrand").isNotNull(), 1).otherwise(0) + F.when(F.col("nmpn").isNotNull(), 1).otherwise(0)
    row = F.struct("id", "brand", "mpn", "title", "price_eur", "nbrand", "nmpn")
    groups = l.groupBy("nean").agg(F.min_by(row, F.struct(-filled, F.col("id"))).alias("r"))
    known = p.where("nean IS NOT NULL").groupBy("nean").agg(F.max("id").alias("by_ean"))
    by_code = p.where("nbrand IS NOT NULL AND nmpn IS NOT NULL").groupBy(F.col("nbrand").alias("b"), F.col("nmpn").alias("m")).agg(F.max("id").alias("by_code"))
    groups = groups.join(known, "nean", "left").join(by_code, (F.col("r.nbrand") == F.col("b")) & (F.col("r.nmpn") == F.col("m")), "left")
    groups = groups.withColumn("found", F.coalesce("by_ean", "by_code"))
    new = groups.where("found IS NULL").select(
        ((F.length("nean") + 10) * F.lit(10**14) + F.col("nean").cast("long")).alias("id"),
        N.derive_sku(F.col("nean"), F.col("r.nbrand"), F.col("r.nmpn"), F.col("r.title")).alias("sku"),
        F.col("r.brand").alias("brand"),
        F.col("r.mpn").alias("mpn"),
        F.col("nean").alias("ean"),
        F.col("r.title").alias("title"),
        F.col("r.price_eur").alias("price_eur"),
    )
    ids = groups.where("found IS NOT NULL").select("nean", F.col("found").alias("product_id")).unionByName(new.select(F.col("ean").alias("nean"), F.col("id").alias("product_id")))
    matches = l.withColumnRenamed("id", "listing_id").join(ids, "nean").select(*_hit("exact_ean", 1.0), F.lit("approved").alias("status"))
    return matches, new


def match_summary(matches: DataFrame) -> DataFrame:
    t = F.col("match_type")
    kind = F.when(t.contains("exact") | t.contains("ean"), "exact").when(t.startswith("vector") | t.startswith("llm"), F.when(F.col("status") == "pending", "pending").otherwise("vector")).otherwise("regex")
    return matches.groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))


def match_exact_title(rows: DataFrame, products: DataFrame) -> DataFrame:
    """Rows (id, title) whose normal title is that of exactly one product."""
    p = products.select(F.col("id").alias("product_id"), N.norm_title(F.col("title")).alias("t")).groupBy("t").agg(F.min("product_id").alias("product_id"), F.count("*").alias("n")).where("n = 1")
    return rows.select(F.col("id").alias("row_id"), N.norm_title(F.col("title")).alias("t")).join(p, "t").select("row_id", "product_id")


def detect_brand(rows: DataFrame, products: DataFrame) -> DataFrame:
    """row_id, brand where the tokens of a title name exactly one brand. A token belongs to the first brand that has it."""
    b = products.select(N.norm_brand(F.col("brand")).alias("brand")).where("brand IS NOT NULL").distinct()
    tokens = b.select("brand", F.explode(F.split(N.norm_title(F.col("brand")), " ")).alias("token")).where(F.length("token") >= 3)
    tokens = tokens.groupBy("token").agg(F.min("brand").alias("brand"))
    own = rows.select(F.col("id").alias("row_id"), F.explode(F.array_distinct(F.split(N.norm_title(F.col("title")), " "))).alias("token"))
    found = own.join(tokens, "token").groupBy("row_id").agg(F.min("brand").alias("brand"), F.max("brand").alias("other"))
    return found.where("brand = other").select("row_id", "brand")


def restrict_by_brand(candidates: DataFrame) -> DataFrame:
    """Candidates (row_id, brand, p_brand, ...) of the detected brand, or all of a row that has none of it."""
    is_brand = F.coalesce(F.col("brand") == F.col("p_brand"), F.lit(False))
    any_ = F.max(is_brand).over(Window.partitionBy("row_id"))
    return candidates.withColumn("__any", any_).where(is_brand | ~F.col("__any")).drop("__any")


def backfill_brand(incoming: DataFrame, products: DataFrame, listings: DataFrame) -> DataFrame:
    """Fills blank brands of rows with an EAN from products, else from earlier listings, of that EAN."""
    first = lambda df: normalised(df).where("nean IS NOT NULL AND nbrand IS NOT NULL").groupBy("nean").agg(F.min_by("brand", "id").alias("b"))
    rows = incoming.withColumn("nean", N.norm_ean(F.col("ean")))
    rows = rows.join(first(products).withColumnRenamed("b", "b1"), "nean", "left").join(first(listings).withColumnRenamed("b", "b2"), "nean", "left")
    return rows.withColumn("brand", F.coalesce(N.blank_to_null(F.col("brand")), "b1", "b2")).select(*incoming.columns)


def _of_products(products: DataFrame, *more: str) -> DataFrame:
    return products.select(*(F.col(c).alias(f"product_{c}") for c in more), F.col("id").alias("product_id"), "sku", F.col("ean").alias("product_ean"), F.col("title").alias("product_title"), F.col("brand").alias("product_brand"), F.col("price_eur").alias("catalogue_price"))


def _of_listings(listings: DataFrame) -> list[Column]:
    return [F.col("id").alias("listing_id"), F.col("competitor_id"), F.col("brand").alias("listing_brand"), *(F.col(c) for c in ("title", "price_eur", "in_stock", "url", "scraped_at"))]


def matched_offers(matches: DataFrame, products: DataFrame, listings: DataFrame, status: str | None = "approved") -> DataFrame:
    """Matches with the columns of product and listing that market analytics read."""
    m = matches.where(F.col("status") == status) if status else matches
    return m.join(listings.select(*_of_listings(listings)), "listing_id").join(_of_products(products), "product_id")


def identity_offers(found: DataFrame, products: DataFrame, listings: DataFrame, status: str | None = "approved", *more: str) -> DataFrame:
    """The rows of matched_offers, from the matches of identities: these meet the products, then the listings, which are
    shuffled once. more: further columns of products, as product_<name>."""
    m = found.where(F.col("status") == status) if status else found
    rows = listings.select(identity().alias("who"), *_of_listings(listings)).join(m.join(_of_products(products, *more).hint("merge"), "product_id"), "who")
    return rows.drop("who")


def kind_matches(kinds: DataFrame, products: DataFrame) -> DataFrame:
    """part, kind, product_id, match_type, confidence, status of kinds (part, kind and IDENTITY): texts that many listings
    share are matched once for all of them."""
    return kinds.select("part", "kind", identity().alias("who")).join(identity_matches(kinds, products), "who").drop("who")


def of_kind(listings: DataFrame, matches: DataFrame, how: str) -> DataFrame:
    """listings beside the matches of their part and kind. The part alone is the key, so listings that are dealt by part stay
    where they are, and the few kinds of a part are told apart in the join."""
    m = matches.withColumnsRenamed({"part": "__part", "kind": "__kind"}).hint("merge")
    return listings.join(m, (F.col("part") == F.col("__part")) & (F.col("kind") - F.col("__kind") == 0), how).drop("part", "kind", "__part", "__kind")


def kind_matches_of(listings: DataFrame, found: DataFrame) -> DataFrame:
    """The matches of listings (id, part, kind), from those of their kinds."""
    return of_kind(listings.select(F.col("id").alias("listing_id"), "part", "kind"), found, "inner").select(*MATCH, "status")


def kind_offers(found: DataFrame, products: DataFrame, listings: DataFrame, how: str = "inner", status: str = "approved") -> DataFrame:
    """The rows of matched_offers for listings with part and kind, from the matches of kinds: these meet the products, then
    the listings. how: left for rows of unmatched listings too."""
    m = found.where(F.col("status") == status).join(_of_products(products).hint("merge"), "product_id")
    return of_kind(listings.select("part", "kind", *_of_listings(listings)), m, how)


def filter_matches(df: DataFrame, status: str | None = None, min_conf: float | None = None, stores: list[str] | None = None, in_stock: bool = False, brand: str | None = None) -> DataFrame:
    if status is not None:
        df = df.where(F.col("status") == status)
    if min_conf is not None:
        df = df.where(F.col("confidence") >= min_conf)
    if stores is not None:
        df = df.where(F.col("competitor_id").isin(stores))
    if in_stock:
        df = df.where("in_stock")
    return df.where(F.lower("listing_brand").contains(brand.lower())) if brand else df


def peers_of(offers: DataFrame, own: list[str]) -> DataFrame:
    """Per listing of our stores: other listings of its product in other stores."""
    mine = offers.where(F.col("competitor_id").isin(own)).select("product_id", F.col("listing_id").alias("own_listing_id"), F.col("competitor_id").alias("own_store"))
    return mine.join(offers, "product_id").where("listing_id <> own_listing_id AND competitor_id <> own_store")


def preferred_source(products: DataFrame, listings: DataFrame, store: str) -> DataFrame:
    """Products with the title and brand of the store's newest listing of their EAN, else their own."""
    new = normalised(listings.where(F.col("competitor_id") == store)).where("nean IS NOT NULL")
    new = new.groupBy("nean").agg(F.max_by(F.struct("title", "brand"), F.struct("scraped_at", "id")).alias("s"))
    p = products.withColumn("nean", N.norm_ean(F.col("ean"))).join(new, "nean", "left")
    return p.select("id", F.coalesce("s.title", "title").alias("title"), F.coalesce("s.brand", "brand").alias("brand"))


def ean_clusters(listings: DataFrame, own: str) -> DataFrame:
    """Listings that share an EAN, with the title of our store's listing, else of the first."""
    l = normalised(listings).where("nean IS NOT NULL")  # noqa: E741
    return l.groupBy(F.col("nean").alias("ean")).agg(F.min_by("title", F.struct(F.col("competitor_id") != own, F.col("id"))).alias("title"), F.count("*").alias("members"), F.count_distinct("competitor_id").alias("stores"))


# --- fuzzy matching --------------------------------------------------------------------------------------------------


def best_similarity(prompt: pd.Series, candidates: pd.Series) -> pd.Series:
    """Default verifier: the first candidate (they come best first) with its similarity as confidence."""
    return pd.Series([f'{{"match_index": 1, "confidence": {c[0]["score"]:.4f}}}' if len(c) else "" for c in candidates])


def verdicts(candidates: DataFrame, answers: Callable[[pd.Series, pd.Series], pd.Series] = best_similarity, least: float = 0.81, tries: int = 3) -> DataFrame:
    """A row per listing (listing_id, prompt, candidates: array of structs with pool_id and score, best first) asked about:
    listing_id, pool_id, similarity, llm_confidence of the accepted candidate (nulls: none), error and tries.

    answers maps the prompts and candidates of a batch to answer texts. A batch that fails is asked again, `tries` times in
    all; then its rows have the last error and no verdict. Every row is written once, so that no listing is asked about twice.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            said, error, n = pd.Series([None] * len(batch), dtype=object), None, 0
            while n < tries:
                n += 1
                try:
                    got = answers(batch["prompt"], batch["candidates"])
                    if len(got) != len(batch):
                        raise ValueError(f"{len(got)} answers to {len(batch)} prompts")
                    said, error = pd.Series(list(got), dtype=object), None
                    break
                except Exception as e:  # noqa: BLE001  the verifier is the caller's; its failure is a column
                    error = f"{type(e).__name__}: {e}"
            yield pd.DataFrame({"listing_id": batch["listing_id"], "answer": said.values, "error": pd.Series([error] * len(batch), dtype=object), "tries": n})

    kind = candidates.schema["listing_id"].dataType.simpleString()
    said = written(candidates.select("listing_id", "prompt", "candidates").mapInPandas(run, f"listing_id {kind}, answer string, error string, tries int"), "verdicts")
    both = candidates.join(said, "listing_id").withColumn("v", N.parse_verdict(F.col("answer"), F.size("candidates"), least))
    chosen = F.element_at("candidates", F.coalesce("v.match_index", F.lit(1)))
    given = lambda c: F.when(F.col("v").isNotNull(), c)
    return both.select("listing_id", given(chosen["pool_id"]).alias("pool_id"), given(F.bround(chosen["score"], 3)).alias("similarity"), F.col("v.confidence").alias("llm_confidence"), "error", "tries")


def verdict_counts(rows: DataFrame) -> DataFrame:
    """One row: listings asked about, accepted, rejected and failed, and tries beyond the first."""
    ok = F.col("pool_id").isNotNull()
    return rows.agg(F.count("*").alias("asked"), F.count_if(ok).alias("accepted"), F.count_if(~ok & F.col("error").isNull()).alias("rejected"), F.count_if(F.col("error").isNotNull()).alias("failed"), F.coalesce(F.sum(F.col("tries") - 1), F.lit(0)).alias("retries"))


def verify(candidates: DataFrame, answers: Callable[[pd.Series, pd.Series], pd.Series] = best_similarity, least: float = 0.81) -> DataFrame:
    """The accepted candidates of `verdicts`: listing_id, pool_id, similarity, llm_confidence."""
    return verdicts(candidates, answers, least).where("pool_id IS NOT NULL").drop("error", "tries")


def fuzzy_candidates(orphans: DataFrame, pool: DataFrame, k: int = 5, floor: float = 0.9) -> DataFrame:
    """listing_id, prompt, candidates of the orphans that have vector candidates within their brand. orphans and pool: id, block,
    vector, brand, mpn, ean, title."""
    near = knn(orphans, pool, k, floor)
    text = pool.select(F.col("id").alias("pool_id"), F.struct("brand", "mpn", "ean", "title").alias("r"))
    found = near.join(text, "pool_id").groupBy(F.col("query_id").alias("id")).agg(F.sort_array(F.collect_list(F.struct("rank", "pool_id", "score", "r"))).alias("candidates"))
    return orphans.join(found, "id").select(F.col("id").alias("listing_id"), N.match_prompt(F.struct("brand", "mpn", "ean", "title"), F.transform("candidates", lambda c: c["r"])).alias("prompt"), F.transform("candidates", lambda c: F.struct(c["pool_id"].alias("pool_id"), c["score"].alias("score"))).alias("candidates"))


def fuzzy_match(orphans: DataFrame, pool: DataFrame, answers: Callable[[pd.Series, pd.Series], pd.Series] = best_similarity, k: int = 5, floor: float = 0.9, auto: float = 0.96) -> DataFrame:
    """Vector candidates within a brand, verified."""
    hits = verify(fuzzy_candidates(orphans, pool, k, floor), answers)
    return hits.withColumn("match_type", F.lit("vector_llm")).withColumn("status", F.when(F.col("similarity") >= auto, "approved").otherwise("pending"))


def connected(edges: DataFrame) -> DataFrame:
    """node, cluster (its least node) for the ends of edges (a, b). Every round takes the least label among a node and its
    neighbours, then the label of that label, and ends when nothing changes."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both = written(both, "cluster-edges")
    labels, before = both.select(F.col("a").alias("node"), F.col("a").alias("cluster")).distinct(), None
    while True:
        seen = both.join(labels.select(F.col("node").alias("b"), "cluster"), "b").select(F.col("a").alias("node"), "cluster").unionByName(labels)
        low = seen.groupBy("node").agg(F.min("cluster").alias("cluster"))
        up = low.select(F.col("node").alias("cluster"), F.col("cluster").alias("up"))
        labels = written(low.join(up, "cluster").select("node", F.least("cluster", "up").alias("cluster")), "clusters")
        now = labels.agg(F.count("*"), F.sum(F.xxhash64("node", "cluster").cast("decimal(38,0)"))).first()
        if now == before:
            return labels
        before = now


def fuzzy_clusters(orphans: DataFrame, pool: DataFrame, answers: Callable[[pd.Series, pd.Series], pd.Series] = best_similarity, floor: float = 0.85) -> DataFrame:
    """Clusters over the best verified edge of each orphan (listings in the form of fuzzy_match); orphans without one are
    clusters of their own. The result does not depend on the order in which orphans come."""
    edges = fuzzy_match(orphans, pool, answers, floor=floor).select(F.col("listing_id").alias("a"), F.col("pool_id").alias("b"), "status", "similarity")
    labels = connected(edges)
    out = orphans.select(F.col("id").alias("listing_id")).join(labels.withColumnRenamed("node", "listing_id"), "listing_id", "left")
    own = edges.select(F.col("a").alias("listing_id"), "similarity", "status")
    return out.join(own, "listing_id", "left").select("listing_id", F.coalesce("cluster", "listing_id").alias("cluster_id"), "similarity", F.coalesce("status", F.lit("approved")).alias("status"))


def share_products(hits: DataFrame, matches: DataFrame, offset: int = 1 << 53) -> DataFrame:
    """Hits between two unmatched listings (listing_id, pool_id): all of a cluster get one product. A listing of it that is
    matched already keeps its product, and the cluster takes the least of these; else a new id is made of the cluster's."""
    labels = connected(hits.select(F.col("listing_id").alias("a"), F.col("pool_id").alias("b")))
    have = matches.select(F.col("listing_id").alias("node"), "product_id")
    of = labels.join(have, "node", "left")
    new = F.pmod(F.xxhash64("cluster"), F.lit(offset)) + F.lit(offset)
    one = of.groupBy("cluster").agg(F.min("product_id").alias("known"))
    return of.where("product_id IS NULL").join(one, "cluster").select(F.col("node").alias("listing_id"), F.coalesce("known", new).alias("product_id"))


def pooled(products: DataFrame, listings: DataFrame) -> DataFrame:
    """Products and listings as one pool. The id holds the kind and the own id as text, so a product and a listing
    of one id differ; block is the normalised brand."""
    one = lambda df, kind: normalised(df).select(F.struct(F.lit(kind).alias("kind"), F.col("id").cast("string").alias("id")).alias("id"), F.col("nbrand").alias("block"), "brand", "mpn", "ean", "title")
    return one(products, "product").unionByName(one(listings, "listing"))


def run_matching(
    listings: DataFrame,
    products: DataFrame,
    matches: DataFrame | None = None,
    vectors: DataFrame | Callable[[DataFrame], DataFrame] | None = None,
    answers: Callable[[pd.Series, pd.Series], pd.Series] | None = None,
    force: bool = False,
    vectors_only: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """One run over the listings that have no match yet (force: over all): new matches with status and similarity, and new
    products. The phases feed each other.

    Barcodes come first: every listing with an EAN gets the product of it, which is derived if there is none, and derived
    products join the catalogue. Then the layers, over the listings without EAN. (Both are left out with vectors_only.)
    With vectors (kind, id, vector, or a function that adds `vector` to a pool of id, brand, mpn, ean, title) and a verifier,
    listings left that have a brand are held against the products and the other listings of it; a hit between listings gives
    both one product. Listings without EAN that nothing reaches stay without a match.
    """
    none = F.lit(None).cast("double").alias("similarity")
    todo = listings if force or matches is None else written(unmatched(listings, matches), "run-todo")
    columns = ["id", "sku", "brand", "mpn", "ean", "title", "price_eur"]
    if vectors_only:
        found, new = layered_match(todo.limit(0), products.limit(0)), None
    else:
        by_ean, new = ean_phase(todo, products)
        new = written(new.withColumn("id", F.col("id").cast(products.schema["id"].dataType)).select(*columns), "run-derived")
        products = products.unionByName(new.select(*(c for c in columns if c in products.columns)), allowMissingColumns=True)
        found = by_ean.unionByName(layered_match(todo.where(N.norm_ean(F.col("ean")).isNull()), products))
    found = written(found.select(*MATCH, "status", none), "run-layers")
    made = None
    if answers is not None and vectors is not None:
        pool = pooled(products, unmatched(todo, found)).where("block IS NOT NULL")
        if callable(vectors):
            pool = written(vectors(pool), "run-vectors-of-pool")
        else:
            pool = pool.join(vectors.select(F.struct("kind", F.col("id").cast("string").alias("id")).alias("id"), "vector"), "id")
        hits = written(fuzzy_match(pool.where("id.kind = 'listing'"), pool, answers), "run-vectors")
        sure = [F.lit("vector_llm").alias("match_type"), F.col("similarity").cast("decimal(3,2)").alias("confidence"), "status", "similarity"]
        own = lambda end, of, name: F.col(f"{end}.id").cast(of.schema["id"].dataType).alias(name)
        direct = hits.where("pool_id.kind = 'product'").select(own("listing_id", listings, "listing_id"), own("pool_id", products, "product_id"), *sure)
        between = hits.where("pool_id.kind = 'listing'").select(own("listing_id", listings, "listing_id"), own("pool_id", listings, "pool_id"), "similarity", "status")
        ends = between.select("listing_id", "similarity", "status").unionByName(between.select(F.col("pool_id").alias("listing_id"), "similarity", "status"))
        ends = ends.groupBy("listing_id").agg(F.min("similarity").alias("similarity"), F.max("status").alias("status"))  # pending if an edge is
        shared = written(share_products(between, direct).join(ends, "listing_id").select("listing_id", "product_id", *sure), "run-shared")
        found = found.unionByName(direct).unionByName(shared)
        known = products.select(F.col("id").alias("product_id"))
        row = F.struct(*(c for c in ("brand", "mpn", "title", "price_eur")), N.norm_ean(F.col("ean")).alias("ean"), F.col("id"))
        born = shared.join(known, "product_id", "left_anti").join(todo.withColumn("r", row).select(F.col("id").alias("listing_id"), "r"), "listing_id")
        born = born.groupBy("product_id").agg(F.min_by("r", "r.id").alias("r"))
        sku = N.derive_sku(F.col("r.ean"), N.norm_brand(F.col("r.brand")), N.norm_mpn(F.col("r.mpn")), F.col("r.title"))
        made = born.select(F.col("product_id").alias("id"), sku.alias("sku"), "r.brand", "r.mpn", "r.ean", "r.title", "r.price_eur")
    if new is None:
        new = made if made is not None else ean_phase(todo.limit(0), products)[1].select(*columns)
    elif made is not None:
        new = new.unionByName(made)
    return found, new


def run_counts(todo: DataFrame, found: DataFrame) -> DataFrame:
    """One row: how many of the listings of a run each phase has matched, and how many it has skipped."""
    t, vector = F.col("match_type"), F.col("match_type").startswith("vector")
    n = lambda hit: F.count_if(hit)
    sums = found.agg(
        n((t.contains("exact") | t.contains("ean")) & ~vector).alias("exact"),
        n(t.startswith("regex") & ~t.contains("ean") | (t == "mpn_no_brand")).alias("regex"),
        n(vector & (F.col("status") == "approved")).alias("vector_llm"),
        n(vector & (F.col("status") == "pending")).alias("pending"),
        F.count_distinct("listing_id").alias("__matched"),
    )
    return sums.crossJoin(todo.agg(F.count("*").alias("__all"))).withColumn("skipped", F.col("__all") - F.col("__matched")).drop("__matched", "__all")


def strict_accept(candidates: DataFrame, least: float = 0.93, margin: float = 0.05) -> DataFrame:
    """Best candidate (row_id, product_id, score, title, p_title, p_mpn) of a row if it is good, well ahead of the next and
    has all model tokens of the title."""
    order = Window.partitionBy("row_id").orderBy(F.desc("score"), "product_id")
    top = candidates.withColumns({"__n": F.row_number().over(order), "__next": F.lead("score").over(order)}).where("__n = 1")
    top = top.where((F.col("score") >= least) & (F.coalesce(F.col("score") - F.col("__next"), F.lit(1.0)) >= margin))
    return top.where(N.model_tokens_present(F.col("title"), F.col("p_title"), F.col("p_mpn"))).select("row_id", "product_id", F.lit("vector_strict").alias("match_type"), F.col("score").alias("confidence"))


def verified_accept(verdicts: DataFrame, least: float = 0.81, least_score: float = 0.8) -> DataFrame:
    """Verdicts (row_id, product_id, llm_confidence, score, title, p_title, p_mpn) that are sure and near enough."""
    ok = verdicts.where((F.col("llm_confidence") >= least) & (F.col("score") >= least_score))
    return ok.where(N.model_tokens_present(F.col("title"), F.col("p_title"), F.col("p_mpn"))).select("row_id", "product_id", F.lit("vector_llm").alias("match_type"), F.col("llm_confidence").alias("confidence"))


def enrich_eans(rows: DataFrame, products: DataFrame, candidates: DataFrame, verdicts: DataFrame | None = None) -> DataFrame:
    """Product of each identifier row (id, ean, title): exact title, strict vector, verified; else ambiguous or no_match."""
    targets = products.where("ean IS NULL AND title IS NOT NULL")
    layers = [match_exact_title(rows, targets).select("row_id", "product_id", F.lit("exact_title").alias("match_type"), F.lit(1.0).alias("confidence")), strict_accept(candidates)]
    if verdicts is not None:
        layers.append(verified_accept(verdicts))
    found = layers[0].withColumn("layer", F.lit(1))
    for k, x in enumerate(layers[1:], 2):
        found = found.unionByName(x.withColumn("layer", F.lit(k)))
    found = found.groupBy("row_id").agg(F.min_by(F.struct("product_id", "match_type", "confidence"), F.struct("layer", "product_id")).alias("m"))
    had = candidates.select(F.col("row_id").alias("had")).distinct()
    out = rows.join(found, rows["id"] == found["row_id"], "left").join(had, rows["id"] == had["had"], "left")
    kind = F.coalesce("m.match_type", F.when(F.col("had").isNotNull(), "ambiguous").otherwise("no_match"))
    return out.select(rows["id"], rows["ean"], rows["title"], F.col("m.product_id").alias("product_id"), kind.alias("match_type"), F.col("m.confidence").alias("confidence"))


def resolve_claims(matched: DataFrame) -> DataFrame:
    """id, ean, product_id, claim, of_ean of rows (id, ean, product_id) that come in the order of their ids. An EAN is settled at
    its last row and may claim one product; of_ean tells conflicts of a whole EAN from those of a row.

    A row does not count for its EAN (product_conflict) if another EAN settled before it has the product. If the rows that
    count name several products, the EAN is a duplicate_ean_conflict in all its rows; if they name one that another EAN has,
    a product_conflict in all; else it claims that one, and its rows are ok. Rows without a product are none, as are those
    without an EAN, which claim nothing. An EAN depends on earlier ones of its products alone, so each round settles every EAN
    that has no earlier open one beside it on a product without a claim, and every one with two products that no other EAN can take from its rows any more,
    a conflict whatever comes; rounds end with the longest chain of such neighbours among the rest.
    """
    rows = written(matched.select("id", "ean", "product_id"), "claim-rows")
    last = rows.where("ean IS NOT NULL").groupBy(F.col("ean").alias("e")).agg(F.max("id").alias("settled"))
    open_ = rows.where("ean IS NOT NULL AND product_id IS NOT NULL").join(last, F.col("ean") == F.col("e")).select("id", "ean", "product_id", "settled")
    open_, done = written(open_, "claims-open"), None
    kinds = f"product_id {dict(open_.dtypes)['product_id']}, by_ean string, at {dict(open_.dtypes)['id']}"
    claims = rows.sparkSession.createDataFrame([], kinds)
    while open_.take(1):
        first = open_.groupBy("product_id").agg(F.min("settled").alias("first"))
        # a claim stays, so a product that has one is no cause to wait; a row counts for sure if no EAN that has claimed its product,
        # or is open and may, settles before it; two products make a conflict, now or later
        sure = F.when(F.coalesce("at", "first") >= F.col("id"), F.col("product_id"))
        ready = open_.join(first, "product_id").join(claims.select("product_id", "at"), "product_id", "left").groupBy(F.col("ean").alias("e"))
        ready = ready.agg(F.max(F.col("at").isNull() & (F.col("first") < F.col("settled"))).alias("waits"), F.coalesce(F.min(sure) < F.max(sure), F.lit(False)).alias("conflict")).where("NOT waits OR conflict").select("e")
        ready = written(ready, "claims-ready")
        now = open_.join(ready, F.col("ean") == F.col("e")).join(claims, "product_id", "left")
        now = now.withColumn("counts", F.col("at").isNull() | (F.col("at") >= F.col("id")))
        per_ean = now.groupBy("ean").agg(F.count_distinct(F.when(F.col("counts"), F.col("product_id"))).alias("n"), F.min(F.when(F.col("counts"), F.col("product_id"))).alias("p"), F.first("settled").alias("settled"))
        per_ean = per_ean.join(claims.select(F.col("product_id").alias("p"), F.lit(True).alias("taken")), "p", "left")
        kind = F.when(F.col("n") > 1, "duplicate_ean_conflict").when(F.col("taken"), "product_conflict").when(F.col("n") == 1, "ok").otherwise("open")
        per_ean = written(per_ean.select("ean", "p", "settled", kind.alias("kind")), "claims-settled")
        mine = now.select("id", "ean", "counts").join(per_ean.select("ean", "kind"), "ean")
        state = F.when(F.col("kind").isin("ok", "open"), F.when(F.col("counts"), "ok").otherwise("product_conflict")).otherwise(F.col("kind"))
        mine = mine.select("id", "ean", "kind", state.alias("claim"))
        done = written(mine if done is None else done.unionByName(mine), "claims-done")
        # a product that two EANs would claim in one round cannot be: of its open EANs only the first can be ready without a conflict
        claims = written(claims.unionByName(per_ean.where("kind = 'ok'").select(F.col("p").alias("product_id"), F.col("ean").alias("by_ean"), F.col("settled").alias("at"))), "claims")
        open_ = written(open_.join(ready, F.col("ean") == F.col("e"), "left_anti"), "claims-open")
    if done is None:
        return rows.withColumns({"claim": F.lit("none"), "of_ean": F.lit(False)})
    whole = done.where("kind NOT IN ('ok', 'open')").groupBy(F.col("ean").alias("e")).agg(F.first("kind").alias("all_rows"))
    out = rows.join(done.select("id", "claim"), "id", "left").join(whole, F.col("ean") == F.col("e"), "left")
    return out.select("id", "ean", "product_id", F.coalesce("claim", "all_rows", F.lit("none")).alias("claim"), F.col("all_rows").isNotNull().alias("of_ean"))


def ean_updates(products: DataFrame, updates: DataFrame) -> DataFrame:
    """What apply_eans would write (product_id, ean): products without an EAN, the least EAN of each. A dry run ends here."""
    return updates.groupBy("product_id").agg(F.min("ean").alias("ean")).where("ean IS NOT NULL").join(products.where("ean IS NULL").select(F.col("id").alias("product_id")), "product_id", "left_semi")


def apply_eans(products: DataFrame, updates: DataFrame) -> DataFrame:
    """Writes EANs (product_id, ean) where a product has none."""
    u = ean_updates(products, updates).select(F.col("product_id").alias("id"), F.col("ean").alias("new_ean"))
    return products.join(u, "id", "left").withColumn("ean", F.coalesce("ean", "new_ean")).select(*products.columns)


def _stamped(matches: DataFrame, hit: Column, status: Column, at: str, reviewer: str) -> DataFrame:
    """matches with the status, time and reviewer of the rows that hit; other rows keep theirs."""
    for name, kind in (("reviewed_at", "timestamp"), ("reviewer", "string")):
        matches = matches if name in matches.columns else matches.withColumn(name, F.lit(None).cast(kind))
    new = {"reviewed_at": F.lit(at).cast("timestamp"), "reviewer": F.lit(reviewer), "status": status}
    return matches.withColumns({c: F.when(hit, v).otherwise(F.col(c)) for c, v in new.items()})


def review(matches: DataFrame, decisions: DataFrame, at: str, reviewer: str) -> DataFrame:
    """Applies decisions (listing_id, status) to pending matches; each id counts once. Rows of earlier reviews keep their
    stamps; updated marks the rows that this one changed."""
    d = decisions.groupBy("listing_id").agg(F.max("status").alias("__new"))
    out = matches.join(d, "listing_id", "left").withColumn("updated", F.col("__new").isNotNull() & (F.col("status") == "pending"))
    return _stamped(out, F.col("updated"), F.col("__new"), at, reviewer).drop("__new")


def auto_approve(matches: DataFrame, at: str, least: float = 0.96, reviewer: str = "auto") -> DataFrame:
    """Approves pending vector matches of high similarity; updated marks them."""
    hit = (F.col("status") == "pending") & F.col("match_type").startswith("vector") & (F.col("similarity") >= least)
    return _stamped(matches.withColumn("updated", F.coalesce(hit, F.lit(False))), F.col("updated"), F.lit("approved"), at, reviewer)


def review_counts(matches: DataFrame) -> DataFrame:
    """Vector matches per status."""
    return matches.where(F.col("match_type").startswith("vector")).groupBy("status").agg(F.count("*").alias("n"))


def review_queue(matches: DataFrame, listings: DataFrame, products: DataFrame, status: str, search: str = "") -> DataFrame:
    """Vector matches of a status with both titles, newest listing first."""
    q = matched_offers(matches.where(F.col("match_type").startswith("vector")), products, listings, status)
    if search:
        q = q.where(F.lower("title").contains(search.lower()) | F.lower("product_title").contains(search.lower()))
    return q.orderBy(F.desc("scraped_at"), "listing_id")
