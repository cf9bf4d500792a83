"""SQL for DuckDB that states what each query returns, written apart from the operators."""

from __future__ import annotations

from shelfscope.plans.fixtures import WITH

NORM = r"""nullif(upper(strip_accents(trim(brand))), '') AS nbrand, nullif(regexp_replace(upper(trim(mpn)), '[\s.\-]+', '', 'g'), '') AS nmpn,
  CASE WHEN regexp_matches(regexp_replace(trim(ean), '\.0*$', ''), '^[0-9]{8,14}$') THEN regexp_replace(trim(ean), '\.0*$', '') END AS nean"""

CODES = r"""list_distinct(list_transform(list_concat(
  regexp_extract_all(upper(title), '\b[0-9]{2}[-\s][0-9]{2}[-\s][0-9]{3}\b'),
  list_filter(regexp_extract_all(upper(title), '[0-9]+'), lambda x: length(x) IN (6, 7, 8)),
  regexp_extract_all(upper(title), '\b[A-Z0-9]{2,}[-/][A-Z0-9]+(?:[-/][A-Z0-9]+)*\b')), lambda x: regexp_replace(x, '[\s.\-]+', '', 'g')))"""

NORMED = f"""{WITH},
np AS (SELECT *, {NORM} FROM products),
nl AS (SELECT *, {NORM} FROM listings)"""

MATCHED = (
    NORMED
    + f""",
lb AS (SELECT nl.*, CASE WHEN nbrand IN (SELECT nbrand FROM np WHERE nbrand IS NOT NULL) THEN nbrand ELSE '' END AS block FROM nl),
pb AS (SELECT *, coalesce(nbrand, '') AS block FROM np),
hits AS (
  SELECT nl.id AS lid, max(np.id) AS pid, 'exact_ean' AS t, 1.00 AS c, 1 AS layer FROM nl JOIN np ON nl.nean = np.nean GROUP BY 1
  UNION ALL SELECT nl.id, max(np.id), 'exact_mpn', 1.00, 2 FROM nl JOIN np ON nl.nbrand = np.nbrand AND nl.nmpn = np.nmpn GROUP BY 1
  UNION ALL SELECT nl.id, max(np.id), 'mpn_no_brand', 0.90, 3 FROM nl JOIN np ON nl.nmpn = np.nmpn WHERE nl.nbrand IS NULL GROUP BY 1
  UNION ALL SELECT a.id, p.id, 'regex_ean_title', 0.93, 4
    FROM (SELECT *, unnest(list_filter(regexp_extract_all(title, '[0-9]+'), lambda x: length(x) = 13)) AS code FROM lb WHERE ean IS NULL) a
    JOIN pb p ON p.ean = a.code AND p.block = a.block
  UNION ALL SELECT a.id, p.id, CASE WHEN a.nbrand = p.nbrand THEN 'regex_mpn_title' ELSE 'regex_mpn_no_brand' END,
      CASE WHEN a.nbrand = p.nbrand THEN 0.90 WHEN a.nbrand IS NULL OR p.nbrand IS NULL THEN 0.78 ELSE 0.72 END, 4
    FROM (SELECT *, unnest({CODES}) AS code FROM lb WHERE nmpn IS NULL) a JOIN pb p ON p.nmpn = a.code AND p.block = a.block),
m AS (SELECT lid AS listing_id, pid AS product_id, t AS match_type, CAST(c AS DECIMAL(3,2)) AS confidence, 'approved' AS status
  FROM (SELECT *, row_number() OVER (PARTITION BY lid ORDER BY layer, c DESC, pid) AS n FROM hits) WHERE n = 1),
mo AS (SELECT m.*, l.competitor_id, l.title, l.price_eur, l.url, l.scraped_at, l.brand AS listing_brand, p.ean AS product_ean, p.title AS product_title, p.brand AS product_brand, p.price_eur AS catalogue_price
  FROM m JOIN listings l ON l.id = m.listing_id JOIN products p ON p.id = m.product_id),
o AS (SELECT product_id, coalesce(product_ean, 'cluster:' || CAST(product_id AS VARCHAR)) AS key, competitor_id AS store, min(price_eur) AS price FROM mo GROUP BY ALL)"""
)

GAP = "round_even((CAST(own_price AS DOUBLE) - CAST(best_price AS DOUBLE)) / CAST(best_price AS DOUBLE) * 100, 4)"
BUCKET = "CASE WHEN gap IS NULL THEN 'M' WHEN gap <= -10 THEN 'A' WHEN gap <= -2 THEN 'B' WHEN gap <= 2 THEN 'C' WHEN gap <= 10 THEN 'D' ELSE 'E' END"

POSITION = (
    MATCHED
    + f""",
mine AS (SELECT key, min(price) AS own_price FROM o WHERE store = 's0' GROUP BY 1),
rivals AS (SELECT key, store, min(price) AS price FROM o WHERE store <> 's0' GROUP BY ALL),
best AS (SELECT key, min(price) AS best_price, arg_min(store, (price, store)) AS best_store, count(*) AS n_rivals, string_agg(store, ',' ORDER BY store) AS rivals FROM rivals GROUP BY 1),
pos AS (SELECT *, {BUCKET} AS bucket, coalesce(abs(gap) >= 300, false) AS outlier
  FROM (SELECT key, own_price, best_price, best_store, coalesce(n_rivals, 0) AS n_rivals, coalesce(rivals, '') AS rivals, {GAP} AS gap FROM mine LEFT JOIN best USING (key)))"""
)


def latest(date: str) -> str:
    return f"""SELECT * FROM mo WHERE confidence >= 0.85 AND scraped_at <= TIMESTAMP '{date}'
  QUALIFY row_number() OVER (PARTITION BY product_id, competitor_id ORDER BY scraped_at DESC, listing_id DESC) = 1"""


def snapshot(date: str) -> str:
    return f"""SELECT r.product_id, DATE '{date}' AS snapshot_date, any_value(coalesce(w.price_eur, p.price_eur)) AS own_price, count(*) AS competitor_count,
    min(r.price_eur) AS min_price, CAST(median(CAST(r.price_eur AS DOUBLE)) AS DECIMAL(12,3)) AS median_price, max(r.price_eur) AS max_price,
    1 + count(*) FILTER (r.price_eur < coalesce(w.price_eur, p.price_eur)) AS own_rank, arg_min(r.competitor_id, (r.price_eur, r.competitor_id)) AS cheapest_competitor
  FROM ({latest(date)}) r JOIN products p ON p.id = r.product_id
  LEFT JOIN ({latest(date)}) w ON w.product_id = r.product_id AND w.competitor_id = 's0'
  WHERE r.competitor_id <> 's0' GROUP BY r.product_id"""


SNAPSHOTS = (
    MATCHED
    + f""",
snaps AS ({snapshot("1996-06-30")} UNION ALL {snapshot("2001-12-31")}),
prevs AS (SELECT *, lag(median_price) OVER (PARTITION BY product_id ORDER BY snapshot_date) AS prev_median FROM snaps),
d AS (SELECT *, CAST(own_price AS DOUBLE) AS a, CAST(median_price AS DOUBLE) AS md, CAST(min_price AS DOUBLE) AS lo, CAST(prev_median AS DOUBLE) AS pm FROM prevs),
cls AS (SELECT *, CASE WHEN pm > 0 AND abs(md - pm) / pm >= 0.20 THEN 'investigate' WHEN (lo - a) / lo >= 0.08 THEN 'raise'
    WHEN (a - md) / md >= 0.15 AND competitor_count >= 2 THEN 'drop' WHEN abs(a - md) / md <= 0.05 THEN 'hold' END AS action FROM d),
recs AS (SELECT product_id, snapshot_date, action AS playbook, own_price AS current_price,
    CAST(CASE action WHEN 'raise' THEN round_even(min_price * 0.99, 2) WHEN 'drop' THEN round_even(median_price, 2) ELSE own_price END AS DECIMAL(10,2)) AS suggested_price, 'pending' AS status, min_price, median_price
  FROM cls WHERE action IS NOT NULL AND snapshot_date = DATE '2001-12-31')"""
)

PCT = "coalesce(round_even(CAST({a} AS DOUBLE) * 100 / nullif({b}, 0), 1), 0)"


def pct(a: str, b: str) -> str:
    return PCT.format(a=a, b=b)


PAIRS = (
    MATCHED
    + """,
ref AS (SELECT product_id, min(price_eur) AS ref_price, arg_min(product_title, listing_id) AS title, arg_min(product_brand, CASE WHEN product_brand IS NOT NULL THEN listing_id END) AS brand FROM mo WHERE confidence >= 0.85 AND competitor_id = 's0' GROUP BY 1),
opp AS (SELECT product_id, competitor_id AS opponent, min(price_eur) AS opp_price FROM mo WHERE confidence >= 0.85 AND competitor_id <> 's0' GROUP BY ALL),
pr AS (SELECT *, (CAST(opp_price AS DOUBLE) - CAST(ref_price AS DOUBLE)) / CAST(ref_price AS DOUBLE) * 100 AS delta FROM ref JOIN opp USING (product_id))"""
)

LPR = f""",
low AS (SELECT product_id, store, min(price) AS price FROM o GROUP BY ALL),
lpr AS (SELECT a.store, count(*) AS comparisons, count(*) FILTER (a.price < b.price) AS wins FROM low a JOIN low b ON a.product_id = b.product_id AND a.store <> b.store GROUP BY 1),
sp AS (SELECT store, count(DISTINCT product_id) AS products FROM o GROUP BY 1)"""

OVERVIEW = f"""{MATCHED}{LPR},
vol AS (SELECT competitor_id AS store, count(*) AS listings, count(*) FILTER (scraped_at >= TIMESTAMP '2001-10-30' - INTERVAL 365 DAY) AS fresh FROM listings GROUP BY 1),
sm AS (SELECT competitor_id AS store, count(DISTINCT listing_id) AS matches FROM mo GROUP BY 1),
ov AS (SELECT s.store, s.store = 's0' AS own, coalesce(listings, 0) AS listings, coalesce(fresh, 0) AS fresh, coalesce(matches, 0) AS matches, coalesce(products, 0) AS products,
    {pct("coalesce(matches, 0)", "listings")} AS match_rate, {pct("coalesce(fresh, 0)", "listings")} AS fresh_share, coalesce({pct("wins", "comparisons")}, 0) AS lower_price_rate,
    CASE WHEN listings <= 500 THEN 'Small' WHEN listings <= 5000 THEN 'Medium' WHEN listings <= 25000 THEN 'Large' WHEN listings > 25000 THEN 'Strategic' END AS tier
  FROM (SELECT DISTINCT 's' || CAST(s_suppkey % 12 AS VARCHAR) AS store FROM supplier) s LEFT JOIN vol USING (store) LEFT JOIN sm USING (store) LEFT JOIN lpr USING (store) LEFT JOIN sp USING (store))"""

OVERLAP = f"""{MATCHED}{LPR},
has AS (SELECT DISTINCT product_id, store FROM o),
ol AS (SELECT a.store AS a, b.store AS b, count(*) AS shared, {pct("count(*)", "least(any_value(x.products), any_value(y.products))")} AS rate
  FROM has a JOIN has b ON a.product_id = b.product_id AND a.store < b.store JOIN sp x ON x.store = a.store JOIN sp y ON y.store = b.store GROUP BY 1, 2)"""

SUMMARY = f"""count(delta) AS n, count(*) FILTER (delta > 0.5) AS wins, round_even(avg(delta) FILTER (delta > 0.5), 4) AS advantage,
  round_even(avg(delta) FILTER (delta < -0.5), 4) AS disadvantage, round_even(avg(delta), 4) AS mean_delta, {pct("count(*) FILTER (delta > 0.5)", "count(delta)")} AS win_pct"""

ORPHAN_EANS = (
    NORMED
    + r""",
part3 AS (SELECT * REPLACE (CASE WHEN id % 3 <> 0 THEN nean END AS nean) FROM np),
grp AS (SELECT nean, arg_min({'id': id, 'title': title, 'price': price_eur, 'b': nbrand, 'm': nmpn}, (-(CASE WHEN nbrand IS NULL THEN 0 ELSE 1 END + CASE WHEN nmpn IS NULL THEN 0 ELSE 1 END), id)) AS r FROM nl WHERE nean IS NOT NULL GROUP BY 1),
res AS (SELECT g.nean, g.r, coalesce((SELECT max(id) FROM part3 p WHERE p.nean = g.nean), (SELECT max(id) FROM part3 p WHERE p.nbrand = g.r.b AND p.nmpn = g.r.m)) AS found FROM grp g),
ids AS (SELECT nean, r, found, coalesce(found, (length(nean) + 10) * 100000000000000 + CAST(nean AS BIGINT)) AS pid FROM res)"""
)

MARKET = (
    MATCHED
    + """,
mk AS (SELECT product_ean AS ean, competitor_id AS seller, price_eur, CASE WHEN length(url) % 3 <> 0 THEN CAST((length(url) % 7) / 2.0 AS DECIMAL(10,2)) END AS delivery_eur FROM mo WHERE product_ean IS NOT NULL),
tot AS (SELECT ean, seller, min(CASE WHEN price_eur > 0 THEN price_eur + coalesce(delivery_eur, 0) END) AS total FROM mk GROUP BY ALL)"""
)

PHASES = (
    ORPHAN_EANS
    + f""",
cat AS (SELECT id, nbrand, nmpn, nean, CASE WHEN id % 3 <> 0 THEN ean END AS ean, title FROM np UNION ALL SELECT pid, r.b, r.m, nean, nean, r.title FROM ids WHERE found IS NULL),
rest AS (SELECT *, CASE WHEN nbrand IN (SELECT nbrand FROM cat WHERE nbrand IS NOT NULL) THEN nbrand ELSE '' END AS block FROM nl WHERE nean IS NULL),
c AS (SELECT *, coalesce(nbrand, '') AS block FROM cat),
hits AS (
  SELECT l.id AS lid, max(c.id) AS pid, 'exact_mpn' AS t, 1.00 AS c, 2 AS layer FROM rest l JOIN c ON l.nbrand = c.nbrand AND l.nmpn = c.nmpn GROUP BY 1
  UNION ALL SELECT l.id, max(c.id), 'mpn_no_brand', 0.90, 3 FROM rest l JOIN c ON l.nmpn = c.nmpn WHERE l.nbrand IS NULL GROUP BY 1
  UNION ALL SELECT a.id, p.id, 'regex_ean_title', 0.93, 4
    FROM (SELECT *, unnest(list_filter(regexp_extract_all(title, '[0-9]+'), lambda x: length(x) = 13)) AS code FROM rest WHERE ean IS NULL) a JOIN c p ON p.ean = a.code AND p.block = a.block
  UNION ALL SELECT a.id, p.id, CASE WHEN a.nbrand = p.nbrand THEN 'regex_mpn_title' ELSE 'regex_mpn_no_brand' END,
      CASE WHEN a.nbrand = p.nbrand THEN 0.90 WHEN a.nbrand IS NULL OR p.nbrand IS NULL THEN 0.78 ELSE 0.72 END, 4
    FROM (SELECT *, unnest({CODES}) AS code FROM rest WHERE nmpn IS NULL) a JOIN c p ON p.nmpn = a.code AND p.block = a.block
  UNION ALL SELECT a.id, p.id, CASE WHEN a.nbrand = p.nbrand THEN 'regex_mpn_title' ELSE 'regex_mpn_no_brand' END,
      CASE WHEN a.nbrand = p.nbrand THEN 0.90 WHEN a.nbrand IS NULL OR p.nbrand IS NULL THEN 0.78 ELSE 0.72 END, 4
    FROM rest a JOIN (SELECT *, unnest({CODES}) AS code FROM c WHERE nmpn IS NULL) p ON p.code = a.nmpn AND p.block = a.block),
run AS (SELECT nl.id AS listing_id, pid AS product_id, 'exact_ean' AS match_type, CAST(1 AS DECIMAL(3,2)) AS confidence FROM nl JOIN ids USING (nean)
  UNION ALL SELECT lid, pid, t, CAST(c AS DECIMAL(3,2)) FROM (SELECT *, row_number() OVER (PARTITION BY lid ORDER BY layer, c DESC, pid) AS n FROM hits) WHERE n = 1)"""
)

ORACLES = {
    "norm_identifiers": NORMED + r" SELECT id, nbrand, nmpn, nean, trim(regexp_replace(strip_accents(lower(title)), '[^a-z0-9]+', ' ', 'g')) AS ntitle, coalesce('derived-ean-' || nean, 'derived-' || coalesce(nbrand, '') || '-' || nmpn, 'derived-title-' || md5(title)) AS sku FROM nl",
    "mpn_candidates": f"{WITH} SELECT id, array_to_string(list_sort({CODES}), ',') AS codes, array_to_string(list_filter(regexp_extract_all(title, '[0-9]+'), lambda x: length(x) = 13), ',') AS eans FROM listings",
    "title_token_counts": r"""SELECT token, count(*) AS documents FROM (SELECT unnest(list_distinct(list_filter(regexp_extract_all(strip_accents(lower(text)), '[a-z0-9]{3,}'),
      lambda w: NOT regexp_matches(w, '^[0-9]+$') AND NOT list_contains(string_split('na pre s z a so pri od do mm cm kg set kus ks sada the and for with von fur mit zu und die der das', ' '), w)))) AS token FROM documents) GROUP BY 1""",
    "price_classes": f"{MATCHED}, g AS (SELECT (CAST(price_eur AS DOUBLE) - CAST(catalogue_price AS DOUBLE)) / CAST(catalogue_price AS DOUBLE) * 100 AS gap FROM mo) SELECT CASE WHEN gap > 1 THEN 'dearer' WHEN gap < -1 THEN 'cheaper' ELSE 'equal' END AS class, {BUCKET} AS bucket, count(*) AS n FROM g GROUP BY ALL",
    "listing_freshness": f"{WITH} SELECT competitor_id, CASE WHEN h < 26 THEN 'fresh' WHEN h < 168 THEN 'recent' ELSE 'stale' END AS tier, count(*) AS n FROM (SELECT competitor_id, (epoch(TIMESTAMP '2001-10-30 12:00:00') - epoch(CAST(scraped_at AS TIMESTAMP))) / 3600 AS h FROM listings) GROUP BY ALL",
    "category_counts": f"""{WITH}, c AS (SELECT lower(title || ' ' || coalesce(brand, '')) AS t FROM products), k AS (SELECT CASE WHEN regexp_matches(t, '\\bplated\\b') THEN 'Plated'
      WHEN regexp_matches(t, '\\bbrushed (copper|tin|nickel|steel|brass)\\b') THEN 'Brushed metal' WHEN regexp_matches(t, '\\bsteel\\b') THEN 'Steel' WHEN regexp_matches(t, '\\b(small|medium)\\b') THEN 'Small parts' ELSE 'Other' END AS category FROM c)
      SELECT category, count(*) AS seen, count(*) FILTER (category <> 'Steel') AS changed FROM k GROUP BY 1""",
    "match_layers": f"{MATCHED} SELECT * FROM m",
    "match_unblocked": f"""{NORMED}, hits AS (
      SELECT nl.id AS lid, 'exact_ean' AS t, 1.00 AS c, 1 AS layer FROM nl SEMI JOIN np ON nl.nean = np.nean
      UNION ALL SELECT nl.id, 'exact_mpn', 1.00, 2 FROM nl SEMI JOIN np ON nl.nbrand = np.nbrand AND nl.nmpn = np.nmpn
      UNION ALL SELECT nl.id, 'mpn_no_brand', 0.90, 3 FROM nl SEMI JOIN np ON nl.nmpn = np.nmpn WHERE nl.nbrand IS NULL
      UNION ALL SELECT a.id, 'regex_ean_title', 0.93, 4 FROM (SELECT *, unnest(list_filter(regexp_extract_all(title, '[0-9]+'), lambda x: length(x) = 13)) AS code FROM nl WHERE ean IS NULL) a JOIN np p ON p.ean = a.code
      UNION ALL SELECT a.id, CASE WHEN a.nbrand = p.nbrand THEN 'regex_mpn_title' ELSE 'regex_mpn_no_brand' END, CASE WHEN a.nbrand = p.nbrand THEN 0.90 WHEN a.nbrand IS NULL OR p.nbrand IS NULL THEN 0.78 ELSE 0.72 END, 4
        FROM (SELECT *, unnest({CODES}) AS code FROM nl WHERE nmpn IS NULL) a JOIN np p ON p.nmpn = a.code)
      SELECT t AS match_type, CAST(c AS DECIMAL(3,2)) AS confidence, count(*) AS n FROM (SELECT * FROM hits QUALIFY row_number() OVER (PARTITION BY lid ORDER BY c DESC, layer) = 1) GROUP BY ALL""",
    "upsert_matches": f"""{MATCHED}, odd AS (SELECT * FROM nl WHERE competitor_id IN ('s1', 's3', 's5', 's7', 's9', 's11')), open_hits AS (
      SELECT nl.id AS lid, max(np.id) AS pid, 'exact_ean' AS t, 1.00 AS c, 1 AS layer FROM odd nl JOIN np ON nl.nean = np.nean GROUP BY 1
      UNION ALL SELECT nl.id, max(np.id), 'exact_mpn', 1.00, 2 FROM odd nl JOIN np ON nl.nbrand = np.nbrand AND nl.nmpn = np.nmpn GROUP BY 1
      UNION ALL SELECT nl.id, max(np.id), 'mpn_no_brand', 0.90, 3 FROM odd nl JOIN np ON nl.nmpn = np.nmpn WHERE nl.nbrand IS NULL GROUP BY 1
      UNION ALL SELECT a.id, p.id, 'regex_ean_title', 0.93, 4 FROM (SELECT *, unnest(list_filter(regexp_extract_all(title, '[0-9]+'), lambda x: length(x) = 13)) AS code FROM odd WHERE ean IS NULL) a JOIN np p ON p.ean = a.code
      UNION ALL SELECT a.id, p.id, CASE WHEN a.nbrand = p.nbrand THEN 'regex_mpn_title' ELSE 'regex_mpn_no_brand' END, CASE WHEN a.nbrand = p.nbrand THEN 0.90 WHEN a.nbrand IS NULL OR p.nbrand IS NULL THEN 0.78 ELSE 0.72 END, 4
        FROM (SELECT *, unnest({CODES}) AS code FROM odd WHERE nmpn IS NULL) a JOIN np p ON p.nmpn = a.code),
      u AS (SELECT lid, pid, t FROM open_hits QUALIFY row_number() OVER (PARTITION BY lid ORDER BY c DESC, layer, pid, t) = 1),
      r AS (SELECT t AS match_type FROM u UNION ALL SELECT match_type FROM m WHERE listing_id NOT IN (SELECT lid FROM u)) SELECT match_type, count(*) AS n FROM r GROUP BY 1""",
    "own_products": f"""{NORMED}, bare AS (SELECT * FROM np), l AS (SELECT *, lower(title) AS t FROM nl WHERE competitor_id = 's0'),
      by_code AS (SELECT nbrand, nmpn, max(id) AS p2 FROM bare WHERE nbrand IS NOT NULL AND nmpn IS NOT NULL GROUP BY ALL), by_title AS (SELECT lower(title) AS t, max(id) AS p3 FROM bare GROUP BY 1),
      f AS (SELECT l.*, coalesce(p2, p3) AS found FROM l LEFT JOIN by_code USING (nbrand, nmpn) LEFT JOIN by_title USING (t)),
      known AS (SELECT found, arg_max({{'ean': nean, 'price': price_eur}}, (scraped_at, id)) AS r FROM f WHERE found IS NOT NULL GROUP BY 1),
      fresh AS (SELECT coalesce(nean, concat_ws('|', nbrand, nmpn, t)) AS k, arg_max({{'ean': nean, 'price': price_eur}}, (scraped_at, id)) AS r FROM f WHERE found IS NULL GROUP BY 1)
      SELECT sku, r.ean AS ean, coalesce(r.price, price_eur) AS price_eur FROM bare LEFT JOIN known ON found = bare.id UNION ALL SELECT 'derived-' || md5(k), r.ean, r.price FROM fresh""",
    "match_summary": f"{MATCHED} SELECT CASE WHEN match_type LIKE '%exact%' OR match_type LIKE '%ean%' THEN 'exact' ELSE 'regex' END AS kind, count(*) AS n FROM m GROUP BY 1",
    "ean_phase": f"{ORPHAN_EANS} SELECT nl.id AS listing_id, pid AS product_id, 'exact_ean' AS match_type, CAST(1 AS DECIMAL(3,2)) AS confidence, 'approved' AS status FROM nl JOIN ids USING (nean)",
    "derived_products": f"{ORPHAN_EANS} SELECT pid AS id, 'derived-ean-' || nean AS sku, nean AS ean, r.title AS title, r.price AS price_eur FROM ids WHERE found IS NULL",
    "unmatched_listings": f"{MATCHED} SELECT competitor_id, count(*) AS n FROM listings WHERE id NOT IN (SELECT listing_id FROM m) GROUP BY 1",
    "token_candidates": f"""{MATCHED}, tk AS (SELECT 'l' AS k, id AS lid, NULL AS pid, nbrand, title FROM nl WHERE competitor_id = 's0' AND id NOT IN (SELECT listing_id FROM m) UNION ALL SELECT 'p', NULL, id, nbrand, title FROM np),
      w AS (SELECT k, lid, pid, nbrand, unnest(list_distinct(list_filter(regexp_extract_all(lower(title), '[a-z0-9]{{3,}}'), lambda w: NOT regexp_matches(w, '^[0-9]+$')))) AS token FROM tk),
      s AS (SELECT a.lid AS listing_id, b.pid AS product_id, count(*) AS shared FROM w a JOIN w b ON a.token = b.token AND a.k = 'l' AND b.k = 'p' WHERE a.nbrand IS NULL OR b.nbrand IS NULL OR a.nbrand = b.nbrand GROUP BY ALL HAVING count(*) >= 2)
      SELECT *, row_number() OVER (PARTITION BY listing_id ORDER BY shared DESC, product_id) AS rank FROM s QUALIFY rank <= 5""",
    "token_candidates_whole": f"""{MATCHED}, tk AS (SELECT 'l' AS k, id AS lid, NULL AS pid, nbrand, title FROM nl WHERE id NOT IN (SELECT listing_id FROM m) UNION ALL SELECT 'p', NULL, id, nbrand, title FROM np),
      t AS (SELECT k, lid, pid, nbrand, list_sort(list_distinct(list_filter(regexp_extract_all(lower(title), '[a-z0-9]{{3,}}'), lambda w: NOT regexp_matches(w, '^[0-9]+$')))) AS tokens FROM tk),
      g AS (SELECT nbrand, tokens, row_number() OVER () AS g FROM (SELECT DISTINCT nbrand, tokens FROM t WHERE k = 'l')),
      w AS (SELECT g, nbrand, unnest(tokens) AS token FROM g), v AS (SELECT pid, nbrand, unnest(tokens) AS token FROM t WHERE k = 'p'),
      s AS (SELECT g, pid, count(*) AS shared FROM w JOIN v ON w.token = v.token WHERE w.nbrand IS NULL OR v.nbrand IS NULL OR w.nbrand = v.nbrand GROUP BY ALL HAVING count(*) >= 2),
      r AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY shared DESC, pid) AS rank FROM s QUALIFY rank <= 40)
      SELECT t.lid AS listing_id, r.pid AS product_id, r.shared, r.rank FROM t JOIN g ON t.k = 'l' AND t.nbrand IS NOT DISTINCT FROM g.nbrand AND t.tokens = g.tokens JOIN r USING (g)""",
    "knn_by_label": """WITH u AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE) / sqrt(list_sum(list_transform(embedding, lambda y: CAST(y AS DOUBLE) * CAST(y AS DOUBLE))))) AS v FROM embeddings),
      s AS (SELECT a.vec_id AS query_id, b.vec_id AS pool_id, round_even(list_dot_product(a.v, b.v), 6) AS score FROM u a JOIN u b ON a.label = b.label AND a.vec_id <> b.vec_id)
      SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, pool_id) AS rank, pool_id FROM s QUALIFY rank <= 5""",
    "exact_titles": f"{WITH}, t AS (SELECT trim(regexp_replace(lower(title), '[^a-z0-9]+', ' ', 'g')) AS t, min(id) AS product_id FROM products GROUP BY 1 HAVING count(*) = 1) SELECT l.id AS row_id, t.product_id FROM listings l JOIN t ON t.t = trim(regexp_replace(lower(l.title), '[^a-z0-9]+', ' ', 'g'))",
    "detect_brand": f"""{NORMED}, b AS (SELECT token, min(nbrand) AS brand FROM (SELECT DISTINCT nbrand, unnest(string_split(trim(regexp_replace(lower(nbrand), '[^a-z0-9]+', ' ', 'g')), ' ')) AS token FROM np WHERE nbrand IS NOT NULL) WHERE length(token) >= 3 GROUP BY 1),
      w AS (SELECT DISTINCT id, unnest(string_split(trim(regexp_replace(lower(title), '[^a-z0-9]+', ' ', 'g')), ' ')) AS token FROM nl)
      SELECT id AS row_id, min(brand) AS brand FROM w JOIN b USING (token) GROUP BY 1 HAVING min(brand) = max(brand)""",
    "backfill_brand": f"{NORMED}, p1 AS (SELECT nean, arg_min(brand, id) AS b FROM np WHERE nean IS NOT NULL AND nbrand IS NOT NULL GROUP BY 1), p2 AS (SELECT nean, arg_min(brand, id) AS b FROM nl WHERE nean IS NOT NULL AND nbrand IS NOT NULL GROUP BY 1) SELECT nl.id, coalesce(CASE WHEN nl.ean IS NULL THEN trim(nl.brand) END, p1.b, p2.b) AS brand FROM nl LEFT JOIN p1 USING (nean) LEFT JOIN p2 USING (nean)",
    "peers": f"{MATCHED} SELECT a.listing_id AS own_listing_id, count(*) AS peers, min(b.price_eur) AS low FROM mo a JOIN mo b ON a.product_id = b.product_id AND a.competitor_id = 's0' AND b.competitor_id <> 's0' AND a.listing_id <> b.listing_id GROUP BY 1",
    "preferred_source": f"{NORMED}, s AS (SELECT nean, arg_max({{'t': title, 'b': brand}}, (scraped_at, id)) AS s FROM nl WHERE competitor_id = 's0' AND nean IS NOT NULL GROUP BY 1) SELECT np.id, coalesce(s.s.t, title) AS title, coalesce(s.s.b, brand) AS brand FROM np LEFT JOIN s USING (nean)",
    "ean_clusters": f"{NORMED} SELECT nean AS ean, arg_min(title, (competitor_id <> 's0', id)) AS title, count(*) AS members, count(DISTINCT competitor_id) AS stores FROM nl WHERE nean IS NOT NULL GROUP BY 1",
    "latest_prices": f"{MATCHED} SELECT product_id, competitor_id, listing_id, price_eur FROM ({latest('2001-12-31')})",
    "snapshot": f"{MATCHED} {snapshot('2001-12-31')}",
    "recommend": f"{SNAPSHOTS} SELECT * EXCLUDE (min_price, median_price) FROM recs",
    "price_history": f"{SNAPSHOTS} SELECT product_id, snapshot_date, own_price, min_price, median_price, max_price FROM snaps WHERE snapshot_date BETWEEN DATE '2001-12-01' AND DATE '2001-12-31'",
    "alerts": f"{SNAPSHOTS} SELECT p.sku, left(p.title, 60) AS title, playbook, current_price, suggested_price, min_price, median_price FROM recs JOIN products p ON p.id = recs.product_id WHERE playbook = 'investigate'",
    "market_position": f"{SNAPSHOTS} SELECT product_id, CAST(own_rank AS VARCHAR) || '/' || CAST(competitor_count + 1 AS VARCHAR) AS position, round_even((CAST(own_price AS DOUBLE) - CAST(median_price AS DOUBLE)) / CAST(median_price AS DOUBLE) * 100, 4) AS gap_pct FROM snaps QUALIFY row_number() OVER (PARTITION BY product_id ORDER BY snapshot_date DESC) = 1",
    "offers": f"{MATCHED} SELECT * FROM o",
    "store_overview": f"{OVERVIEW} SELECT * FROM ov",
    "overview_summary": f"{OVERVIEW} SELECT count(*) AS configured, count(*) FILTER (listings > 0) AS active, CAST(sum(listings) AS BIGINT) AS listings, CAST(sum(fresh) AS BIGINT) AS fresh, CAST(sum(matches) AS BIGINT) AS matches, {pct('sum(matches)', 'sum(listings)')} AS match_rate, {pct('sum(fresh)', 'sum(listings)')} AS fresh_share FROM ov",
    "lower_price_rate": f"{MATCHED}{LPR} SELECT store, comparisons, wins, {pct('wins', 'comparisons')} AS rate FROM lpr",
    "store_overlap": f"{OVERLAP} SELECT * FROM ol",
    "top_overlaps": f"{OVERLAP} SELECT * FROM ol ORDER BY shared DESC, rate DESC, a, b LIMIT 8",
    "overlap_nodes": f"{OVERLAP} SELECT store, products, round_even(0.6 + 1.6 * sqrt(CAST(products AS DOUBLE) / max(products) OVER ()), 6) AS radius, CAST((SELECT count(*) FROM ol WHERE a = sp.store OR b = sp.store) AS INTEGER) AS n_partners, coalesce((SELECT string_agg(CASE WHEN a = sp.store THEN b ELSE a END, ',' ORDER BY rate DESC, CASE WHEN a = sp.store THEN b ELSE a END) FROM ol WHERE a = sp.store OR b = sp.store), '') AS partners FROM sp",
    "seller_stats": f"{MATCHED} SELECT store, count(*) AS offers, count(DISTINCT product_id) AS products FROM o GROUP BY 1",
    "sku_position": f"{POSITION} SELECT * FROM pos",
    "position_kpis": f"{POSITION} SELECT count(*) AS skus, count(gap) AS comparable, count(*) FILTER (gap <= 0) AS wins, count(*) FILTER (gap <= -10) AS deep_cheap, count(*) FILTER (gap >= 10) AS deep_pricey, count(*) FILTER (n_rivals = 0) AS monopoly, round_even(median(gap), 4) AS median_gap, {pct('count(*) FILTER (gap <= 0)', 'count(gap)')} AS win_rate FROM pos",
    "bucket_hist": f"{POSITION} SELECT b AS bucket, count(key) AS n FROM (SELECT unnest(['A', 'B', 'C', 'D', 'E', 'M']) AS b) LEFT JOIN pos ON bucket = b GROUP BY 1",
    "head_to_head": f"{MATCHED}, low AS (SELECT key, store, min(price) AS price FROM o GROUP BY ALL), j AS (SELECT b.store, a.price AS own, b.price, (CAST(b.price AS DOUBLE) - CAST(a.price AS DOUBLE)) / CAST(a.price AS DOUBLE) * 100 AS gap FROM low a JOIN low b ON a.key = b.key AND a.store = 's0' AND b.store <> 's0') SELECT store, count(*) AS overlap, count(*) FILTER (own < price) AS ref_cheaper, count(*) FILTER (own > price) AS rival_cheaper, count(*) FILTER (own = price) AS same, round_even(median(gap), 4) AS median_gap, {pct('count(*) FILTER (own < price)', 'count(*)')} AS win_rate FROM j GROUP BY 1",
    "catalog_overlap": f"{MATCHED}, h AS (SELECT DISTINCT key, store FROM o), r AS (SELECT key FROM h WHERE store = 's0') SELECT store, count(*) AS skus, count(r.key) AS shared, {pct('count(r.key)', 'count(*)')} AS of_seller, {pct('count(r.key)', '(SELECT count(*) FROM r)')} AS of_ref FROM h LEFT JOIN r USING (key) WHERE store <> 's0' GROUP BY 1 HAVING count(*) >= 30",
    "density": f"{POSITION} SELECT n_rivals, count(*) AS skus FROM pos GROUP BY 1",
    "density_rivals": f"{POSITION}, e AS (SELECT n_rivals, unnest(string_split(rivals, ',')) AS store FROM pos WHERE n_rivals > 0), c AS (SELECT n_rivals, store, count(*) AS keys FROM e GROUP BY ALL), n AS (SELECT n_rivals, count(*) AS skus FROM pos GROUP BY 1) SELECT n_rivals, store, keys, row_number() OVER (PARTITION BY n_rivals ORDER BY keys DESC, store) AS rank, {pct('keys', 'skus')} AS share FROM c JOIN n USING (n_rivals) QUALIFY rank <= 8",
    "unlisted": f"{MATCHED} SELECT key, min(price) AS best_price, arg_min(store, (price, store)) AS best_store, count(DISTINCT store) AS n_rivals, 'N' AS bucket FROM o WHERE key NOT IN (SELECT key FROM o WHERE store = 's0') GROUP BY 1",
    "opportunities": f"{POSITION}, g AS (SELECT key, gap FROM pos WHERE gap IS NOT NULL AND NOT outlier) (SELECT *, 'worst' AS side FROM g ORDER BY gap DESC, key LIMIT 25) UNION ALL (SELECT *, 'best' FROM g ORDER BY gap, key LIMIT 25)",
    "price_tiles": f"""{MATCHED}, t AS (SELECT product_id, min(price_eur) FILTER (competitor_id = 's0') AS own_price, min(price_eur) FILTER (competitor_id <> 's0') AS market_min, count(*) AS members, coalesce(arg_min(nullif(trim(listing_brand), ''), CASE WHEN nullif(trim(listing_brand), '') IS NOT NULL THEN listing_id END) FILTER (competitor_id = 's0'), any_value(product_brand)) AS brand, coalesce(arg_min(title, listing_id) FILTER (competitor_id = 's0'), any_value(product_title)) AS title,
      string_agg(competitor_id, ',' ORDER BY competitor_id <> 's0', price_eur IS NULL, price_eur, competitor_id, listing_id) AS stores FROM mo GROUP BY 1) SELECT *, CASE WHEN own_price > 0 THEN round_even((CAST(own_price AS DOUBLE) - CAST(market_min AS DOUBLE)) / CAST(own_price AS DOUBLE) * 100, 4) END AS saving_pct FROM t""",
    "pair_summary": f"{PAIRS} SELECT opponent, {SUMMARY} FROM pr GROUP BY 1",
    "brand_summary": f"{PAIRS} SELECT brand, {SUMMARY} FROM pr GROUP BY 1",
    "merge_pairs": f"{PAIRS}, low AS (SELECT title, brand, opponent, min(opp_price) AS price, min(ref_price) AS ref_price FROM pr GROUP BY ALL) SELECT title, brand, min(ref_price) AS ref_price, count(*) FILTER ((CAST(price AS DOUBLE) - CAST(ref_price AS DOUBLE)) / CAST(ref_price AS DOUBLE) * 100 > 0.5) AS wins, count(*) AS n_opponents, min(price) FILTER (opponent = 's1') AS s1, min(price) FILTER (opponent = 's2') AS s2 FROM low GROUP BY title, brand",
    "manufacturer_summary": f"{MATCHED}, own AS (SELECT product_id, listing_id, price_eur AS own_price FROM mo WHERE competitor_id = 's0' AND coalesce(nullif(trim(listing_brand), ''), product_brand) ILIKE '%brand#2%'), ot AS (SELECT product_id, competitor_id AS store, price_eur AS price, confidence FROM mo WHERE competitor_id <> 's0' QUALIFY row_number() OVER (PARTITION BY product_id, competitor_id ORDER BY price_eur, listing_id) = 1), v AS (SELECT *, (CAST(price AS DOUBLE) - CAST(own_price AS DOUBLE)) / CAST(own_price AS DOUBLE) * 100 AS d FROM own JOIN ot USING (product_id)) SELECT store, count(DISTINCT listing_id) AS matched, round_even(avg(d), 4) AS mean_diff, count(*) FILTER (d < -1) AS cheaper, count(*) FILTER (abs(d) <= 1) AS equal, count(*) FILTER (d > 1) AS dearer, round_even(avg(CAST(confidence AS DOUBLE)), 4) AS confidence, {pct('count(DISTINCT listing_id)', '(SELECT count(*) FROM own)')} AS match_pct FROM v GROUP BY 1",
    "comparison_stats": f"{PAIRS} SELECT count(DISTINCT product_id) AS products, count(*) AS hits, round_even(avg(delta), 4) AS mean_premium, count(*) FILTER (delta < -5) AS cheaper, count(*) FILTER (abs(delta) <= 5) AS parity, count(*) FILTER (delta > 5) AS dearer FROM pr",
    "brand_remap": f"{NORMED}, r AS (SELECT brand, nbrand, count(*) AS n FROM nl WHERE nbrand IS NOT NULL GROUP BY ALL), b AS (SELECT nbrand, arg_min(brand, (-n, brand)) AS canonical FROM r GROUP BY 1 HAVING count(*) > 1) SELECT brand, canonical, n FROM r JOIN b USING (nbrand)",
    "offer_matrix": f"{MARKET}, w AS (SELECT *, min(total) OVER (PARTITION BY ean) AS lo, max(total) OVER (PARTITION BY ean) AS hi FROM tot) SELECT ean, seller, total, lo <> hi AND total = lo AS cheapest, lo <> hi AND total = hi AS dearest FROM w",
    "delivery_quartiles": f"{MARKET}, q AS (SELECT seller, quantile_cont(CAST(delivery_eur AS DOUBLE), [0, 0.25, 0.5, 0.75, 1]) AS q FROM mk WHERE delivery_eur IS NOT NULL GROUP BY 1) SELECT seller, round_even(q[1], 4) AS low, round_even(q[2], 4) AS q1, round_even(q[3], 4) AS median, round_even(q[4], 4) AS q3, round_even(q[5], 4) AS high FROM q",
    "wide_prices": f"{MATCHED}, l AS ({latest('2001-12-31')}) SELECT p.id, p.sku, "
    + ", ".join(f"min(l.price_eur) FILTER (l.competitor_id = 's{i}') AS s{i}_price, min(l.url) FILTER (l.competitor_id = 's{i}') AS s{i}_url" for i in range(12))
    + " FROM products p JOIN l ON l.product_id = p.id GROUP BY ALL",
    "upsert_listings": f"""{WITH}, k AS (SELECT md5(concat(competitor_id, '|', url)) AS id, * FROM shaped),
      b AS (SELECT *, scraped_at >= TIMESTAMP '1998-06-30' AS late FROM k QUALIFY row_number() OVER (PARTITION BY id, late ORDER BY scraped_at DESC, price_eur, title, coalesce(ean, ''), coalesce(mpn, ''), coalesce(brand, '')) = 1)
      SELECT id, coalesce(max(brand) FILTER (late), max(brand) FILTER (NOT late)) AS brand, coalesce(max(mpn) FILTER (late), max(mpn) FILTER (NOT late)) AS mpn, coalesce(max(ean) FILTER (late), max(ean) FILTER (NOT late)) AS ean,
        coalesce(max(price_eur) FILTER (late), max(price_eur) FILTER (NOT late)) AS price_eur FROM b GROUP BY 1""",
    "page_links": r"""WITH h AS (SELECT DISTINCT unnest(regexp_extract_all(html, '(?is)<a\s[^>]*?href=["'']([^"''#][^"'']*)["'']', 1)) AS href FROM pages),
      u AS (SELECT CASE WHEN regexp_matches(href, '^[a-zA-Z][a-zA-Z0-9+.-]*:') THEN href WHEN href LIKE '/%' THEN 'https://shop.test' || href ELSE 'https://shop.test/' || href END AS a FROM h WHERE NOT regexp_matches(href, '^(?i)(mailto|javascript|tel):'))
      SELECT DISTINCT regexp_replace(regexp_replace(a, '[?#].*$', ''), '/+$', '') AS link FROM u""",
    "page_titles": r"""SELECT url, trim(string_split(trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)), ' | ')[1]) AS title FROM pages""",
    "windowed_prices": f"{WITH} SELECT competitor_id, CAST(time_bucket(INTERVAL 7 DAY, CAST(scraped_at AS TIMESTAMP), TIMESTAMP '1970-01-01') AS DATE) AS start, count(*) AS n, min(price_eur) AS low FROM listings GROUP BY ALL",
    "search_batch": NORMED
    + r""",
tq AS (SELECT id, lower(title) AS f, regexp_extract_all(lower(title), '[a-z0-9]+') AS tk FROM products WHERE id % 50 = 0),
h AS (SELECT id, hay, regexp_extract_all(hay, '[a-z0-9]+') AS ht FROM (SELECT id, lower(concat_ws(' ', title, brand, mpn, sku, ean)) AS hay FROM products)),
s AS (SELECT tq.id AS q, h.id AS p, len(list_filter(tk, lambda x: list_contains(ht, x))) AS matched, len(tk) AS n, contains(hay, f) AS phrase,
    len(list_filter(range(1, len(tk)), lambda i: contains(hay, tk[CAST(i AS BIGINT)] || ' ' || tk[CAST(i + 1 AS BIGINT)]))) AS adjacent FROM tq, h)
SELECT 't' || q AS query_id, arg_max(p, (CASE WHEN matched = n THEN 1 ELSE 0 END, CASE WHEN phrase THEN 1 ELSE 0 END, adjacent, matched, p)) AS product_id, 'text' AS how FROM s WHERE matched > 0 GROUP BY 1
UNION ALL SELECT 'e' || np.id, t.id, 'ean' FROM np JOIN (SELECT nean, max(id) AS id FROM np GROUP BY 1) t USING (nean)
UNION ALL SELECT 'm' || id, max(id) OVER (PARTITION BY nmpn), 'mpn' FROM np
UNION ALL SELECT 's' || id, id, 'sku' FROM np""",
    "page_details": r"""SELECT url, CASE WHEN length(h) > 55 THEN left(h, 54) || '…' ELSE h END AS short, regexp_replace(regexp_replace(CASE WHEN regexp_matches(url, '^[a-zA-Z][a-zA-Z0-9+.-]*:') THEN url ELSE '/' || ltrim(url, '/') END, '[?#].*$', ''), '/+$', '') AS link
      FROM (SELECT url, trim(regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1)) AS h FROM pages)""",
    "title_numbers": f"""{WITH}, r AS (SELECT l.*, p.title AS p_title, p.mpn AS p_mpn FROM listings l JOIN products p ON p.id = CAST(regexp_extract(l.url, '/p/([0-9]+)/', 1) AS BIGINT)),
      b AS (SELECT *, trim(CASE WHEN brand IS NULL THEN title ELSE regexp_replace(title, '(?i)' || regexp_escape(brand), '', 'g') END) AS bare, list_transform(regexp_extract_all(lower(title), '[a-z0-9][a-z0-9./-]*[0-9][a-z0-9./-]*'), lambda w: regexp_replace(w, '[^a-z0-9]+', '', 'g')) AS models,
        regexp_replace(lower(p_title || ' ' || p_mpn), '[^a-z0-9]+', '', 'g') AS dense, string_split(regexp_replace(url, '/[0-9]+$', ''), '/')[-1] AS slug FROM r)
      SELECT id, nullif(regexp_extract(bare, '\\b(?:[0-9]{{2,4}}(?:[-\\s][0-9]{{2,4}}){{1,3}}|[0-9]{{6,8}})\\b', 0), '') AS title_mpn, CASE WHEN length(slug) BETWEEN 4 AND 8 THEN slug END AS url_mpn, price_eur AS price,
        CASE WHEN in_stock THEN CAST(round_even(price_eur / 25.0, 2) AS DECIMAL(10,2)) ELSE price_eur END AS eur, len(list_filter(models, lambda w: NOT contains(dense, w))) = 0 AS models_there FROM b""",
    "manufacturer_kpis": f"{MATCHED}, own AS (SELECT product_id, listing_id, price_eur FROM mo WHERE competitor_id = 's0' AND coalesce(nullif(trim(listing_brand), ''), product_brand) ILIKE '%brand#2%'), v AS (SELECT own.*, r.competitor_id AS store FROM own LEFT JOIN (SELECT DISTINCT product_id, competitor_id FROM mo WHERE competitor_id <> 's0') r USING (product_id)) SELECT count(DISTINCT listing_id) AS products, count(DISTINCT CASE WHEN store IS NOT NULL THEN listing_id END) AS with_match, (SELECT round_even(avg(CAST(price_eur AS DOUBLE)), 4) FROM own) AS avg_price, count(DISTINCT store) AS stores FROM v",
    "merged_brands": f"{PAIRS}, low AS (SELECT title, brand, opponent, min(opp_price) AS price, min(ref_price) AS ref_price FROM pr GROUP BY ALL), d AS (SELECT title, brand, opponent, (CAST(price AS DOUBLE) - CAST(min(ref_price) OVER (PARTITION BY title, brand) AS DOUBLE)) / CAST(min(ref_price) OVER (PARTITION BY title, brand) AS DOUBLE) * 100 AS d FROM low) SELECT brand, count(DISTINCT title) AS products, round_even(avg(d) FILTER (opponent IN ('s1', 's2')), 4) AS mean_delta FROM d GROUP BY 1",
    "stronger_products": f"{PAIRS}, low AS (SELECT title, brand, opponent, min(opp_price) AS price, min(ref_price) AS ref_price FROM pr GROUP BY ALL) SELECT title, brand, min(ref_price) AS ref_price, count(*) AS n_opponents FROM low GROUP BY ALL HAVING count(*) = count(*) FILTER ((CAST(price AS DOUBLE) - CAST(ref_price AS DOUBLE)) / CAST(ref_price AS DOUBLE) * 100 > 0.5)",
    "comparison_hits": f"{PAIRS}, t AS (SELECT count(DISTINCT product_id) AS total FROM mo WHERE competitor_id = 's0') SELECT opponent, count(DISTINCT product_id) AS hits, any_value(total) AS total, {pct('count(DISTINCT product_id)', 'any_value(total)')} AS rate FROM pr, t GROUP BY 1",
    "explore_skus": f"{POSITION}, tt AS (SELECT coalesce(product_ean, 'cluster:' || CAST(product_id AS VARCHAR)) AS key, left(arg_min(product_title, product_id), 120) AS title FROM mo GROUP BY 1) SELECT key, title, gap FROM pos LEFT JOIN tt USING (key) WHERE (contains(lower(key), 'brand#2') OR contains(lower(title), 'brand#2')) AND bucket = 'E' ORDER BY key LIMIT 300",
    "scatter_rows": f"{POSITION} SELECT key, own_price, best_price, gap FROM pos WHERE gap IS NOT NULL AND NOT outlier",
    "monopolies": f"{POSITION} SELECT key, own_price FROM pos WHERE key NOT IN (SELECT key FROM o WHERE store = 's1') ORDER BY key LIMIT 30",
    "position_page": f"{POSITION} SELECT key, bucket FROM pos ORDER BY key LIMIT 40 OFFSET 80",
    "top_brands": f"{WITH} SELECT brand, count(*) AS n FROM listings WHERE brand IS NOT NULL GROUP BY 1 ORDER BY n DESC, brand LIMIT 15",
    "own_brands": f"{WITH} SELECT DISTINCT trim(brand) AS brand FROM listings WHERE competitor_id = 's0' AND brand IS NOT NULL",
    "with_unlisted": f"{POSITION}, un AS (SELECT DISTINCT key FROM o WHERE key NOT IN (SELECT key FROM o WHERE store = 's0')) SELECT bucket, count(*) AS n FROM (SELECT bucket FROM pos UNION ALL SELECT 'N' FROM un) GROUP BY 1",
    "filtered_matches": f"{MATCHED} SELECT m.listing_id, m.product_id FROM m JOIN listings l ON l.id = m.listing_id WHERE confidence >= 0.9 AND competitor_id IN ('s1', 's2') AND in_stock AND lower(l.brand) LIKE '%brand#1%'",
    "restrict_by_brand": f"{MATCHED} SELECT listing_id AS row_id, product_id FROM m",
    "run_daily": f"{SNAPSHOTS} SELECT product_id, playbook, suggested_price FROM recs",
    "new_matches": f"{MATCHED} SELECT match_type, count(*) AS n FROM m JOIN listings l ON l.id = m.listing_id WHERE competitor_id IN ('s1', 's3', 's5', 's7', 's9', 's11') GROUP BY 1",
    "matching_run": f"{MATCHED}, r AS (SELECT m.match_type FROM m JOIN listings l ON l.id = m.listing_id WHERE competitor_id IN ('s1', 's3', 's5', 's7', 's9', 's11') UNION ALL SELECT 'derived_ean' FROM nl WHERE nean IS NOT NULL AND id NOT IN (SELECT listing_id FROM m)) SELECT match_type, 'approved' AS status, count(*) AS n FROM r GROUP BY 1",
    "matching_phases": f"{PHASES} SELECT * FROM run",
    "matching_counts": f"{PHASES} SELECT count(*) FILTER (match_type IN ('exact_ean', 'exact_mpn', 'regex_ean_title')) AS exact, count(*) FILTER (match_type IN ('mpn_no_brand', 'regex_mpn_title', 'regex_mpn_no_brand')) AS regex, 0 AS vector_llm, 0 AS pending, (SELECT count(*) FROM listings) - count(*) AS skipped FROM run",
    "matching_pool": f"{MATCHED} SELECT 'product' AS kind, nbrand AS block, count(*) AS n, min(CAST(id AS VARCHAR)) AS first FROM np GROUP BY nbrand UNION ALL SELECT 'listing', nbrand, count(*), min(CAST(id AS VARCHAR)) FROM nl WHERE id NOT IN (SELECT listing_id FROM m) GROUP BY nbrand",
    "ean_dry_run": f"{MATCHED} SELECT m.product_id, min(l.ean) AS ean FROM m JOIN listings l ON l.id = m.listing_id JOIN products p ON p.id = m.product_id WHERE l.ean IS NOT NULL AND (p.id % 3 = 0 OR p.ean IS NULL) GROUP BY 1",
    "catalogue_rows": f"{WITH} SELECT sku, brand, mpn, ean, trim(title) AS title, price_eur, id % 7 = 0 AS no_cost, CAST(id % 50 AS INT) AS stock FROM products WHERE id % 11 <> 0 AND id % 13 <> 0",
    "catalogue_errors": f"{WITH} SELECT sku, concat_ws(',', CASE WHEN id % 11 = 0 THEN 'price_eur' END, CASE WHEN id % 13 = 0 THEN 'stock' END) AS bad FROM products WHERE id % 11 = 0 OR id % 13 = 0",
    "upsert_catalogue": f"{WITH} SELECT id, sku, CASE WHEN sku LIKE '%1' AND id % 11 <> 0 AND id % 13 <> 0 THEN trim(title) ELSE title END AS title, CASE WHEN sku LIKE '%1' AND id % 11 <> 0 AND id % 13 <> 0 THEN price_eur ELSE 1 END AS price_eur FROM products",
    "feed_listings": f"{WITH} SELECT id AS competitor_sku, nullif(trim(brand), '') AS brand, mpn, ean, trim(title) AS title, price_eur, in_stock, url FROM listings WHERE competitor_id = 's1' AND length(url) % 9 <> 0",
    "offer_rows": f"{NORMED} SELECT nean AS ean, trim(title) AS title, competitor_id AS seller, url AS seller_url, price_eur, CASE WHEN length(url) % 3 <> 0 THEN CAST(length(url) % 7 AS DECIMAL(10,2)) END AS delivery_eur, CAST(scraped_at AS DATE) AS day FROM nl WHERE ean IS NOT NULL",
    "identifier_rows": f"{NORMED} SELECT DISTINCT nean AS ean, trim(title) AS title FROM nl WHERE nean IS NOT NULL",
    "reference_prices": f"{WITH} SELECT ean, price_eur AS reference_price FROM products WHERE ean IS NOT NULL",
    "ingested_listings": f"""{NORMED}, b AS (SELECT *, CASE WHEN ean IS NULL THEN nullif(trim(brand), '') END AS own FROM nl), p1 AS (SELECT nean, arg_min(brand, id) AS b FROM np WHERE nean IS NOT NULL AND nbrand IS NOT NULL GROUP BY 1)
      SELECT b.id, coalesce(own, p1.b) AS brand, CASE WHEN regexp_matches(lower(title), '\\bplated\\b') THEN 'Plated' WHEN regexp_matches(lower(title), '\\bbrushed (copper|tin|nickel|steel|brass)\\b') THEN 'Brushed metal'
        WHEN regexp_matches(lower(title), '\\bsteel\\b') THEN 'Steel' WHEN regexp_matches(lower(title), '\\bsmall\\b|\\bmedium\\b') THEN 'Small parts' ELSE 'Other' END AS category FROM b LEFT JOIN p1 USING (nean)""",
    "search_results": f"""{MATCHED}, new AS (SELECT * FROM mo WHERE competitor_id <> 's0' QUALIFY row_number() OVER (PARTITION BY product_id, competitor_id ORDER BY scraped_at DESC, listing_id DESC) = 1),
      r AS (SELECT product_id, count(*) AS n, min({{'p': price_eur, 'o': -epoch(CAST(scraped_at AS TIMESTAMP)), 'l': listing_id, 's': competitor_id}}) AS f FROM new GROUP BY 1),
      w AS (SELECT product_id, arg_max(price_eur, (scraped_at, listing_id)) AS own_price FROM mo WHERE competitor_id = 's0' GROUP BY 1)
      SELECT 's' || p.id AS query_id, p.id AS product_id, own_price, CAST(coalesce(r.n, 0) AS INT) AS n_rivals, r.f.p AS low, r.f.s AS low_store FROM products p LEFT JOIN r ON r.product_id = p.id LEFT JOIN w ON w.product_id = p.id""",
    "search_freshness": f"{MATCHED} SELECT product_id, date_diff('hour', max(CAST(scraped_at AS TIMESTAMP)), TIMESTAMP '1998-11-01') < 720 AND count(*) FILTER (scraped_at >= DATE '1998-10-02' AND competitor_id <> 's0') > 0 AS fresh FROM mo WHERE scraped_at <= DATE '1998-11-01' GROUP BY 1",
    "sparse_weights": f"""{WITH}, t AS (SELECT id, unnest(regexp_extract_all(lower(title), '[a-z0-9]{{2,}}')) AS w FROM products),
      h AS (SELECT id, CAST('0x' || md5(w)[1:8] AS BIGINT) AS h FROM t), s AS (SELECT id, CAST(h % 512 AS INT) AS bucket, sum(CASE WHEN h // 512 % 2 = 0 THEN 1 ELSE -1 END) AS s FROM h GROUP BY 1, 2 HAVING sum(CASE WHEN h // 512 % 2 = 0 THEN 1 ELSE -1 END) <> 0)
      SELECT id, bucket, round_even(CAST(s AS DOUBLE) / sqrt(CAST(sum(s * s) OVER (PARTITION BY id) AS DOUBLE)), 6) AS weight FROM s""",
    "listing_pairs": f"{MATCHED}, s AS (SELECT * FROM mo WHERE confidence >= 0.85) SELECT a.listing_id AS ref_listing, b.listing_id AS opp_listing, b.competitor_id AS opponent, a.product_brand AS brand, a.price_eur AS ref_price, b.price_eur AS opp_price, round_even((CAST(b.price_eur AS DOUBLE) - CAST(a.price_eur AS DOUBLE)) / CAST(a.price_eur AS DOUBLE) * 100, 4) AS delta FROM s a JOIN s b ON a.product_id = b.product_id AND a.competitor_id = 's0' AND b.competitor_id <> 's0'",
    "enriched_listings": f"{MATCHED} SELECT l.id, coalesce(nullif(trim(l.brand), ''), p.brand) AS brand, coalesce(nullif(trim(l.mpn), ''), p.mpn) AS mpn, coalesce(nullif(trim(l.ean), ''), p.ean) AS ean, coalesce(nullif(trim(l.ean), ''), p.ean, nullif(trim(l.mpn), ''), p.mpn) AS competitor_sku FROM listings l LEFT JOIN m ON m.listing_id = l.id LEFT JOIN products p ON p.id = m.product_id",
    "resolved_hits": f"""{MATCHED}, w AS (SELECT product_id, competitor_id AS store, url, CASE WHEN match_type LIKE '%ean%' THEN 1 WHEN match_type LIKE '%mpn%' THEN 2 ELSE 3 END AS strategy,
      len(list_intersect(list_distinct(regexp_extract_all(lower(title), '[a-z0-9]{{3,}}')), list_distinct(regexp_extract_all(lower(product_title), '[a-z0-9]{{3,}}')))) AS n FROM mo)
      SELECT product_id, store, strategy, url FROM w WHERE n >= 2 QUALIFY row_number() OVER (PARTITION BY product_id, store ORDER BY strategy, url) = 1""",
    "euro_prices": f"{WITH}, c AS (SELECT id, price_eur AS price, ['EUR', 'czk', 'PLN', 'XXX'][CAST(price_eur * 100 % 4 AS INT) + 1] AS currency FROM listings) SELECT id, currency, CAST(CASE currency WHEN 'EUR' THEN price WHEN 'czk' THEN round_even(CAST(price AS DOUBLE) / 24.37, 2) WHEN 'PLN' THEN round_even(CAST(price AS DOUBLE) / 4.31, 2) END AS DECIMAL(10,2)) AS price_eur FROM c",
    "jsonld_products": f"{WITH} SELECT 'https://shop.test/' || id AS url, title, brand, sku AS competitor_sku, ean, price_eur AS price, 'EUR' AS currency, id % 3 <> 0 AS in_stock FROM products",
    "page_items": r"""SELECT url, nullif(trim(regexp_extract(html, '(?is)<h1[^>]*>\s*([^<]+)', 1)), '') AS title, nullif(regexp_extract(html, '"product_code"\s*:\s*"([^"]*)"', 1), '') AS mpn FROM pages""",
    "review_counts": f"{MATCHED} SELECT CASE WHEN confidence >= 0.9 THEN 'approved' ELSE 'pending' END AS status, count(*) AS n FROM m GROUP BY 1",
    "upsert_offers": f"{MARKET} SELECT count(*) FILTER (seller >= 's3') AS inserted, count(*) FILTER (seller < 's3') AS updated FROM tot WHERE seller > 's1'",
    "rival_offers": f"{MATCHED}, new AS (SELECT * FROM mo WHERE competitor_id <> 's0' QUALIFY row_number() OVER (PARTITION BY product_id, competitor_id ORDER BY scraped_at DESC, listing_id DESC) = 1) SELECT 's' || CAST(product_id AS VARCHAR) AS query_id, row_number() OVER (PARTITION BY product_id ORDER BY price_eur, scraped_at DESC, listing_id) AS rank, listing_id FROM new QUALIFY rank <= 3",
}
