"""Normal forms and derived values of identifiers, titles, prices and texts, as Spark columns."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Brand spellings and what they stand for.
BRAND_ALIASES = {
    "KNIPEX GMBH": "KNIPEX",
    "KNIPEX GMBH & CO KG": "KNIPEX",
    "KNIPEX GMBH & CO. KG": "KNIPEX",
    "FEIN AG": "FEIN",
    "FEIN GMBH": "FEIN",
    "C. & E. FEIN GMBH": "FEIN",
    "WERA TOOLS": "WERA",
    "WERA GMBH": "WERA",
    "WIHA GMBH": "WIHA",
    "WIHA WERKZEUGE GMBH": "WIHA",
    "STANLEY TOOLS": "STANLEY",
    "STANLEY BLACK & DECKER": "STANLEY",
    "STANLEY BLACK&DECKER": "STANLEY",
    "IRWIN TOOLS": "IRWIN",
    "IRWIN INDUSTRIAL TOOLS": "IRWIN",
    "C.K TOOLS": "CK",
    "CK TOOLS": "CK",
    "C.K": "CK",
    "BAHCO AB": "BAHCO",
    "GEDORE TOOLS": "GEDORE",
    "BETA UTENSILI": "BETA",
    "STAHLWILLE GMBH": "STAHLWILLE",
}
# Words that do not count as title tokens.
STOP_WORDS = "na pre s z a so pri od do mm cm kg set kus ks sada the and for with von fur mit zu und die der das".split()
LOOSE_STOP_WORDS = "na pre v s z a so pri od do".split()

_letters = [chr(c) for a, b in ((0xC0, 0x250), (0x1E00, 0x1F00)) for c in range(a, b)]
_folded = [(c, "".join(x for x in unicodedata.normalize("NFD", c) if unicodedata.category(x) != "Mn")) for c in _letters]
_pairs = [(a, b) for a, b in _folded if a != b and len(b) == 1]
_FROM, _TO = "".join(a for a, _ in _pairs), "".join(b for _, b in _pairs)


def fold(c: Column) -> Column:
    """Letters without their diacritics."""
    return F.regexp_replace(F.translate(c, _FROM, _TO), r"\p{Mn}", "")


def blank_to_null(c: Column) -> Column:
    return F.when(F.trim(c) != "", F.trim(c))


def norm_brand(c: Column) -> Column:
    name = blank_to_null(fold(F.upper(F.trim(c))))
    aliases = F.create_map(*(F.lit(x) for pair in BRAND_ALIASES.items() for x in pair))
    return F.coalesce(F.try_element_at(aliases, name), name)


def norm_mpn(c: Column) -> Column:
    return blank_to_null(F.regexp_replace(fold(F.upper(F.trim(c))), r"[\s.\-]+", ""))


def norm_ean(c: Column) -> Column:
    digits = F.regexp_replace(F.trim(c.cast("string")), r"\.0*$", "")
    return F.when(digits.rlike("^[0-9]{8,14}$"), digits)


def strict_ean(c: Column) -> Column:
    ean = norm_ean(c)
    return F.when(F.length(ean).isin(8, 12, 13), ean)


def norm_title(c: Column) -> Column:
    return F.trim(F.regexp_replace(fold(F.lower(c)), "[^a-z0-9]+", " "))


def title_tokens(c: Column, mode: str = "strict") -> Column:
    """Distinct tokens of three characters or more. strict drops its stop words and numbers; loose keeps numbers."""
    found = F.regexp_extract_all(fold(F.lower(c)), F.lit("[a-z0-9]{3,}"), F.lit(0))
    if mode == "loose":
        return F.array_distinct(F.filter(found, lambda w: ~w.isin(LOOSE_STOP_WORDS)))
    return F.array_distinct(F.filter(found, lambda w: ~w.isin(STOP_WORDS) & ~w.rlike("^[0-9]+$")))


def dense(c: Column) -> Column:
    return F.regexp_replace(fold(F.lower(c)), "[^a-z0-9]+", "")


def model_tokens(c: Column) -> Column:
    found = F.regexp_extract_all(fold(F.lower(c)), F.lit(r"[a-z0-9][a-z0-9./-]*[0-9][a-z0-9./-]*"), F.lit(0))
    return F.array_distinct(F.filter(F.transform(found, lambda w: F.regexp_replace(w, "[^a-z0-9]+", "")), lambda w: w != ""))


def model_tokens_present(title: Column, other_title: Column, other_mpn: Column) -> Column:
    """Whether every model token of title is part of the other product's title and part number."""
    there = dense(F.concat_ws(" ", F.coalesce(other_title, F.lit("")), F.coalesce(other_mpn, F.lit(""))))
    return F.forall(model_tokens(title), lambda w: there.contains(w))


def mpn_candidates(c: Column) -> Column:
    """Part-number-like codes of a text, normalised, in the order of the four kinds, each once."""
    text = F.upper(F.translate(c, " ", " "))
    all_of = lambda p: F.regexp_extract_all(text, F.lit(p), F.lit(0))
    found = F.concat(
        all_of(r"\b[0-9]{2}[-\s][0-9]{2}[-\s][0-9]{3}\b"),
        all_of(r"(?<![0-9])[0-9]{7,8}(?![0-9])"),
        all_of(r"(?<![0-9])[0-9]{6}(?![0-9])"),
        all_of(r"\b[A-Z0-9]{2,}[-/][A-Z0-9]+(?:[-/][A-Z0-9]+)*\b"),
    )
    return F.array_distinct(F.filter(F.transform(found, norm_mpn), lambda x: x.isNotNull()))


def ean13_candidates(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit("(?<![0-9])[0-9]{13}(?![0-9])"), F.lit(0))


def mpn_from_slug(url: Column) -> Column:
    """First code of six digits or more in the last part of a url, else its longest of four or more."""
    codes = F.regexp_extract_all(F.replace(F.element_at(F.split(url, "/"), -1), F.lit(".htm"), F.lit("")), F.lit(r"\b[0-9]{4,8}\b"), F.lit(0))
    long_ = F.filter(codes, lambda x: F.length(x) >= 6)
    best = F.array_max(F.transform(codes, lambda x, i: F.struct(F.length(x).alias("n"), (-i).alias("i"), x.alias("x"))))["x"]
    return F.coalesce(F.get(long_, F.lit(0)), best)


#: Fixed value: part numbers in titles are two to four groups of 2 to 4 digits around dashes or spaces, or 6 to 8 digits.
TITLE_MPN = r"\b(?:[0-9]{2,4}(?:[-\s][0-9]{2,4}){1,3}|[0-9]{6,8})\b"


def mpn_from_title(title: Column, brand: Column) -> Column:
    """First part number of a title without its brand."""
    quoted = F.regexp_replace(F.coalesce(brand, F.lit("")), r"([^A-Za-z0-9 ])", r"\\$1")
    bare = F.trim(F.regexp_replace(title, F.concat(F.lit("(?i)"), quoted), F.lit("")))
    return blank_to_null(F.regexp_extract(bare, TITLE_MPN, 0))


def parse_price(c: Column) -> Column:
    """Number of a price text as decimal(10,2): the comma is the decimal sign unless a point follows it."""
    bare = F.regexp_replace(c, "(?i)€|eur|^\\s*od\\b|[\\s ]", "")
    plain = F.when(bare.contains(",") & bare.contains("."), F.replace(bare, F.lit(","), F.lit(""))).otherwise(F.replace(bare, F.lit(","), F.lit(".")))
    return plain.try_cast("decimal(10,2)")


def parse_stock(c: Column) -> Column:
    """Availability text: negative phrases win, unknown ones are null."""
    text = fold(F.lower(c))
    return F.when(text.rlike("nie je sklad|neni sklad|nedostup|vypredan|out ?of ?stock|soldout|na objednavku"), False).when(text.rlike("sklad|in ?stock|dostupn|ihned"), True)


#: Fixed value: units of a currency per euro.
RATES = {"CZK": 25.0}


def to_eur(price: Column, currency: Column, rates: dict[str, float] = RATES) -> Column:
    """Price in euros by units per euro, null for unknown currencies."""
    out = F.when(currency == "EUR", price.cast("decimal(10,2)"))
    for name, rate in rates.items():
        out = out.when(currency == name, F.bround(price / F.lit(rate), 2).cast("decimal(10,2)"))
    return out


def with_eur(rows: DataFrame, rates: DataFrame, price: str = "price", currency: str = "currency", out: str = "price_eur") -> DataFrame:
    """rows with out: the price in euros by a table of rates (currency, per_eur: units per euro), rounded to two digits; euros need
    no rate, unknown, null and zero rates give null. One rate counts per currency, the least; a column named out is replaced."""
    one = rates.where("per_eur > 0").groupBy(F.upper(F.trim("currency")).alias("__code")).agg(F.min("per_eur").cast("double").alias("__rate"))
    code = F.upper(F.trim(F.col(currency)))
    met = rows.drop(out).join(one, code == F.col("__code"), "left")
    eur = F.when(code == "EUR", F.col(price).cast("decimal(10,2)")).otherwise(F.bround(F.col(price) / F.col("__rate"), 2).cast("decimal(10,2)"))
    return met.withColumn(out, eur).drop("__code", "__rate")


def slug_sku(url: Column, prefix: str) -> Column:
    """prefix and the last part of a url's path, in capitals; null without one."""
    last = F.regexp_extract(canon_url(url), r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/]+/(?:.*/)?([^/]+)$", 1)
    return F.when(last != "", F.concat(F.lit(prefix), F.upper(last)))


def canon_url(c: Column, base: str = "") -> Column:
    absolute = F.when(c.rlike("^[a-zA-Z][a-zA-Z0-9+.-]*:"), c).when(c.startswith("/"), F.concat(F.lit(base.rstrip("/")), c)).otherwise(F.concat(F.lit(base.rstrip("/") + "/"), c))
    return F.regexp_replace(F.regexp_replace(absolute, "[?#].*$", ""), "/+$", "")


def classify_category(title: Column, brand: Column, rules: list[tuple[str, list[str]]], other: str = "Other") -> Column:
    """First group of rules (name, patterns) with a pattern in the folded title and brand. The rules are the caller's."""
    text = fold(F.lower(F.concat_ws(" ", F.coalesce(title, F.lit("")), F.coalesce(brand, F.lit("")))))
    out = F.lit(other)
    for name, patterns in reversed(rules):
        out = F.when(text.rlike("|".join(f"(?:{p})" for p in patterns)), F.lit(name)).otherwise(out)
    return out


def delta_pct(price: Column, ref: Column) -> Column:
    return F.when(ref != 0, (price.cast("double") - ref.cast("double")) / ref.cast("double") * 100)


def delta_class(delta: Column, threshold: float = 0.5) -> Column:
    return F.when(delta > threshold, "dearer").when(delta < -threshold, "cheaper").when(delta.isNotNull(), "equal")


def gap_bucket(gap: Column) -> Column:
    return F.when(gap.isNull(), "M").when(gap <= -10, "A").when(gap <= -2, "B").when(gap <= 2, "C").when(gap <= 10, "D").otherwise("E")


def is_outlier(gap: Column) -> Column:
    return F.coalesce(F.abs(gap) >= 300, F.lit(False))


def freshness(ts: Column, as_of: Column) -> Column:
    hours = (F.unix_timestamp(as_of.cast("timestamp")) - F.unix_timestamp(ts.cast("timestamp"))) / 3600
    return F.when(ts.isNull(), "never").when(hours < 26, "fresh").when(hours < 24 * 7, "recent").otherwise("stale")


def volume_tier(n: Column) -> Column:
    return F.when(n <= 0, None).when(n <= 500, "Small").when(n <= 5000, "Medium").when(n <= 25000, "Large").when(n > 25000, "Strategic")


def derive_sku(ean: Column, brand: Column, mpn: Column, title: Column) -> Column:
    return F.coalesce(F.concat(F.lit("derived-ean-"), ean), F.substring(F.concat(F.lit("derived-"), F.coalesce(brand, F.lit("")), F.lit("-"), mpn), 1, 80), F.concat(F.lit("derived-title-"), F.md5(title)))


def offer_key(ean: Column, product_id: Column) -> Column:
    return F.coalesce(blank_to_null(ean), F.concat(F.lit("cluster:"), product_id.cast("string")))


def ellipsize(c: Column, n: int) -> Column:
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n - 1), F.lit("…"))).otherwise(c)


def norm_query(c: Column) -> Column:
    return F.coalesce(norm_ean(c), norm_ean(F.regexp_replace(F.trim(c), r"[\s-]+", "")), F.regexp_replace(F.trim(c), r"\s+", " "))


def query_kind(c: Column) -> Column:
    q = F.trim(c)
    return F.when(norm_ean(q).isNotNull(), "ean").when(q.rlike(r"(?i)^[0-9]{2}[-\s][0-9]{2}[-\s][0-9]{3}$|^[A-Z0-9]{2,}(?:[-/][A-Z0-9]+)+$"), "mpn").otherwise("text")


def hash_embed(texts: list[Column], dims: int = 512) -> Column:
    """Unit vector of hashed tokens of two characters or more; zero for no tokens."""
    tokens = F.regexp_extract_all(fold(F.lower(F.concat_ws(" ", *texts))), F.lit("[a-z0-9]{2,}"), F.lit(0))
    hashed = F.transform(tokens, lambda w: F.conv(F.substring(F.md5(w), 1, 8), 16, 10).cast("long"))
    at = lambda k: F.aggregate(F.filter(hashed, lambda h: F.pmod(h, F.lit(dims)) == k), F.lit(0.0), lambda a, h: a + F.when(F.pmod(F.floor(h / dims), F.lit(2)) == 0, 1.0).otherwise(-1.0))
    v = F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), at)
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))
    return F.transform(v, lambda x: F.when(norm > 0, x / norm).otherwise(0.0).cast("float"))


def match_prompt(listing: Column, candidates: Column) -> Column:
    """Request text of a listing (struct brand, mpn, ean, title) and its numbered candidates (array of such structs)."""

    def lines(r: Column) -> Column:
        named = [F.concat(F.lit(f"{label}: "), c) for label, c in (("Brand", norm_brand(r["brand"])), ("MPN", r["mpn"]), ("EAN", r["ean"]), ("Title", norm_title(r["title"])))]
        return F.concat_ws("\n  ", *named)

    numbered = F.transform(candidates, lambda c, i: F.concat(F.lit("Candidate "), (i + 1).cast("string"), F.lit(":\n  "), lines(c)))
    return F.concat(F.lit("Which candidate is the same product as the listing, in the same size and variant?\n\nListing:\n  "), lines(listing), F.lit("\n\n"), F.array_join(numbered, "\n\n"), F.lit('\n\nAnswer with JSON only: {"match_index": 1-based number or null, "confidence": 0.0 to 1.0}'))


def parse_verdict(answer: Column, n: Column, least: float = 0.81) -> Column:
    """struct(match_index, confidence) of an answer, null unless it is sure enough and names one of n candidates."""
    data = F.from_json(F.regexp_extract(answer, r"(?s)\{.*\}", 0), "match_index string, confidence string")
    index, sure = data["match_index"].try_cast("int"), data["confidence"].try_cast("double")
    return F.when((sure >= least) & index.between(1, n), F.struct(index.alias("match_index"), F.bround(sure, 2).alias("confidence")))
