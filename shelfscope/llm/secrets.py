"""Secret scans: base patterns by kind, then linking of parts that make a credential only together.

Only DataFrame expressions. The scope of a part are the REACH code points before and behind it. The interval join between the
parts of a text is a sweep over one sorted array, forward with the last end and backward with the next start of the other
side, so no text is shuffled, no pairs are emitted and the work grows with the number of parts.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Kinds in the order in which spans with equal starts are listed: fixed values of the contract, then our own.
KINDS = ("assign", "access", "hex", "identifier", "weak", "endpoint")
#: Parts further apart than so many code points do not belong together.
REACH = 200
#: Rows of an array that are gathered before they are added to the whole, which would be copied for each row otherwise.
CHUNK = 128

ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: A run is matched whole, so a least length in the pattern drops the same matches as a check afterwards.
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
#: An access key without id must not be the tail of secret_access_key, so words before it do not end in ret; \b and no
#: look-behind, which not every engine has.
IDENTIFIER = r"""(?i)(?:access_?key_?id|\b(?:[a-z0-9_]*(?:[a-su-z0-9]|[a-df-z0-9]t|[a-qs-z0-9]et)_)?access_?key|client_?id|account_?id|user_?name|login)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.@=-]{4,}"""
WEAK = r"""(?i)(?:secret_?(?:access_?)?key|secret|token|passw(?:or)?d|pwd|passphrase|auth|api_?key|private_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]{4,}"""
ENDPOINT = r"(?i)(?:https?|jdbc|postgres|mysql|mongodb|redis|amqp|ftp)://[A-Za-z0-9._-]+(?::[0-9]+)?"

SPAN = "array<struct<start:int,kind:int,end:int>>"

#: Where a match of group 2 of ASSIGN begins in the whole match.
ASSIGN_HEAD = r"""(?i)^(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?"""
#: Literals, one of which every match of a pattern has, in lower case; looking for them is cheaper than the pattern.
HINTS = {"assign": ("passw", "secret", "token", "api"), "identifier": ("access", "client", "account", "user", "login")}
#: Code points of a block of a text that is masked.
BLOCK = 256


def with_matches(df: DataFrame, pattern: str, kind: str, hint: Column, head: str = "", least: int = 0) -> DataFrame:
    """df with the column kind: spans (start, place in KINDS, end) of all leftmost, non-overlapping matches in its column t where
    the hint holds; least: length of what follows head in a match.

    The pieces between matches and the matches themselves alternate, so running lengths give code point offsets. They are a
    column of their own, which the sweep reads in chunks.
    """
    pieces = F.arrays_zip(F.split("t", pattern, -1).alias("gap"), F.regexp_extract_all("t", F.lit(pattern), F.lit(0)).alias("hit"))

    def step(at: Column, p: Column) -> tuple[Column, Column, Column]:
        begin = at + F.length(p["gap"])
        end = begin + F.coalesce(F.length(p["hit"]), F.lit(0))
        long_enough = F.length(F.regexp_replace(p["hit"], head, "")) >= least if least else F.lit(True)
        span = F.struct(begin.alias("start"), F.lit(KINDS.index(kind)).alias("kind"), end.alias("end"))
        return end, p["hit"].isNotNull() & long_enough, span

    df = df.withColumn("pieces", F.when(hint, pieces))
    return df.withColumn(kind, swept(F.col("pieces"), F.lit(0), step, SPAN)).drop("pieces")


def swept(rows: Column, start: Column, step: Callable[[Column, Column], tuple[Column, Column, Column]], kind: str) -> Column:
    """Array of what step(carried, row) = (carried on, keep, value) keeps over the rows in their order."""
    none = F.expr(f"cast(array() as {kind})")

    def inner(s: Column, row: Column) -> Column:
        on, keep, value = step(s["at"], row)
        return F.struct(on.alias("at"), F.when(keep, F.concat(s["out"], F.array(value))).otherwise(s["out"]).alias("out"))

    def outer(s: Column, i: Column) -> Column:
        chunk = F.slice(rows, i * CHUNK + 1, CHUNK)
        return F.aggregate(chunk, F.struct(s["at"].alias("at"), none.alias("out")), inner, lambda t: F.struct(t["at"].alias("at"), F.concat(s["out"], t["out"]).alias("out")))

    chunks = F.sequence(F.lit(0), F.floor((F.size(rows) - 1) / CHUNK).cast("int"))
    return F.when(F.size(rows) > 0, F.aggregate(chunks, F.struct(start.alias("at"), none.alias("out")), outer, lambda s: s["out"])).otherwise(none)


def with_both_sweeps(df: DataFrame, rows: str, low: Column, high: Column, forth: Callable, back: Callable, kind: str) -> DataFrame:
    """df whose column rows has been swept forth from low, then back from high; forth and back give (carried on, row). Each sweep
    reads a column that is there, as an expression would be evaluated for every chunk."""
    one = lambda step: lambda at, x: (lambda on, row: (on, F.lit(True), row))(*step(at, x))
    df = df.withColumn(rows, F.reverse(swept(F.col(rows), low, one(forth), kind)))
    return df.withColumn(rows, swept(F.col(rows), high, one(back), kind))


def _span(x: Column, **more: Column) -> Column:
    return F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end"), *(c.alias(n) for n, c in more.items()))


def without_overlaps(df: DataFrame, weak: str, assign: str) -> DataFrame:
    """df without the spans of weak that overlap one of assign (two sorted arrays of spans, each without overlaps)."""
    of_assign = lambda x: x["kind"] == KINDS.index("assign")

    def carry(x: Column, at: Column, hit: Column, on: Column) -> tuple[Column, Column]:
        return F.when(of_assign(x), on).otherwise(at), _span(x, hit=x["hit"] | hit)

    both = (F.size(weak) > 0) & (F.size(assign) > 0)
    df = df.withColumn("sweep", F.when(both, F.array_sort(F.transform(F.concat(weak, assign), lambda x: _span(x, hit=F.lit(False))))))
    forth, back = (lambda at, x: carry(x, at, at > x["start"], F.greatest(at, x["end"]))), (lambda at, x: carry(x, at, x["end"] > at, x["start"]))
    df = with_both_sweeps(df, "sweep", F.lit(-1), F.lit(1 << 30), forth, back, "array<struct<start:int,kind:int,end:int,hit:boolean>>")
    kept = F.transform(F.filter("sweep", lambda x: ~of_assign(x) & ~x["hit"]), lambda x: _span(x))
    return df.withColumn(weak, F.when(both, kept).otherwise(F.col(weak))).drop("sweep")


def with_linked(df: DataFrame, reach: int = REACH) -> DataFrame:
    """df with linked: the spans of identifier, weak and endpoint whose complements lie within reach. All parts of a text are
    swept once forth, with the last ends of identifiers and secrets, and once back, with their next starts."""
    of = lambda x, *kinds: x["kind"].isin(*(KINDS.index(k) for k in kinds))
    is_id, is_secret = (lambda x: of(x, "access", "identifier")), (lambda x: of(x, "assign", "hex", "weak"))

    def step(at: Column, x: Column, near: Callable[[Column], Column], on: Callable[[Column], Column]) -> tuple[Column, Column]:
        carried = F.struct(F.when(is_id(x), on(at["id"])).otherwise(at["id"]).alias("id"), F.when(is_secret(x), on(at["secret"])).otherwise(at["secret"]).alias("secret"))
        return carried, _span(x, by_id=x["by_id"] | near(at["id"]), by_secret=x["by_secret"] | near(at["secret"]))

    forth = lambda at, x: step(at, x, lambda a: a + reach >= x["start"], lambda a: F.greatest(a, x["end"]))
    back = lambda at, x: step(at, x, lambda a: x["end"] + reach >= a, lambda a: x["start"])
    ends = lambda n: F.struct(F.lit(n).alias("id"), F.lit(n).alias("secret"))
    ids, secrets = F.size("access") + F.size("identifier") > 0, F.size("assign") + F.size("hex") + F.size("weak") > 0
    marked = F.transform(F.array_sort(F.concat(*KINDS)), lambda x: _span(x, by_id=F.lit(False), by_secret=F.lit(False)))
    df = df.withColumn("sweep", F.when(ids & secrets, marked))
    df = with_both_sweeps(df, "sweep", ends(-(1 << 30)), ends(1 << 30), forth, back, "array<struct<start:int,kind:int,end:int,by_id:boolean,by_secret:boolean>>")
    hits = F.filter("sweep", lambda x: of(x, "identifier") & x["by_secret"] | of(x, "weak") & x["by_id"] | of(x, "endpoint") & x["by_id"] & x["by_secret"])
    return df.withColumn("linked", F.when(F.size("sweep") > 0, F.transform(hits, lambda x: _span(x))).otherwise(F.expr(f"cast(array() as {SPAN})"))).drop("sweep")


def listed(spans: Column) -> Column:
    """kind:start:end by start, then kind, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ",")


def _scanned(docs: DataFrame) -> DataFrame:
    """r (the row of docs as a struct, so that no name of it can clash), t (its text, null: empty), base and spans."""
    df = docs.select(F.struct("*").alias("r"), F.coalesce(F.col("text"), F.lit("")).alias("t")).withColumn("low", F.lower("t"))
    has = lambda *words: reduce(lambda x, y: x | y, (F.col("low").contains(w) for w in words))
    sets = F.col("t").contains(":") | F.col("t").contains("=")
    df = with_matches(df, ASSIGN, "assign", sets & has(*HINTS["assign"]), ASSIGN_HEAD, 8)
    df = with_matches(df, ACCESS, "access", F.col("t").contains("AKIA"))
    df = with_matches(df, HEX, "hex", F.col("t").rlike(HEX))
    df = with_matches(df, IDENTIFIER, "identifier", sets & has(*HINTS["identifier"]))
    df = with_matches(df, ENDPOINT, "endpoint", F.col("t").contains("://"))
    # a weak secret needs an identifier or access key, so other texts are not searched for one
    ids = (F.size("access") > 0) | (F.size("identifier") > 0)
    df = with_matches(df, WEAK, "weak", ids)
    df = with_linked(without_overlaps(df, "weak", "assign"))
    df = df.withColumn("base", F.concat("assign", "access", "hex"))
    return df.select("r", "t", "base", F.concat("base", "linked").alias("spans"))


def scan(docs: DataFrame, base: str = "base", spans: str = "spans") -> DataFrame:
    """docs with the columns base (spans of assign, access and hex) and spans (these and linked parts).

    A weak identifier is reported if a secret lies within REACH of it, a weak secret if an identifier or access key
    does, an endpoint if both do. Null texts are empty; empty texts have no spans; repeated rows are scanned each by
    itself; columns of docs with these two names are replaced, all others pass through; an empty table gives an empty one.
    """
    return _scanned(docs.drop(base, spans)).select("r.*", F.col("base").alias(base), F.col("spans").alias(spans))


def scan_digest(docs: DataFrame) -> DataFrame:
    """doc_id, counts and digest of the base spans, and all spans, per row. Null and empty texts count 0 and have the digest
    of the empty string; repeated rows and null ids give a row each; an empty table gives an empty one; other columns are
    not read."""
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == KINDS.index(kind))).cast("long").alias(f"n_{kind}")
    return scan(docs).select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


def redacted(docs: DataFrame, mask: str = "[SECRET]") -> DataFrame:
    """docs with every span of the scan replaced by mask; overlapping spans count as one. Nulls stay null, empty texts and texts
    without spans as they are; repeated rows are masked each by itself; all columns pass through, n_chars as the new length
    where a text changes; an empty table gives an empty one.

    A text is cut into blocks once, and what lies between spans is put together from these, so the work grows with the text
    and its spans, not with their product."""
    df = _scanned(docs).withColumn("spans", F.array_sort("spans")).withColumn("hit", F.size("spans") > 0)
    ends = F.array(F.struct(F.length("t").alias("start"), F.lit(0).alias("kind"), F.length("t").alias("end")))

    def gap(at: Column, x: Column) -> tuple[Column, Column, Column]:
        return F.greatest(at, x["end"]), x["start"] >= at, F.struct(at.alias("start"), (x["start"] - at).alias("n"))

    df = df.withColumn("rows", F.when(F.col("hit"), F.concat("spans", ends)))
    df = df.withColumn("gaps", swept(F.col("rows"), F.lit(0), gap, "array<struct<start:int,n:int>>"))
    df = df.withColumn("blocks", F.when(F.col("hit"), F.regexp_extract_all("t", F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))))

    def piece(g: Column) -> Column:
        first = F.floor(g["start"] / BLOCK).cast("int")
        n = F.floor((g["start"] + g["n"] - 1) / BLOCK).cast("int") - first + 1
        joined = F.array_join(F.slice("blocks", first + 1, F.greatest(n, F.lit(0))), "")
        return F.when(g["n"] > 0, F.substr(joined, g["start"] - first * BLOCK + 1, g["n"])).otherwise(F.lit(""))

    clean = F.when(F.size("blocks") > 0, F.array_join(F.transform("gaps", piece), mask))
    df = df.withColumn("clean", F.when(F.col("hit"), clean).otherwise(F.col("r.text")))
    new = {"text": F.col("clean")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col("hit"), F.length("clean").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("r.n_chars"))
    return df.select(*(new.get(c, F.col("r").getField(c)).alias(c) for c in docs.columns))
