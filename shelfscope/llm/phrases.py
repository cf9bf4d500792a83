"""Phrase collocations, counted in counting quotient filters.

Frequent words get dense ids and an n-gram packs its ids into limbs of 64 bits. An invertible mix of the limbs spreads the
grams evenly; the first bits of the mixed gram are its quotient and all other bits its remainder, kept in full, so a filter
is a lossless table of counts: one bit per quotient that occurs, one bit per entry that ends a quotient's run, the remainders,
and a byte per count (large counts beside it). Each task fills a filter per shard (a range of quotients) from the texts it
holds, so what is shuffled is counted before; a shard's filters are sorted alike and merge into one.

Longer phrases are counted level by level: a phrase can reach the least count only if its two parts that leave out an end
word reach it, so grams without them are not counted at all. The filters of parts go to every task only while they are
small (BROADCAST entries); beyond that a level is counted without them, with the same result.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .sharding import numbered
from .store import written

LEAST, LONGEST, TOP = 100, 5, 2000
#: Words that a task holds before it counts their phrases, and that a shard is meant for.
CHUNK = 1 << 20
#: Different words that a task counts before it hands the counts on.
DIFFERENT = 1 << 17
#: Entries (and eight times as many bytes) up to which dictionaries and tables of parts are sent to every task.
BROADCAST = 1 << 22
ENDS = bytes.maketrans(b".,;:!?\n\x0b\x0c\r", b"\xff" * 10)
#: No UTF-8 text holds this byte.
END = b"\xff"
MIX = (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53)
UNMIX = tuple(pow(m, -1, 1 << 64) for m in MIX)


def tokens(text: bytes | None) -> list[bytes]:
    """Words of a UTF-8 text, A-Z in lower case, with END where a piece ends."""
    return (text or b"").lower().translate(ENDS).replace(END, b" \xff ").split()


# --- packed grams


def mixed(x: np.ndarray) -> np.ndarray:
    for m in MIX:
        x = (x ^ (x >> np.uint64(33))) * np.uint64(m)
    return x ^ (x >> np.uint64(33))


def unmixed(x: np.ndarray) -> np.ndarray:
    for m in UNMIX[::-1]:
        x = (x ^ (x >> np.uint64(33))) * np.uint64(m)
    return x ^ (x >> np.uint64(33))


def per_limb(bits: int) -> int:
    return 64 // bits


def packed(ids: np.ndarray, at: np.ndarray, m: int, bits: int) -> list[np.ndarray]:
    """Limbs of the m-grams of ids that start at `at`, mixed: the first limb depends on all words, so it alone tells nearly all
    grams apart; together the limbs tell all."""
    each, limbs = per_limb(bits), []
    for begin in range(0, m, each):
        limb = np.zeros(len(at), np.uint64)
        for j in range(begin, min(m, begin + each)):
            limb = (limb << np.uint64(bits)) | ids[at + j].astype(np.uint64)
        limbs.append(limb)
    for k, limb in enumerate(limbs[1:], 1):
        limbs[0] = limbs[0] ^ mixed(limb + np.uint64(k))
    return [mixed(limbs[0]), *limbs[1:]]


def unpacked(limbs: list[np.ndarray], m: int, bits: int) -> np.ndarray:
    """Rows of m word ids: the inverse of `packed`."""
    first = unmixed(limbs[0])
    for k, limb in enumerate(limbs[1:], 1):
        first = first ^ mixed(limb + np.uint64(k))
    each, out, plain = per_limb(bits), np.zeros((len(first), m), np.int64), [first, *limbs[1:]]
    for j in range(m):
        last = min(m, (j // each + 1) * each) - 1
        out[:, j] = (plain[j // each] >> np.uint64(bits * (last - j))) & np.uint64((1 << bits) - 1)
    return out


def summed(limbs: list[np.ndarray], counts: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Distinct grams in order, with the sums of their counts."""
    if not len(counts):
        return limbs, counts
    order = np.argsort(limbs[0], kind="stable") if len(limbs) == 1 else np.lexsort(limbs[::-1])
    limbs = [x[order] for x in limbs]
    new = np.ones(len(order), bool)
    new[1:] = np.logical_or.reduce([x[1:] != x[:-1] for x in limbs])
    first = np.flatnonzero(new)
    return [x[first] for x in limbs], np.add.reduceat(counts[order], first)


# --- filters


def filter_of(limbs: list[np.ndarray], counts: np.ndarray, shard_bits: int) -> bytes:
    """The counting quotient filter of the sorted, distinct grams of one shard (their first shard_bits bits are alike)."""
    n = len(counts)
    q = max(3, min((n - 1).bit_length(), 62 - shard_bits))
    kept = 64 - shard_bits - q  # bits of the remainder of the first limb
    quotient = ((limbs[0] << np.uint64(shard_bits)) >> np.uint64(64 - q)).astype(np.int64)
    occupied = np.zeros(1 << q, bool)
    occupied[quotient] = True
    ends = np.append(quotient[1:] != quotient[:-1], True)
    size = (kept + 7) // 8
    rest = (limbs[0] & np.uint64((1 << kept) - 1)).astype("<u8").view(np.uint8).reshape(n, 8)[:, :size]
    large = counts >= 255
    parts = [np.array([n, q, len(limbs), large.sum()], "<i8"), np.packbits(occupied), np.packbits(ends), rest.T, *(x.astype("<u8") for x in limbs[1:]), np.where(large, 255, counts).astype(np.uint8), counts[large].astype("<i8")]
    return b"".join(np.ascontiguousarray(x).tobytes() for x in parts)


def filter_read(blob: bytes, shard: int, shard_bits: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Grams and counts of a filter: the inverse of `filter_of`."""
    n, q, n_limbs, n_large = np.frombuffer(blob, "<i8", 4).tolist()
    at = 32

    def take(size: int, kind: str = "u1") -> np.ndarray:
        nonlocal at
        out = np.frombuffer(blob, kind, size, at)
        at += out.nbytes
        return out

    occupied = np.flatnonzero(np.unpackbits(take((1 << q) // 8)))
    ends = np.unpackbits(take((n + 7) // 8), count=n)
    kept = 64 - shard_bits - q
    size = (kept + 7) // 8
    rest = np.zeros((n, 8), np.uint8)
    rest[:, :size] = take(n * size).reshape(size, n).T
    quotient = occupied[np.cumsum(ends) - ends].astype(np.uint64)
    first = (quotient << np.uint64(kept)) | rest.view("<u8")[:, 0]
    if shard_bits:
        first = first | (np.uint64(shard) << np.uint64(64 - shard_bits))
    limbs = [first, *(take(n, "<u8").astype(np.uint64) for _ in range(n_limbs - 1))]
    counts = take(n).astype(np.int64)
    counts[counts == 255] = take(n_large, "<i8")
    return limbs, counts


# --- words


def _raw(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("binary").alias("raw"))


def word_counts(docs: DataFrame) -> DataFrame:
    """lang, word (binary), n."""

    def flush(counts: dict[str, Counter[bytes]]) -> Iterator[pa.RecordBatch]:
        for lang, n in counts.items():
            n.pop(END, None)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(n), pa.string()), pa.array(list(n), pa.binary()), pa.array(list(n.values()), pa.int64())], ["lang", "word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, Counter[bytes]] = {}
        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("raw"), strict=True):
                counts.setdefault(lang, Counter()).update(tokens(text.as_py()))
                if sum(map(len, counts.values())) >= DIFFERENT:
                    yield from flush(counts)
                    counts = {}
        yield from flush(counts)

    counts = _raw(docs).mapInArrow(run, "lang string, word binary, n long")
    return counts.groupBy("lang", "word").agg(F.sum("n").alias("n"))


def _ids(words: list[bytes], known: dict[bytes, int]) -> np.ndarray:
    """Word ids of a text, 0 for words without one and where a piece or the text ends."""
    get = known.get
    out = np.zeros(len(words) + 1, np.int32)
    out[:-1] = np.fromiter((get(w, 0) for w in words), np.int32, len(words))
    return out


def _blob(ids: np.ndarray) -> bytes:
    """Ids with one 0 at the place of several."""
    keep = ids != 0
    keep[1:] |= ids[:-1] != 0
    return ids[keep].astype("<i4").tobytes()


def encoded(docs: DataFrame, words: DataFrame, limit: int = BROADCAST) -> DataFrame:
    """ids: the texts as word ids, a row per chunk. The dictionary of frequent words goes to the tasks if it has at most
    `limit` entries and eight times as many bytes; else each text's own words are joined with it."""
    spark = docs.sparkSession
    n, size = words.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("word")), F.lit(0))).first()
    if n <= limit and size <= 8 * limit:
        known: dict[str, dict[bytes, int]] = {}
        for r in words.select("lang", "word", "id").collect():
            known.setdefault(r["lang"], {})[bytes(r["word"])] = r["id"]
        sent = spark.sparkContext.broadcast(known)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held, n, none = [], 0, {}
            for batch in batches:
                for lang, text in zip(batch.column("lang").to_pylist(), batch.column("raw"), strict=True):
                    held.append(_ids(tokens(text.as_py()), sent.value.get(lang, none)))
                    n += len(held[-1])
                    if n >= CHUNK:
                        yield pa.RecordBatch.from_arrays([pa.array([_blob(np.concatenate(held))], pa.binary())], ["ids"])
                        held, n = [], 0
            if held:
                yield pa.RecordBatch.from_arrays([pa.array([_blob(np.concatenate(held))], pa.binary())], ["ids"])

        return written(_raw(docs).mapInArrow(run, "ids binary"), "ids")

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [list(set(tokens(t.as_py()))) for t in batch.column("raw")]
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("lang"), pa.array(own, pa.list_(pa.binary()))], ["key", "lang", "own"])

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            blobs = []
            for raw, own in zip(batch.column("raw"), batch.column("own"), strict=True):
                blobs.append(_blob(_ids(tokens(raw.as_py()), {x["word"]: x["id"] for x in own.as_py()})))
            yield pa.RecordBatch.from_arrays([pa.array(blobs, pa.binary())], ["ids"])

    texts = written(_raw(docs).withColumn("key", F.monotonically_increasing_id()), "texts")
    own = texts.select("key", "lang", "raw").mapInArrow(split, "key long, lang string, own array<binary>").select("key", "lang", F.explode("own").alias("word"))
    own = own.join(words.hint("merge"), ["lang", "word"]).groupBy("key").agg(F.collect_list(F.struct("word", "id")).alias("own"))
    return written(texts.join(own.hint("merge"), "key").select("raw", "own").mapInArrow(spell, "ids binary"), "ids")


# --- phrases


def _starts(ids: np.ndarray, m: int, bits: int, parts: np.ndarray | None) -> np.ndarray:
    """Where an m-gram of frequent words starts, whose two (m-1)-grams may be frequent."""
    word = ids != 0
    ok = word[: len(ids) - m + 1].copy()
    for j in range(1, m):
        ok &= word[j : len(ids) - m + 1 + j]
    at = np.flatnonzero(ok)
    if parts is None:
        return at
    if not len(parts):
        return at[:0]
    short = np.unique(np.concatenate((at, at + 1)))
    key = packed(ids, short, m - 1, bits)[0]
    found = parts[np.minimum(np.searchsorted(parts, key), len(parts) - 1)] == key
    good = np.zeros(len(ids) + 1, bool)
    good[short[found]] = True
    return at[good[at] & good[at + 1]]


def _counter(m: int, bits: int, shard_bits: int, parts: Callable[[], np.ndarray | None]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def flush(held: list[np.ndarray]) -> pa.RecordBatch:
        ids = np.concatenate([*held, np.zeros(m, np.int32)])
        at = _starts(ids, m, bits, parts())
        limbs, counts = summed(packed(ids, at, m, bits), np.ones(len(at), np.int64))
        shard = (limbs[0] >> np.uint64(64 - shard_bits)).astype(np.int64) if shard_bits else np.zeros(len(counts), np.int64)
        edges = np.flatnonzero(np.diff(shard, prepend=-1)).tolist() + [len(shard)]
        pa.default_memory_pool().release_unused()
        blobs = [filter_of([x[a:b] for x in limbs], counts[a:b], shard_bits) for a, b in zip(edges, edges[1:], strict=False)]
        return pa.RecordBatch.from_arrays([pa.array([int(shard[a]) for a in edges[:-1]], pa.int64()), pa.array(blobs, pa.binary())], ["shard", "filter"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            for blob in batch.column("ids"):
                ids = np.frombuffer(blob.as_buffer(), "<i4")
                held += [ids, np.zeros(1, "<i4")]
                n += len(ids)
                if n >= CHUNK:
                    yield flush(held)
                    held, n = [], 0
        if held:
            yield flush(held)

    return run


def _merger(m: int, bits: int, shard_bits: int, least: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Merges the filters of each shard (rows come sorted by it), a few at a time, and gives the grams of `least` occurrences."""

    def done(limbs: list[np.ndarray], counts: np.ndarray) -> pa.RecordBatch:
        often = counts >= least
        limbs = [x[often] for x in limbs]
        words = unpacked(limbs, m, bits).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(0, words.size + 1, m), pa.int32()), pa.array(words.ravel(), pa.int32()))
        return pa.RecordBatch.from_arrays([lists, pa.array(counts[often], pa.int64()), pa.array(limbs[0].view(np.int64))], ["words", "a", "key"])

    def merge(held: list[tuple[list[np.ndarray], np.ndarray]]) -> tuple[list[np.ndarray], np.ndarray]:
        return summed([np.concatenate(x) for x in zip(*(h[0] for h in held), strict=True)], np.concatenate([h[1] for h in held]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, size = None, [], 0
        for batch in batches:
            for shard, blob in zip(batch.column("shard").to_pylist(), batch.column("filter"), strict=True):
                if shard != now and held:
                    yield done(*merge(held))
                    held, size = [], 0
                now = shard
                held.append(filter_read(blob.as_py(), shard, shard_bits))
                size += len(held[-1][1])
                if size > 2 * max(CHUNK, len(held[0][1])):
                    held = [merge(held)]
                    size = len(held[0][1])
        if held:
            yield done(*merge(held))

    return run


def counted(ids: DataFrame, m: int, bits: int, shard_bits: int, parts: np.ndarray | None, least: int) -> DataFrame:
    """words (m ids), a and key (the first limb) of every m-gram that occurs `least` times. parts: the sorted keys of all such
    (m-1)-grams, or None to do without."""
    sent = ids.sparkSession.sparkContext.broadcast(parts)
    filters = ids.mapInArrow(_counter(m, bits, shard_bits, lambda: sent.value), "shard long, filter binary")
    filters = filters.repartition("shard").sortWithinPartitions("shard")
    return written(filters.mapInArrow(_merger(m, bits, shard_bits, least), "words array<int>, a long, key long"), f"grams-{m}")


def phrases(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, limit: int = BROADCAST) -> DataFrame:
    """lang, words (ids), a for the words and phrases that occur `least` times, and word, the word of single ones, n, the
    number of all words of the language."""
    counts = written(word_counts(docs), "words")
    totals = counts.groupBy("lang").agg(F.sum("n").alias("total"))
    often = counts.where(F.col("n") >= least).select(F.struct("lang", "word", "n").alias("r"))
    # ids from 1 by place in sorted files of the shared folder, so no task numbers all words
    rows, size = numbered(often.select("r.*"), "lang", "word")
    words = written(rows.select("r.lang", "r.word", "r.n", (F.col("row") + 1).cast("int").alias("id")), "dictionary")
    ids = encoded(docs, words, limit)
    bits = max(1, size.bit_length())
    shards = max(1, (totals.agg(F.sum("total")).first()[0] or 0) // CHUNK)
    shard_bits = min(20, (shards - 1).bit_length())
    grams, parts = [], None
    for m in range(2, longest + 1):
        grams.append(counted(ids, m, bits, shard_bits, parts, least))
        n = grams[-1].count()
        if not n:
            break
        keys = grams[-1].select("key")
        parts = np.sort(keys.toPandas()["key"].to_numpy(np.int64).view(np.uint64)) if n <= limit else None
    out = words.select("lang", F.array("id").alias("words"), F.col("n").alias("a"), "id", "word")
    for g in grams:
        by_first = g.select("words", "a", F.element_at("words", 1).alias("id"))
        by_first = by_first.join(words.select("id", "lang"), "id").select("lang", "words", "a", F.lit(None).cast("int").alias("id"), F.lit(None).cast("binary").alias("word"))
        out = out.unionByName(by_first)
    return written(out.join(F.broadcast(totals), "lang") if totals.count() <= 10_000 else out.join(totals, "lang"), "phrases")


def scored(table: DataFrame) -> DataFrame:
    """lang, words, a, l, r, total, score of the phrases of `phrases` that no longer one of at least the same count holds.

    score is floor(1000 * a * total / (l * r)) of the cut with the least score, ties to the shortest first part. Products are
    decimals of 38 digits: counts up to 10**16 are exact."""
    whole = table.where(F.size("words") > 1)
    counts = table.select("words", F.col("a").alias("f"))
    cuts = whole.select("lang", "words", "a", "total", F.explode(F.expr("sequence(1, size(words) - 1)")).alias("k"))
    first = counts.select(F.col("words").alias("w1"), F.col("f").alias("l"))
    rest = counts.select(F.col("words").alias("w2"), F.col("f").alias("r"))
    cuts = cuts.withColumns({"w1": F.expr("slice(words, 1, k)"), "w2": F.expr("slice(words, k + 1, size(words) - k)")}).join(first, "w1").join(rest, "w2")
    score = F.expr("(cast(1000 * a as decimal(19, 0)) * cast(total as decimal(19, 0))) div (cast(l as decimal(19, 0)) * cast(r as decimal(19, 0)))")
    cuts = cuts.withColumn("score", score)
    best = cuts.groupBy("words").agg(F.first("lang").alias("lang"), F.first("a").alias("a"), F.first("total").alias("total"), F.min(F.struct("score", "k", "l", "r")).alias("b"))
    # a phrase inside a longer one of the same count is inside one that is a word longer, of that count too
    inner = whole.where(F.size("words") > 2).select(F.col("a").alias("outer"), F.explode(F.array(F.expr("slice(words, 1, size(words) - 1)"), F.expr("slice(words, 2, size(words) - 1)"))).alias("inside"))
    inner = inner.groupBy("inside").agg(F.max("outer").alias("outer"))
    best = best.join(inner, best["words"] == inner["inside"], "left").where("outer is null or 100 * outer < 100 * a")
    return best.select("lang", "words", "a", "b.l", "b.r", "total", "b.score")


def collocations(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, top: int = TOP, limit: int = BROADCAST) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's first `top` phrases by score, a (both descending) and phrase.

    Null languages are `und`, null and empty texts have no words, repeated rows count again, ties go by the phrase's bytes, an
    empty table gives an empty one; columns other than lang and text are not read."""
    table = phrases(docs, least, longest, limit)
    by_count = Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc())
    best = scored(table).withColumn("place", F.rank().over(by_count)).where(F.col("place") <= top).drop("place")
    best = written(best, "best")
    names = table.where("id is not null").select("id", "word")
    spelled = best.select("words", F.posexplode("words").alias("at", "id")).join(names, "id")
    spelled = spelled.groupBy("words").agg(F.sort_array(F.collect_list(F.struct("at", F.col("word").cast("string").alias("word")))).alias("s"))
    best = best.join(spelled, "words").withColumn("phrase", F.array_join(F.col("s.word"), " "))
    order = Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), "phrase")
    best = best.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= top)
    return best.select("lang", "rank", "phrase", "a", "l", "r", F.col("total").alias("n"), "score")
