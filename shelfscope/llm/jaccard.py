"""N-gram Jaccard join with a token-group matrix.

A document's set holds the hashes of its distinct five-word shingles; documents with equal sets are one class. Two classes
link when the Jaccard similarity of their sets reaches the threshold. The join is exact:

1. Prefixes. Of a set of n tokens in one global order only the first n - ceil(t n) + 1 can hold the first token that it
   shares with a linked set. Tokens that stand in many documents come last in that order, so passages that many documents
   share, licence lines and the like, make no candidates.
2. Groups. Classes that share prefix tokens are held against one class that has such a token (its hub), a number of checks
   linear in the rows; components of the links found are the groups of similar classes. The hub is the class with the
   fewest prefix tokens of its own: of a group of near copies the one with the fewest changes, which all others that can
   link at all are close to. So a large group of near copies becomes one group, with one row per token in the matrix.
3. Matrix. (token, group) rows of the prefix tokens that stand in two or more groups. A class is a query against the other
   groups: the number of its tokens that a group has bounds their overlap, as the tokens behind the shorter prefix are all
   that can still be common. Of the groups left, cut into parts of at most PART classes, a task takes the union of all tokens
   once; a query opens only parts whose union holds ceil(t n) of its n tokens, and only there is it compared with the members.
   One link per query and part is kept, as the members of a group are linked already.

Token rows of frequent tokens are salted, so that no run of equal tokens is longer than about RUN rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components
from .store import WORD, leaving_nothing, small_batches, written

WORDS = 5
PERCENT = 75
PART = 256
RUN = 4096
#: Tokens of queries that one part of a group answers at once.
BLOCK = 2_000_000
#: Documents whose tokens a task counts at once, and how often a token has to stand in them to be reported.
CHUNK, LOCAL = 3000, 3
#: A token is frequent from this share of the documents on (and from LEAST documents). So there are no more of them than
#: the mean set size over the share: that bounds the table which every task gets.
SHARE, LEAST = 2e-4, 64
KEPT = 200_000
#: Texts whose sets a task keeps, and the most shingles that one of them has.
TEXTS, SHORT = 256, 2000


#: Sets of a task's latest short texts, by their hash: copies, which often are many, are taken apart once.
_kept: dict[bytes, np.ndarray] = {}


def _forget() -> None:
    _kept.clear()


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _begins(x: np.ndarray) -> np.ndarray:
    """Where each distinct value of the sorted x begins."""
    return np.flatnonzero(np.concatenate((np.ones(min(len(x), 1), bool), x[1:] != x[:-1])))


def shingles(text: bytes | None, k: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a UTF-8 text's k-word shingles; with fewer words, of the whole sequence."""
    if (key := xxhash.xxh3_128_digest(text or b"") + bytes([k])) in _kept:
        return _kept[key]
    words = (text or b"").lower().split()  # of bytes: A-Z only, ASCII white space only
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    # digests are joined as bytes: a number object per word, or a table of words, takes longer and holds more
    h = np.frombuffer(b"".join(map(xxhash.xxh3_64_digest, words)), ">u8").astype(np.uint64)
    take, out = min(k, n), np.zeros(max(n - k + 1, 1), np.uint64)
    for i in range(take):
        out *= np.uint64(0x9E3779B97F4A7C15)
        out += h[i : i + len(out)]
    out += np.uint64(take)
    out = _mixed(out)
    out.sort()
    found = out[_begins(out)]
    if len(_kept) >= TEXTS:
        _forget()
    if len(found) <= SHORT:
        _kept[key] = found
    return found


def class_of(tokens: np.ndarray) -> int:
    return int.from_bytes(xxhash.xxh3_64_digest(tokens), "big", signed=True)


def prefix_size(n: int, percent: int = PERCENT) -> int:
    return n - -(-percent * n // 100) + 1


def _bytes(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("raw"), F.xxhash64("text").alias("sign"))


def _slices(batches: Iterator[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def _described(docs: DataFrame) -> DataFrame:
    """kind 0: doc_id, sign (hash of the text), n, class_id per row of docs (class_id null for empty sets); kind 1: token
    and a count of it in one chunk, copies counted once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, seen = [], set()

        def counts() -> pa.RecordBatch:
            every = np.concatenate(held)
            held.clear()
            every.sort()
            at = _begins(every)
            n = np.diff(at, append=len(every))
            often = n >= LOCAL
            token, n, none = every[at[often]].view(np.int64), n[often], [None] * int(often.sum())
            seen.clear()
            return pa.RecordBatch.from_arrays([pa.array([1] * len(n), pa.int32()), pa.array(none, pa.int64()), pa.array(none, pa.int64()), pa.array(n, pa.int64()), pa.array(token, pa.int64())], names)

        names = ["kind", "doc_id", "sign", "n", "token"]
        for batch in _slices(batches):
            sizes, classes = [], []
            for raw in batch.column("raw").to_pylist():
                tokens = shingles(raw)
                sizes.append(len(tokens))
                classes.append(class_of(tokens) if len(tokens) else None)
                if len(tokens) and classes[-1] not in seen:
                    seen.add(classes[-1])
                    held.append(tokens)
                if len(held) >= CHUNK:
                    yield counts()
            yield pa.RecordBatch.from_arrays([pa.array([0] * len(sizes), pa.int32()), batch.column("doc_id"), batch.column("sign"), pa.array(sizes, pa.int64()), pa.array(classes, pa.int64())], names)
        if held:
            yield counts()

    return written(_bytes(docs).mapInArrow(leaving_nothing(run, _forget), "kind int, doc_id long, sign long, n long, token long"), "shingle-sets")


def _frequent(described: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Frequent tokens, sorted, and the number of salts of each."""
    n_docs = described.where("kind = 0").count()
    least = max(LEAST, int(SHARE * n_docs))
    found = described.where("kind = 1").groupBy("token").agg(F.sum("n").alias("n")).where(F.col("n") >= least).toPandas()
    token = found["token"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(token)
    return token[order], np.maximum(1, found["n"].to_numpy()[order] // RUN + 1)


def _prefix_rows(docs: DataFrame, frequent: tuple[np.ndarray, np.ndarray], percent: int) -> DataFrame:
    sent = docs.sparkSession.sparkContext.broadcast(frequent)  # at most mean set size / SHARE tokens

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often, salts = sent.value
        seen: set[int] = set()
        for batch in _slices(batches):
            out = []
            for raw in batch.column("raw").to_pylist():
                tokens = shingles(raw)
                if not len(tokens) or (c := class_of(tokens)) in seen:
                    continue
                if len(seen) < KEPT:
                    seen.add(c)
                n, salt, hot = len(tokens), np.full(len(tokens), -1), 0
                if len(often):
                    at = np.minimum(np.searchsorted(often, tokens), len(often) - 1)
                    is_often = often[at] == tokens
                    salt = np.where(is_often, c % salts[at], -1)
                    hot, order = int(is_often.sum()), np.argsort(is_often, kind="stable")
                    tokens, salt = tokens[order], salt[order]
                p = prefix_size(n, percent)
                out.append((tokens[:p], salt[:p], np.full(p, c), np.full(p, n), np.full(p, hot)))
            if out:
                token, salt, c, n, hot = (np.concatenate(x) for x in zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(token.view(np.int64)), *(pa.array(x.astype(t)) for x, t in ((salt, np.int32), (c, np.int64), (n, np.int32), (hot, np.int32)))], ["token", "salt", "c", "n", "hot"])

    return _bytes(docs).mapInArrow(leaving_nothing(run, _forget), "token long, salt int, c long, n int, hot int")


def _shared(rows: DataFrame, percent: int) -> DataFrame:
    """token, salt, c, n, hot: the rows of runs (equal token and salt) that have a possible partner in their run, or are
    salted. Runs are sorted by Spark and passed through in batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["token", "salt", "c", "n", "hot"]
        rest = [np.zeros(0, t) for t in (np.int64, np.int32, np.int64, np.int32, np.int32)]

        def runs(cols: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            token, salt, c, n, hot = cols
            if not len(token):
                return
            new = np.concatenate(([True], (token[1:] != token[:-1]) | (salt[1:] != salt[:-1])))
            fresh = new | np.concatenate(([True], c[1:] != c[:-1]))
            token, salt, c, n, hot, new = (x[fresh] for x in (token, salt, c, n, hot, new))
            begin = np.flatnonzero(new)
            length = np.diff(np.append(begin, len(token)))
            several = np.repeat(length > 1, length) | (salt >= 0)
            token, salt, c, n, hot, length = token[several], salt[several], c[several], n[several], hot[several], length[(length > 1) | (salt[begin] >= 0)]
            if not len(token):
                return
            # a class has a partner only if the next larger or smaller set of the run is of a size that can link
            run_of = np.repeat(np.arange(len(length)), length)
            order = np.lexsort((n, run_of))
            near = (run_of[order][1:] == run_of[order][:-1]) & (n[order][:-1] * 100 >= n[order][1:].astype(np.int64) * percent)
            partner = np.zeros(len(token), bool)
            partner[order[1:]] |= near
            partner[order[:-1]] |= near
            keep = partner | (salt >= 0)
            if keep.any():
                yield pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in (token, salt, c, n, hot)], names)

        for batch in batches:
            cols = [np.concatenate((r, batch.column(x).to_numpy(zero_copy_only=False))) for r, x in zip(rest, names, strict=True)]
            token, salt = cols[0], cols[1]
            ends = np.flatnonzero((token[1:] != token[:-1]) | (salt[1:] != salt[:-1]))
            cut = int(ends[-1]) + 1 if len(ends) else 0  # the last run may go on
            yield from runs([x[:cut] for x in cols])
            rest = [x[cut:] for x in cols]
        yield from runs(rest)

    return rows.repartition("token", "salt").sortWithinPartitions("token", "salt", "c").mapInArrow(leaving_nothing(run), "token long, salt int, c long, n int, hot int")


def _hubs(shared: DataFrame, percent: int) -> DataFrame:
    """token, salt, hub, hub_own: of each run the class with the fewest prefix tokens that it shares with nobody, the least one of
    equals."""
    known = shared.groupBy("c").agg(F.first("n").alias("n"), F.count("*").alias("k"))
    own = known.select(F.greatest("c", "c").alias("__c"), (F.col("n") - _behind(F.col("n"), percent) - F.col("k")).cast("int").alias("own"))
    ranked = shared.join(own, shared["c"] == own["__c"]).groupBy("token", "salt").agg(F.min(F.struct("own", "c")).alias("h"))
    return written(ranked.select("token", "salt", F.col("h.c").alias("hub"), F.col("h.own").alias("hub_own")), "runs")


def _sets(docs: DataFrame, described: DataFrame, classes: DataFrame) -> DataFrame:
    """c, n, tokens of the given classes, from the text of one document each."""
    first = described.where("kind = 0").groupBy(F.col("token").alias("c")).agg(F.min(F.struct("doc_id", "sign")).alias("d"))
    need = first.join(classes.distinct(), "c").select("d.doc_id", "d.sign")
    need = written(need, "members").select(F.col("doc_id").alias("i"), F.col("sign").alias("s"))
    raw = _bytes(docs)
    # the same plan at every size: the list of documents grows with the corpus, so it is never sent to all tasks
    texts = raw.join(need.hint("merge"), raw["doc_id"].eqNullSafe(need["i"]) & (raw["sign"] == need["s"]), "left_semi").select("raw")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in _slices(batches):
            rows = []
            for raw in batch.column("raw").to_pylist():
                tokens = shingles(raw)
                if (c := class_of(tokens)) not in seen:
                    seen.add(c)
                    rows.append((c, len(tokens), tokens.view(np.int64)))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.list_(pa.int64()))], ["c", "n", "tokens"])

    return written(texts.mapInArrow(leaving_nothing(run, _forget), "c long, n int, tokens array<long>"), "sets")


def _similar(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of classes whose sets reach the threshold."""
    x, y = (sets.select(F.col("c").alias(f"{k}_c"), F.col("n").alias(f"{k}_n"), F.col("tokens").alias(f"{k}_t")) for k in "xy")
    both = pairs.join(x, pairs["a"] == x["x_c"]).join(y, F.col("b") == y["y_c"])
    both = both.where((F.col("x_n") * 100 >= F.col("y_n") * percent) & (F.col("y_n") * 100 >= F.col("x_n") * percent))
    common = F.size(F.array_intersect("x_t", "y_t"))
    return both.where(common * 100 >= (F.col("x_n") + F.col("y_n") - common) * percent).select("a", "b")


def _close(a: Column, b: Column, percent: int) -> Column:
    return (a * 100 >= b * percent) & (b * 100 >= a * percent)


def _least_overlap(a: Column, b: Column, percent: int) -> Column:
    """Common tokens that sets of these sizes need to link."""
    return F.ceil((a + b) * percent / (100 + percent) - 1e-9)


def _behind(n: Column, percent: int) -> Column:
    """Tokens of a set behind its prefix."""
    return F.ceil(n * percent / 100) - 1


def linked(docs: DataFrame, percent: int = PERCENT) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, sign, n_shingles, class_id) of all documents, and links (a, b) between classes.

    The links connect all classes that are connected by pairs of the threshold or more, and all are such pairs; pairs
    inside a group that is connected already are not all listed.
    """
    with small_batches(docs.sparkSession):  # all Python steps run in here
        return _linked(docs, percent)


def _linked(docs: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    described = _described(docs)
    rows = described.where("kind = 0").select("doc_id", "sign", F.col("n").alias("n_shingles"), F.col("token").alias("class_id"))
    shared = written(_shared(_prefix_rows(docs, _frequent(described), percent), percent), "shared")

    # hubs; of salted tokens also the hubs of all salts against the purest of them
    hubs = _hubs(shared, percent)
    of = hubs.select(F.greatest("token", "token").alias("__t"), F.greatest("salt", "salt").alias("__s"), "hub")
    own = shared.join(of, (F.col("token") == F.col("__t")) & (F.col("salt") == F.col("__s"))).select(F.col("c").alias("a"), F.col("hub").alias("b"))
    salted = hubs.where("salt >= 0")
    top = salted.groupBy("token").agg(F.min(F.struct("hub_own", "hub")).alias("top")).select(F.greatest("token", "token").alias("__t"), F.col("top.hub").alias("top"))
    tops = salted.join(top, salted["token"] == top["__t"]).select(F.col("hub").alias("a"), F.col("top").alias("b"))
    pairs = own.unionByName(tops).where("a <> b").groupBy("a", "b").agg(F.count("*").alias("k"))
    size = shared.groupBy("c").agg(F.first("n").alias("n"))
    pairs = pairs.join(size.select(F.greatest("c", "c").alias("a1"), F.col("n").alias("a_n")), F.col("a") == F.col("a1")).join(size.select(F.greatest("c", "c").alias("b1"), F.col("n").alias("b_n")), F.col("b") == F.col("b1"))
    pairs = pairs.where(_close(F.col("a_n"), F.col("b_n"), percent))
    pairs = pairs.where(F.col("k") + _behind(F.greatest("a_n", "b_n"), percent) >= _least_overlap(F.col("a_n"), F.col("b_n"), percent)).select("a", "b")
    pairs = written(pairs, "hubs")
    sets = _sets(docs, described, pairs.select(F.col("a").alias("c")).unionByName(pairs.select(F.col("b").alias("c"))))
    links = written(_similar(pairs, sets, percent), "links")
    return rows, links.unionByName(_matrix(docs, described, shared, links, percent))


def _matrix(docs: DataFrame, described: DataFrame, shared: DataFrame, links: DataFrame, percent: int) -> DataFrame:
    """Links between the groups that links makes. The smaller group of two asks; the larger one is opened in parts.

    Two classes can link through a rare token, whose matches are counted, or through frequent tokens only. A class has
    frequent tokens in its prefix only if all its rare ones are there too; without a common rare one the overlap is at most
    the smaller of the two numbers of frequent tokens, which keeps classes apart that share one long passage.
    """
    groups = written(components(links), "groups")
    sizes = groups.groupBy("component").agg(F.count("*").alias("size"))
    groups = groups.join(sizes.select(F.greatest("component", "component").alias("__g"), "size"), F.col("component") == F.col("__g"))
    of = groups.select(F.col("node").alias("__c"), F.col("component").alias("__g"), "size")
    rows = shared.join(of, F.col("c") == F.col("__c"), "left")
    own_hot = F.greatest(F.lit(0), F.col("n") - _behind(F.col("n"), percent) - (F.col("n") - F.col("hot")))
    rows = rows.select("token", "c", "n", "hot", (F.col("salt") >= 0).alias("often"), own_hot.alias("prefix_hot"), F.coalesce("__g", "c").alias("g"), F.coalesce("size", F.lit(1)).alias("size"))
    rows = rows.withColumn("part", F.pmod("c", F.ceil(F.col("size") / PART)).cast("int"))
    rows = written(rows, "token-groups")
    matrix = rows.groupBy("token", "g", "part").agg(F.first("size").alias("g_size"), F.min("n").alias("low"), F.max("n").alias("high"), F.max("hot").alias("m_hot"), F.max("prefix_hot").alias("m_prefix_hot"))
    several = matrix.groupBy("token").agg(F.min("g").alias("g1"), F.max("g").alias("g2")).where("g1 < g2").select(F.greatest("token", "token").alias("__t"))
    matrix = written(matrix.join(several, F.col("token") == F.col("__t"), "left_semi"), "matrix")
    matrix = matrix.select(F.col("token").alias("m_token"), F.col("g").alias("m_g"), F.col("part").alias("m_part"), "g_size", "low", "high", "m_hot", "m_prefix_hot")

    fits = (F.col("n") * 100 >= F.col("low") * percent) & (F.col("high") * 100 >= F.col("n") * percent) & (F.struct("size", "g") < F.struct("g_size", "m_g"))
    both = rows.join(matrix, (rows["token"] == matrix["m_token"]) & fits & (~F.col("often") | (F.least("hot", "m_hot") >= _least_overlap(F.col("n"), F.greatest(F.col("low"), F.ceil(F.col("n") * percent / 100)), percent))))
    asks = both.groupBy("c", "m_g", "m_part").agg(F.count_if(~F.col("often")).alias("rare"), F.max("often").alias("often"), F.least(F.first("prefix_hot"), F.max("m_prefix_hot")).alias("common_hot"), F.first("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"))
    asks = asks.withColumn("k", F.col("rare") + F.col("common_hot"))
    # the bound is loosest for a member of the largest size that can link
    largest = F.least(F.col("high"), F.floor(F.col("n") * 100 / percent))
    least = F.greatest(F.col("low"), F.ceil(F.col("n") * percent / 100))
    loose = lambda m: F.col("k") + _behind(F.greatest(F.col("n"), m), percent) >= _least_overlap(F.col("n"), m, percent)
    asks = written(asks.where(F.col("often") | loose(largest) | loose(least)).select("c", "n", "m_g", "m_part"), "asks")

    members = rows.select("c", "g", "part").distinct()
    members = written(members.join(asks, (F.col("g") == F.col("m_g")) & (F.col("part") == F.col("m_part")), "left_semi"), "members")
    sets = _sets(docs, described, asks.select("c").unionByName(members.select("c")))
    # queries of one part are dealt to as many blocks as their tokens ask for; each gets the members
    blocks = asks.groupBy("m_g", "m_part").agg(F.ceil(F.sum("n") / BLOCK).cast("int").alias("blocks"))
    blocks = written(blocks.select(F.col("m_g").alias("b_g"), F.col("m_part").alias("b_part"), "blocks"), "blocks")
    asking = asks.join(blocks, (F.col("m_g") == F.col("b_g")) & (F.col("m_part") == F.col("b_part"))).select("m_g", "m_part", F.pmod("c", "blocks").cast("int").alias("block"), F.lit(1).alias("asks"), "c")
    asked = members.join(blocks, (F.col("g") == F.col("b_g")) & (F.col("part") == F.col("b_part"))).select(F.col("g").alias("m_g"), F.col("part").alias("m_part"), F.explode(F.expr("sequence(0, blocks - 1)")).alias("block"), F.lit(0).alias("asks"), "c")
    both = asked.unionByName(asking).join(sets.select(F.col("c").alias("__c"), "tokens"), F.col("c") == F.col("__c")).drop("__c")
    key = ["m_g", "m_part", "block"]
    both = both.repartition(*key).sortWithinPartitions(*key, "asks", "c")
    return written(both.mapInArrow(leaving_nothing(lambda batches: _opened(batches, percent)), "a long, b long"), "links")


def _opened(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """One link (a, b) of each query a to the least member b that it links to, of a part of a group. The part's members come
    first; their union bounds the overlap, and only parts whose union holds enough of the query are opened."""
    key, members, union = None, [], None
    for batch in _slices(batches):
        a, b = [], []
        columns = [batch.column(k).to_pylist() for k in ("m_g", "m_part", "block", "asks", "c")]
        held = batch.column("tokens")
        for at, (g, part, block, asks, c) in enumerate(zip(*columns, strict=True)):
            tokens = held[at].values.to_numpy(zero_copy_only=False)
            if key != (g, part, block):
                key, members, union = (g, part, block), [], None
            if not asks:
                members.append((c, tokens))
                continue
            if union is None:
                size = np.array([len(t) for _, t in members])
                of = np.repeat(np.arange(len(members)), size)
                whole = np.concatenate([t for _, t in members])
                order = np.argsort(whole, kind="stable")
                union, begin, length = np.unique(whole[order], return_index=True, return_counts=True)
                of = of[order]
            place = np.minimum(np.searchsorted(union, tokens), len(union) - 1)
            place = place[union[place] == tokens]
            n = len(tokens)
            if len(place) * 100 < n * percent:
                continue
            first, count = begin[place], length[place]
            each = np.repeat(first - np.concatenate(([0], np.cumsum(count)[:-1])), count) + np.arange(count.sum())
            common = np.bincount(of[each], minlength=len(members))
            found = np.flatnonzero(common * 100 >= (n + size - common) * percent)
            if len(found):
                a.append(c)
                b.append(members[found[0]][0])
        if a:
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def _classes(rows: DataFrame, links: DataFrame) -> DataFrame:
    """class, component (its least class) and the kept row of the class: k = (doc_id is null, doc_id, sign)."""
    tops = written(components(links), "components")
    first = rows.where("class_id is not null").groupBy("class_id").agg(F.min(F.struct(F.isnull("doc_id").alias("none"), "doc_id", "sign")).alias("k"))
    return first.join(tops, first["class_id"] == tops["node"], "left").select("class_id", "k", F.coalesce("component", "class_id").alias("top"))


def grouped(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles and component_id, the least doc_id that links reach, for every row of docs.

    Null, empty and wordless texts have no shingles and their own component. Equal texts are linked. Rows with a null
    doc_id take part; a component of such rows only has a null component_id. Columns other than doc_id and text are not
    read. An empty table gives an empty one.
    """
    rows, links = linked(docs, percent)
    classes = _classes(rows, links)
    lows = classes.groupBy("top").agg(F.min("k.doc_id").alias("component_id")).select(F.greatest("top", "top").alias("__top"), "component_id")
    classes = written(classes.join(lows, classes["top"] == lows["__top"]).select(F.col("class_id").alias("__class"), "component_id"), "classes")
    out = rows.join(classes, rows["class_id"] == classes["__class"], "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("class_id").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def one_per_group(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """docs with one row of each group: that of the least doc_id (nulls last), of several texts with it the one with the least
    hash, of equal rows any one. A group is told by texts, so unlinked texts under one doc_id all stay. Rows without words are
    in no group and all stay. Other columns pass through, whatever their names. An empty table gives an empty one.
    """
    rows, links = linked(docs, percent)
    keep = _classes(rows, links).groupBy("top").agg(F.min("k").alias("k")).select(F.col("k.doc_id").alias("__keep"), F.col("k.sign").alias("__kept_sign"))
    keep = written(keep.distinct(), "kept")
    worded = F.coalesce(F.col("text").rlike(WORD), F.lit(False))
    some = docs.where(worded).withColumn("__sign", F.xxhash64("text"))
    some = some.join(keep, F.col("doc_id").cast("long").eqNullSafe(keep["__keep"]) & (F.col("__sign") == keep["__kept_sign"]), "left_semi")
    return some.dropDuplicates(["doc_id", "__sign"]).drop("__sign").unionByName(docs.where(~worded))
