"""Packing by lexical retrieval: within a shard, a BM25 inverted index returns unused neighbours of a seed document, which
fill its window greedily.

Documents are tokenized once and written with a lexical signature; the same pass counts in how many documents each token of
the vocabulary stands. Number of documents, document frequencies and mean length are those of all documents; their table has
at most as many rows as the vocabulary and goes to every task. Shards hold about SHARD tokens of documents with close
signatures: signature buckets are cut or joined by their token counts, so a bucket that holds a third of all tokens becomes
many shards. A shard of the index is searched and packed by one task; a seed's neighbours are those of its shard.
"""

from __future__ import annotations

import functools
import os
import re
import unicodedata
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from operator import attrgetter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import hand_back, leaving_nothing, small_batches, written

WINDOW = 2048
#: Stands at the end of every document.
CLOSE = 1
#: Tokens that a shard aims at, and buckets of signatures: the largest table that the driver sees.
SHARD, BUCKETS = 1_500_000, 4096
K1, B = 1.2, 0.75
#: Tokens in more than this share of all documents say nothing about them.
COMMON = 0.2
#: Pieces and words that a worker keeps; neighbours that are ranked first.
KEPT, FIRST = 400_000, 24


#: Punctuation whose runs are words of their own.
MARKS = b"!#$%&*+,./:;=?@|()-"
WORDY = re.compile(rb"[a-z\x80-\xff]*")
id_of = attrgetter("id")


def byte_letters() -> dict[int, str]:
    """The letters that byte-level vocabularies write for bytes: printable ones stand for themselves, the others follow."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}


class Encoder(dict):
    """Token ids (16 bits, as bytes) of pieces of text. White space never stands inside a token of this tokenizer and parts
    two of them, so pieces between white space are encoded once and kept. A piece of letters and then punctuation is two
    words to the tokenizer's model, which splits them by itself; any other piece goes through the whole tokenizer."""

    def __init__(self, path: str):
        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        if self.tokenizer.get_vocab_size() > 1 << 16:
            raise ValueError("the vocabulary needs more than 16 bits")
        self.model, self.letters = self.tokenizer.model, byte_letters()
        # whether the file cuts and lower-cases as the short way does; if not, all goes through the whole tokenizer
        self.lowers = self.tokenizer.normalizer is not None and self.tokenizer.normalizer.normalize_str("AbZ") == "abz"
        self.parts = self._ids("ab c") == self._ids("ab") + self._ids("c")
        self.plain = self.lowers and self.parts and all(self._ids(x) == [t.id for t in self.model.tokenize(x)] for x in ("plain", "words", "of", "letters", "--", "(%"))

    def _ids(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def word(self, word: bytes) -> bytes | None:
        """Ids of letters only or punctuation only; None if the model alone does not do: upper case above ASCII, letters
        that are not composed, other characters."""
        if not word.isascii():
            text = word.decode("utf-8")
            if not (text.isalpha() and text == text.lower() and unicodedata.is_normalized("NFC", text)):
                return None
            text = word.decode("latin-1").translate(self.letters)
        else:
            text = word.decode("ascii")
        ids = self[word] = array("H", map(id_of, self.model.tokenize(text))).tobytes()
        return ids

    def __missing__(self, piece: bytes) -> bytes:
        if len(self) > KEPT:
            self.clear()
        a = b = None
        if self.plain:
            head = piece.rstrip(MARKS)
            tail = piece[len(head) :]
            if not head:
                return self.word(tail)
            if head.isalpha() or WORDY.fullmatch(head):  # of bytes: ASCII letters, or those and characters above ASCII
                if not tail:
                    a, b = self.word(head), b""
                    if a is not None:
                        return a  # word() keeps it
                else:
                    a, b = self.get(head) or self.word(head), self.get(tail) or self.word(tail)
        if a is None or b is None:
            ids = array("H", self._ids(piece.decode("utf-8", "replace"))).tobytes()
        else:
            ids = a + b
        self[piece] = ids
        return ids

    def ids(self, text: bytes | None) -> np.ndarray:
        text = text or b""
        if not self.parts:
            return np.array([*self._ids(text.decode("utf-8", "replace")), CLOSE], np.uint16)
        if self.lowers and b"<|" not in text:  # else it may hold a special token's name, whose case counts
            text = text.lower()  # of bytes: A-Z only
        return np.frombuffer(b"".join([*map(self.__getitem__, text.split()), np.uint16(CLOSE).tobytes()]), np.uint16)


@functools.cache
def encoder(path: str) -> Encoder:
    """One per worker process, which tasks that follow each other share."""
    return Encoder(path)


def pairs(ids: np.ndarray) -> np.ndarray:
    """Pairs of adjacent tokens, of a document's ids without the closing one; of one token, the token."""
    own = ids[:-1].astype(np.uint64)
    return (own[:-1] << np.uint64(16)) | own[1:] if len(own) > 1 else own


def signature(t: np.ndarray) -> int:
    """The least hash of the pairs, as a bucket."""
    if not len(t):
        return 0
    h = t * np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xC2B2AE3D27D4EB4F)
    return int(h.min()) * 0x165667B19E3779F9 % (1 << 64) >> 52


def encoded(docs: DataFrame, tokenizer: str) -> DataFrame:
    """kind 0: doc_id, ids (binary, 16 bits each), n, bucket, place (tells equal rows apart) per row of docs; kind 1: place, a
    token, and n, in how many documents of a task it stands."""
    names = ["kind", "doc_id", "ids", "n", "bucket", "place"]

    def batch_of(kind: int, *columns: pa.Array) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(columns[0]), kind, np.int32)), *columns], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, seen, row = encoder(tokenizer).ids, np.zeros(1 << 16, np.int64), TaskContext.get().partitionId() << 33
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                ids = [encode(x) for x in part.column("raw").to_pylist()]
                of = np.repeat(np.arange(len(ids), dtype=np.uint32) << np.uint32(16), list(map(len, ids)))
                held = np.sort(of | np.concatenate(ids))
                seen += np.bincount(held[np.flatnonzero(np.concatenate(([True], held[1:] != held[:-1])))] & np.uint32(0xFFFF), minlength=1 << 16)
                buckets = [signature(pairs(x)) for x in ids]
                place = np.arange(row, row + len(ids))
                row += len(ids)
                yield batch_of(0, part.column("doc_id"), pa.array([x.tobytes() for x in ids], pa.binary()), pa.array(list(map(len, ids)), pa.int64()), pa.array(buckets, pa.int32()), pa.array(place))
        token = np.flatnonzero(seen)
        if len(token):
            yield batch_of(1, pa.nulls(len(token), pa.int64()), pa.nulls(len(token), pa.binary()), pa.array(seen[token]), pa.nulls(len(token), pa.int32()), pa.array(token))

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("raw"))
    with small_batches(docs.sparkSession):
        return written(rows.mapInArrow(leaving_nothing(run), "kind int, doc_id long, ids binary, n long, bucket int, place long"), "tokens")


@dataclass(frozen=True)
class Statistics:
    """Of all documents: their number, their mean length in tokens, and in how many each token stands."""

    n: int
    mean: float
    df: np.ndarray

    @staticmethod
    def of(rows: DataFrame) -> Statistics:
        n, total = rows.where("kind = 0").agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
        found = rows.where("kind = 1").groupBy("place").agg(F.sum("n").alias("n")).toPandas()  # at most one row per token of the vocabulary
        df = np.zeros(1 << 16, np.int64)
        df[found["place"].to_numpy(np.int64)] = found["n"].to_numpy(np.int64)
        return Statistics(n, total / max(n, 1), df)


def shard_plan(sizes: list[tuple[int, int]], aim: int = SHARD) -> list[tuple[int, int, int]]:
    """bucket, first shard, number of shards, from the tokens of each bucket: small neighbours share a shard."""
    plan, shard, held = [], 0, 0
    for bucket, n in sorted(sizes):
        if n > aim or held + n > aim:
            shard, held = shard + (held > 0), 0
        parts = -(-n // aim) if n > aim else 1
        plan.append((bucket, shard, parts))
        if parts > 1:
            shard += parts
        else:
            held += n
    return plan


class Index:
    """BM25 over the documents of a shard, with the statistics of all documents. Tokens of a large share of all documents are
    left out, and those of one document of the shard, which find nothing."""

    def __init__(self, docs: list[np.ndarray], known: Statistics):
        n = self.n = len(docs)
        length = np.fromiter(map(len, docs), np.int64, n)
        whole = np.concatenate(docs).astype(np.int64)
        doc = np.repeat(np.arange(n), length)
        useful = known.df <= max(2, COMMON * known.n)
        own = useful[whole]
        own[np.cumsum(length) - 1] = False  # the closing token
        key = np.sort((whole[own] << 32) | doc[own])
        new = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)
        tf, key = np.diff(np.append(new, len(key))), key[new]
        term, doc = key >> 32, key & 0xFFFFFFFF
        keep = np.bincount(term, minlength=1 << 16)[term] > 1
        term, doc, tf = term[keep], doc[keep], tf[keep]
        idf = np.log(1 + (known.n - known.df + 0.5) / (known.df + 0.5))
        self.weight = idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length[doc] / known.mean))
        self.posting, self.term_at = doc, np.searchsorted(term, np.arange((1 << 16) + 1))
        order = np.argsort(doc, kind="stable")
        self.of_doc, self.doc_at = term[order], np.searchsorted(doc[order], np.arange(n + 1))

    def neighbours(self, seed: int, used: np.ndarray) -> Iterator[int]:
        """Unused documents that share a token with the seed, best first, then in their order."""
        t = self.of_doc[self.doc_at[seed] : self.doc_at[seed + 1]]
        if not len(t):
            return
        begin, count = self.term_at[t], self.term_at[t + 1] - self.term_at[t]
        at = np.arange(count.sum()) + np.repeat(begin - np.concatenate(([0], np.cumsum(count)[:-1])), count)
        score = np.bincount(self.posting[at], self.weight[at], self.n)
        score[used] = 0
        hits = np.flatnonzero(score > 0)
        if len(hits) > FIRST:  # a window seldom needs more
            least = np.partition(score[hits], -FIRST)[-FIRST]
            best, hits = hits[score[hits] >= least], hits[score[hits] < least]
            yield from best[np.argsort(-score[best], kind="stable")].tolist()
        yield from hits[np.argsort(-score[hits], kind="stable")].tolist()


def packed(docs: list[np.ndarray], known: Statistics, window: int = WINDOW) -> list[tuple[int, int, int, int, int]]:
    """Pieces (document, start, length, sequence, offset). A window's seed is what begins it; its neighbours follow until it
    is full, the last one is cut and begins the next window. The last window is cut at powers of two: nothing is padded."""
    index, used, out = Index(docs, known), np.zeros(len(docs), bool), []
    sequence, offset, next_, queue = 0, 0, 0, iter(())
    for _ in range(len(docs)):
        doc = next((i for i in queue if not used[i]), None)
        seeds = doc is None or offset == 0
        if doc is None:
            while used[next_]:
                next_ += 1
            doc = next_
        used[doc] = True
        start = 0
        while start < len(docs[doc]):
            length = min(len(docs[doc]) - start, window - offset)
            out.append((doc, start, length, sequence, offset))
            start, offset = start + length, offset + length
            if offset == window:
                sequence, offset, seeds = sequence + 1, 0, start < len(docs[doc])
        if seeds and offset:
            queue = index.neighbours(doc, used.copy())
        elif not offset:
            queue = iter(())
    if not offset:
        return out
    last = [x for x in out if x[3] == sequence]
    out, free = out[: -len(last)], offset
    room = 1 << (free.bit_length() - 1)
    at = 0
    for doc, start, length, _, _ in last:
        while length:
            take = min(length, room - at)
            out.append((doc, start, take, sequence, at))
            start, length, at = start + take, length - take, at + take
            if at == room:
                free -= room
                sequence, at = sequence + 1, 0
                room = 1 << (free.bit_length() - 1) if free else 0
    return out


def pack(docs: DataFrame, tokenizer: str, window: int = WINDOW, aim: int = SHARD) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset per piece.

    Null and empty texts are one token, the closing one. Repeated rows and equal ids are documents of their own, as are
    rows with a null doc_id. Only doc_id and text are read. An empty table gives no pieces.
    """
    rows = encoded(docs, tokenizer)
    spark = docs.sparkSession
    known = spark.sparkContext.broadcast(Statistics.of(rows))
    rows = rows.where("kind = 0")
    sizes = [(r[0], r[1]) for r in rows.groupBy("bucket").agg(F.sum("n")).collect()]  # at most BUCKETS rows
    plan = F.broadcast(spark.createDataFrame(shard_plan(sizes, aim), "__bucket int, first int, parts int"))
    spread = F.pmod(F.xxhash64("doc_id", "place"), F.col("parts")).cast("int")
    rows = rows.join(plan, rows["bucket"] == plan["__bucket"]).select("doc_id", "ids", (F.col("first") + spread).alias("shard"))

    def run(shard: pd.DataFrame) -> pd.DataFrame:
        encoder.cache_clear()  # what this worker kept of the tokenizing stage
        hand_back()
        shard = shard.sort_values("doc_id" if shard["doc_id"].is_unique else ["doc_id", "ids"], na_position="first", ignore_index=True)
        ids = [np.frombuffer(x, np.uint16) for x in shard["ids"]]
        pieces = pd.DataFrame(packed(ids, known.value, window), columns=["doc", "start", "length", "sequence_id", "offset"])
        length = np.fromiter(map(len, ids), np.int64, len(ids))
        wide = memoryview(np.concatenate(ids).astype("<u4").view(np.uint8))
        begin = 4 * ((np.cumsum(length) - length)[pieces["doc"]] + pieces["start"].to_numpy())
        crc = [zlib.crc32(wide[a:b]) for a, b in zip(begin.tolist(), (begin + 4 * pieces["length"].to_numpy()).tolist(), strict=True)]
        own = shard["doc_id"].astype("Int64").to_numpy(dtype=object)[pieces["doc"]]
        return pd.DataFrame(
            {
                "doc_id": pd.array(own, dtype="Int64"),
                "start": pieces["start"],
                "length": pieces["length"],
                "ids_crc32": crc,
                "doc_tokens": length[pieces["doc"]],
                "sequence_id": pieces["sequence_id"] + (int(shard["shard"].iloc[0]) << 32),
                "offset": pieces["offset"],
            }
        )

    return rows.groupBy("shard").applyInPandas(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
