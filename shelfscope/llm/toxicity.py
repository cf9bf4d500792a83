"""Toxicity: subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A word's vector is the mean of the vectors of its character n-grams, with marks for its ends, hashed into one table, so
unseen misspellings and inflections share a known word's vectors. A text's vector is the mean over all its words; a softmax
layer scores it. Only n-grams whose share of texts differs between the labels beyond chance have vectors: the others would
let the model learn texts by heart.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .sample import labelled, remainder
from .store import extended, written

#: Bound of the sample on which the model is fitted, for each of the two labels.
PER_CLASS = 5000
BUCKETS = 1 << 18
SIZE = 8
GRAMS = (3, 4, 5, 6)
EPOCHS, BATCH, RATE, GAIN = 60, 256, 0.3, 40.0
#: An n-gram gets a vector if LEAST texts of the sample have it and its shares differ by SURE standard errors.
LEAST, SURE = 8, 5.0
#: Words whose scores a worker keeps, texts scored and words hashed at once.
KEPT, TOGETHER, WORDS_TOGETHER = 500_000, 256, 20_000
#: Odd numbers of 64 bits that spread hashes.
MULTIPLIER, MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
WORDS = re.compile(r"\w+")


def grams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The word (its place) and the bucket of every n-gram of the words, marks for their ends included; a word too long to be
    one of its n-grams is one as a whole. A word's buckets do not depend on the others."""
    if not words:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    codes = np.frombuffer("".join(f"<{w}>" for w in words).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    size = np.fromiter(map(len, words), np.int64, len(words)) + 2
    end = np.cumsum(size)
    of = np.repeat(np.arange(len(words)), size)
    left = end[of] - np.arange(len(codes))
    own, hashes, h = [], [], np.zeros(len(codes), np.uint64)
    for n in range(1, max(GRAMS) + 1):
        h = h[: len(codes) - n + 1] * MULTIPLIER + codes[n - 1 :]
        if n in GRAMS:
            at = np.flatnonzero(left[: len(h)] >= n)
            own.append(of[at])
            hashes.append(h[at])
    whole = np.flatnonzero(size > max(GRAMS))
    place = np.arange(len(codes)) - (end - size)[of]
    power = np.cumprod(np.full(int(size.max()), MULTIPLIER))  # wraps around, as hashes do
    own.append(whole)
    hashes.append(np.add.reduceat(codes * power[place], end - size)[whole])
    h = np.concatenate(hashes)
    h = (h ^ (h >> np.uint64(29))) * MIX
    return np.concatenate(own), ((h ^ (h >> np.uint64(32))) % np.uint64(BUCKETS)).astype(np.int64)


def words(text: str | None) -> list[str]:
    return WORDS.findall(text.lower()) if isinstance(text, str) else []


@dataclass
class Model:
    """What scoring needs of the trained parameters: the softmax margin of every row of the table, NaN for rows without a
    vector, and the threshold as a bias."""

    margin: np.ndarray
    bias: float

    def words(self, words: list[str]) -> np.ndarray:
        """Mean margin of the n-grams of each word that have a vector, 0 without any."""
        of, bucket = grams(words)
        own = self.margin[bucket]
        has = ~np.isnan(own)
        n = np.bincount(of[has], minlength=len(words))
        return np.bincount(of[has], own[has], len(words)) / np.maximum(n, 1)

    def scores(self, texts: list[str | None], kept: dict[str, float]) -> np.ndarray:
        out = np.zeros(len(texts))
        for i in range(0, len(texts), TOGETHER):
            parted = [words(t) for t in texts[i : i + TOGETHER]]
            new = list({w: None for ws in parted for w in ws if w not in kept})
            for j in range(0, len(new), WORDS_TOGETHER):
                some = new[j : j + WORDS_TOGETHER]
                kept.update(zip(some, self.words(some).tolist(), strict=True))
            for k, ws in enumerate(parted, i):
                out[k] = sum(map(kept.__getitem__, ws)) / len(ws) if ws else 0.0
            if len(kept) > KEPT:
                kept.clear()
        return 1 / (1 + np.exp(-np.clip(out + self.bias, -40, 40)))


def counted(texts: list[str | None], y: np.ndarray, counts: np.ndarray) -> None:
    """Adds to counts (label, bucket) the texts of each label that have an n-gram of the bucket, to its last column all texts
    with a word."""
    for text, label in zip(texts, y, strict=True):
        ws = list(dict.fromkeys(words(text)))
        if ws:
            counts[label, np.unique(np.concatenate([grams(ws[i : i + WORDS_TOGETHER])[1] for i in range(0, len(ws), WORDS_TOGETHER)]))] += 1
            counts[label, -1] += 1


def sure(n0, n1, all0: int, all1: int):
    """Whether n0 of all0 and n1 of all1 texts differ beyond chance; for arrays and for columns."""
    share, apart = (n0 + n1) / (all0 + all1), n1 / all1 - n0 / all0
    return (n0 + n1 >= LEAST) & (apart * apart > SURE**2 * (1 / all0 + 1 / all1) * share * (1 - share))


def bag_of(text: str | None, live: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
    """A text's number of words, and the places in live (sorted buckets) of its n-grams with their weights in its mean."""
    ws = words(text)
    counts = Counter(ws)
    weights, distinct, often = np.zeros(len(live)), list(counts), np.fromiter(counts.values(), float, len(counts))
    for i in range(0, len(distinct) if len(live) else 0, WORDS_TOGETHER):
        of, bucket = grams(distinct[i : i + WORDS_TOGETHER])
        at = np.minimum(np.searchsorted(live, bucket), len(live) - 1)
        has = live[at] == bucket
        of, at = of[has], at[has]
        n = np.bincount(of, minlength=1)
        weights += np.bincount(at, often[i + of] / n[of], len(live)) / len(ws)
    col = np.flatnonzero(weights)
    return len(ws), col, weights[col]


def train(texts: list[str | None], y: np.ndarray, seed: int = 5, totals: tuple[float, float] = (1, 1), back: np.ndarray | None = None) -> Model:
    """The model of texts at hand; every fifth text with a word is kept back, if back does not say which. Null and empty texts are
    not learnt from, equal texts count again, and without both labels every text scores the label there is (0 for none)."""
    y = np.asarray(y)
    has = np.array([bool(words(t)) for t in texts], bool)
    if back is None:
        back = has & ((np.cumsum(has) - 1) % 5 == 4)
    counts = np.zeros((2, BUCKETS + 1), np.int64)
    fit_on = has & ~back
    counted([t for t, f in zip(texts, fit_on, strict=True) if f], y[fit_on], counts)
    live = np.flatnonzero(sure(*counts[:, :-1], *np.maximum(counts[:, -1], 1)))
    return train_bags([bag_of(t, live) for t in texts], y, back, live, seed, totals)


def train_bags(bags: list[tuple[int, np.ndarray, np.ndarray]], y: np.ndarray, back: np.ndarray, live: np.ndarray, seed: int, totals: tuple[float, float]) -> Model:
    """Adagrad on the table and the softmax weights together. Texts come in a fixed order, so reruns agree.

    The texts kept back set the threshold; there an error counts as many texts as its label stands for, given the totals of
    the two labels (in proportion) that the sample was taken from. Texts without words are not learnt from. Without both
    labels there is nothing to learn: every text then scores the label there is (0 for no rows).
    """
    if len(set(y.tolist())) < 2:
        return Model(np.full(BUCKETS, np.nan, np.float32), 40.0 if len(y) and y[0] == 1 else -40.0)
    has = np.array([size > 0 for size, _, _ in bags])
    y, back, bags = y[has], back[has], [b for b in bags if b[0]]
    begin = np.cumsum([0, *(len(col) for _, col, _ in bags)])
    col = np.concatenate([np.zeros(0, np.int64), *(col for _, col, _ in bags)])
    val = GAIN * np.concatenate([np.zeros(0), *(val for _, _, val in bags)])

    rng = np.random.default_rng(seed)
    fit_on = np.flatnonzero(~back)
    table, weights, bias = rng.uniform(-0.5 / SIZE, 0.5 / SIZE, (max(len(live), 1), SIZE)), np.zeros((2, SIZE)), np.zeros(2)
    seen_t, seen_w, seen_b = np.full((len(table), 1), 1e-8), np.full((2, SIZE), 1e-8), np.full(2, 1e-8)

    def bag(at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        size = begin[at + 1] - begin[at]
        row = np.repeat(np.arange(len(at)), size)
        k = np.repeat(begin[at] - np.concatenate(([0], np.cumsum(size)[:-1])), size) + np.arange(size.sum())
        c, v = col[k], val[k]
        return row, c, v, np.stack([np.bincount(row, v * table[c, j], len(at)) for j in range(SIZE)], 1)

    for _ in range(EPOCHS):
        for at in np.array_split(rng.permutation(fit_on), max(1, len(fit_on) // BATCH)):
            row, c, v, x = bag(at)
            z = x @ weights.T + bias
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            g = (p - np.eye(2)[y[at]]) / len(at)
            to_bag = g @ weights
            grad = np.stack([np.bincount(c, v * to_bag[row, j], len(table)) for j in range(SIZE)], 1)
            gw, gb = g.T @ x, g.sum(0)
            seen_t += (grad**2).mean(1, keepdims=True)
            seen_w += gw**2
            seen_b += gb**2
            table -= RATE * grad / np.sqrt(seen_t)
            weights -= RATE * gw / np.sqrt(seen_w)
            bias -= RATE * gb / np.sqrt(seen_b)
    turn = weights[1] - weights[0]
    margin = np.full(BUCKETS, np.nan, np.float32)
    margin[live] = (GAIN * table @ turn)[: len(live)]
    if not len(bags):
        return Model(margin, 0.0)
    z = bag(np.arange(len(bags)))[3] @ turn
    use = back if len(set(y[back].tolist())) == 2 else ~back
    each = np.array(totals, float) / np.maximum(np.bincount(y[use], minlength=2), 1)
    return Model(margin, -threshold(z[use], y[use], each))


def threshold(z: np.ndarray, y: np.ndarray, each: np.ndarray) -> float:
    """The middle of the cuts with the least errors; an error on label c counts each[c]."""
    order = np.argsort(z, kind="stable")
    clean, toxic = np.cumsum(y[order] == 0) * each[0], np.cumsum(y[order] == 1) * each[1]
    errors = np.concatenate(([clean[-1]], clean[-1] - clean + toxic))
    best = np.flatnonzero(errors <= errors.min() + 1e-9)
    edges = np.concatenate(([z.min() - 1], np.sort(z), [z.max() + 1]))
    return float((edges[best[0]] + edges[best[-1] + 1]) / 2)


def fit(docs: DataFrame, labels: DataFrame, fold_mod: int = 5, held_out: int = 0, per_class: int = PER_CLASS) -> Model:
    """The model of a bounded sample of labelled rows of the folds that are not held out. Null and empty texts count as texts
    without words; labels other than 0 and 1, null ids and ids without a document are left out; equal texts count once.
    Without rows of both labels the model scores the label there is. Only doc_id, text and toxic are read.

    Texts stay in the tasks: these count which texts have an n-gram, in the part that is fitted on, then give each text as
    the weights of the few n-grams that differ between the labels. The driver gets those rows alone."""
    fold = remainder(F.col("__id"), fold_mod) != held_out
    spark = docs.sparkSession
    rows = labelled(docs.select("doc_id", "text"), labels, "toxic", fold, per_class).withColumn("digest", F.sha2(F.coalesce("text", F.lit("")), 256))
    first = Window.partitionBy("digest").orderBy("doc_id", "y")  # copies would make chance words look sure
    rows = rows.withColumn("__n", F.row_number().over(first)).where("__n = 1").drop("__n")
    rows = written(rows.withColumn("back", F.crc32("digest") % 5 == 4), "toxicity_sample")
    n = dict(labels.select(F.col("doc_id").alias("__id"), F.col("toxic").alias("y")).where(fold & F.col("y").isin(0, 1)).groupBy("y").agg(F.count("*")).collect())

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts = np.zeros((2, BUCKETS + 1), np.int64)
        for batch in batches:
            counted(batch["text"].tolist(), batch["y"].to_numpy(), counts)
        at = np.flatnonzero(counts.sum(0))
        yield pd.DataFrame({"bucket": at, "n0": counts[0, at], "n1": counts[1, at]})

    counts = rows.where("NOT back").mapInPandas(count, "bucket long, n0 long, n1 long").groupBy("bucket").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    counts = written(counts, "toxicity_counts")
    total = counts.where(F.col("bucket") == BUCKETS).first() or (0, 0, 0)
    chosen = counts.where(sure(F.col("n0"), F.col("n1"), max(total[1], 1), max(total[2], 1)) & (F.col("bucket") < BUCKETS))
    live = np.array(sorted(r["bucket"] for r in chosen.select("bucket").collect()), np.int64)
    sent = spark.sparkContext.broadcast(live)  # at most BUCKETS numbers

    def bags(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [bag_of(t, sent.value) for t in batch["text"]]
            yield batch[["doc_id", "y", "digest", "back"]].assign(size=[f[0] for f in found], col=[f[1] for f in found], val=[f[2] for f in found])

    kinds = dict(docs.dtypes)
    got = rows.mapInPandas(bags, f"doc_id {kinds['doc_id']}, y int, digest string, back boolean, size long, col array<int>, val array<double>").collect()
    got.sort(key=lambda r: (r["doc_id"], r["y"], r["digest"]))
    parts = [(r["size"], np.array(r["col"], np.int64), np.array(r["val"])) for r in got]
    y, back = np.array([r["y"] for r in got], np.int64), np.array([r["back"] for r in got], bool)
    return train_bags(parts, y, back, live, 5, (n.get(0, 1), n.get(1, 1)))


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """docs with score (0 to 1) and predicted. Null and empty texts score as a window without words. Rows are scored one
    by one; an empty table gives an empty one; columns named score and predicted are replaced."""
    docs = docs.drop("score", "predicted")
    sent = docs.sparkSession.sparkContext.broadcast(model)  # a fixed size: BUCKETS floats
    kept: dict[str, float] = {}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            score = sent.value.scores(batch["text"].tolist(), kept)
            yield batch.assign(score=score, predicted=(score >= 0.5).astype("int32"))

    return docs.mapInPandas(run, extended(docs, score="double", predicted="integer"))
