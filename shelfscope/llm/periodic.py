"""Periodic runs of words: stretches in which words q apart are identical, at least four periods long.

Seed and extend, on the diagonals of a text's comparison with itself. A run of period q holds 3 * q words (5 and 6 for q of 1
and 2) that recur q words later, so k-grams of that guaranteed overlap are the seeds. Periods are looked for in scales: for
the periods q from lo to (k + 1) / 2, k = 3 * lo (5 for the first), a k-gram inside a run of period q occurs next exactly q
words later, as a nearer occurrence would give the run a smaller period. So each occurrence is paired with the next one
alone: pairs grow with the text, not with the square of a frequent k-gram. A table of the furthest word covered per lag drops
seeds inside a stretch that has been extended.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import WORD

LEAST_WORDS, LEAST_PERIODS = 6, 4
FOUND = "struct<runs:array<struct<start:bigint,length:bigint,period:bigint>>,collapsed:binary,n_words:bigint>"


def _reach(w: np.ndarray, at: int, q: int, step: int) -> int:
    """How many positions from `at` on, in the direction of step, hold w[i] == w[i + q]; looked at in growing blocks."""
    length, end = 0, len(w) - q
    block = 32
    while True:
        a = at + step * length
        room = end - a if step > 0 else a + 1
        size = min(block, room)
        if size <= 0:
            return length
        same = w[a : a + size] == w[a + q : a + q + size] if step > 0 else (w[a - size + 1 : a + 1] == w[a - size + 1 + q : a + 1 + q])[::-1]
        if not same.all():
            return length + int(np.argmin(same))
        length, block = length + size, block * 2


def _repeated(pos: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Dense codes, and positions, of the grams that occur twice or more."""
    _, code, n = np.unique(code, return_inverse=True, return_counts=True)
    more = n[code] > 1
    return pos[more], code[more]


def runs_of(w: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of a sequence of word codes, by start, then period. Exact: grams get their codes by
    comparison, not by hashing."""
    n, out = len(w), []
    furthest: dict[int, int] = {}
    codes, held, lo, k = np.asarray(w, np.int64), 1, 1, 5
    pos, codes = _repeated(np.arange(n), codes)
    while len(pos) and n >= 4 * lo:
        here = np.full(n + 1, -1, np.int64)
        here[pos] = codes
        top, hi = len(pos) + 1, (k + 1) // 2
        # a k-gram is covered by grams of the scale before, each of which must occur twice too
        for off in dict.fromkeys([*range(held, k - held, held), k - held]):
            fits = pos <= n - off - held
            pos, codes = pos[fits], codes[fits]
            fits = here[pos + off] >= 0
            pos, codes = _repeated(pos[fits], codes[fits] * top + here[pos[fits] + off])
        order = np.argsort(codes, kind="stable")
        at, gram = pos[order], codes[order]
        lag = np.diff(at)
        seed = (gram[1:] == gram[:-1]) & (lag >= lo) & (lag <= hi)
        at, lag = at[:-1][seed], lag[seed]
        order = np.lexsort((at, lag))
        at, lag = at[order], lag[order]
        first = np.ones(len(at), bool)
        first[1:] = (lag[1:] != lag[:-1]) | (at[1:] != at[:-1] + 1)
        for i, q in zip(at[first].tolist(), lag[first].tolist(), strict=True):
            if furthest.get(q, -1) > i:
                continue
            left, right = _reach(w, i - 1, q, -1), _reach(w, i, q, 1)
            furthest[q] = i + right
            length = left + right + q
            if length >= max(LEAST_WORDS, LEAST_PERIODS * q):
                out.append((i - left, length, q))
        held, lo = k, hi + 1
        k = 3 * lo
    return sorted(out, key=lambda r: (r[0], r[2]))


def found_in(raw: bytes | None) -> tuple[list[tuple[int, int, int]], bytes, int]:
    """Runs of a UTF-8 text, the text without what they repeat, and its number of words."""
    words = (raw or b"").split()  # of bytes: at ASCII white space only
    if len(words) < LEAST_WORDS:
        return [], b" ".join(words), len(words)
    ids: dict[bytes, int] = {}
    runs = runs_of(np.fromiter((ids.setdefault(x, len(ids)) for x in words), np.int64, len(words)))
    if runs:
        edge = np.zeros(len(words) + 1, np.int64)
        for start, length, q in runs:
            edge[start + q] += 1
            edge[start + length] -= 1
        kept = np.flatnonzero(np.cumsum(edge[:-1]) == 0).tolist()
        return runs, b" ".join([words[i] for i in kept]), len(words)
    return runs, b" ".join(words), len(words)


def _found(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for batch in batches:
        rows = [found_in(x.as_py()) for x in batch]
        runs = [[{"start": s, "length": n, "period": q} for s, n, q in r[0]] for r in rows]
        kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
        yield pa.StructArray.from_arrays([pa.array(runs, kind), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.int64())], ["runs", "collapsed", "n_words"])


_found.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}


def with_runs(docs: DataFrame, text: str | Column = "text") -> DataFrame:
    """docs with runs (start, length and period in words), collapsed (its words without those that any run holds after its
    first period, joined by a space) and n_words.

    Each text is searched within its row, whole, in time and memory that grow with it by n log n at most. Null and empty texts
    have no runs and collapse to an empty text; repeated rows are searched each by itself; an empty table gives an empty one;
    columns of docs with these three names are replaced.
    """
    docs = docs.drop("runs", "collapsed", "n_words")
    found = F.arrow_udf(_found, FOUND)((F.col(text) if isinstance(text, str) else text).cast("binary"))
    rows = docs.select(F.struct("*").alias("r"), found.alias("f"))
    return rows.select("r.*", "f.runs", F.col("f.collapsed").cast("string").alias("collapsed"), "f.n_words")


def looped(docs: DataFrame) -> DataFrame:
    """doc_id and text, where every tenth document (by h = crc32 of the decimal doc_id) ends in a loop: with g = h div 10, its
    words from a = g mod n on repeat those of the first p = 1 + (n - a) div (3 + g mod 8). A null doc_id loops nothing."""
    words = docs.select("doc_id", "text", F.crc32(F.col("doc_id").cast("string")).alias("h"))
    words = words.withColumn("w", F.when(F.expr("h % 10 = 0"), F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(WORD), F.lit(0))))
    words = words.withColumns({"n": F.coalesce(F.size("w"), F.lit(0)), "g": F.expr("h div 10")})
    words = words.withColumn("a", F.expr("if(n > 0, cast(g % n as int), 0)")).withColumn("p", F.expr("cast(1 + (n - a) div (3 + g % 8) as int)"))
    loop = F.expr("array_join(slice(concat(slice(w, 1, a), flatten(array_repeat(slice(w, a + 1, p), cast((n - a + p - 1) div p as int)))), 1, n), ' ')")
    return words.select("doc_id", F.when(F.expr("n > 0"), loop).otherwise(F.col("text")).alias("text"))


def run_digest(docs: DataFrame) -> DataFrame:
    """Per row of docs (doc_id, text): n_runs; start, length, period and exponent_milli of the longest run (ties: smallest
    start, then period; nulls without runs); digests of all runs and of the collapsed text."""
    rows = with_runs(docs.select("doc_id", "text"))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    rows = rows.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("b"), F.sha2(F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise(F.lit("")), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    return rows.select("doc_id", "n_runs", (-F.col("b.start")).alias("start"), F.col("b.length").alias("length"), (-F.col("b.period")).alias("period"), F.expr("1000 * b.length div -b.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")
