"""Hashed embeddings of product texts: dense vectors, sparse pairs, and a hook for encoders of the caller's."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfscope.functions import normalise as N

DIMS = 512
#: The texts of a product that are embedded, in this order.
TEXTS = ("brand", "mpn", "ean", "title")
TOKEN = re.compile("[a-z0-9]{2,}")


def folded(texts: list[Column]) -> Column:
    return N.fold(F.lower(F.concat_ws(" ", *texts)))


def vector_of(text: str | None, dims: int = DIMS) -> np.ndarray:
    """Unit vector of a folded text: each token of two characters or more adds its sign at its bucket, both read from the
    first eight hex digits of its md5; zero for no tokens."""
    v = np.zeros(dims)
    for w in TOKEN.findall(text or ""):
        h = int(hashlib.md5(w.encode()).hexdigest()[:8], 16)
        v[h % dims] += 1.0 if h // dims % 2 == 0 else -1.0
    n = np.sqrt((v * v).sum())
    return v / n if n else v


def hash_vector(texts: list[Column], dims: int = DIMS) -> Column:
    """Dense vectors, one pass over the tokens of a text. Equal to `normalise.hash_embed`, which is one expression."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([vector_of(t, dims).astype(np.float32) for t in batch.to_pylist()], pa.list_(pa.float32()))

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, "array<float>")(folded(texts))


def sparse_vectors(df: DataFrame, texts: list[Column], dims: int = DIMS) -> DataFrame:
    """id, bucket, weight: the parts of the hashed unit vectors that are not zero, by one explode of the tokens and a sum. Rows
    without tokens, or whose tokens cancel out, have none. Ids are unique."""
    tokens = F.regexp_extract_all(folded(texts), F.lit(TOKEN.pattern), F.lit(0))
    h = F.conv(F.substring(F.md5("w"), 1, 8), 16, 10).cast("long")
    rows = df.select("id", F.explode(tokens).alias("w")).select("id", (h % dims).cast("int").alias("bucket"), F.when(F.floor(h / dims) % 2 == 0, 1).otherwise(-1).alias("sign"))
    sums = rows.groupBy("id", "bucket").agg(F.sum("sign").alias("s")).where("s <> 0")
    norms = sums.groupBy("id").agg(F.sqrt(F.sum(F.col("s") * F.col("s"))).alias("norm"))
    return sums.join(norms, "id").select("id", "bucket", (F.col("s") / F.col("norm")).alias("weight"))


def sparse_cosine(a: DataFrame, b: DataFrame, floor: float = 0.0) -> DataFrame:
    """a_id, b_id, score of the pairs that share buckets, of at least floor (above 0): one join on the buckets."""
    both = a.select(F.col("id").alias("a_id"), "bucket", F.col("weight").alias("x")).join(b.select(F.col("id").alias("b_id"), "bucket", F.col("weight").alias("y")), "bucket")
    score = F.bround(F.sum(F.col("x") * F.col("y")), 6)
    return both.groupBy("a_id", "b_id").agg(score.alias("score")).where((F.col("score") >= floor) & (F.col("score") > 0))


def encoded(rows: DataFrame, encode: Callable[[pd.Series], pd.Series] | None = None, texts: list[Column] | None = None, dims: int = DIMS, batch: int = 256) -> DataFrame:
    """rows with vector, encoder and encode_error. encode gives a vector per text, `batch` texts at a time; where it fails, or
    gives none, the hashed vector of the row stands in, encoder is `hash` and encode_error says why. Without encode all are
    hashed. Columns of rows with these names are replaced."""
    rows = rows.drop("vector", "encoder", "encode_error")
    text = folded(texts or [F.col(c) for c in TEXTS])
    out = T.StructType([T.StructField("vector", T.ArrayType(T.FloatType())), T.StructField("encoder", T.StringType()), T.StructField("encode_error", T.StringType())])

    def one(part: list[str]) -> list[dict]:
        error, got = None, [None] * len(part)
        if encode is not None:
            try:
                got = list(encode(pd.Series(part)))
                if len(got) != len(part):
                    raise ValueError(f"{len(got)} vectors of {len(part)} texts")
            except Exception as e:  # noqa: BLE001  the encoder is the caller's; its failure is a column
                error, got = f"{type(e).__name__}: {e}", [None] * len(part)
        reason = error or ("no vector" if encode is not None else None)
        return [{"vector": [float(x) for x in v], "encoder": "own", "encode_error": None} if v is not None else {"vector": vector_of(t, dims).tolist(), "encoder": "hash", "encode_error": reason} for t, v in zip(part, got, strict=True)]

    kind = pa.struct([("vector", pa.list_(pa.float32())), ("encoder", pa.string()), ("encode_error", pa.string())])

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for b in batches:
            all_ = b.to_pylist()
            yield pa.array([r for at in range(0, len(all_), batch) for r in one(all_[at : at + batch])], kind)

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    done = rows.select(F.struct("*").alias("r"), F.arrow_udf(run, out)(text).alias("e"))
    return done.select("r.*", "e.*")
