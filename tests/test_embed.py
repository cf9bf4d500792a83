"""Hashed vectors, the encoder hook and the error channel of verifiers."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from shelfscope.functions import embed
from shelfscope.functions import normalise as N
from shelfscope.operators import matching as M

ROWS = [(1, "Knipex", "87-01", "4003773022022", "Cobra Zange 250mm"), (2, "Knipex", None, None, "Cobra Zange 180mm"), (3, None, None, None, "Wasserpumpenzange für Rohre"), (4, None, None, None, None), (5, "a", "b", "c", "d é")]
TEXTS = embed.TEXTS


def table(spark):
    return spark.createDataFrame(ROWS, "id long, brand string, mpn string, ean string, title string")


def test_vectors_of_all_forms_agree(spark):
    df, texts = table(spark), [F.col(c) for c in TEXTS]
    rows = df.select("id", embed.hash_vector(texts, 64).alias("dense"), N.hash_embed(texts, 64).alias("plain")).collect()
    sparse = {}
    for r in embed.sparse_vectors(df, texts, 64).collect():
        sparse.setdefault(r["id"], np.zeros(64))[r["bucket"]] = r["weight"]
    for r in rows:
        assert np.allclose(r["dense"], r["plain"], atol=1e-6) and np.allclose(r["dense"], sparse.get(r["id"], np.zeros(64)), atol=1e-6)
    dense = {r["id"]: np.array(r["dense"]) for r in rows}
    s = embed.sparse_vectors(df, texts, 64)
    got = {(r["a_id"], r["b_id"]): r["score"] for r in embed.sparse_cosine(s, s, 0.3).collect()}
    want = {(a, b): float(dense[a] @ dense[b]) for a in dense for b in dense if dense[a] @ dense[b] >= 0.3}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-5 for k in want)


def test_an_encoder_that_fails_is_marked(spark):
    def encode(texts):
        if texts.str.contains("180").any():
            raise OSError("no service")
        return pd.Series([[1.0, float(len(t))] if t else None for t in texts])

    rows = {r["id"]: r for r in embed.encoded(table(spark).withColumn("vector", F.lit("old")), encode, dims=8, batch=1).collect()}
    assert rows[1]["encoder"] == "own" and rows[1]["vector"][0] == 1.0 and rows[1]["encode_error"] is None
    assert (rows[2]["encoder"], rows[2]["encode_error"]) == ("hash", "OSError: no service") and len(rows[2]["vector"]) == 8
    assert (rows[4]["encoder"], rows[4]["encode_error"], set(rows[4]["vector"])) == ("hash", "no vector", {0.0})
    assert {r["encoder"] for r in embed.encoded(table(spark)).collect()} == {"hash"} and embed.encoded(table(spark).where("false")).count() == 0


def test_a_failing_verifier_is_counted(spark):
    rows = spark.createDataFrame([(i, f"p{i}", [{"pool_id": 10 + i, "score": 0.95}]) for i in range(6)], "listing_id long, prompt string, candidates array<struct<pool_id: long, score: double>>")

    def answers(prompts, candidates):
        if prompts.isin(["p1", "p4"]).any():
            raise OSError("no service")
        return prompts.map(lambda p: '{"match_index": 1, "confidence": 0.9}' if p != "p2" else '{"match_index": null, "confidence": 0.9}')

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1")
    try:
        said = M.verdicts(rows, answers)
        got = {r["listing_id"]: (r["pool_id"], r["error"], r["tries"]) for r in said.collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got[0] == (10, None, 1) and got[2] == (None, None, 1) and got[1] == got[4] == (None, "OSError: no service", 3)
    assert M.verdict_counts(said).first().asDict() == {"asked": 6, "accepted": 3, "rejected": 1, "failed": 2, "retries": 4}


def test_a_verifier_that_recovers_is_asked_again(spark, tmp_path):
    rows = spark.createDataFrame([(1, "p", [{"pool_id": 7, "score": 0.9}])], "listing_id long, prompt string, candidates array<struct<pool_id: long, score: double>>")
    mark = tmp_path / "asked"

    def answers(prompts, candidates):
        if not mark.exists():
            mark.write_text("")
            raise OSError("busy")
        return M.best_similarity(prompts, candidates)

    assert [(r["pool_id"], r["error"], r["tries"]) for r in M.verdicts(rows, answers).collect()] == [(7, None, 2)]
    assert M.verdict_counts(M.verdicts(rows.where("false"))).first()["asked"] == 0
