"""Phrases, periodic runs, shards."""

import hashlib
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfscope.llm import periodic, phrases, queries, sharding
from shelfscope.llm.store import new_path
from tests.checked import agree
from tests.conftest import SMALL
from tests.llm import brute

# --- shards


@pytest.mark.parametrize("n", [1, 2, 3, 7, 8, 9, 1000, 4097])
def test_permutation_and_its_inverse(n):
    rows = np.arange(n)
    p = sharding.permuted(rows, n)
    assert sorted(p) == rows.tolist() and (sharding.permuted(p, n, back=True) == rows).all()
    shard, slot = sharding.place_of(rows, n, 8)
    assert (sharding.row_at(shard, slot, n, 8) == rows).all()
    assert n < 9 or (p != sharding.permuted(rows, n, seed=99)).any()


def check_shards(rows, texts):
    """rows: doc_id, size, text_crc32, law, shard, slot, grown_shard."""
    raw = [(i, (t or "").encode()) for i, t in texts]
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == Counter((i, len(t) + 1, zlib.crc32(t)) for i, t in raw)
    assert {(r["law"], r["grown_shard"]) for r in rows} <= {("rows", None)}
    held = {}
    for r in rows:
        held.setdefault(r["shard"], []).append(r["slot"])
    sizes = [len(held.get(s, [])) for s in range(8)]
    assert max(sizes) - min(sizes) <= 1 and all(sorted(x) == list(range(len(x))) for x in held.values()) and set(held) <= set(range(8))


def test_shards_of_odd_rows(spark):
    texts = [(1, "a"), (1, "a"), (1, "b"), (None, None), (None, None), (None, "é😀"), (7, ""), (2, "x " * 40_000)] + [(5, "same")] * 60
    docs = spark.createDataFrame(texts, "doc_id long, text string").withColumns({"shard": F.lit("clash"), "r": F.lit(1), "tie": F.lit(2)})
    rows = sharding.shard_digest(docs).collect()
    check_shards(rows, texts)
    again = sharding.shard_digest(docs.orderBy(F.desc("text")).repartition(7)).collect()
    assert Counter(rows) == Counter(again)
    assert sharding.shard_digest(docs.where("false")).collect() == []
    kept = sharding.placed(docs, 3).drop("slot")
    assert kept.columns == ["doc_id", "text", "r", "tie", "shard"] and dict(kept.dtypes)["shard"] == "int"


def test_numbers_follow_the_order(spark):
    ids = [(i * 37 % 101,) for i in range(101)]
    rows, n = sharding.numbered(spark.createDataFrame(ids, "doc_id long").repartition(9), "doc_id")
    assert n == 101 and all(r["row"] == r["r"]["doc_id"] for r in rows.collect())


def test_shards_can_be_computed_and_read_by_slot(spark):
    docs = spark.range(1000).select(F.col("id").alias("doc_id"), F.col("id").cast("string").alias("text"))
    path = new_path(spark, "shards")
    sharding.write_shards(sharding.placed(docs), path, block=16)
    got = {r["slot"]: r["doc_id"] for r in sharding.read_slots(spark, path, 3, 30, 50, block=16).collect()}
    assert got == dict(zip(range(30, 50), sharding.row_at(np.full(20, 3), np.arange(30, 50), 1000, 8).tolist(), strict=True))
    assert spark.read.parquet(path).count() == 1000


@pytest.mark.parametrize("name", ["op11_phrases", "op13_sharding"])
def test_query_agrees_with_sql(spark, name):
    assert agree(spark, queries.queries()[name], queries.oracle_sql()[name], SMALL) > 0


# --- runs


def sequences():
    rng = np.random.default_rng(12)
    for t in range(1500):
        if t % 2:
            yield rng.integers(0, rng.integers(1, 4), rng.integers(0, 120))
        else:
            yield np.concatenate([np.tile(rng.integers(0, rng.integers(1, 4), rng.integers(1, 14)), rng.integers(1, 9)) for _ in range(rng.integers(1, 5))])


def test_runs_equal_brute_force():
    some = 0
    for w in sequences():
        want = brute.runs(w.tolist())
        assert periodic.runs_of(w) == want
        some += len(want)
    assert some > 500


def test_a_long_text_of_one_loop():
    w = np.tile(np.random.default_rng(3).integers(0, 3, 700), 300)
    assert (0, len(w), 700) in periodic.runs_of(w)
    assert periodic.runs_of(np.zeros(300_000, int)) == [(0, 300_000, 1)]


def run_rows(texts):
    return {i: brute.run_digest(brute.looped(i, t)) for i, t in texts.items()}


def digest(r):
    return (r["n_runs"], r["start"], r["length"], r["period"], r["exponent_milli"], r["runs_sha256"], r["collapsed_sha256"])


def test_runs_of_odd_rows(spark):
    texts = ["a b " * 9, "", None, "x", "é  é\té\né é é é", "  " * 7, " ".join("abc" * 4) + " q " + " ".join("abc" * 4), "a a a a a a b b b b b b", "w " * 30_000]
    docs = spark.createDataFrame([(3, t) for t in texts] * 2, "doc_id long, text string").withColumns({"runs": F.lit(1), "f": F.lit(2)})
    rows = periodic.with_runs(docs).collect()
    assert Counter(r["text"] for r in rows) == Counter(texts * 2)
    for r in rows:
        want, kept = brute.runs_of_text(r["text"])
        assert [(x["start"], x["length"], x["period"]) for x in r["runs"]] == want and r["collapsed"] == kept and r["f"] == 2
    assert Counter(map(digest, periodic.run_digest(docs).collect())) == Counter(map(brute.run_digest, texts * 2))
    assert periodic.run_digest(docs.where("false")).collect() == []
    loose = periodic.looped(spark.createDataFrame([(None, "a b c")] + [(i, t) for i in range(40) for t in ("a b c d e f g h", None, " ")], "doc_id long, text string")).collect()
    assert all((r["text"] or "").split() == brute.looped(r["doc_id"], "a b c d e f g h").split() for r in loose if r["doc_id"] is not None and (r["text"] or "").strip())
    assert [r["text"] for r in loose if r["doc_id"] is None] == ["a b c"]


def test_runs_of_the_table(spark):
    texts = dict(duckdb.sql(f"SELECT doc_id, text FROM '{SMALL}/documents.parquet'").fetchall())
    want = run_rows(texts)
    rows = queries.op12_periodic_runs(spark, SMALL).collect()
    assert len(rows) == len(texts) and sum(r["n_runs"] for r in rows) and all(digest(r) == want[r["doc_id"]] for r in rows)


# --- phrases


@pytest.mark.parametrize("bits", [1, 9, 15, 22, 31])
def test_filters_lose_nothing(bits):
    rng = np.random.default_rng(bits)
    ids = np.minimum(rng.geometric(0.2, 5000), (1 << bits) - 1).astype(np.int32)
    for m in range(2, 6):
        at = np.arange(len(ids) - m + 1)
        limbs, counts = phrases.summed(phrases.packed(ids, at, m, bits), np.ones(len(at), np.int64))
        assert dict(zip(map(tuple, phrases.unpacked(limbs, m, bits).tolist()), counts.tolist(), strict=True)) == Counter(zip(*(ids[j : j + len(at)].tolist() for j in range(m)), strict=True))
        for shard_bits in (0, 3):
            shard = (limbs[0] >> np.uint64(64 - shard_bits)).astype(int) if shard_bits else np.zeros(len(counts), int)
            for s in set(shard.tolist()):
                own = shard == s
                again, n = phrases.filter_read(phrases.filter_of([x[own] for x in limbs], counts[own] * 200, shard_bits), s, shard_bits)
                assert all((x == y[own]).all() for x, y in zip(again, limbs, strict=True)) and (n == counts[own] * 200).all()


def listed(rows):
    return {(r["lang"], r["rank"]): (r["phrase"], r["a"], r["l"], r["r"], r["n"], r["score"]) for r in rows}


@pytest.mark.parametrize("limit", [phrases.BROADCAST, 0])
@pytest.mark.parametrize("chunk", [phrases.CHUNK, 300])
def test_phrases_equal_brute_force(spark, limit, chunk, monkeypatch):
    monkeypatch.setattr(phrases, "CHUNK", chunk)
    rng = np.random.default_rng(5)
    texts = [(["en", None, "und", "fr"][i % 4], "".join(rng.choice(["a", "B", "cc", "é", "d d"], p=[0.4, 0.3, 0.1, 0.1, 0.1]) + rng.choice([" ", "\t", ". ", "\n", "  "], p=[0.6, 0.1, 0.1, 0.1, 0.1]) for _ in range(rng.integers(0, 60)))) for i in range(160)]
    texts += [("en", None), ("en", ""), ("de", " .;\n"), ("en", "new york city " * 400), ("en", "New york\tcity " * 3), ("es", "uno dos " * 5)]
    docs = spark.createDataFrame(texts, "lang string, text string").withColumns({"word": F.lit(1), "id": F.lit(2)})
    rows = phrases.collocations(docs, least=8, top=25, limit=limit).collect()
    assert len(rows) == len(listed(rows)) and listed(rows) == brute.collocations(texts, 8, 25)


def test_phrases_of_empty_tables(spark):
    docs = spark.createDataFrame([("en", None), (None, " ")], "lang string, text string")
    assert phrases.collocations(docs).collect() == [] and phrases.collocations(docs.where("false")).collect() == []
