"""What a task of a Python worker leaves to the stages after it."""

import pyarrow as pa
import pytest

from shelfscope.llm import jaccard, packing, quality_rules, store


def test_a_task_clears_and_hands_back_when_its_rows_end(monkeypatch):
    done = []
    monkeypatch.setattr(store, "hand_back", lambda: done.append("back"))
    run = store.leaving_nothing(lambda batches: (2 * x for x in batches), lambda: done.append("cleared"))
    rows = run(iter([1, 2]))
    assert next(rows) == 2 and not done
    assert list(rows) == [4] and done == ["cleared", "back"]


def test_a_task_that_stops_early_hands_back_too(monkeypatch):
    done = []
    monkeypatch.setattr(store, "hand_back", lambda: done.append("back"))
    rows = store.leaving_nothing(lambda batches: iter(batches))([1, 2])
    assert next(rows) == 1
    rows.close()
    assert done == ["back"]


def test_words_of_shingles_are_forgotten():
    jaccard.shingles(b"a b c d e f")
    assert jaccard._kept
    jaccard._forget()
    assert not jaccard._kept


def test_handing_back_keeps_values():
    batch = pa.RecordBatch.from_pydict({"x": list(range(1000))})
    store.hand_back()
    assert batch.column("x").to_pylist() == list(range(1000))


def test_stages_with_python_hand_back():
    for module in (jaccard, packing, quality_rules):
        assert module.leaving_nothing is store.leaving_nothing


def test_texts_go_to_workers_in_small_batches(spark):
    """Spark's own batches are 10 000 rows, here 20 MB."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    texts = spark.range(0, 10_000, 1, 1).selectExpr("cast(repeat('x', 2000) as binary) raw")
    sizes = lambda batches: (pa.RecordBatch.from_pydict({"n": [b.nbytes]}) for b in batches)
    before = spark.conf.get(key, None)
    with store.small_batches(spark):
        most = texts.mapInArrow(sizes, "n long").agg({"n": "max"}).first()[0]
    assert most < 2 * store.BATCH
    assert spark.conf.get(key, None) == before


def test_words_are_not_kept_but_copies_of_short_texts_are():
    jaccard._forget()
    text = " ".join(f"w{i}" for i in range(1000)).encode()
    assert jaccard.shingles(text) is jaccard.shingles(text) and len(jaccard._kept) == 1
    long = " ".join(f"w{i}" for i in range(jaccard.SHORT + 10)).encode()
    assert len(jaccard.shingles(long)) == jaccard.SHORT + 6 and len(jaccard._kept) == 1
    for i in range(2 * jaccard.TEXTS):
        jaccard.shingles(b"text %d" % i)
    assert len(jaccard._kept) <= jaccard.TEXTS
    jaccard._forget()


def test_a_lone_word_is_stored_once():
    stored = []

    class Noting(packing.Encoder):
        def __setitem__(self, piece, ids):
            stored.append(piece)
            super().__setitem__(piece, ids)

    public_tokenizers = pytest.importorskip("public_tokenizers")
    encode = Noting(public_tokenizers.path("word_bpe_49k.json"))
    text = "Plain words, caf\u00e9 (x1)"
    got = encode.ids(text.encode()).tolist()
    assert got == [*encode.tokenizer.encode(text, add_special_tokens=False).ids, packing.CLOSE]
    assert len(stored) == len(set(stored))
