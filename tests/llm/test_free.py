"""Operators in free style: archives, classifiers, packing, joins, rules, near-duplicates, pipeline."""

import base64
import hashlib
import zlib
from collections import defaultdict
from pathlib import Path
from types import SimpleNamespace

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from shelfscope.llm import jaccard, neardup, packing, quality_model, quality_rules, queries, sample, toxicity, warc
from shelfscope.llm.store import new_path
from tests.conftest import SMALL
from tests.llm import brute


def table(name, columns, folder=SMALL):
    return duckdb.sql(f"SELECT {columns} FROM '{folder}/{name}.parquet'").fetchall()


# --- archives


def sha(text):
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


def check_archive(pages, rows):
    groups = defaultdict(list)
    for page_id, _, html in pages:
        groups[sha(html)].append(page_id)
    assert len(rows) == len(pages)
    for r in rows:
        top = max(groups[r["payload_digest"]], key=lambda x: -1 if x is None else x)
        assert (r["record_type"], r["refers_to"]) == (("response", None) if r["page_id"] == top else ("revisit", top))
    assert sorted((r["payload_digest"], r["payload_bytes"]) for r in rows) == sorted((sha(h), len((h or "").encode())) for _, _, h in pages)


def test_archives(spark):
    pages = [(1, "http://a/ b?x=é", "same"), (2, None, "same"), (3, "", None), (9, "http://c", ""), (4, "u", "x\r\n\r\nWARC/1.1\r\n\r\n"), (5, "u", "\r\n\r\n" * 5), (6, "u", "é\n" * 300_000), (7, "u", "tail\r\n")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("record_id", F.lit("clash"))
    check_archive(pages, warc.archived(df, new_path(spark, "warc")).collect())
    assert warc.archived(df.where("false"), new_path(spark, "warc")).count() == 0


def test_archives_of_repeated_rows_and_null_ids(spark):
    df = spark.createDataFrame([(1, "u", "a"), (1, "u", "a"), (None, "u", "a"), (None, "u", "b")], "page_id long, url string, html string")
    rows = warc.archived(df, new_path(spark, "warc")).collect()
    assert sorted(r["record_type"] for r in rows) == ["response", "response", "revisit", "revisit"] and {r["refers_to"] for r in rows} == {None, 1}


def test_archives_of_the_table(spark):
    check_archive(table("pages", "page_id, url, html"), queries.op1_warc(spark, SMALL).collect())


def test_arc_versions_and_wrong_lengths():
    one = b"filedesc://a 0.0.0.0 20240101000000 text/plain 14\n1 0 x\nFields\n\n"
    two = b"filedesc://a 0.0.0.0 20240101000000 text/plain 200 - - 0 f 14\n2 0 x\nFields\n\n"
    rows = list(warc.arc_records("a", one + b"http://x 1.2.3.4 20240102030405 text/html 17\nHTTP/1.0\r\n\r\nabcde\n"))
    assert rows[0][1:5] == ("http://x", "1.2.3.4", "2024-01-02T03:04:05Z", "text/html") and rows[0][7] == b"abcde"
    rows = list(warc.arc_records("a", two + b"http://x 1.2.3.4 20240102030405 text/html 200 - - 9 f 17\nHTTP/1.0\r\n\r\nabcde\n"))
    assert rows[0][9] == sha("abcde")
    plain = list(warc.arc_records("a", one + b"dns:x 1.2.3.4 202401020304 text/dns 9\n1.2.3.4\r\n\nhttp://y 1.2.3.4 20240102 text/html 22\nHTTP/1.0 200 OK\r\n\r\nabc\n"))
    assert plain[0][1:4] == ("dns:x", "1.2.3.4", "2024-01-02T03:04:00Z") and plain[0][6:8] == (b"", b"1.2.3.4\r\n") and plain[1][3] == "2024-01-02T00:00:00Z" and plain[1][7] == b"abc"
    names = [x.split(" ")[0] for x in warc.RECORD.split(", ")]
    text = warc.warc_record(SimpleNamespace(**dict(zip(names, plain[0], strict=True)), refers_to="urn:x", refers_url="", refers_date=""))
    assert b"WARC-Type: resource" in text and b"Content-Type: text/dns" in text and text.endswith(b"\r\n\r\n1.2.3.4\r\n")
    assert [r[0] for r in warc.warc_rows((text + b"\r\n\r\n").split(b"\n")[:-1])] == ["resource"]
    for bad in (one.replace(b"1 0 x", b"7 0 x") + b"http://x 1.2.3.4 20240102030405 text/html 3\nabc\n", one + b"http://x 1.2.3.4 2024010203 text/html 3\nabc\n".replace(b"2024010203", b"2024x"), one + b"http://x 1.2.3.4 20240102030405 text/html 99\nabc\n", one + b"http://x 20240102030405 9\nabc\n", b"http://x\n"):
        with pytest.raises(ValueError):
            list(warc.arc_records("a", bad))


def arc_file(name, version, records):
    """An ARC file of (url, type, block)."""
    rest = {1: "", 2: " 200 - - 0 {}".format(name)}[version]
    block = f"{version} 0 x\nFields\n".encode()
    parts = [f"filedesc://{name} 0.0.0.0 20240101000000 text/plain{rest} {len(block)}\n".encode(), block, b"\n"]
    for url, kind, block in records:
        parts += [url, f" 1.2.3.4 20010203040506 {kind}{rest} {len(block)}\n".encode(), block, b"\n"]
    return b"".join(parts)


BLOCKS = [
    (b"http://a/lf", "text/html", b"HTTP/1.0 200 OK\nServer: x\n\nbare\n\nline feeds"),
    (b"http://a/mixed", "text/html", b"HTTP/1.0 200 OK\r\nServer: x\n\r\nmixed"),
    (b"http://a/two words?q=a b", "text/html; charset=iso-8859-1", b"HTTP/1.0 200 OK\r\nServer: caf\xe9\r\n\r\nlatin \xe9"),
    ("http://a/é".encode(), "text/html", b"HTTP/1.0 200 OK\r\n\r\nagain"),
    (b"http://b/again", "text/html", b"HTTP/1.0 200 OK\nX: y\n\nagain"),
    (b"http://b/empty", "no-type", b"HTTP/1.0 204 No\r\nServer: x\r\n\r\n"),
    (b"dns:b", "text/dns", b"20010203 1.2.3.4\r\n\r\nb"),
]
PAYLOADS = [b"bare\n\nline feeds", b"mixed", b"latin \xe9", b"again", b"again", b"", b"20010203 1.2.3.4\r\n\r\nb"]


@pytest.mark.parametrize("version", [1, 2])
def test_foreign_arc_files_round_trip(spark, version):
    files = spark.createDataFrame([("x.arc", arc_file("x.arc", version, BLOCKS)), ("empty.arc", b""), ("null.arc", None)], "name string, content binary")
    records = warc.read_arc(files)
    assert [(r["payload"], r["payload_digest"]) for r in records.collect()] == [(p, warc.digest(p)) for p in PAYLOADS]
    assert [r["url"] for r in records.collect()][2:4] == ["http://a/two%20words?q=a%20b", "http://a/%C3%A9"]
    path = new_path(spark, "warc")
    warc.write_warc(warc.with_revisits(records), path)
    back = warc.read_warc(spark, path).collect()
    assert sorted((r["payload_digest"], r["payload_bytes"]) for r in back) == sorted((warc.digest(p), len(p)) for p in PAYLOADS)
    assert sorted(r["record_type"] for r in back) == ["resource", *["response"] * 5, "revisit"]


@pytest.mark.parametrize("version", [1, 2])
def test_bad_arc_records_are_set_aside(spark, version):
    good = arc_file("x.arc", version, BLOCKS[:2])
    longer = arc_file("x.arc", version, [(b"http://c/long", "text/html", b"HTTP/1.0 200 OK\r\n\r\nlong")]).split(b"\n", 4)[4].replace(b" 23\n", b" 31\n")
    date = arc_file("x.arc", version, [(b"http://c/date", "text/html", b"abc")]).split(b"\n", 4)[4].replace(b"20010203040506", b"20011303040506")
    last = arc_file("x.arc", version, BLOCKS[2:4]).split(b"\n", 4)[4]
    rows = warc.read_arc_or_set_aside(spark.createDataFrame([("x.arc", good + longer + date + last), ("y.arc", b"no archive\n")], "name string, content binary")).collect()
    assert [r["payload"] for r in rows if r["error"] is None] == PAYLOADS[:4]
    bad = [r for r in rows if r["error"] is not None]
    assert [r["name"] for r in bad] == ["x.arc", "x.arc", "y.arc"] and all(r["record_id"] is None for r in bad)
    assert bytes(bad[0]["bytes"]).startswith(b"http://c/long") and b"20011303040506" in bytes(bad[1]["bytes"])
    with pytest.raises(Exception, match="does not end"):
        warc.read_arc(spark.createDataFrame([("x.arc", good + longer + last)], "name string, content binary")).collect()


# --- classifiers

MARKED = ["{} " * 3 + "the cat sat on the mat and looked at the {} moon"]


def test_toxicity_shares_grams_with_misspellings(spark):
    rng = np.random.default_rng(0)
    filler = ["river", "stone", "garden", "window", "paper", "music", "bridge", "yellow", "market", "winter"]
    bad = ["blockhead", "dimwit", "scoundrel"]
    texts, y = [], []
    for i in range(400):
        words = rng.choice(filler, 30).tolist()
        y.append(i % 2)
        if i % 2:
            for w in rng.choice(bad, 3):
                words.insert(int(rng.integers(30)), str(w))
        texts.append(" ".join(words))
    model = toxicity.train(texts, np.array(y))
    new = ["river stone blockheads garden dimwitt window " * 3, "river stone garden window " * 3, "", None]
    s = model.scores(new, {})
    assert s[0] > 0.5 > s[1] and s[2] == s[3] < 0.5
    assert (model.scores(texts, {}) >= 0.5).tolist() == [bool(v) for v in y]


def test_grams_of_a_word_do_not_depend_on_other_words():
    of, bucket = toxicity.grams(["ab", "hello", "ab", "é" * 40_000])
    assert np.bincount(of[of < 3]).tolist() == [3, 5 + 4 + 3 + 2 + 1, 3]
    alone = toxicity.grams(["hello"])[1]
    assert bucket[of == 1].tolist() == alone.tolist() and bucket[of == 0].tolist() == bucket[of == 2].tolist()
    assert set(bucket[of == 0]).isdisjoint(alone) and len(set(alone) & set(toxicity.grams(["hellos"])[1])) == 4 + 3 + 2 + 1
    assert [len(x) for x in toxicity.grams([])] == [0, 0]


def test_toxicity_fit_in_tasks_equals_training_at_hand(spark):
    rng = np.random.default_rng(3)
    filler, bad = ["river", "stone", "garden", "window", "paper", "music"], ["blockhead", "dimwit"]
    rows = [(i, " ".join(rng.choice(filler, 20).tolist() + ([str(rng.choice(bad))] if i % 3 == 0 else []))) for i in range(300)]
    rows += [(300, rows[0][1]), (301, None), (302, ""), (None, "dimwit"), (303, "dimwit " * 100_000), (303, "stone"), (304, "no label")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(304)] + [(304, None), (305, 1), (None, 1)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    assert toxicity.fit(docs, labels).margin.tobytes() == model.margin.tobytes()
    first = {}
    used = [(i, int(i % 3 == 0), t or "") for i, t in rows if i is not None and i < 304 and zlib.crc32(str(i).encode()) % 5]
    for i, y, t in sorted(used):
        first.setdefault(t, (i, y, hashlib.sha256(t.encode()).hexdigest()))
    order = sorted((*v, t) for t, v in first.items())
    back = np.array([zlib.crc32(d.encode()) % 5 == 4 for _, _, d, _ in order])
    n = np.bincount([i % 3 == 0 for i in range(304) if zlib.crc32(str(i).encode()) % 5])
    want = toxicity.train([t for *_, t in order], np.array([y for _, y, _, _ in order]), totals=(n[0], n[1]), back=back)
    assert np.allclose(model.margin, want.margin, equal_nan=True) and np.isclose(model.bias, want.bias)
    assert toxicity.fit(docs.where("false"), labels).scores(["x"], {})[0] < 1e-6


def test_toxicity_without_both_labels():
    assert toxicity.train([], np.array([], int)).scores(["x"], {})[0] < 1e-6
    assert toxicity.train(["a b"], np.array([1])).scores(["x", None], {}).min() > 0.99


@pytest.mark.parametrize(("name", "mod", "rest", "label", "least"), [("op2_toxicity", 5, 0, "toxic", 0.85), ("op5_quality_classifier", 3, 1, "quality", 0.93)])
def test_classifiers_on_held_out_rows(spark, name, mod, rest, label, least):
    folder = "/root/testdata/sf0.01"
    rows = {r["doc_id"]: r for r in queries.queries()[name](spark, folder).collect()}
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % mod == rest) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for i, r in rows.items())
    held = [(rows[i]["predicted"], y) for i, y in table("labels", f"doc_id, {label}", folder) if rows[i]["held_out"]]
    assert sum(p == y for p, y in held) / len(held) >= least


def test_scores_of_odd_rows(spark):
    df = spark.createDataFrame([(1, None, 5.0), (None, "", 1.0), (2, "word " * 30_000, 0.0), (2, "word", 0.0)], "doc_id long, text string, score double")
    out = quality_model.scored(df, quality_model.Model([((("words", True, 3.0), ("symbols", False, 0.5)), 2.0)], -1.0)).collect()
    assert sorted(round(r["score"], 3) for r in out) == [0.269, 0.269, 0.269, 0.731]
    model = toxicity.Model(np.full(toxicity.BUCKETS, np.nan, np.float32), -1.0)
    assert {round(r["score"], 3) for r in toxicity.scored(df, model).collect()} == {0.269}
    assert toxicity.scored(df.where("false"), model).count() == quality_model.scored(df.where("false"), quality_model.Model([], 0.0)).count() == 0
    labels = spark.createDataFrame([(1, None), (None, 1), (2, 1), (2, 7)], "doc_id long, toxic int")
    assert sample.labelled(df, labels, "toxic", F.lit(True), 10).count() == 2


def test_rules_match_the_compiled_column(spark):
    df = quality_model.with_statistics(spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text"))
    x = df.select("__s.*").toPandas()[list(quality_model.STATISTICS)].to_numpy(float)
    y = (x[:, 2] < 0.1).astype(float)
    model = quality_model.train(x, y)
    want = 1 / (1 + np.exp(-(quality_model.holds([r for r, _ in model.rules], x) @ np.array([w for _, w in model.rules]) + model.bias)))
    got = np.array([r[0] for r in df.select(model.column()).collect()])
    assert np.allclose(got, want) and ((got >= 0.5) == (y == 1)).mean() > 0.98


# --- packing


def check_pieces(ids, rows):
    by, seqs = defaultdict(list), defaultdict(list)
    for r in rows:
        by[r["doc_id"]].append(r)
        seqs[r["sequence_id"]].append((r["offset"], r["length"]))
    for doc, want in ids.items():
        raw, at = np.array(want, "<u4"), 0
        for r in sorted(by.pop(doc), key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(want) and r["ids_crc32"] == zlib.crc32(raw[at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(want)
    assert not by
    for pieces in seqs.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at and length > 0
            at += length
        assert at <= 2048 and at & (at - 1) == 0


HARD = ["abc's don't I'll", "abc.'s", "<|ENDOFTEXT|> x", "<|endoftext|>abc", "ÉTÉ été", "été", "ΣΑΣ ς", "İstanbul", "x²", "ﬁ", "a b", "中文字", "!!! ***", "€5,00", "--a--", "\x1c\x1dA", "ß ẞ", "ªº", " ", "", None, "a\x00b", "KK"]


def test_packing_equals_the_tokenizer(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(queries.tokenizer_path())
    texts = [*HARD, "long word " * 9000] + ["again and again"] * 30
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("n", F.lit("clash"))
    ids = {i: [*t.encode(x or "", add_special_tokens=False).ids, 1] for i, x in enumerate(texts)}
    check_pieces(ids, packing.pack(df, queries.tokenizer_path()).collect())
    check_pieces(ids, packing.pack(df, queries.tokenizer_path(), aim=500).collect())
    assert packing.pack(df.where("false"), queries.tokenizer_path()).count() == 0
    rows = packing.pack(df.where("doc_id in (0, 9)").withColumn("doc_id", F.lit(None).cast("long")), queries.tokenizer_path())
    assert {r["doc_id"] for r in rows.collect()} == {None}
    same = spark.range(40).select(F.lit(5).cast("long").alias("doc_id"), F.lit("one and the same row " * 9).alias("text")).repartition(3)
    rows = packing.pack(same, queries.tokenizer_path(), aim=100).collect()
    n = len(t.encode("one and the same row " * 9, add_special_tokens=False).ids) + 1
    assert sum(r["length"] for r in rows) == 40 * n and len({r["sequence_id"] >> 32 for r in rows}) > 5  # repeated rows are spread
    known = packing.Statistics.of(packing.encoded(df, queries.tokenizer_path()))
    assert known.n == len(ids) and known.mean == sum(map(len, ids.values())) / len(ids) and all(known.df[x] == sum(x in v[:-1] for v in ids.values()) for x in set(sum(ids.values(), [])) - {1})


def test_other_tokenizers(spark, tmp_path):
    """Files that do not lower-case, or join pieces over white space, go through the whole tokenizer."""
    from tokenizers import Tokenizer

    for file in sorted(Path(queries.tokenizer_path()).parent.glob("*.json")):
        t = Tokenizer.from_file(str(file))
        if t.get_vocab_size() <= 1 << 16:
            for x in [*HARD, "Some Words  of\nText."]:
                assert packing.Encoder(str(file)).ids((x or "").encode()).tolist() == [*t.encode(x or "", add_special_tokens=False).ids, 1], (file.name, x)


def test_packing_of_the_table(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(queries.tokenizer_path())
    check_pieces({i: [*t.encode(x or "", add_special_tokens=False).ids, 1] for i, x in table("documents", "doc_id, text")}, queries.op3_packing(spark, SMALL).collect())


def test_neighbours_are_ranked_by_bm25():
    rng = np.random.default_rng(1)
    docs = [np.append(rng.integers(2, 400, int(rng.integers(5, 60))), 1).astype(np.uint16) for _ in range(60)]
    bags = [dict(zip(*(x.tolist() for x in np.unique(d[:-1], return_counts=True)), strict=True)) for d in docs]
    df = np.zeros(1 << 16, np.int64)
    for b in bags:
        df[list(b)] += 1
    df[3::4] += 7  # documents of other shards count too
    mean = np.mean([len(d) for d in docs]) + 5
    index = packing.Index(docs, packing.Statistics(60, mean, df))
    used = np.zeros(60, bool)
    used[:3] = True
    want = {}
    for j in range(3, 60):
        k = packing.K1 * (1 - packing.B + packing.B * len(docs[j]) / mean)
        s = sum(np.log(1 + (60 - df[t] + 0.5) / (df[t] + 0.5)) * bags[j][t] * (packing.K1 + 1) / (bags[j][t] + k) for t in bags[0] if t in bags[j] and df[t] <= max(2, packing.COMMON * 60))
        if s:
            want[j] = s
    got = list(index.neighbours(0, used))
    assert len(got) > packing.FIRST and set(got) == set(want) and all(want[a] >= want[b] - 1e-9 for a, b in zip(got, got[1:], strict=False))


def test_shard_plan_cuts_and_joins_buckets():
    plan = packing.shard_plan([(0, 10), (1, 95), (2, 1000), (3, 20), (4, 30)], 100)
    assert plan == [(0, 0, 1), (1, 1, 1), (2, 2, 10), (3, 12, 1), (4, 12, 1)]


# --- joins


def check_groups(texts, rows):
    sizes, tops = brute.near(texts)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows} == {i: (n, t) for i, (n, t) in enumerate(zip(sizes, tops, strict=True))}


def near_texts(seed=0, n=160, words=4000):
    rng = np.random.default_rng(seed)
    passage = " ".join(f"p{i}" for i in range(40))
    out = [None, "", " \n", "one two", "One TWO", "one two three", "É é", "é É"]
    while len(out) < n:
        base = [f"w{x}" for x in rng.integers(0, words, int(rng.integers(4, 80)))]
        for _ in range(int(rng.integers(1, 6))):
            copy = list(base)
            for k in rng.integers(0, len(copy), int(rng.integers(0, 3))):
                copy[k] = f"x{rng.integers(9)}"
            out.append(" ".join(copy) + (" " + passage if rng.random() < 0.3 else ""))
    return out


@pytest.mark.parametrize("seed", range(3))
def test_join_is_exact(spark, seed, monkeypatch):
    texts = near_texts(seed)
    if seed:  # frequent tokens, salts and parts on a small table
        monkeypatch.setattr(jaccard, "LEAST", 6)
        monkeypatch.setattr(jaccard, "RUN", 4)
        monkeypatch.setattr(jaccard, "PART", 2)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("token", F.lit("clash"))
    check_groups(texts, jaccard.grouped(df).collect())


def test_join_of_many_near_copies(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "LEAST", 8)
    monkeypatch.setattr(jaccard, "RUN", 8)
    base = [f"w{i}" for i in range(60)]
    texts = [" ".join([*base[:i], f"x{i}", *base[i + 1 :]]) for i in range(60)] + [" ".join(base[:47])] * 5 + ["other words entirely here now"]
    check_groups(texts, jaccard.grouped(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect())


def test_join_of_odd_tables(spark):
    df = spark.createDataFrame([(None, "a b c d e f"), (4, "a b c d e f"), (4, "a b c d e f"), (7, "x " * 60_000), (8, "x " * 60_000)], "doc_id long, text string")
    assert sorted((str(r["doc_id"]), r["n_shingles"], r["component_id"]) for r in jaccard.grouped(df).collect()) == [("4", 2, 4), ("4", 2, 4), ("7", 1, 7), ("8", 1, 7), ("None", 2, 4)]
    assert jaccard.grouped(df.where("false")).count() == 0
    assert sorted(str(r["doc_id"]) for r in jaccard.one_per_group(df.withColumn("c", F.lit("clash"))).collect()) == ["4", "7"]
    df = spark.createDataFrame([(None, "only here"), (None, "only here"), (4, "a b c d e f"), (4, "some other text of its own"), (9, None), (9, None), (None, "")], "doc_id long, text string")
    assert sorted((str(r["doc_id"]), str(r["text"])) for r in jaccard.one_per_group(df).collect()) == [("4", "a b c d e f"), ("4", "some other text of its own"), ("9", "None"), ("9", "None"), ("None", ""), ("None", "only here")]
    assert jaccard.one_per_group(df.where("false")).count() == 0


def test_join_of_the_table(spark):
    rows = sorted(table("documents", "doc_id, text"))
    assert [r[0] for r in rows] == list(range(len(rows)))
    check_groups([t for _, t in rows], queries.op4_jaccard_join(spark, SMALL).collect())


# --- rules


def test_measures():
    for text in [None, "", "a b c d e " * 3, "x y\nx y\n\n x\x1fy", "é é # $$\r\n<|>", "a b c d e f a b c d e"]:
        t = quality_rules.Text(text)
        assert t.n_repeat_words == brute.repeat_words(text) and t.n_words == len((text or "").encode().split())
        assert t.word_chars == sum(len(w.decode()) for w in (text or "").encode().split())


def test_verdict_does_not_depend_on_the_order(spark):
    df = spark.read.parquet(f"{SMALL}/documents.parquet").unionByName(spark.createDataFrame([(None, None, None, None, None), (1, "", "x", "y", 0)], "doc_id long, text string, lang string, source string, n_chars long")).withColumn("rejected_by", F.lit("clash"))
    names = list(quality_rules.RULES)
    kept = [sorted(str(r["doc_id"]) for r in quality_rules.judged(df, o).where("rejected_by is null").collect()) for o in (names, names[::-1], None)]
    assert kept[0] == kept[1] == kept[2] and 0 < len(kept[0]) < df.count()
    assert quality_rules.judged(df.where("false")).count() == 0 and quality_rules.measured(df.where("false")).count() == 0


# --- near-duplicates


def check_links(rows, got):
    n = len(rows)
    ok = [lab is not None and v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v) for lab, v in rows]
    cos = lambda a, b: np.dot(a, b) / np.linalg.norm(a) / np.linalg.norm(b)
    pairs = [(i, j) for j in range(n) for i in range(j) if ok[i] and ok[j] and rows[i][0] == rows[j][0] and len(rows[i][1]) == len(rows[j][1]) and cos(np.array(rows[i][1]), np.array(rows[j][1])) >= 0.93]
    tops = brute.components(n, pairs)
    degree = np.bincount(np.array(pairs, int).ravel(), minlength=n) if pairs else np.zeros(n, int)
    assert {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in got} == {i: (degree[i], tops[i], tops[i] == i) for i in range(n)}


def vectors(seed=0, n=300, dims=16):
    rng = np.random.default_rng(seed)
    rows = [(0, None), (None, [1.0] * dims), (0, [0.0] * dims), (0, [1.0, None] + [0.0] * (dims - 2)), (0, [float("nan")] + [1.0] * (dims - 1)), (0, [1.0, 2.0]), (0, [2.0, 4.0]), (0, [])]
    while len(rows) < n:
        base = rng.normal(size=dims)
        rows += [(int(rng.integers(2)), [float(np.float32(x)) for x in base + rng.normal(size=dims) * 0.15 * rng.random()]) for _ in range(int(rng.integers(1, 9)))]
    return rows + rows[-5:]


@pytest.mark.parametrize("small", [False, True])
def test_links(spark, small, monkeypatch):
    if small:  # several shards and blocks
        monkeypatch.setattr(neardup, "AIM", 40)
        monkeypatch.setattr(neardup, "CAP", 30)
    rows = vectors()
    df = spark.createDataFrame([(i, lab, v, "clash") for i, (lab, v) in enumerate(rows)], "vec_id long, label int, embedding array<float>, key string")
    check_links(rows, neardup.deduped(df).collect())
    assert neardup.deduped(df.where("false")).count() == 0


def test_links_of_the_table(spark):
    rows = [(lab, v) for _, lab, v in sorted(table("embeddings", "vec_id, label, embedding"), key=lambda r: r[0])]
    check_links(rows, queries.op9_embedding_neardup(spark, SMALL).collect())


def dense(n=160, dims=16, spread=0.09):
    """A group whose pairs lie around the threshold, so it has no cells of its own, a second group and repeated rows."""
    rng = np.random.default_rng(5)
    base = rng.normal(size=(2, dims)) / np.sqrt(dims)
    rows = [(0, [float(np.float32(x)) for x in base[int(i % 5 == 4)] + rng.normal(size=dims) * spread * 0.5]) for i in range(n)]
    return rows + rows[:3]


def test_links_beyond_the_widest_overlap(spark, monkeypatch):
    monkeypatch.setattr(neardup, "AIM", 4)
    rows = dense()
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "vec_id long, label int, embedding array<float>")
    _, entry = neardup.entries(df)
    assert neardup.recall(entry, neardup.search(neardup.assigned(entry, neardup.WIDEST), neardup.THRESHOLD), queries=500)[0] < neardup.RECALL
    check_links(rows, neardup.deduped(df).collect())


@pytest.mark.parametrize("cap", [12, 2048])
def test_exact_links(spark, monkeypatch, cap):
    monkeypatch.setattr(neardup, "AIM", 16)
    monkeypatch.setattr(neardup, "CAP", cap)
    monkeypatch.setattr(neardup, "RECALL", 2.0)
    monkeypatch.setattr(neardup, "counted", lambda *a: 2.0)
    for rows in (vectors(3, 120), dense()):
        df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "vec_id long, label int, embedding array<float>")
        check_links(rows, neardup.deduped(df, overlap=neardup.WIDEST).collect())


def test_low_recall_is_an_error(spark, monkeypatch):
    monkeypatch.setattr(neardup, "RECALL", 1.5)
    df = spark.createDataFrame([(0, 0, [1.0, 2.0]), (1, 0, [1.0, 2.1])], "vec_id long, label int, embedding array<float>")
    with pytest.raises(RuntimeError):
        neardup.deduped(df, overlap=neardup.WIDEST)


def test_an_audit_without_pairs_measures_nothing(spark):
    """One near pair among many vectors: an audit of few would find no pair and call that whole."""
    rng = np.random.default_rng(8)
    v = rng.normal(size=(1500, 32))
    v[700] = v[3] + 0.01 * rng.normal(size=32)
    rows, entry = neardup.entries(spark.createDataFrame([(i, 0, x.tolist()) for i, x in enumerate(v)], "vec_id long, label int, embedding array<double>"))
    none = spark.createDataFrame([], "a string, b string")
    assert neardup.recall(entry, none) == (0.0, 1)
    assert neardup.recall(entry, none, queries=1, most=1)[0] is None
    df = spark.createDataFrame([(i, 0, x.tolist()) for i, x in enumerate(v)], "vec_id long, label int, embedding array<double>")
    assert {r["vec_id"] for r in neardup.deduped(df).where("n_links > 0").collect()} == {3, 700}


# --- pipeline


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SMALL)
        assert out.columns == docs.columns
        seen[name], docs = out.collect(), spark.createDataFrame(out.collect(), docs.schema)
    good = seen["quality_rules"]
    texts = sorted((r["doc_id"], r["text"]) for r in good)
    tops = brute.near([t for _, t in texts])[1]
    assert sorted(r["doc_id"] for r in seen["near_duplicates"]) == sorted(texts[i][0] for i in set(tops))
    assert not any(brute.base_spans(r["text"]) for r in seen["secret_scans"])
    words = lambda rows: sum(len(r["text"].encode().split()) for r in rows)
    assert abs(words(seen["source_mix"]) - words(seen["secret_scans"])) <= 20
    assert corpus_pipeline.run(spark, SMALL).agg(F.sum("length")).first()[0] > 0


def test_pipeline_of_odd_tables(spark):
    """Null, empty and repeated rows, and columns named like those of the operators, which come out as they went in."""
    one, two, three = "the quick brown fox jumps over the lazy dog and then runs away", "a large river flows through many towns before it meets the open sea", "nobody knows why some letters never reach the people they are sent to"
    rows = [(1, one, "a", 7), (1, one, "a", 7), (2, two, None, 8), (None, three, "b", None), (3, None, "a", 9), (4, "", None, 9)]
    extra = ["rejected_by", "size", "source_size", "target", "taken", "token", "ids", "__sign", "__u", "__bin", "__text", "__spans", "__base", "__sweep", "__keep", "r", "t", "u", "own", "own_4", "gaps", "weak", "two words"]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long")
    docs = docs.select("*", *(F.concat(F.lit(f"{x} of "), F.coalesce("doc_id", F.lit(0)).cast("string")).alias(x) for x in extra))
    out = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, out, SMALL)
        assert out.columns == docs.columns, name
        out = spark.createDataFrame(out.collect(), docs.schema)
        assert out.count() and all(r[x] == f"{x} of {r['doc_id'] or 0}" for r in out.collect() for x in extra), name
    assert {r["doc_id"] for r in out.collect()} == {1, 2, None}
    assert corpus_pipeline.STAGES[-1][1](spark, out, SMALL).agg(F.sum("length")).first()[0] > 0
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.where("false"), SMALL).count() == 0


def test_pruned_lists_keep_no_covered_neighbour():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 8))
    x[100:140] = x[0] + 0.01 * rng.normal(size=(40, 8))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    others, s = np.random.default_rng(1).integers(0, 300, (300, neardup.FAR)), x @ x.T
    want = [set() for _ in x]
    for i in range(300):
        pool = set(np.argsort(-np.where(np.arange(300) == i, -2, s[i]))[: neardup.POOL].tolist()) | set(others[i].tolist())
        kept = []
        for c in sorted(pool - {i}, key=lambda c: -s[i, c]):
            if len(kept) < neardup.DEGREE and all(neardup.ALPHA * np.linalg.norm(x[k] - x[c]) > np.linalg.norm(x[i] - x[c]) for k in kept):
                kept.append(c)
        for c in kept:
            want[i].add(c)
            want[c].add(i)
    assert [set(h.tolist()) for h in neardup.pruned(x)] == want
    assert [len(h) for h in neardup.pruned(x[:1])] == [0] and neardup.pruned(x[:0]) == []


def test_vectors_in_double_precision(spark):
    """A pair whose cosine only doubles tell from the threshold."""
    b = [0.93, float(np.sqrt(1 - 0.93**2))]
    low = [0.93 - 1e-9, float(np.sqrt(1 - (0.93 - 1e-9) ** 2))]
    for v, linked in ((b, True), (low, False)):
        cos = np.array([1.0, 0.0]) @ (np.array(v) / np.linalg.norm(v))
        df = spark.createDataFrame([(1, 1, [1.0, 0.0]), (2, 1, v)], "vec_id long, label long, embedding array<double>")
        assert [r["n_links"] for r in neardup.deduped(df).collect()] == [int(cos >= 0.93)] * 2
        assert linked or cos < 0.93
