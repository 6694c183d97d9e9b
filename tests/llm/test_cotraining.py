"""Co-training: held-out accuracy, and that it covers every row."""

from __future__ import annotations

import random

from tessera.llm import cotraining
from tessera.llm.queries import QUERIES


def corpus(n=900):
    rng = random.Random(4)
    docs, labels = [], []
    for k in range(n):
        good = rng.random() < 0.6
        own = [f"{'good' if good else 'junk'}{rng.randrange(15)}" for _ in range(4)]
        words = [f"w{rng.randrange(500)}" for _ in range(25)] + own * (rng.random() < 0.9)
        source = f"s{rng.randrange(5) + 5 * (not good if rng.random() < 0.9 else good)}"
        docs.append((k, " ".join(words), "en", source, "extra"))
        labels.append((k, int(good), 0))
    return docs, labels


SCHEMA = "doc_id long, text string, lang string, source string, p_text string"


def test_held_out_accuracy(spark):
    docs, labels = corpus()
    known = spark.createDataFrame(labels[:120] + [(None, 1, 0), (5000, 0, 1), (3, None, None)], "doc_id long, quality int, toxic int")
    got = cotraining.classify_quality(spark.createDataFrame(docs, SCHEMA), known, ["lang", "source"], text_bits=10, share=0.2)
    got = {r["doc_id"]: r for r in got.collect()}
    assert len(got) == len(docs)
    right = [got[k]["kept"] == bool(q) for k, q, _ in labels[120:]]
    assert sum(right) / len(right) > 0.9
    assert all(0 <= got[k][c] <= 1 for k in got for c in ("p_text", "p_page", "score"))


def test_nulls_repeats_one_kind_and_empty(spark):
    docs = [(1, None, None, None, None), (1, None, None, None, None), (None, "", "en", "s", "x")]
    df = spark.createDataFrame(docs, SCHEMA)
    one_kind = spark.createDataFrame([(1, 1, None)], "doc_id long, quality int, toxic int")
    got = cotraining.classify_quality(df, one_kind, ["lang", "source"]).collect()
    assert [(r["kept"], r["score"]) for r in got] == [(True, None)] * 3
    more, labels = corpus(60)
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = cotraining.classify_quality(spark.createDataFrame(docs + more, SCHEMA), known, ["lang", "source"], rounds=1, text_bits=8)
    assert got.count() == 63 and got.where("score IS NULL").count() == 0
    assert cotraining.classify_quality(df.limit(0), one_kind, ["lang", "source"]).count() == 0


def split_words_corpus(n=1500, seed=9):
    """Few labels, rare words in the texts, and a page view that tells most documents apart."""
    rng = random.Random(seed)
    docs, labels = [], []
    for k in range(n):
        good = rng.random() < 0.5
        words = [f"{'g' if good else 'b'}{rng.randrange(250)}" for _ in range(5)] + [f"w{rng.randrange(40)}" for _ in range(10)]
        rng.shuffle(words)
        seen = good if rng.random() < 0.97 else not good
        docs.append((k, " ".join(words), "en", f"s{rng.randrange(3) + 3 * (not seen)}", "extra"))
        labels.append((k, int(good), 0))
    return docs, labels


def test_exchange_helps_on_documents_without_labels(spark):
    docs, labels = split_words_corpus()
    df = spark.createDataFrame(docs, SCHEMA)
    known = spark.createDataFrame(labels[:60], "doc_id long, quality int, toxic int")
    right = {}
    for rounds in (0, 2):
        got = cotraining.classify_quality(df, known, ["source"], rounds=rounds, text_bits=12, confident=0.7, share=0.3)
        got = {r["doc_id"]: r["p_text"] >= 0.5 for r in got.collect()}
        right[rounds] = sum(got[k] == bool(q) for k, q, _ in labels[60:]) / len(labels[60:])
    assert 1 - right[2] < 0.7 * (1 - right[0]) and right[2] > 0.9, right  # a third of the wrong cases goes


def test_every_unlabelled_row_is_offered(spark):
    """Pseudo-labels are the surest rows of the whole table, a share of it at any size, equally many of both kinds."""
    docs, labels = corpus(1200)
    rows = cotraining.featured(spark.createDataFrame(docs, SCHEMA), ["source"], 10, "doc_id", "text").checkpoint()
    labelled = rows.join(spark.createDataFrame([(k, q) for k, q, _ in labels[:300]], "id long, good int"), "id")
    bits = {"text": 10, "page": cotraining.PAGE_BITS}
    models = {v: cotraining._fit(labelled, v, b) for v, b in bits.items()}
    for share in (0.02, 0.1):
        got = cotraining._confident(rows, models, 0.6, share).groupBy("view", "good").count().collect()
        for r in got:
            assert abs(r["count"] - share * 1200) <= max(4, 0.25 * share * 1200), r
        assert {(r["view"], r["good"]) for r in got} == {(v, k) for v in ("text", "page") for k in (0, 1)}


def test_folds_of_one_kind(spark):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet").where("doc_id < 100")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    got = cotraining.classify_quality(docs, labels, ["lang", "source"], rounds=1)
    assert got.count() == docs.count() and got.where("score IS NULL").count() == 0
    few = spark.createDataFrame([(1, 1, 0), (2, 0, 0)], "doc_id long, quality int, toxic int")
    assert cotraining.classify_quality(docs, few, ["lang"], rounds=1).where("score IS NULL").count() == 0
    outside = spark.createDataFrame([(1, 1, 0), (10**9, 0, 0)], "doc_id long, quality int, toxic int")
    assert cotraining.classify_quality(docs, outside, ["lang"]).where("score IS NULL AND kept").count() == docs.count()


def test_query_covers_every_row_and_generalises(spark):
    folder = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    known = labels.where("pmod(xxhash64(doc_id, 'held'), 4) != 0")
    want = {r["doc_id"]: r["quality"] == 1 and r["toxic"] != 1 for r in labels.where("pmod(xxhash64(doc_id, 'held'), 4) = 0").collect()}
    got = {r["doc_id"]: r["kept"] for r in cotraining.classify_quality(docs, known, ["lang", "source"]).collect()}
    assert len(got) == docs.count()
    assert sum(got[k] == v for k, v in want.items()) / len(want) > 0.85
    assert QUERIES["op2_cotraining"](spark, "/root/testdata/sf0.01").count() == 1000
