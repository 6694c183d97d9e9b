"""Base statistics by definition; rules on labels with a known cause."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from tessera.llm import quality_rules
from tessera.llm.queries import QUERIES

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def statistics(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    places: dict[tuple, list[int]] = {}
    for i in range(len(words) - 7):
        places.setdefault(tuple(words[i : i + 8]), []).append(i)
    covered = {j for p in places.values() if len(p) > 1 for i in p for j in range(i, i + 8)}
    n = len(words)
    base = (n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered))
    return *base, n < 20 or 100 * len(covered) > 30 * n


def texts(seed=0):
    rng = random.Random(seed)
    vocabulary = ["a", "the", "é", "x#y", "$$", "Long", "𝒳", "<b>"] + [f"w{i}" for i in range(40)]
    out = [None, "", " ", "\n\n", "one", " lead", "trail \n", "a b c d e f g h", "a b c d e f g h " * 2, "z " * 9, "l\nl\n l\n\nl", "\x0b\x0ca\x85b\xa0c"]
    for _ in range(80):
        words = rng.choices(vocabulary[: rng.choice([2, 5, 48])], k=rng.randint(1, 70))
        out.append("".join(w + rng.choice([" ", " ", "\n", "\t"]) for w in words))
    out.append("big " * 9000 + "end")
    return out


def test_statistics(spark):
    given = dict(enumerate(texts()))
    df = spark.createDataFrame(list(given.items()), "doc_id long, text string").repartition(3)
    got = quality_rules.with_base(df).select("doc_id", *quality_rules.BASE, "base_failed").collect()
    assert {r[0]: tuple(r)[1:] for r in got} == {k: statistics(t) for k, t in given.items()}


def labelled(seed=2, n=600):
    rng = random.Random(seed)
    docs, labels = [], []
    for k in range(n):
        words = [f"word{rng.randrange(9999)}" for _ in range(rng.randint(25, 80))]
        bad = rng.random() < 0.3
        if bad:
            words = [w + "##" for w in words] if k % 2 else [w.upper() for w in words]
        docs.append((k, " ".join(words), None, 5))
        labels.append((k, int(not bad)))
    return docs, labels


def test_rules_find_the_cause(spark):
    docs, labels = labelled()
    df = spark.createDataFrame(docs, "doc_id long, text string, n_words string, bad int")
    known = spark.createDataFrame(labels[:450] + [(None, 1), (3, None), (99999, 0)], "doc_id long, quality int")
    got = {r["row"]["doc_id"]: r["kept"] for r in quality_rules.quality_rules(df, known).collect()}
    held_out = [got[k] == bool(q) for k, q in labels[450:]]
    assert sum(held_out) / len(held_out) > 0.97
    assert all(got[k] for k, q in labels if q)


def test_columns_of_any_name_come_back_unchanged(spark):
    names = ["n_words", "rule", "kept", "base_failed", "_text", "_words", "_windows", "_given", "row", "bad", "n_lines", "_id", "_order", "_label"]
    docs, labels = labelled(n=120)
    df = spark.createDataFrame([(k, t, *[f"{c}{k}" for c in names]) for k, t, *_ in docs], "doc_id long, text string, " + ", ".join(f"`{c}` string" for c in names))
    plain = spark.createDataFrame([(k, t) for k, t, *_ in docs], "doc_id long, text string")
    known = spark.createDataFrame(labels, "doc_id long, quality int")
    got = {r["row"]["doc_id"]: r for r in quality_rules.quality_rules(df, known).collect()}
    want = {r["row"]["doc_id"]: r for r in quality_rules.quality_rules(plain, known).collect()}
    assert all(got[k]["row"][c] == f"{c}{k}" for k in got for c in names)
    assert {k: tuple(r)[1:] for k, r in got.items()} == {k: tuple(r)[1:] for k, r in want.items()}


def test_rules_read_as_conditions(spark):
    docs, labels = labelled()
    df = spark.createDataFrame([(k, t) for k, t, *_ in docs], "doc_id long, text string").join(spark.createDataFrame(labels, "doc_id long, quality int"), "doc_id")
    rules = quality_rules.learn_rules(quality_rules.with_base(df).withColumn("bad", 1 - F.col("quality")).withColumn("_order", F.xxhash64("doc_id")))
    assert rules and all(r.precision >= 0.97 and 1 <= len(r.conditions) <= 3 for r in rules)
    tests = {c.feature for r in rules for c in r.conditions}
    assert tests & {"symbols_per_char", "capitals", "word_length"}


@pytest.mark.parametrize("labels", [[], [(1, 1), (2, 1)], [(None, None)]])
def test_no_bad_label_leaves_the_base_rule(spark, labels):
    df = spark.createDataFrame([(1, "w " * 5, None), (2, " ".join(map(str, range(30))), None), (2, " ".join(map(str, range(30))), None), (None, None, None)], "doc_id long, text string, kind string")
    got = quality_rules.quality_rules(df, spark.createDataFrame(labels, "doc_id long, quality int"))
    assert sorted((r["row"]["doc_id"] or -1, r["kept"], r["rule"]) for r in got.collect()) == [(-1, False, 0), (1, False, 0), (2, True, 0), (2, True, 0)]


def test_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert quality_rules.quality_rules(empty, spark.createDataFrame([], "doc_id long, quality int")).count() == 0


def test_query_on_given_tables(spark):
    folder = "/root/testdata/sf0.01"
    rows = spark.read.parquet(f"{folder}/documents.parquet").collect()
    truth = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    got = {r["doc_id"]: r for r in QUERIES["op5_quality_rules"](spark, folder).collect()}
    assert {k: tuple(r)[1:7] for k, r in got.items()} == {r["doc_id"]: statistics(r["text"]) for r in rows}
    good = [got[k]["kept"] for k, q in truth.items() if q and not got[k]["base_failed"]]
    bad = [got[k]["kept"] for k, q in truth.items() if not q]
    assert sum(good) / len(good) > 0.99
    assert sum(bad) / len(bad) < 0.3
