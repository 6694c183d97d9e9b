"""Substring deduplication against the definition."""

from __future__ import annotations

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import substring
from tessera.llm.queries import QUERIES

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, kept string, lo int"


def by_definition(docs, window):
    seen, out = set(), {}
    for k, text in sorted(docs.items()):
        words = WORD.findall(text or "")
        gone = [False] * len(words)
        for s in range(len(words) - window + 1):
            w = tuple(words[s : s + window])
            if w in seen:
                gone[s : s + window] = [True] * window
            seen.add(w)
        out[k] = (len(words), sum(gone), " ".join(w for w, g in zip(words, gone, strict=True) if not g))
    return out


def corpus(seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(rng.choice([3, 12, 200]))] + ["été", "ß"]
    passages = [rng.choices(vocabulary, k=rng.randint(3, 60)) for _ in range(6)]
    docs = {}
    for k in rng.sample(range(-50, 1000), 60):
        words = []
        for _ in range(rng.randint(0, 5)):
            words += rng.choice(passages) if rng.random() < 0.6 else rng.choices(vocabulary, k=rng.randint(0, 40))
        if docs and rng.random() < 0.3:
            words = WORD.findall(docs[rng.choice(list(docs))])
            if words and rng.random() < 0.7:
                words[rng.randrange(len(words))] = "edit"
        docs[k] = "".join(w + rng.choice([" ", "\n", "\t ", "  "]) for w in words)
    docs[2000] = "same " * 100
    docs[2001] = "same " * 30
    docs[2002] = " ".join(f"long{i}" for i in range(5000))
    docs[2003] = docs[2002] + " end"
    return docs


@pytest.mark.parametrize("seed,window,base", [(0, 20, 5), (1, 20, 5), (2, 8, 1), (3, 6, 3), (4, 16, 2), (5, 20, 5)])
def test_against_the_definition(spark, seed, window, base):
    docs = corpus(seed)
    rows = [(k, t, "x", 1) for k, t in docs.items()]
    got = substring.dedup_substrings(spark.createDataFrame(rows, SCHEMA).repartition(5), window, base)
    assert {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept"]) for r in got.collect()} == by_definition(docs, window)


def test_removed_stretches(spark):
    a = " ".join(f"a{i}" for i in range(30))
    got = substring.dedup_substrings(spark.createDataFrame([(1, a, "", 0), (2, "x y " + a + " z", "", 0)], SCHEMA))
    assert [(r["doc_id"], [tuple(s) for s in r["removed"]], r["kept"]) for r in got.orderBy("doc_id").collect()] == [(1, [], a), (2, [(2, 30)], "x y z")]


def test_nulls_repeats_and_empty(spark):
    a = " ".join(f"a{i}" for i in range(25))
    rows = [(1, a, None, None), (1, a, None, None), (None, a, "k", 1), (None, a, "k", 1), (3, None, "k", 1), (4, "", "k", 1), (5, " \n", "k", 1), (6, a, "k", 1)]
    got = substring.dedup_substrings(spark.createDataFrame(rows, SCHEMA))
    got = sorted(tuple(r)[:4] for r in got.select(F.coalesce("doc_id", F.lit(-1)), "n_words", "n_removed", "kept").collect())
    assert got == [(-1, 25, 0, a)] * 2 + [(1, 25, 0, a)] * 2 + [(3, 0, 0, ""), (4, 0, 0, ""), (5, 0, 0, ""), (6, 25, 25, "")]
    assert substring.dedup_substrings(spark.createDataFrame([], SCHEMA)).count() == 0


def test_lengths_are_checked(spark):
    for window, base in ((20, 6), (5, 5), (20, 0), (15, 5)):
        with pytest.raises(ValueError):
            substring.dedup_substrings(spark.createDataFrame([], SCHEMA), window, base)


def test_extension_stays_inside_the_window():
    for window, base in ((20, 5), (16, 1), (64, 2)):
        for length, moved in substring.extensions(window, base).items():
            at = np.arange(window - base + 1) + moved
            assert (at >= 0).all() and (at + length <= window).all()


def test_query_on_given_tables(spark):
    folder = "/root/testdata/sf0.001"
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    want = {k: v[:2] for k, v in by_definition(docs, 20).items()}
    got = QUERIES["op1_substring_dedup"](spark, folder).collect()
    assert {r["doc_id"]: (r["n_words"], r["n_removed"]) for r in got} == want
