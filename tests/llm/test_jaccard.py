"""Jaccard groups against all pairs."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from tessera.llm import jaccard
from tessera.llm.common import components
from tessera.llm.queries import QUERIES

WORD = re.compile(r"[^\x20\x09-\x0D]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, n string, gram int"


def shingles(text):
    words = WORD.findall((text or "").translate(UPPER))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4)))


def all_pairs(docs, num=80, den=100):
    sets = {k: shingles(t) for k, t in docs.items()}
    root = {k: k for k in docs}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    keys = sorted(docs)
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            if sets[a] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {k: (len(sets[k]), find(k)) for k in keys}


def corpus(seed):
    rng = random.Random(seed)
    vocabulary = [f"W{i}" for i in range(rng.choice([4, 300, 3000]))] + ["É", "ß"]
    passage = rng.choices(vocabulary, k=40)
    docs = {}
    for k in rng.sample(range(-20, 900), 90):
        words = rng.choices(vocabulary, k=rng.choice([0, 1, 3, 5, 6, 9, 30, 80, 200]))
        if rng.random() < 0.3:
            words = words[: len(words) // 2] + passage + words[len(words) // 2 :]
        if docs and rng.random() < 0.5:
            words = docs[rng.choice(list(docs))].split()
            for _ in range(rng.choice([0, 1, 1, 2, 4, 8])):
                if words:
                    words[rng.randrange(len(words))] = rng.choice(vocabulary)
            if rng.random() < 0.3:
                words = words + rng.choices(vocabulary, k=3)
        docs[k] = " ".join(words) if rng.random() < 0.8 else "\n".join(words).lower()
    return docs


@pytest.mark.parametrize("seed", range(5))
def test_against_all_pairs(spark, seed, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK_TEXT", 2000)
    docs = corpus(seed)
    rows = [(k, t, "x", 1) for k, t in docs.items()]
    got = jaccard.jaccard_groups(spark.createDataFrame(rows, SCHEMA).repartition(4)).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == all_pairs(docs)


def test_chains_are_followed(spark):
    """Neighbours link, the ends do not."""
    words = [f"w{i}" for i in range(104)]
    docs = {}
    for k in range(12):
        docs[100 - k] = " ".join(words)
        words[8 * k] = f"x{k}"
    want = all_pairs(docs)
    got = jaccard.jaccard_groups(spark.createDataFrame([(k, t, None, None) for k, t in docs.items()], SCHEMA)).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == want
    assert len({c for _, c in want.values()}) == 1


def test_nulls_repeats_and_empty(spark):
    text = " ".join(f"a{i}" for i in range(50))
    rows = [(7, text, None, None), (7, text, None, None), (9, text.upper(), "x", 1), (None, text, "x", 1), (None, "b", "x", 1), (3, None, "x", 1), (4, "", "x", 1), (5, " ", "x", 1), (6, "two words", "x", 1), (8, "Two  words", "x", 1)]
    got = jaccard.jaccard_groups(spark.createDataFrame(rows, SCHEMA)).collect()
    key = lambda r: tuple(-99 if v is None else v for v in r)
    assert sorted(map(key, got)) == [(-99, -99, -99)] * 2 + [(3, 0, 3), (4, 0, 4), (5, 0, 5), (6, 1, 6), (7, 46, 7), (7, 46, 7), (8, 1, 6), (9, 46, 7)]
    assert jaccard.jaccard_groups(spark.createDataFrame([], SCHEMA)).count() == 0


def test_large_group_of_near_copies(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(200)]
    rows = []
    for k in range(400):
        own = list(words)
        own[rng.randrange(200)] = f"x{k}"
        rows.append((k, " ".join(own), "x", 1))
    got = jaccard.jaccard_groups(spark.createDataFrame(rows, SCHEMA))
    assert got.agg(F.min("component_id"), F.max("component_id")).first()[:] == (0, 0)


def test_components(spark):
    edges = [(5, 9), (9, 7), (1, 2), (3, 3), (8, 2), (10, 8), (4, 10), (20, 21), (22, 21), (23, 22)]
    got = components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()
    assert sorted((r["node"], r["root"]) for r in got) == [(1, 1), (2, 1), (4, 1), (5, 5), (7, 5), (8, 1), (9, 5), (10, 1), (20, 20), (21, 20), (22, 20), (23, 20)]


def test_query_on_given_tables(spark):
    folder = "/root/testdata/sf0.001"
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    got = QUERIES["op9_ngram_jaccard_join"](spark, folder).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == all_pairs(docs)
