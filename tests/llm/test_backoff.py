"""Stupid backoff against plain counting."""

from __future__ import annotations

import math
import random
from collections import Counter

import pytest

from tessera.llm import backoff

SCHEMA = "doc_id long, text string, g1 string, tf int"


def plain_scores(docs, order, alpha=0.4, least=2):
    words = [(t or "").lower().split() for t in docs]
    counts = Counter(tuple(w[i : i + n]) for w in words for n in range(1, order + 1) for i in range(len(w) - n + 1))
    total = sum(map(len, words))
    out = []
    for w in words:
        score = 0.0
        for i in range(len(w)):
            for n in range(order, 0, -1):
                gram = tuple(w[i - n + 1 : i + 1]) if i - n + 1 >= 0 else None
                if n == 1:
                    score += math.log(counts[gram] / total) + (order - 1) * math.log(alpha)
                elif gram and counts[gram] >= least:
                    score += math.log(counts[gram] / counts[gram[:-1]]) + (order - n) * math.log(alpha)
                    break
        out.append((len(w), score))
    return out


@pytest.mark.parametrize("order", [1, 2, 3])
def test_against_plain_counting(spark, order):
    rng = random.Random(order)
    vocabulary = [f"W{i}" for i in range(25)] + ["é", "the"] * 5
    texts = [" ".join(rng.choices(vocabulary, k=rng.randint(0, 40))) for _ in range(50)] + [None, "", "once", "the the the", "long " * 4000]
    rows = [(i, t, None, 1) for i, t in enumerate(texts)]
    got = {r["doc_id"]: r for r in backoff.backoff_scores(spark.createDataFrame(rows, SCHEMA), order).collect()}
    for i, (n, score) in enumerate(plain_scores(texts, order)):
        assert got[i]["n_words"] == n and got[i]["score"] == pytest.approx(score, abs=1e-6), texts[i]
        assert (got[i]["mean_score"] is None) == (n == 0)


def test_repeats_null_ids_and_empty(spark):
    rows = [(1, "a b a", None, None), (1, "a b a", None, None), (None, "a b", "x", 1), (2, "a b a", "x", 1)]
    got = backoff.backoff_scores(spark.createDataFrame(rows, SCHEMA)).collect()
    want = plain_scores([t for _, t, *_ in rows], 2)
    assert sorted((r["doc_id"] or -1, r["n_words"], round(r["score"], 6)) for r in got) == sorted((k or -1, n, round(s, 6)) for (k, *_), (n, s) in zip(rows, want, strict=True))
    assert backoff.backoff_scores(spark.createDataFrame([], SCHEMA)).count() == 0
