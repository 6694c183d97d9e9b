"""Best-position search against scoring every document."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from tessera.llm import ranked_search as rs

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, score string, rank int, item long, id string"
ITEMS = "item_id long, text string, score string, id double"


def terms(text):
    return TERM.findall((text or "").translate(UPPER))


def brute(docs, items, k=10):
    listed = [(i, Counter(terms(t)), len(terms(t))) for i, t in docs]
    n_docs, total = sum(n > 0 for *_, n in listed), sum(n for *_, n in listed)
    df = Counter(t for _, c, _ in listed for t in c)
    out = []
    for item in {i for i, _ in items}:
        own = {t for i, text in items if i == item for t in terms(text)}
        scores = []
        for i, c, n in listed:
            if n:
                m = 10 + 90 * n * n_docs // total
                score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in own if c[t])
                scores.append((-score, i is not None, i or 0, i))
        for r, (s, *_, i) in enumerate(sorted(scores)[:k], 1):
            if s < 0:
                out.append((item, r, i, -s))
    return sorted(out, key=str)


def frames(spark, docs, items):
    return spark.createDataFrame([(i, t, "s", 1, 2, "d") for i, t in docs], SCHEMA), spark.createDataFrame([(i, t, "s", 0.5) for i, t in items], ITEMS)


def corpus(seed):
    rng = random.Random(seed)
    vocabulary = [f"t{i}" for i in range(60)] + ["Été", "naïve", "x1"] + ["common"] * 20
    docs = [(k, rng.choice([" ", "-", "\n"]).join(rng.choices(vocabulary, k=rng.randint(1, 40)))) for k in rng.sample(range(-500, 5000), 400)]
    docs += [(6000 + k, docs[0][1]) for k in range(60)] + [(None, None), (7000, ""), (7001, "--- !!"), (7002, "common " * 3000), (None, "t1 t2 T3")]
    items = [(k, " ".join(rng.choices(vocabulary, k=rng.randint(1, 25)))) for k in range(12)] + [(20, "COMMON common"), (21, None), (22, "nowhere"), (23, docs[0][1]), (None, "t5 t6")]
    rng.shuffle(docs)
    return docs, items


@pytest.mark.parametrize("seed", range(3))
def test_against_every_score(spark, monkeypatch, seed):
    if seed:  # many blocks, and several groups of queries
        for name, value in (("BLOCK_TEXT", 3000), ("BLOCK_CELLS", 1500), ("QUERY_BYTES", 400), ("STRIDE", seed)):
            monkeypatch.setattr(rs, name, value)
    docs, items = corpus(seed)
    got = rs.lexical_search(*frames(spark, docs, items)).collect()
    assert sorted(((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in got), key=str) == brute(docs, items)


def one_block(docs):
    """Lists over whole documents of one block, and the hashes of its terms."""
    data = "\x00".join(t for _, t in docs).encode()
    starts = np.concatenate([[0], np.cumsum([len(t.encode()) + 1 for _, t in docs])])
    starts[-1] = len(data)
    words = rs.term_words(np.frombuffer(data, np.uint8), starts)
    own = np.unique(words.hashes())
    at = np.searchsorted(own, words.hashes())
    key, tf = np.unique(at * len(docs) + words.text_of_word(), return_counts=True)
    row = {"ids": np.array([i for i, _ in docs], np.int64).tobytes(), "n": words.counts.astype(np.int64).tobytes(), "terms": list(range(len(own)))}
    row |= {"counts": np.bincount(key // len(docs)).tolist(), "doc": (key % len(docs)).astype(np.int32).tobytes(), "tf": tf.astype(np.int32).tobytes()}
    return rs.Lists(np.full(len(own), 1000), len(docs), int(words.first[-1]), row), own


def test_stops_early_and_only_strictly_below():
    docs = [(k, "rare word here") for k in range(5)] + [(k, "here and there are words") for k in range(100, 4000)]
    lists, own = one_block(docs)
    probe = rs.term_words(np.frombuffer(b"rare word", np.uint8), np.array([0, 9])).hashes()
    terms_ = np.searchsorted(own, np.unique(probe))
    best = []
    lists.search(terms_, best, 3)
    assert [d for _, d in best] == [0, 1, 2]
    # a tenth score that is equal to the bound must not stop the reading: smaller ids follow in this block
    tied = [(best[0][0], 10**6), (best[0][0], 10**6 + 1), (best[0][0], 10**6 + 2)]
    lists.search(terms_, tied, 3)
    assert [d for _, d in tied] == [0, 1, 2]
    # and one strictly above it lets the block be skipped without an access
    higher = [(best[0][0] - 1, 10**6 + k) for k in range(3)]
    assert lists.search(terms_, higher, 3) == 0
    everywhere = np.searchsorted(own, np.unique(rs.term_words(np.frombuffer(b"rare here", np.uint8), np.array([0, 9])).hashes()))
    best = []
    assert lists.search(everywhere, best, 3) < 2 * len(docs) and [d for _, d in best] == [0, 1, 2]


def test_empty_tables(spark):
    docs, items = frames(spark, [(1, "a b")], [(1, "a")])
    assert rs.lexical_search(docs.limit(0), items).count() == 0
    assert rs.lexical_search(docs, items.limit(0)).count() == 0
    assert [tuple(r) for r in rs.lexical_search(docs, items).collect()] == [tuple(brute([(1, "a b")], [(1, "a")])[0])]
