"""Word hashes: patterns that fool polynomial hashes must not."""

from __future__ import annotations

import random

import numpy as np

from tessera.llm import backoff, decontaminate, jaccard, substring
from tessera.llm.words import space_words

from .test_backoff import plain_scores


def thue_morse(n, a="a", b="b"):
    return "".join(b if bin(i).count("1") % 2 else a for i in range(n))


X, Y = thue_morse(1024), thue_morse(1024, "b", "a")


def test_different_words_different_hashes():
    rng = random.Random(1)
    words = {X, Y, *(thue_morse(n) for n in range(1, 200)), *("".join(rng.choices("abé", k=rng.randint(1, 140))) for _ in range(5000)), *(chr(c) for c in range(33, 127))}
    words = sorted(words)
    text = " ".join([*words, *words]).encode()
    h = space_words(np.frombuffer(text, np.uint8), np.array([0, len(text)])).hashes()
    assert len(set(h[: len(words)].tolist())) == len(words) and (h[: len(words)] == h[len(words) :]).all()


def test_hash_does_not_depend_on_surroundings():
    data = b"abc abc\x00 abcdefgh abcdefghi " + b"x" * 65
    h = space_words(np.frombuffer(data, np.uint8), np.array([0, len(data)])).hashes()
    for w, v in zip(data.split(), h.tolist(), strict=True):
        assert space_words(np.frombuffer(w, np.uint8), np.array([0, len(w)])).hashes()[0] == v


def frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts, 1)), "doc_id long, text string")


def test_substring_dedup(spark):
    head = " ".join(f"w{i}" for i in range(19))
    got = {r["doc_id"]: r["n_removed"] for r in substring.dedup_substrings(frame(spark, [f"{head} {X}", f"{head} {Y}"])).collect()}
    assert got == {1: 0, 2: 0}
    # patterns of whole words, in stretches of any length
    a, b = (" ".join(thue_morse(2048, *p)) for p in (("p", "q"), ("q", "p")))
    hashes = space_words(np.frombuffer(f"{a} {b}".encode(), np.uint8), np.array([0, len(a) + len(b) + 1])).hashes()
    one, two = substring.stretch_hashes(hashes, np.array([0, 2048]), np.array([2048, 2048]))
    assert one != two


def test_jaccard(spark):
    got = {r["doc_id"]: r["component_id"] for r in jaccard.jaccard_groups(frame(spark, [f"a b c d {X}", f"a b c d {Y}"])).collect()}
    assert got == {1: 1, 2: 2}


def test_backoff(spark):
    texts = [f"a {X} c", f"a {Y} c", f"{X} {X}"]
    got = {r["doc_id"]: r["score"] for r in backoff.backoff_scores(frame(spark, texts), 2).collect()}
    for i, (_, score) in enumerate(plain_scores(texts, 2), 1):
        assert abs(got[i] - score) < 1e-6


def test_decontamination(spark):
    item = "one two three four five six seven eight"
    items = spark.createDataFrame([(1, f"{item} {X} nine ten")], "item_id long, text string")
    found = decontaminate.occurrences(frame(spark, [f"{item} {X} nine ten", f"{item} {Y} nine ten"]), items, free_ends=True).collect()
    distance = {r["doc_id"]: r["distance"] for r in found}
    assert distance[1] == 0 and distance.get(2) == 1
