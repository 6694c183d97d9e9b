"""Decontamination against all windows."""

from __future__ import annotations

import random

import numpy as np

from tessera.llm import decontaminate
from tessera.llm.queries import QUERIES

SCHEMA = "doc_id long, text string, item_id string, distance int"


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def all_windows(docs, items):
    out = {}
    for k, t in docs.items():
        words = (t or "").lower().split()
        for i, x in items.items():
            item = (x or "").lower().split()
            m = len(item)
            if m >= 5:
                found = [(d, s) for s in range(len(words) - m + 1) if (d := distance(words[s : s + m], item)) <= m // 5]
                if found:
                    out[k, i] = min(found)
    return out


def planted(seed=0):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)] + ["the", "of", "and"] * 40
    items = {i: " ".join(rng.choices(vocabulary, k=rng.randint(12, 45))) for i in range(25)}
    docs = {}
    for k in range(70):
        words = rng.choices(vocabulary, k=rng.randint(0, 90))
        if k % 2:
            item = items[rng.randrange(25)].split()
            for _ in range(rng.choice([0, 0, 1, 2, 3, len(item) // 5])):
                at = rng.randrange(len(item))
                kind = rng.random()
                item[at : at + 1] = [] if kind < 0.25 else [item[at], "new"] if kind < 0.5 else ["changed"]
            at = rng.randint(0, len(words))
            words[at:at] = [w.upper() for w in item]
        docs[k] = " ".join(words)
    return docs, items


def test_recall_and_exact_distances(spark):
    docs, items = planted()
    want = all_windows(docs, items)
    got = decontaminate.occurrences(
        spark.createDataFrame([(k, t, "x", 1) for k, t in docs.items()], SCHEMA),
        spark.createDataFrame(list(items.items()), "item_id long, text string"),
    ).collect()
    found = {(r["doc_id"], r["item_id"]): (r["distance"], r["start_word"]) for r in got}
    assert set(found) <= set(want)
    assert len(found) >= 0.95 * len(want) and len(want) > 25
    assert all(d >= want[p][0] for p, (d, _) in found.items())
    assert sum(found[p] == want[p] for p in found) >= 0.9 * len(found)
    assert all(p in found for p, (d, _) in want.items() if d == 0)


def test_edit_distances():
    rng = np.random.default_rng(0)
    x, y = rng.integers(0, 4, (60, 9)).astype(np.uint64), rng.integers(0, 4, (60, 9)).astype(np.uint64)
    assert decontaminate.edit_distances(x, y).tolist() == [distance(a, b) for a, b in zip(x.tolist(), y.tolist(), strict=True)]


def test_large_benchmarks_take_several_passes(spark, monkeypatch):
    docs, items = planted(3)
    d = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    b = spark.createDataFrame(list(items.items()), "item_id long, text string")
    once = sorted(map(tuple, decontaminate.occurrences(d, b).collect()))
    monkeypatch.setattr(decontaminate, "ITEM_BYTES", 1500)
    assert sorted(map(tuple, decontaminate.occurrences(d, b).collect())) == once


def test_nulls_repeats_and_empty(spark):
    text = "one two three four five six"
    docs = spark.createDataFrame([(1, text, None, None), (1, text, None, None), (None, "x " + text, "k", 1), (2, None, "k", 1), (3, "", "k", 1), (4, "clean", "k", 1)], SCHEMA)
    items = spark.createDataFrame([(7, text), (None, text), (8, None), (9, "two three"), (10, "")], "item_id long, text string")
    got = decontaminate.occurrences(docs, items).collect()
    assert sorted((r["doc_id"] or -1, r["item_id"] or -1, r["start_word"], r["distance"]) for r in got) == [(-1, -1, 1, 0), (-1, 7, 1, 0)] + [(1, -1, 0, 0)] * 2 + [(1, 7, 0, 0)] * 2
    assert sorted(r["doc_id"] or -1 for r in decontaminate.without_benchmark(docs, items).collect()) == [-1, 2, 3, 4]
    empty = spark.createDataFrame([], SCHEMA)
    assert decontaminate.occurrences(empty, items).count() == 0
    assert decontaminate.occurrences(docs, items.limit(0)).count() == 0


def test_query_finds_whole_items(spark):
    folder = "/root/testdata/sf0.01"
    docs = {r["doc_id"]: r["text"].lower().split() for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    items = {r["item_id"]: r["text"].lower().split() for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()}
    want = {(k, i) for k, d in docs.items() for i, m in items.items() if any(d[s : s + len(m)] == m for s in range(len(d)) if d[s] == m[0])}
    got = {(r["doc_id"], r["item_id"]): r["distance"] for r in QUERIES["op7_decontamination"](spark, folder).collect()}
    assert want and all(got.get(p) == 0 for p in want)


def test_every_window_at_the_bound_is_found(spark):
    rng = random.Random(5)
    docs, items, want = {}, {}, set()
    for i, m in enumerate([20, 45, 60, 100, 200] * 6):
        item = [f"i{i}w{j}" for j in range(m)]
        text = list(item)
        for j in rng.sample(range(m), m // 5):
            text[j] = "other"
        items[i], docs[i] = " ".join(item), " ".join(["before"] * 4 + text + ["behind"] * 3)
        want.add((i, i, 4, m // 5))
    got = decontaminate.occurrences(
        spark.createDataFrame(list(docs.items()), "doc_id long, text string"),
        spark.createDataFrame(list(items.items()), "item_id long, text string"),
    ).collect()
    assert {(r["doc_id"], r["item_id"], r["start_word"], r["distance"]) for r in got} == want


def nearest(item, words):
    """Distance, start and size of the nearest window of any size."""
    m = len(item)
    sizes = range(max(m - m // 5, 1), m + m // 5 + 1)
    return min(((distance(words[s : s + n], item), s, n) for n in sizes for s in range(len(words) - n + 1)), default=(m, 0, 0))


def free_ends(spark, docs, items):
    got = decontaminate.occurrences(
        spark.createDataFrame(list(docs.items()), "doc_id long, text string"),
        spark.createDataFrame(list(items.items()), "item_id long, text string"),
        free_ends=True,
    ).collect()
    return {(r["doc_id"], r["item_id"]): (r["distance"], r["start_word"], r["n_words"]) for r in got}


def test_free_ends_against_windows_of_all_sizes(spark):
    docs, items = planted(1)
    docs = {k: t for k, t in docs.items() if k < 40} | {100: items[0] + " x " + items[0].replace(" the ", " ") * 9, 101: ""}
    items = {i: t for i, t in items.items() if i < 12}
    want = {}
    for k, t in docs.items():
        words = t.lower().split()
        for i, x in items.items():
            item = x.lower().split()
            if len(set(words) & set(item)) > len(set(item)) // 2:
                best = nearest(item, words)
                if best[0] <= len(item) // 5:
                    want[k, i] = best
    assert len(want) > 8
    assert free_ends(spark, docs, items) == want


def test_insertions_count_once_and_short_texts_match(spark):
    item = [f"i{j}" for j in range(38)]
    inserted = list(item)
    for at in (3, 9, 14, 20, 25, 30, 35):
        inserted.insert(at, "new")
    docs = {0: " ".join(["x"] * 5 + inserted + ["y"] * 5), 1: " ".join(item[:10] + item[11:]), 2: " ".join(item[7:]), 3: " ".join(item[8:]), 4: "a b c d"}
    assert free_ends(spark, docs, {7: " ".join(item), 8: "a b c d e"}) == {(0, 7): (7, 5, 45), (1, 7): (1, 0, 37), (2, 7): (7, 0, 31), (4, 8): (1, 0, 4)}
    d = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    b = spark.createDataFrame([(7, " ".join(item)), (8, "a b c d e")], "item_id long, text string")
    assert [r["doc_id"] for r in decontaminate.without_benchmark(d, b).collect()] == [3]


def test_query_finds_windows_of_other_sizes(spark, tmp_path):
    item = [f"i{j}" for j in range(10)]
    spark.createDataFrame([(1, " ".join(item[1:]))], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(5, " ".join(item))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = QUERIES["op7_decontamination"](spark, str(tmp_path)).collect()
    assert [(r["doc_id"], r["item_id"], r["n_words"], r["distance"]) for r in got] == [(1, 5, 9, 1)]
