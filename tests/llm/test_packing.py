"""Packing against the plain one-piece-at-a-time method."""

from __future__ import annotations

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tessera.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, sequence_id string, id int"


def best_fit_decreasing(lengths, capacity):
    """Remaining capacities of the sequences, in order of opening."""
    bins: list[int] = []
    for n in sorted(lengths, reverse=True):
        fitting = [(r, i) for i, r in enumerate(bins) if r >= n]
        if fitting:
            bins[min(fitting)[1]] -= n
        else:
            bins.append(capacity - n)
    return bins


@pytest.mark.parametrize("seed", range(30))
def test_plan_equals_plain_method(seed):
    rng = random.Random(seed)
    capacity = rng.choice([1, 7, 20, 50])
    lengths = [rng.randint(1, capacity) for _ in range(rng.randint(0, 80))]
    counts = {n: lengths.count(n) for n in set(lengths)}
    places: dict[int, list[tuple[int, int]]] = {}
    ranks: dict[int, set[int]] = {n: set() for n in counts}
    for length, rank, count, sequence, offset in packing.plan_runs(counts, capacity):
        for k in range(count):
            places.setdefault(sequence + k, []).append((offset, length))
            assert rank + k not in ranks[length]
            ranks[length].add(rank + k)
    assert all(ranks[n] == set(range(c)) for n, c in counts.items())
    for spots in places.values():
        at = 0
        for offset, length in sorted(spots):
            assert offset == at
            at += length
        assert at <= capacity
    left = sorted(capacity - sum(n for _, n in s) for s in places.values())
    assert left == sorted(best_fit_decreasing(lengths, capacity))


def test_tightest_open():
    tree = packing.RemainingCapacities(10)
    assert tree.tightest(0) is None
    for r in (3, 7):
        tree.set(r, True)
    assert [tree.tightest(n) for n in (1, 3, 4, 7, 8)] == [3, 3, 7, 7, None]


def test_a_piece_beyond_the_capacity_is_refused():
    with pytest.raises(ValueError):
        packing.plan_runs({11: 1}, 10)


def test_documents(spark):
    words = "the license of a long tale about nothing and all that ".split()
    rng = random.Random(1)
    texts = {i: " ".join(rng.choices(words, k=rng.randint(0, 90))) for i in range(60)}
    rows = [(k, t, "x", 1) for k, t in texts.items()] + [(60, None, None, None), (61, "", "y", 0), (None, "the end", "z", 2), (5, texts[5], "x", 1)]
    got = packing.pack_documents(spark.createDataFrame(rows, SCHEMA), PATH, capacity=40).collect()
    tokenizer = Tokenizer.from_file(PATH)
    want = []
    for k, t, *_ in rows:
        ids = np.array(tokenizer.encode(t or "", add_special_tokens=False).ids + [1], "<u4")
        want += [(k, p, s, len(ids[s : s + 40]), zlib.crc32(ids[s : s + 40].tobytes())) for p, s in enumerate(range(0, len(ids), 40))]
    key = lambda r: tuple(-1 if v is None else v for v in r)
    assert sorted((tuple(r)[:5] for r in got), key=key) == sorted(want, key=key)
    bins: dict[int, list] = {}
    for r in got:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for spots in bins.values():
        at = 0
        for offset, length in sorted(spots):
            assert offset == at
            at += length
        assert at <= 40
    assert len(bins) == len(best_fit_decreasing([w[3] for w in want], 40))


def test_empty_table(spark):
    got = packing.pack_documents(spark.createDataFrame([], SCHEMA), PATH)
    assert got.count() == 0
    assert got.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]


def test_one_length_holding_most_rows_is_spread(spark):
    df = spark.range(3000).select("id", F.lit(3).alias("length"))
    got = packing.packed(df, 10, ["id"])
    assert got.groupBy("sequence_id").count().where("count > 3").count() == 0
    assert got.select("sequence_id").distinct().count() == 1000
    assert got.select("sequence_id", "offset").distinct().count() == 3000
