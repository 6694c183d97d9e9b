"""Histogram shards against a plain sort of the same keys."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import pytest

from tessera.llm import sharding
from tessera.llm.common import NO_ID

SCHEMA = "doc_id long, text string, shard string, slot double, size int, `row` int, k1 string, piece int"


def frame(spark, docs):
    return spark.createDataFrame([(i, t, "x", 0.5, 1, 2, "k", 3) for i, t in docs], SCHEMA)


def hash60(text):
    return int(hashlib.md5(text.encode()).hexdigest()[:15], 16)


def plain_cuts(docs, shards, tolerance):
    """Bytes below each splitter, times ``shards``: the ends of equal texts, of equal (text, id), or of rows."""
    rows = sorted((hash60(t or ""), NO_ID if i is None else i, len((t or "").encode()) + 1) for i, t in docs)
    total = sum(r[2] for r in rows)
    cuts = []
    for s in range(1, shards):
        for level in (1, 2, 3):
            ends, below = [0], 0
            for k, r in enumerate(rows):
                below += r[2]
                if level == 3 or k + 1 == len(rows) or rows[k + 1][:level] != r[:level]:
                    ends.append(below)
            best = min(ends, key=lambda e: (abs(shards * e - s * total), e))
            if abs(shards * best - s * total) <= tolerance * total:
                break
        cuts.append(best)
    return cuts, total


@pytest.mark.parametrize(("shards", "tolerance"), [(8, 0.005), (3, 0.0), (5, 0.2), (1, 0.01)])
def test_against_plain_sort(spark, shards, tolerance):
    rng = random.Random(shards)
    texts = ["hot text " * 30] * 100 + ["é" * rng.randint(0, 400) + str(rng.random()) for _ in range(150)] + ["warm"] * 40 + ["a long one " * 3000]
    docs = [(rng.choice([k, -k * 10**15]), t) for k, t in enumerate(texts)]
    got = sharding.shard_documents(frame(spark, docs), shards, tolerance).collect()
    assert Counter((r["row"]["doc_id"], r["row"]["text"]) for r in got) == Counter(docs)
    assert all(r["size"] == len(r["row"]["text"].encode()) + 1 for r in got)
    by = defaultdict(list)
    for r in got:
        by[r["shard"]].append(r)
    for rows in by.values():
        assert sorted(r["slot"] for r in rows) == list(range(len(rows)))
    cuts, total = plain_cuts(docs, shards, tolerance)
    sizes = [sum(r["size"] for r in by[s]) for s in range(shards)]
    assert sizes == [b - a for a, b in zip([0, *cuts], [*cuts, total], strict=True)]


def test_equal_texts_stay_together_within_tolerance(spark):
    docs = [(k, f"text {k // 10}") for k in range(4000)]
    got = sharding.shard_documents(frame(spark, docs), 8, tolerance=0.02).collect()  # a group of ten is 0.02 of a shard
    homes = defaultdict(set)
    for r in got:
        homes[r["row"]["text"]].add(r["shard"])
    assert all(len(h) == 1 for h in homes.values())
    sizes = Counter()
    for r in got:
        sizes[r["shard"]] += r["size"]
    mean = sum(sizes.values()) / 8
    assert all(abs(sizes[s] - mean) <= 0.04 * mean for s in range(8))


def test_pieces_number_a_shard_without_gaps(spark, monkeypatch):
    monkeypatch.setattr(sharding, "PIECE", 200)
    docs = [(k, "same text") for k in range(300)] + [(k, f"t{k}") for k in range(300, 500)]
    got = sharding.shard_documents(frame(spark, docs), 4)
    rows = got.collect()
    for s in range(4):
        slots = [r["slot"] for r in rows if r["shard"] == s]
        assert sorted(slots) == list(range(len(slots)))


def test_nulls_repeats_empty_and_few_rows(spark):
    docs = [(None, None), (None, None), (None, ""), (1, "a"), (1, "a"), (1, "a"), (2, None), (2, "b")]
    rows = sharding.shard_documents(frame(spark, docs), 8).collect()
    assert Counter((r["row"]["doc_id"], r["row"]["text"], r["size"]) for r in rows) == Counter((i, t, len(t or "") + 1) for i, t in docs)
    assert {r["shard"] for r in rows} <= set(range(8))
    alone = sharding.shard_documents(frame(spark, [(5, "one")]), 8).collect()
    assert len(alone) == 1 and alone[0]["slot"] == 0
    assert sharding.shard_documents(frame(spark, []), 8).count() == 0


def test_query_columns_and_files(spark, tmp_path):
    folder = "/root/testdata/sf0.001"
    got = sharding.op12(spark, folder)
    assert got.dtypes[:7] == [("doc_id", "bigint"), ("size", "bigint"), ("text_crc32", "bigint"), ("law", "string"), ("shard", "int"), ("slot", "bigint"), ("grown_shard", "int")]
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert all(r["text_crc32"] == zlib.crc32((texts[r["doc_id"]] or "").encode()) for r in got.collect())
    path = str(tmp_path / "shards")
    sharding.write_shards(sharding.shard_documents(docs), path)
    back = spark.read.parquet(path)
    assert {(r["doc_id"], r["shard"], r["slot"]) for r in got.collect()} == {(r["row"]["doc_id"], r["shard"], r["slot"]) for r in back.collect()}


def test_main_path_is_native(spark):
    plan = sharding.op12(spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
