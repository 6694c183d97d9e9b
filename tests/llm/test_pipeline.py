"""The pipeline's stages against brute force on the smallest tables."""

from __future__ import annotations

import corpus_pipeline as cp
from pyspark.sql import functions as F

from .test_jaccard import all_pairs
from .test_substring import by_definition

FOLDER = "/root/testdata/sf0.001"


def test_stages_one_after_another(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns = docs.columns
    for name, stage in cp.STAGES[:-1]:
        before = {r["doc_id"]: r for r in docs.collect()}
        docs = stage(spark, docs, FOLDER)
        assert docs.columns == columns
        after = {r["doc_id"]: r for r in docs.collect()}
        assert set(after) <= set(before) and after
        if name == "near_copies":
            want = all_pairs({k: r["text"] for k, r in before.items()})
            assert set(after) == {k for k, (_, c) in want.items() if k == c}
            assert all(after[k] == before[k] for k in after)
        elif name == "repeated_passages":
            want = by_definition({k: r["text"] for k, r in before.items()}, 20)
            assert set(after) == {k for k, (n, gone, _) in want.items() if not gone or gone < n}
            assert all(after[k]["text"] == (want[k][2] if want[k][1] else before[k]["text"]) for k in after)
        else:
            assert all(after[k] == before[k] for k in after)
        docs = spark.createDataFrame(list(after.values()), docs.schema)
    assert set(r["doc_id"] for r in cp.STAGES[-1][1](spark, docs, FOLDER).collect()) == set(after)


def test_extra_columns_of_clashing_names(spark):
    names = ["n_words", "n_removed", "kept", "_kept", "rule", "row", "cut", "id", "component_id", "n_shingles", "item_id", "distance", "_text", "_words", "length", "piece"]
    plain = spark.read.parquet(f"{FOLDER}/documents.parquet")
    docs = plain.select("*", *[F.concat(F.lit(c), F.col("doc_id").cast("string")).alias(c) for c in names])
    for _, stage in cp.STAGES[:-1]:
        got = stage(spark, docs, FOLDER)
        assert got.dtypes == docs.dtypes
        rows = {r["doc_id"]: r for r in got.collect()}
        assert all(r[c] == f"{c}{k}" for k, r in rows.items() for c in names)
        assert set(rows) == {r["doc_id"] for r in stage(spark, plain, FOLDER).collect()}
    assert cp.STAGES[-1][1](spark, docs, FOLDER).count() > 0


def test_run(spark):
    got = cp.run(spark, FOLDER)
    assert got.columns[0] == "doc_id" and got.count() > 0
    assert [n for n, _ in cp.STAGES] == ["quality_rules", "near_copies", "repeated_passages", "decontamination", "packing"]


def test_empty_documents(spark):
    empty = spark.read.parquet(f"{FOLDER}/documents.parquet").limit(0)
    for _, stage in cp.STAGES[:-1]:
        assert stage(spark, empty, FOLDER).count() == 0
