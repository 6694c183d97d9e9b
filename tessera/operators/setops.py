"""Set operations between splits, releases and shards."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.joins import duplicated_keys


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    """Union by name; a column absent from one frame is NULL there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def set_relation(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Sizes of both sets, their intersection and both differences, and equality, from one grouping."""
    tagged = a.select(key).withColumn("s", F.lit(1)).unionByName(b.select(key).withColumn("s", F.lit(2)))
    per = tagged.groupBy(key).agg(F.bit_or("s").alias("m"))
    n = lambda v: F.coalesce(F.sum((F.col("m") == v).cast("long")), F.lit(0))
    return per.agg(n(3).alias("n_both"), n(1).alias("n_only_a"), n(2).alias("n_only_b")).withColumn(
        "equal", (F.col("n_only_a") == 0) & (F.col("n_only_b") == 0)
    )


def merge_parts(parts: Sequence[DataFrame], key: Sequence[str], expected: DataFrame, constant: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Merged shards and their check table: exactly-once coverage and equal configuration columns."""
    merged = union_all(parts)
    n = lambda df, name: df.agg(F.count(F.lit(1)).alias("n_violations")).select(F.lit(name).alias("check"), "n_violations")
    checks = [
        n(expected.select(*key).join(merged, list(key), "left_anti"), "not_covered"),
        n(merged.join(expected.select(*key), list(key), "left_anti"), "unexpected"),
        n(duplicated_keys(merged, key), "covered_twice"),
    ]
    for c in constant:
        spread = merged.agg((F.min(c) != F.max(c)).cast("long").alias("n_violations"))
        checks.append(spread.select(F.lit(f"{c}_differs").alias("check"), F.coalesce("n_violations", F.lit(0)).alias("n_violations")))
    return merged, reduce(DataFrame.unionByName, checks)
