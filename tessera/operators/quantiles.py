"""Exact interpolated quantiles of groups of any size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.joins import same_key_join
from tessera.operators.ranked import running_total


def exact_quantile(df: DataFrame, value: str, probabilities: Sequence[float], by: Sequence[str] = (), count: str | None = None) -> DataFrame:
    """``(by..., probability, quantile)`` with linear interpolation; NULL values are ignored.

    ``count`` names a column that says how many rows a row stands for. A row looks up the probabilities that fall on it, so
    distinct values are not multiplied by them.

    Distinct values get their cumulative count by value range, so a group never has to fit into
    one task, unlike with ``percentile``, which keeps all distinct values of a group together.
    """
    levels = df.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).cast("double").alias("__v")).agg(
        (F.sum(count) if count else F.count(F.lit(1))).alias("__c")
    )
    steps = running_total(levels, by, "__v", {"__c": F.col("__c")})
    wanted = F.array(*[F.lit(float(p)) for p in probabilities])
    at = lambda p: p * (F.col("__c_total") - 1)
    inside = lambda at: (at >= F.col("__c_before")) & (at < F.col("__c_before") + F.col("__c"))
    here = F.filter(wanted, lambda p: inside(F.floor(at(p))) | inside(F.ceil(at(p))))
    hit = steps.withColumn("__p", F.explode(here))
    position = at(F.col("__p"))
    low, high = F.floor(position), F.ceil(position)
    return hit.groupBy(*by, "__p").agg(
        F.max(F.when(inside(low), F.col("__v"))).alias("__a"),
        F.max(F.when(inside(high), F.col("__v"))).alias("__b"),
        F.max(position - low).alias("__w"),
    ).select(*by, F.col("__p").alias("probability"), F.expr("__a + (__b - __a) * __w").alias("quantile"))


def quantile_array(df: DataFrame, value: str, probabilities: Sequence[float], by: Sequence[str] = (), count: str | None = None) -> DataFrame:
    """``(by..., q)``: the quantiles as an array in ascending order of probability."""
    q = exact_quantile(df, value, probabilities, by, count)
    packed = q.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("probability", "quantile"))).alias("__q"))
    return packed.select(*by, F.transform("__q", lambda e: e["quantile"]).alias("q"))


def quantile_summary(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """Count, mean, min, quartiles and max of the stated values."""
    q = quantile_array(df, value, [0.0, 0.25, 0.5, 0.75, 1.0], by)
    g = df.groupBy(*by).agg(F.count(value).alias("n_finite"), F.avg(value).alias("mean"))
    joined = same_key_join(g, q, by, "left") if by else g.withColumn("q", q.scalar())
    names = ("min", "q25", "median", "q75", "max")
    return joined.select(*by, "n_finite", "mean", *[F.col("q")[i].alias(n) for i, n in enumerate(names)])
