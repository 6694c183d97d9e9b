"""Numeric column helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def r6(c: Column, places: int = 6) -> Column:
    return F.round(c, places)


def half_even(c: Column) -> Column:
    """Round half to even, as quota counts need."""
    return F.bround(c, 0)


def clip(c: Column, low: float, high: float) -> Column:
    return F.greatest(F.least(c, F.lit(high)), F.lit(low))


def clipped_prob(p: Column, eps: float) -> Column:
    return clip(p, eps, 1.0 - eps)


def sigmoid(z: Column) -> Column:
    """Logistic function, written so that neither tail overflows."""
    tail = F.exp(-F.abs(z))
    return F.when(z >= 0, 1.0 / (1.0 + tail)).otherwise(tail / (1.0 + tail))


def logit(p: Column, eps: float = 1e-6) -> Column:
    q = clipped_prob(p, eps)
    return F.log(q) - F.log(1.0 - q)


def smd_continuous(mean_a: Column, var_a: Column, mean_b: Column, var_b: Column) -> Column:
    """Standardised mean difference a - b; equal means give 0, zero spread otherwise inf."""
    pooled = F.sqrt((var_a + var_b) / 2.0)
    gap = mean_a - mean_b
    return (
        F.when(pooled > 0, gap / pooled)
        .when(gap == 0, F.lit(0.0))
        .when(gap.isNotNull(), F.lit(float("inf")))
    )


def smd_level(pa: Column, pb: Column) -> Column:
    """Standardised difference of two proportions."""
    scale = F.sqrt((pa * (1.0 - pa) + pb * (1.0 - pb)) / 2.0)
    return (
        F.when(scale > 0, (pa - pb) / scale)
        .when(pa == pb, F.lit(0.0))
        .when(pa.isNotNull() & pb.isNotNull(), F.lit(float("inf")))
    )
