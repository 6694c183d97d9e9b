"""Logistic recalibration of many cells at once, prior shift and monotone transport."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import logit, sigmoid
from tessera.operators import replicates
from tessera.operators.joins import broadcast_if_small, same_key_join
from tessera.operators.ranked import range_edges, with_range_bucket
from tessera.session import cut_lineage

def fit_cells(
    df: DataFrame,
    cell: Sequence[str],
    x: str,
    label: str,
    weight: str | None = None,
    l2: float = 0.0,
    fixed_slope: bool = False,
) -> DataFrame:
    """``(cell..., intercept, slope, converged)`` of the logistic regression of ``label`` on ``x`` per cell.

    ``l2`` penalises the slope. With ``fixed_slope`` the slope stays 1. All cells are fitted at once.
    """
    rows, cells = replicates.plain_rows(df, cell, x, label, weight)
    return replicates.fit_replicates(rows, cells, cell, 1, l2, fixed_slope).select(*cell, "intercept", "slope", "converged")


def bounded_fits(fits: DataFrame) -> DataFrame:
    """Fits with a positive slope; a slope of 0 or less moves to the boundary 1e-12.

    At the boundary the score has no weight left, so the intercept is the logit of the base rate.
    """
    low, rate = F.col("slope") <= 0, F.col("n_pos") / F.col("n")
    return fits.withColumns(
        {
            "boundary_fit": low,
            "intercept": F.when(low, logit(rate, 1e-12)).otherwise(F.col("intercept")),
            "slope": F.when(low, F.lit(1e-12)).otherwise(F.col("slope")),
        }
    )


def monotone_fit(df: DataFrame, cell: Sequence[str], x: str, label: str, weight: str | None = None) -> DataFrame:
    """Logistic fit with a positive slope per cell: intercept, slope, boundary_fit, converged."""
    rows, cells = replicates.plain_rows(df, cell, x, label, weight)
    fits = bounded_fits(replicates.fit_replicates(rows, cells, cell, 1))
    return cut_lineage(fits.select(*cell, "intercept", "slope", "boundary_fit", "converged"))


def apply_fit(df: DataFrame, fits: DataFrame, cell: Sequence[str], x: str, out: str) -> DataFrame:
    j = same_key_join(df, broadcast_if_small(fits.select(*cell, "intercept", "slope")), cell)
    return j.withColumn(out, sigmoid(F.col("intercept") + F.col("slope") * F.col(x))).drop("intercept", "slope")


def transport_audit(df: DataFrame, cell: Sequence[str], x: str, prob: str, eps: float = 1e-6) -> DataFrame:
    """Ties made by rounding, saturation and order reversals of a monotone map, per cell.

    Distinct scores are compared with their predecessor inside value ranges; the first score of
    a range is compared with the largest probability of all lower ranges.
    """
    levels = df.groupBy(*cell, F.col(x).alias("__x")).agg(F.max(prob).alias("__p"), F.count(F.lit(1)).alias("__n"))
    levels = cut_lineage(levels)
    levels = with_range_bucket(levels, "__x", range_edges(levels, "__x"), "__b")
    inside = Window.partitionBy(*cell, "__b").orderBy("__x")
    levels = levels.withColumn("__rev", (F.col("__p") < F.lag("__p").over(inside)).cast("long"))
    at_clip = (F.col("__p") <= eps) | (F.col("__p") >= 1 - eps)
    ranges = levels.groupBy(*cell, "__b").agg(
        F.count(F.lit(1)).alias("n_x"),
        F.coalesce(F.sum("__rev"), F.lit(0)).alias("rev"),
        F.min_by("__p", "__x").alias("p_first"),
        F.max("__p").alias("p_max"),
        F.sum(F.when(at_clip, F.col("__n")).otherwise(0)).alias("n_clip"),
    )
    across = Window.partitionBy(*cell).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    fell = F.col("p_first") < F.max("p_max").over(across)
    ranges = ranges.withColumn("__c", F.coalesce(fell.cast("long"), F.lit(0)))
    per = ranges.groupBy(*cell).agg(
        F.sum("n_x").alias("n_unique_score"),
        F.sum(F.col("rev") + F.col("__c")).alias("order_reversals"),
        F.sum("n_clip").alias("n_at_clip"),
    )
    probs = levels.groupBy(*cell, "__p").agg(F.count(F.lit(1)).alias("__m")).groupBy(*cell).agg(F.count(F.lit(1)).alias("n_unique_prob"))
    return same_key_join(per, probs, cell).withColumn(
        "new_ties", F.greatest(F.col("n_unique_score") - F.col("n_unique_prob"), F.lit(0))
    )


def prior_correct(prob: Column, source_rate: Column, target_rate: float = 0.5) -> Column:
    """Shift the logit by the difference of the two base-rate logits."""
    return sigmoid(logit(prob) + (logit(F.lit(target_rate)) - logit(source_rate)))


def shrink_curve(df: DataFrame, prob: str, source_rate: Column, lambdas: Sequence[float], out: str = "shrunk") -> DataFrame:
    """One row per lambda: the prior-corrected logit scaled by lambda."""
    grid = F.explode(F.array(*[F.lit(float(v)) for v in lambdas]))
    return df.withColumn("lam", grid).withColumn(out, sigmoid(F.col("lam") * logit(prior_correct(F.col(prob), source_rate))))
