"""Discrimination, calibration and win metrics over long prediction tables.

All cells (arm, seed, population, replicate ...) are computed in one pass; nothing loops over them.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import clipped_prob, logit
from tessera.operators.joins import same_key_join
from tessera.operators.quantiles import exact_quantile
from tessera.operators.ranked import running_total

EPS = 1e-6


def auroc(
    pred: DataFrame,
    cell: Sequence[str],
    score: str,
    label: str,
    weight: str | None = None,
    edges: Sequence[float] | None = None,
) -> DataFrame:
    """Area under the ROC curve with average-rank ties; NULL where a cell has one class.

    Scores are reduced to one row per (cell, score); the negatives below each score are a
    running total by score range, so one cell may hold all rows. A NULL or NaN score is refused
    when the rows are computed.
    """
    unfit = F.col(score).isNull() | F.isnan(F.col(score).cast("double"))
    pred = pred.withColumn(score, F.when(unfit, F.raise_error(F.lit("a score is NULL or NaN"))).otherwise(F.col(score)))
    w = F.col(weight) if weight else F.lit(1)
    y = F.col(label)
    levels = pred.groupBy(*cell, score).agg(
        F.sum(F.when(y == 1, w).otherwise(0)).alias("__p"), F.sum(F.when(y == 0, w).otherwise(0)).alias("__n")
    )
    steps = running_total(levels, cell, score, {"__n": F.col("__n")}, edges)
    won = F.col("__p").cast("double") * (F.col("__n_before") + F.col("__n") / 2.0)
    g = steps.groupBy(*cell).agg(
        F.sum(won).alias("__w"), F.sum("__p").cast("long").alias("n_pos"), F.sum("__n").cast("long").alias("n_neg")
    )
    pairs = F.col("n_pos").cast("double") * F.col("n_neg")
    return g.select(*cell, "n_pos", "n_neg", F.when(pairs > 0, F.col("__w") / pairs).alias("auroc"))


def log_loss(label: Column, prob: Column, eps: float = EPS) -> Column:
    p = clipped_prob(prob, eps)
    return F.when(label == 1, -F.log(p)).otherwise(-F.log(1.0 - p))


def brier(label: Column, prob: Column) -> Column:
    return F.pow(prob - label, F.lit(2.0))


def probability_metrics(pred: DataFrame, cell: Sequence[str], label: str, prob: str, eps: float = EPS) -> DataFrame:
    """Log loss (all, per class, excess over log 2), Brier and skill, entropy, logit spread."""
    y, p = F.col(label), clipped_prob(F.col(prob), eps)
    loss = log_loss(y, F.col(prob), eps)
    z = logit(F.col(prob), eps)
    entropy = -(p * F.log(p) + (1.0 - p) * F.log(1.0 - p))
    base = pred.select(*cell, y.alias("y"), p.alias("p"), loss.alias("l"), z.alias("z"), entropy.alias("e"))
    g = base.groupBy(*cell).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(F.col("y").cast("double")).alias("prevalence"),
        F.avg("l").alias("nll"),
        F.avg(F.when(F.col("y") == 1, F.col("l"))).alias("nll_positive"),
        F.avg(F.when(F.col("y") == 0, F.col("l"))).alias("nll_negative"),
        F.avg(brier(F.col("y"), F.col("p"))).alias("brier"),
        F.avg("e").alias("entropy"),
        F.stddev_pop("z").alias("logit_sd"),
    )
    return g.withColumns(
        {"excess_nll": F.col("nll") - math.log(2.0), "brier_skill": 1.0 - F.col("brier") / 0.25}
    )


def prior_centred_logit(pred: DataFrame, cell: Sequence[str], label: str, prob: str, eps: float = EPS) -> DataFrame:
    """Mean absolute distance of the logit from the logit of the cell's prevalence."""
    rates = pred.groupBy(*cell).agg(logit(F.avg(F.col(label).cast("double")), eps).alias("__z0"))
    joined = same_key_join(pred.select(*cell, prob), rates, cell)
    return joined.groupBy(*cell).agg(F.avg(F.abs(logit(F.col(prob), eps) - F.col("__z0"))).alias("mean_abs_logit"))


def confusion_metrics(pred: DataFrame, cell: Sequence[str], label: str, score: str, cut: float | None = None) -> DataFrame:
    """MCC, macro-F1, balanced accuracy and predicted-positive rate at a cut (default: median score of the cell)."""
    if cut is None:
        cuts = exact_quantile(pred, score, [0.5], cell).select(*cell, F.col("quantile").alias("__cut"))
        base = same_key_join(pred, cuts, cell)
    else:
        base = pred.withColumn("__cut", F.lit(cut))
    yes, y = F.col(score) > F.col("__cut"), F.col(label)
    n = lambda c: F.sum(c.cast("double"))
    g = base.groupBy(*cell).agg(
        n(yes & (y == 1)).alias("tp"), n(yes & (y == 0)).alias("fp"), n(~yes & (y == 1)).alias("fn"), n(~yes & (y == 0)).alias("tn")
    )
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    spread = F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))
    f1 = lambda hit, a, b: F.when(2 * hit + a + b > 0, 2 * hit / (2 * hit + a + b)).otherwise(F.lit(0.0))
    recall = lambda hit, miss: F.when(hit + miss > 0, hit / (hit + miss))
    rate = (tp + fp) / (tp + fp + fn + tn)
    return g.select(
        *cell,
        F.when(spread > 0, (tp * tn - fp * fn) / spread).otherwise(F.lit(0.0)).alias("mcc"),
        ((f1(tp, fp, fn) + f1(tn, fn, fp)) / 2).alias("macro_f1"),
        ((recall(tp, fn) + recall(tn, fp)) / 2).alias("balanced_accuracy"),
        rate.alias("positive_rate"),
        ((rate == 0) | (rate == 1)).alias("degenerate"),
    )


def absolute_results(pred: DataFrame, cell: Sequence[str], score: str, prob: str, label: str) -> DataFrame:
    """AUROC, log loss and Brier of every cell."""
    a = auroc(pred, cell, score, label)
    p = probability_metrics(pred, cell, label, prob)
    return same_key_join(a, p.select(*cell, "n", "nll", "brier"), cell)


def paired_differences(results: DataFrame, arm: str, a: str, b: str, shared: Sequence[str]) -> DataFrame:
    """Arm ``a`` minus arm ``b`` per shared cell, signed so that positive is better for ``a``."""
    left = results.where(F.col(arm) == a)
    right = results.where(F.col(arm) == b).select(*shared, *[F.col(m).alias(f"__{m}") for m in ("auroc", "nll", "brier")])
    j = same_key_join(left, right, shared)
    return j.select(
        *shared,
        (F.col("auroc") - F.col("__auroc")).alias("delta_auroc"),
        (F.col("__nll") - F.col("nll")).alias("delta_neg_nll"),
        (F.col("__brier") - F.col("brier")).alias("delta_neg_brier"),
    )


def sensitivity_gap(results: DataFrame, cell: Sequence[str], value: str, wide: str, narrow: str) -> DataFrame:
    """Metric in the wide population minus the same metric in the narrow one."""
    p = results.groupBy(*cell).pivot("population", [wide, narrow]).agg(F.avg(value))
    return p.withColumn("gap", F.col(wide) - F.col(narrow))


def macro_auroc(pred: DataFrame, outer: Sequence[str], inner: str, score: str, label: str, edges=None) -> DataFrame:
    """Mean AUROC over the inner cells (raters, classes) that have both labels."""
    per = auroc(pred, [*outer, inner], score, label, edges=edges)
    return per.groupBy(*outer).agg(F.avg("auroc").alias("macro_auroc"), F.count("auroc").alias("n_valid"))


def one_vs_rest(pred: DataFrame, truth: str, classes: Sequence, score_of: dict) -> DataFrame:
    """Long table with one binary problem per class: label 1 where the truth is that class."""
    entries = F.array(
        *[F.struct(F.lit(c).alias("class"), F.col(score_of[c]).cast("double").alias("score")) for c in classes]
    )
    long = pred.withColumn("e", F.explode(entries)).select("*", "e.*").drop("e")
    return long.withColumn("y_class", (F.col(truth) == F.col("class")).cast("int"))


def symmetrised_log_odds(scores: DataFrame, keys: Sequence[str], eps: float = 1e-9) -> DataFrame:
    """Mean log odds over the two option orders; ``complete`` says whether both orders are present."""
    want = F.when(F.col("swap"), F.col("p_a")).otherwise(F.col("p_b"))
    other = F.when(F.col("swap"), F.col("p_b")).otherwise(F.col("p_a"))
    low = F.log(F.greatest(want, F.lit(eps))) - F.log(F.greatest(other, F.lit(eps)))
    return scores.groupBy(*keys).agg(F.avg(low).alias("z"), (F.min("swap") != F.max("swap")).alias("complete"))


def counterfactual_change(
    original: DataFrame, changed: DataFrame, unit: Sequence[str], value: str, label: str, by: Sequence[str] = ()
) -> DataFrame:
    """Size of the score change, label support removed, and share of changes above 0.1."""
    j = original.join(changed.select(*unit, F.col(value).alias("__c")), list(unit))
    d = F.col(value) - F.col("__c")
    sign = 2 * F.col(label) - 1
    return j.groupBy(*by).agg(
        F.avg(F.abs(d)).alias("mean_abs_change"),
        F.sqrt(F.avg(d * d)).alias("rms_change"),
        F.avg(sign * d).alias("label_support_removed"),
        F.avg((F.abs(d) > 0.1).cast("double")).alias("fraction_above"),
    )


def region_choice(grid: DataFrame, clip: str, score: str, query: str, distractor: str, valid: str, cell: str) -> DataFrame:
    """Per clip, does the query region outscore the distractor (ties count half), and is the top cell a hit.

    A clip is a fixed-size grid. The top cell is the highest valid score, then the lowest cell number.
    """
    inside = lambda m: F.coalesce(F.avg(F.when(F.col(m), F.col(score))), F.lit(0.0))
    g = grid.groupBy(clip).agg(
        inside(query).alias("q"),
        inside(distractor).alias("d"),
        F.max_by(F.col(query), F.when(F.col(valid), F.struct(F.col(score), -F.col(cell)))).alias("h"),
    )
    gap = F.col("q") - F.col("d")
    win = F.when(F.abs(gap) < 1e-9, F.lit(0.5)).otherwise((gap > 0).cast("double"))
    return g.select(clip, win.alias("win"), F.coalesce(F.col("h"), F.lit(False)).cast("double").alias("hit"))


def probe_change(results: DataFrame, arm: str, a: str, b: str, target: str) -> DataFrame:
    """Nuisance probes: mean AUROC change a - b over targets, and how many targets did not increase."""
    wide = results.groupBy(target, "seed").pivot(arm, [a, b]).agg(F.avg("auroc"))
    per = wide.groupBy(target).agg(F.avg(F.col(a) - F.col(b)).alias("delta"))
    return per.agg(
        F.avg("delta").alias("macro_change"),
        F.sum((F.col("delta") <= 0).cast("long")).alias("n_not_increased"),
        F.count(F.lit(1)).alias("n_targets"),
    )
