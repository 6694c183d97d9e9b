"""Explicit gates: named checks, verdicts and interpretation branches."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.joins import ContractError
from tessera.operators.profile import domains_with_both
from tessera.operators.quantiles import quantile_summary


def checks_table(parts: Sequence[tuple[str, DataFrame, float, str]]) -> DataFrame:
    """``(check, observed, threshold, passed)`` from one-value frames.

    Each part is (name, frame with one row and one column, threshold, comparison); the
    comparison is one of ``<=``, ``>=``, ``==``.
    """
    rows = []
    for name, frame, threshold, how in parts:
        v, t = F.col(frame.columns[0]).cast("double"), F.lit(float(threshold))
        ok = {"<=": v <= t, ">=": v >= t, "==": v == t}[how]
        rows.append(
            frame.select(F.lit(name).alias("check"), v.alias("observed"), t.alias("threshold"), F.coalesce(ok, F.lit(False)).alias("passed"))
        )
    return reduce(DataFrame.unionByName, rows)


def verdict(checks: DataFrame) -> DataFrame:
    return checks.agg(
        F.count(F.lit(1)).alias("n_checks"),
        F.sum((~F.col("passed")).cast("long")).alias("n_failed"),
        F.when(F.every("passed"), F.lit("GO")).otherwise(F.lit("NO_GO")).alias("verdict"),
    )


def overlap_guard(df: DataFrame, pairs: Mapping[str, tuple[Column, Column]]) -> DataFrame:
    """Rows that belong to both sides of each forbidden combination, in one pass."""
    sums = [F.sum(F.coalesce((a & b).cast("long"), F.lit(0))).alias(n) for n, (a, b) in pairs.items()]
    return df.agg(*sums).unpivot([], list(pairs), "guard", "n_overlap")


def require_zero(guard: DataFrame, count: str = "n_overlap") -> DataFrame:
    if guard.where(F.col(count) != 0).limit(1).count():
        raise ContractError("a guard count is not zero")
    return guard


def pair_support(
    judged: DataFrame, label: str, positives: str, negatives: str, need_pos: int = 2, need_neg: int = 1
) -> DataFrame:
    """Coverage overall and per label of units with enough positives and negatives."""
    pos, neg = F.col(positives) >= need_pos, F.col(negatives) >= need_neg
    scopes = F.explode(F.array(F.lit("ALL"), F.col(label).cast("string")))
    d = judged.select(scopes.alias("scope"), pos.alias("p"), neg.alias("n"))
    share = lambda c: F.avg(c.cast("double"))
    return d.groupBy("scope").agg(
        F.count(F.lit(1)).alias("n_units"),
        share(F.col("p")).alias("positive_ok"),
        share(F.col("n")).alias("negative_ok"),
        share(F.col("p") & F.col("n")).alias("eligible"),
    )


def pair_support_gate(
    judged: DataFrame, label: str, domain: str, positives: str, negatives: str, least: float = 0.80
) -> DataFrame:
    """Checks of the pair-support gate: coverage overall and per label, both labels in every domain."""
    cover = pair_support(judged, label, positives, negatives)
    one = lambda c: cover.where(c).agg(F.min("eligible").alias("v"))
    both = domains_with_both(judged, domain, label).agg(F.min(F.col("has_both").cast("int")).alias("v"))
    return checks_table(
        [
            ("overall_coverage", one(F.col("scope") == "ALL"), least, ">="),
            ("each_label_coverage", one(F.col("scope") != "ALL"), least, ">="),
            ("each_domain_has_both_labels", both, 1, "=="),
        ]
    )


def support_quantiles(judged: DataFrame, label: str, counts: Sequence[str]) -> DataFrame:
    """Quantiles of the support counts, overall and per label."""
    long = judged.select(
        F.explode(F.array(F.lit("ALL"), F.col(label).cast("string"))).alias("scope"), *counts
    ).unpivot(["scope"], list(counts), "count", "value")
    return quantile_summary(long, "value", ["scope", "count"])


# The words of the interpretation branches.
BRANCHES = (
    "alignment_correspondence_not_established",
    "correspondence_and_matched_transfer_gain",
    "correspondence_without_matched_transfer_equivalence_compatible",
    "correspondence_gain_but_matched_transfer_inconclusive",
)


def interpretation(corr_low: Column, auc: tuple[Column, Column], nll: tuple[Column, Column], auc_margin: float, nll_margin: float) -> Column:
    """Branch from the interval of the correspondence gain and the two transfer intervals."""
    inside = lambda ci, m: (ci[0] >= -m) & (ci[1] <= m)
    lost, gain, same, open_ = (F.lit(b) for b in BRANCHES)
    return F.when(corr_low <= 0, lost).when((auc[0] > 0) & (nll[0] > 0), gain).when(inside(auc, auc_margin) & inside(nll, nll_margin), same).otherwise(open_)


def signal_word(low: Column, high: Column, same_sign: Column) -> Column:
    return (
        F.when((low > 0) & same_sign, F.lit("SIGNAL"))
        .when((high < 0) & same_sign, F.lit("REVERSED"))
        .otherwise(F.lit("inconclusive"))
    )


def feasibility_word(value: Column, low: Column, high: Column, need: float = 0.60) -> Column:
    return (
        F.when((high < 0.5) | (low <= 0.5) | (value < need), F.lit("INFEASIBLE"))
        .when(low > need, F.lit("FEASIBLE"))
        .otherwise(F.lit("insufficient"))
    )


def run_manifest_audit(
    runs: DataFrame, arms: Sequence[str], seeds: Sequence[int], steps: int
) -> DataFrame:
    """Violations of a training-run table ``(arm, seed, init_hash, order_hash, first_loss, last_loss, n_steps)``.

    The expected set is the product of the two listed settings. Arms of one seed must share
    initial weights and data order. A missing hash, step count or loss, or a loss that is not finite, is a violation.
    """
    cells = F.array(*[F.struct(F.lit(a).alias("arm"), F.lit(s).alias("seed")) for a in arms for s in seeds])
    expected = runs.sparkSession.range(1).select(F.explode(cells).alias("e")).select("e.*")
    n = lambda df, name: df.agg(F.count(F.lit(1)).alias("n_violations")).select(F.lit(name).alias("check"), "n_violations")
    differs = lambda c: (F.count(c) < F.count(F.lit(1))) | ~F.min(c).eqNullSafe(F.max(c))
    per_seed = runs.groupBy("seed").agg(differs("init_hash").alias("init"), differs("order_hash").alias("order"))
    finite = [F.abs(F.col(c).cast("double")) < float("inf") for c in ("first_loss", "last_loss")]
    decreased = finite[0] & finite[1] & (F.col("last_loss") < F.col("first_loss"))
    parts = [
        n(expected.join(runs, ["arm", "seed"], "left_anti"), "run_missing"),
        n(runs.join(expected, ["arm", "seed"], "left_anti"), "run_unexpected"),
        n(runs.groupBy("arm", "seed").count().where("count > 1"), "run_repeated"),
        n(per_seed.where("init"), "init_differs_between_arms"),
        n(per_seed.where("order"), "order_differs_between_arms"),
        n(runs.where(~F.col("n_steps").eqNullSafe(F.lit(steps))), "schedule_differs"),
        n(runs.where(~F.coalesce(decreased, F.lit(False))), "loss_not_decreased"),
    ]
    return reduce(DataFrame.unionByName, parts)


def grid_gates(cells: DataFrame, rope: float) -> DataFrame:
    """Whether all intervals are above zero, and whether all lie inside the region of equivalence."""
    return cells.agg(
        F.count(F.lit(1)).alias("n_cells"),
        F.every(F.col("ci_low") > 0).alias("all_positive"),
        F.every((F.col("ci_low") > -rope) & (F.col("ci_high") < rope)).alias("all_equivalent"),
    )


def frozen_difference(current: DataFrame, frozen: DataFrame, key: Sequence[str], values: Sequence[str], tolerance: float = 1e-9) -> DataFrame:
    """Compare a table with its frozen copy: unmatched keys, largest difference, equal within tolerance."""
    b = frozen.select(*key, *[F.col(v).alias(f"__{v}") for v in values], F.lit(True).alias("__in_b"))
    j = current.select(*key, *values, F.lit(True).alias("__in_a")).join(b, list(key), "full")
    gap = F.greatest(*[F.coalesce(F.abs(F.col(v) - F.col(f"__{v}")), F.lit(0.0)) for v in values], F.lit(0.0))
    one_null = reduce(lambda a, c: a | c, [F.col(v).isNull() != F.col(f"__{v}").isNull() for v in values])
    unmatched = F.col("__in_a").isNull() | F.col("__in_b").isNull()
    g = j.agg(
        F.sum((unmatched | one_null).cast("long")).alias("n_unmatched"), F.max(F.when(~unmatched, gap)).alias("max_difference")
    )
    return g.withColumn("equal", (F.col("n_unmatched") == 0) & (F.coalesce("max_difference", F.lit(0.0)) <= tolerance))


def group_mean_report(df: DataFrame, arm: str, a: str, b: str, attributes: Sequence[str]) -> DataFrame:
    """Mean and population sd of each attribute in two arms, and the difference of means."""
    long = df.select(arm, *[F.col(x).cast("double").alias(x) for x in attributes]).unpivot([arm], list(attributes), "attribute", "v")
    side = lambda s: F.when(F.col(arm) == s, F.col("v"))
    g = long.groupBy("attribute").agg(
        F.avg(side(a)).alias("mean_a"), F.stddev_pop(side(a)).alias("sd_a"),
        F.avg(side(b)).alias("mean_b"), F.stddev_pop(side(b)).alias("sd_b"),
    )
    return g.withColumn("delta", F.col("mean_a") - F.col("mean_b"))
