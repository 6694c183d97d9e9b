"""Bootstrap intervals from hash draws.

``multinomial`` draws: slot ``k`` of replicate ``b`` takes the unit of rank ``hash(salt, b, k) mod n``
(with replacement, ``n`` draws of ``n`` units). ``poisson`` draws give every unit an independent
Poisson(1) count per replicate from ``hash(salt, b, unit)``; they need neither ranks nor a shuffle
and are the choice for very large tables. Arms share draws because arms are not part of the hash.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import salted_sha
from tessera.operators import metrics, replicates
from tessera.operators.joins import ContractError, same_key_join
from tessera.operators.ranked import ranked
from tessera.session import cut_lineage

METRICS = ("auroc", "neg_nll", "neg_brier")


def draw_lists(
    units: DataFrame, unit: str, reps: int, salt: str, by: Sequence[str] = (), scheme: str = "multinomial"
) -> DataFrame:
    """``(by..., unit, __reps, __times)``, a row for each unit with the replicates that drew it and how often, materialised."""
    base = units.select(*by, unit).distinct()
    if scheme == "poisson":
        return cut_lineage(replicates.poisson_lists(base, [*by, unit], reps, salt))
    if scheme != "multinomial":
        raise ValueError(scheme)
    placed = cut_lineage(ranked(base.withColumn("__h", salted_sha(salt, unit)), by, "__h", "__r", "__n").drop("__h"))
    return cut_lineage(replicates.multinomial_lists(placed, by, unit, reps, salt))


def draws(
    units: DataFrame, unit: str, reps: int, salt: str, by: Sequence[str] = (), scheme: str = "multinomial"
) -> DataFrame:
    """``(by..., rep, unit, times)`` with ``times > 0``; ``units`` may repeat a unit."""
    lists = draw_lists(units, unit, reps, salt, by, scheme)
    long = lists.select(*by, unit, F.explode(F.arrays_zip("__reps", "__times")).alias("d"))
    return long.select(*by, F.col("d.__reps").alias("rep"), unit, F.col("d.__times").cast("long").alias("times")).where("times > 0")


def interval(values: DataFrame, by: Sequence[str], value: str = "value", reps: int | None = None) -> DataFrame:
    """95% percentile interval over replicates; NULL replicates are discarded and counted."""
    q = F.percentile(value, F.array(F.lit(0.025), F.lit(0.975)))
    g = values.groupBy(*by).agg(q.alias("q"), F.count(value).alias("n_valid"), F.count(F.lit(1)).alias("__n"))
    total = F.lit(reps) if reps else F.col("__n")
    return g.select(
        *by, F.col("q")[0].alias("ci_low"), F.col("q")[1].alias("ci_high"), "n_valid", (total - F.col("n_valid")).alias("n_discarded")
    )


def replicate_means(
    values: DataFrame,
    cell: Sequence[str],
    cluster: str,
    value: str,
    reps: int,
    salt: str,
    seed: str | None = None,
    scheme: str = "multinomial",
    weight: str | None = None,
) -> DataFrame:
    """Replicates of a mean: ``(cell..., rep, value)``. Rows are reduced to cluster sums first.

    With ``seed`` the replicate also redraws seeds: the result is the mean over drawn seeds.
    """
    n = F.col(weight) if weight else F.lit(1)
    extra = [seed] if seed else []
    keys = [*cell, *extra]
    sums = cut_lineage(values.groupBy(*keys, cluster).agg(F.sum(F.col(value)).alias("__v"), F.sum(n).alias("__w")))
    zero = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    rows = sums.select(*keys, cluster, zero("__v").alias("__s"), zero("__w").alias("__c"), F.lit(1.0).alias("__one"), F.col("__v").isNotNull().cast("double").alias("__some"))
    rows, cells = replicates.keyed(rows, keys)
    drawn = replicates.joined_draws(rows.where(F.col(cluster).isNotNull()), draw_lists(sums, cluster, reps, salt, scheme=scheme), [cluster])
    per = replicates.additive(drawn, cells, reps, ["__s", "__c", "__one", "__some"]).where("__one > 0")  # clusters of the cell drawn
    per = per.select(*keys, "rep", F.when(F.col("__some") > 0, F.try_divide("__s", "__c")).alias("value"))
    return over_seeds(per, values, cell, seed, reps, salt)


def over_seeds(per: DataFrame, rows: DataFrame, cell: Sequence[str], seed: str | None, reps: int, salt: str) -> DataFrame:
    """Mean over seeds drawn with replacement; a replicate with an undefined seed value is undefined."""
    if seed is None:
        return per
    d = draws(rows, seed, reps, f"{salt}-seed")
    joined = per.join(d, ["rep", seed])
    bad = F.max(F.col("value").isNull().cast("int"))
    mean = F.sum(F.col("times") * F.col("value")) / F.sum("times")
    return joined.groupBy(*cell, "rep").agg(F.when(bad == 0, mean).alias("value"))


def replicate_metric(
    pred: DataFrame,
    cell: Sequence[str],
    cluster: str,
    metric: str,
    label: str,
    score: str,
    prob: str,
    reps: int,
    salt: str,
    seed: str | None = None,
    scheme: str = "multinomial",
    by: Sequence[str] = (),
    lists: DataFrame | None = None,
) -> DataFrame:
    """Replicates ``(cell..., rep, value)`` of one of METRICS; one-class replicates are NULL.

    With ``by``, columns of the cell, clusters are drawn anew inside each of their values.

    Rows are reduced first: additive metrics to sums per cluster, AUROC to one row per cluster, score and label. What is
    left carries its draws as arrays, made once per cluster; ``lists`` gives them (:func:`draw_lists`) where several metrics share them.
    """
    if metric not in METRICS:
        raise ValueError(metric)
    extra = [seed] if seed else []
    keys = [*cell, *extra]
    y = F.col(label)
    if metric == "auroc":
        rows = pred.groupBy(*keys, cluster, score, label).agg(F.count(F.lit(1)).alias("__k"))
    else:
        loss = metrics.log_loss(y, F.col(prob)) if metric == "neg_nll" else metrics.brier(y, F.col(prob))
        rows = pred.groupBy(*keys, cluster).agg(
            F.sum(-loss).alias("__s"), F.count(F.lit(1)).alias("__c"), F.sum((y == 1).cast("long")).alias("__p")
        )
    rows, cells = replicates.keyed(cut_lineage(rows), keys)
    if lists is None:
        lists = draw_lists(rows, cluster, reps, salt, by, scheme)
    drawn = replicates.joined_draws(rows, lists, [*by, cluster])
    if metric == "auroc":
        drawn = drawn.withColumn("__times", F.transform("__times", lambda t: (t * F.col("__k")).cast("int")))
        per = replicates.auroc(drawn, cells, keys, score, label, reps, replicates.score_edges(rows, score)).withColumnRenamed("auroc", "value")
    else:
        sums = replicates.additive(drawn, cells, reps, ["__s", "__c", "__p"])
        both = (F.col("__p") > 0) & (F.col("__c") > F.col("__p"))
        per = sums.withColumn("value", F.when(both, F.col("__s") / F.col("__c")))
    return over_seeds(per.select(*keys, "rep", "value"), pred, cell, seed, reps, salt)


def paired_replicates(values: DataFrame, arm: str, a: str, b: str, shared: Sequence[str] = ()) -> DataFrame:
    """Arm ``a`` minus arm ``b`` per replicate."""
    side = lambda x, c: F.max(F.when(F.col(arm) == x, c))
    both = values.groupBy(*shared, "rep").agg(side(a, F.col("value")).alias("__a"), side(b, F.col("value")).alias("__b"), side(a, F.lit(1)).alias("__in_a"), side(b, F.lit(1)).alias("__in_b"))
    return both.where("__in_a = 1 AND __in_b = 1").select(*shared, "rep", (F.col("__a") - F.col("__b")).alias("value"))


def require_pair_clusters(pred: DataFrame, cluster: str, cell: Sequence[str]) -> DataFrame:
    """Matched-pair bootstraps need exactly two rows per pair in every cell."""
    wrong = pred.groupBy(*cell, cluster).agg(F.count(F.lit(1)).alias("n")).where("n != 2")
    if wrong.limit(1).count():
        raise ContractError(f"{cluster}: a cluster does not have exactly two rows")
    return pred


def cluster_sizes(pred: DataFrame, cluster: str) -> DataFrame:
    """Number of clusters, singletons and the largest, to report beside a stratum bootstrap."""
    g = pred.groupBy(cluster).agg(F.count(F.lit(1)).alias("n"))
    return g.agg(
        F.count(F.lit(1)).alias("n_clusters"),
        F.sum((F.col("n") == 1).cast("long")).alias("n_singletons"),
        F.max("n").alias("largest"),
    )


def profile_macro(values: DataFrame, cell: Sequence[str], seed: str, profile: str, value: str) -> DataFrame:
    """Mean per profile, the unit of a profile bootstrap (every profile then has equal weight)."""
    return values.groupBy(*cell, seed, profile).agg(F.avg(value).alias(value))


def replicate_macro_auroc(
    pred: DataFrame, cell: Sequence[str], rater: str, unit: str, score: str, label: str, reps: int, salt: str
) -> DataFrame:
    """Units redrawn within each rater; the replicate is the mean AUROC over raters with both classes."""
    keys = [*cell, rater]
    rows, cells = replicates.keyed(cut_lineage(pred.select(*dict.fromkeys([*keys, unit, score, label]))), keys)
    drawn = replicates.joined_draws(rows, draw_lists(rows, unit, reps, salt, by=[rater]), [rater, unit])
    per = replicates.auroc(drawn, cells, keys, score, label, reps, replicates.score_edges(rows, score))
    return per.groupBy(*cell, "rep").agg(F.avg("auroc").alias("value"))


def replicate_one_vs_rest(
    pred: DataFrame, cell: Sequence[str], cls: str, cluster: str, score: str, label: str, reps: int, salt: str, seed: str | None = None
) -> DataFrame:
    """Replicates of the mean one-vs-rest AUROC: ``pred`` has a row per class, and one draw of clusters serves all classes.

    A class that a replicate leaves with one label takes no part in its mean.
    """
    extra = [seed] if seed else []
    per = replicate_metric(pred, [*cell, *extra, cls], cluster, "auroc", label, score, score, reps, salt)
    macro = per.groupBy(*cell, *extra, "rep").agg(F.avg("value").alias("value"))
    return over_seeds(macro, pred, cell, seed, reps, salt)


def matrix_replicates(values: DataFrame, cell: Sequence[str], seed: str, unit: str, value: str, reps: int, salt: str) -> DataFrame:
    """Replicates of a mean over a seed x unit matrix with both axes redrawn: sum of w_seed v w_unit over the sum of the weights.

    ``values`` lists the matrix's cells; cells that are absent take no part. Units are weighted by arrays over replicates
    inside each row of the matrix; the rows' sums, one per (cell, seed), then meet the seeds' draws.
    """
    keys = [*cell, seed]
    sums = values.where(F.col(value).isNotNull()).groupBy(*keys, unit).agg(F.sum(value).alias("__v"), F.count(F.lit(1)).alias("__c"))
    rows, cells = replicates.keyed(cut_lineage(sums), keys)
    drawn = replicates.joined_draws(rows, draw_lists(values, unit, reps, salt), [unit])
    per = replicates.additive(drawn, cells, reps, ["__v", "__c"])
    seeds = draws(values, seed, reps, f"{salt}-seed")
    t = F.col("times")
    weighed = same_key_join(per, seeds, ["rep", seed]).groupBy(*cell, "rep").agg(F.sum(t * F.col("__v")).alias("__v"), F.sum(t * F.col("__c")).alias("__c"))
    return weighed.select(*cell, "rep", F.when(F.col("__c") > 0, F.col("__v") / F.col("__c")).alias("value"))


def paired_matrix_interval(values: DataFrame, arm: str, a: str, b: str, seed: str, unit: str, value: str, reps: int, salt: str) -> DataFrame:
    """One row: observed mean of arm ``a`` - arm ``b``, its two-way interval, the number of seeds and units, and how many
    seeds' means are positive, negative or zero. Both arms must cover the same (seed, unit) cells, once each."""
    wide = values.where(F.col(arm).isin(a, b)).groupBy(seed, unit).agg(
        F.sum(F.when(F.col(arm) == a, F.col(value))).alias("__a"), F.sum(F.when(F.col(arm) == b, F.col(value))).alias("__b"), F.count(value).alias("__n")
    )
    wide = cut_lineage(wide)
    if wide.where("__a IS NULL OR __b IS NULL OR __n != 2").limit(1).count():
        raise ContractError("the arms do not cover the same cells once each")
    delta = wide.select(seed, unit, (F.col("__a") - F.col("__b")).alias("delta"))
    ci = interval(matrix_replicates(delta, [], seed, unit, "delta", reps, salt), [], reps=reps)
    sign = lambda c: F.sum((F.signum("delta") == c).cast("long"))
    seeds = delta.groupBy(seed).agg(F.avg("delta").alias("delta")).agg(F.count(F.lit(1)).alias("n_seeds"), sign(1).alias("n_positive"), sign(-1).alias("n_negative"), sign(0).alias("n_zero"))
    whole = delta.agg(F.avg("delta").alias("observed"), F.count_distinct(unit).alias("n_units"))
    both = ci.withColumns({"__w": whole.select(F.struct(*whole.columns)).scalar(), "__s": seeds.select(F.struct(*seeds.columns)).scalar()})
    return both.select("__w.observed", "ci_low", "ci_high", "n_valid", "__w.n_units", "__s.n_seeds", "__s.n_positive", "__s.n_negative", "__s.n_zero")


def absolute_intervals(
    pred: DataFrame, cell: Sequence[str], seed: str, unit: str, label: str, score: str, prob: str, reps: int, salt: str, by: Sequence[str] = ()
) -> DataFrame:
    """``(cell..., metric, observed, ci)``: AUROC, log loss and Brier score as means over seeds, with intervals over units and
    seeds as a struct (low, high). Units are redrawn inside each value of ``by`` (columns of the cell, such as a population)."""
    point = metrics.absolute_results(pred, [*cell, seed], score, prob, label).groupBy(*cell).agg(*[F.avg(m).alias(m) for m in ("auroc", "nll", "brier")])
    point = point.unpivot([*cell], ["auroc", "nll", "brier"], "metric", "observed")
    parts = {}
    lists = draw_lists(pred, unit, reps, salt, by)
    for metric, name, sign in zip(METRICS, ("auroc", "nll", "brier"), (1, -1, -1), strict=True):
        v = replicate_metric(pred, cell, unit, metric, label, score, prob, reps, salt, seed, by=by, lists=lists)
        parts[name] = v.withColumn("value", F.col("value") * sign)
    i = interval(union_metrics(parts), [*cell, "metric"], reps=reps)
    ci = i.select(*cell, "metric", F.struct(F.col("ci_low").alias("low"), F.col("ci_high").alias("high")).alias("ci"), "n_valid")
    return same_key_join(point, ci, [*cell, "metric"])


def union_metrics(parts: dict[str, DataFrame]) -> DataFrame:
    """Replicates of several metrics in one table, so that one aggregate gives all intervals."""
    return reduce(DataFrame.unionByName, [p.withColumn("metric", F.lit(m)) for m, p in parts.items()])
