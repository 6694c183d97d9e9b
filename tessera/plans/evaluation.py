"""Evaluation: paired arm comparison over several metrics, probability transport, retrieval audit."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators import bootstrap, calibrate, metrics, replicates, retrieval
from tessera.operators.joins import same_key_join
from tessera.session import cut_lineage


def compare_arms(
    pred: DataFrame, arm: str, a: str, b: str, seed: str, unit: str, names: Sequence[str], label: str, score: str, prob: str, reps: int, salt: str
) -> DataFrame:
    """Paired unit x seed intervals of the enumerated metrics, one row per metric."""
    two = pred.where(F.col(arm).isin(a, b))
    lists = bootstrap.draw_lists(two, unit, reps, salt)
    parts = {
        m: bootstrap.paired_replicates(
            bootstrap.replicate_metric(two, [arm], unit, m, label, score, prob, reps, salt, seed, lists=lists), arm, a, b
        )
        for m in names
    }
    return bootstrap.interval(bootstrap.union_metrics(parts), ["metric"], reps=reps)


def transport_replicates(
    calibration: DataFrame, evaluation: DataFrame, cell: Sequence[str], seed: str, unit: str, label: str, logit: str, reps: int, salt: str
) -> DataFrame:
    """Replicates ``(cell..., metric, rep, value)`` of AUROC, negative log loss and negative Brier score after transport.

    Both sets are redrawn and every calibrator is refitted in every replicate; all fits are taken together. AUROC ranks by
    the score before transport, which a positive slope does not reorder. A replicate with one class on either side is NULL.
    Rows of equal score and label are added up with their draws first; every step then reads those sums.
    """
    keys = [*cell, seed]

    def drawn(rows: DataFrame, side: str) -> tuple[DataFrame, DataFrame]:
        rows, cells = replicates.keyed(rows, keys)
        lists = bootstrap.draw_lists(rows, unit, reps, f"{salt}-{side}")
        rows = replicates.joined_draws(rows.select("__key", unit, "__x", "__y"), lists, [unit])
        levels = cut_lineage(replicates.levels(rows, reps, replicates.score_edges(sets[side], "__x")))
        return levels, cut_lineage(cells.join(levels.select("__key").distinct(), "__key", "left_semi"))

    values = [F.col(logit).cast("double").alias("__x"), F.col(label).cast("double").alias("__y")]
    sets = {side: cut_lineage(rows.select(*keys, unit, *values)) for side, rows in (("cal", calibration), ("eval", evaluation))}

    fitted, cells = drawn(sets["cal"], "cal")
    fits = calibrate.bounded_fits(replicates.fit_replicates(fitted, cells, keys, reps))
    two_classes = (F.col("n_pos") > 0) & (F.col("n_pos") < F.col("n"))
    usable = fits.where(two_classes).select(*keys, "rep", "intercept", "slope")
    held, cells = drawn(sets["eval"], "eval")
    losses = replicates.score_fits(held, cells, usable, keys, reps, metrics.EPS).where(two_classes)
    area = replicates.auroc(held, cells, keys, "__x", "__y", reps, replicates.score_edges(held, "__x"))
    both = same_key_join(losses, area, [*keys, "rep"])
    # a replicate without a usable fit has NaN losses
    both = both.withColumns({"neg_nll": F.nanvl(-F.col("nll") / F.col("n"), F.lit(None).cast("double")), "neg_brier": F.nanvl(-F.col("brier") / F.col("n"), F.lit(None).cast("double"))})
    both = both.withColumn("auroc", F.when(F.col("neg_nll").isNotNull(), F.col("auroc")))
    every = cells.select(*keys, F.explode(F.sequence(F.lit(0), F.lit(reps - 1))).alias("rep"))
    per = same_key_join(every, both, [*keys, "rep"], "left").unpivot([*keys, "rep"], list(bootstrap.METRICS), "metric", "value")
    seeds = sets["cal"].select(seed).unionByName(sets["eval"].select(seed))
    return bootstrap.over_seeds(per, seeds, [*cell, "metric"], seed, reps, salt)


def retrieval_audit(
    queries: DataFrame, bank: DataFrame, query_id: str, vector: str, gold: str, bank_id: str, bank_vector: str, conditions: Sequence[str]
) -> DataFrame:
    """Retrieval metrics per condition beside the analytic random-ranking baseline."""
    ranks = retrieval.cosine_ranks(queries, bank, query_id, vector, gold, bank_id, bank_vector, conditions)
    found = retrieval.retrieval_metrics(ranks, ["condition"])
    return found.join(retrieval.random_ranking(ranks, ["condition"]).drop("n_queries"), "condition")
