"""Linear readouts with pyspark.ml: standardisation, C grid, one-standard-error choice, Platt calibration."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import StandardScaler, StandardScalerModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators import calibrate, metrics
from tessera.operators.joins import same_key_join
from tessera.session import cut_lineage

# The grid of inverse regularisation strengths.
C_GRID = (0.001, 0.003, 0.01, 0.03, 0.1, 0.3, 1.0, 3.0)


def assemble_features(df: DataFrame, parts: Sequence[Column], out: str = "features") -> DataFrame:
    """Concatenate scalar and array columns into one vector column (a fusion arm)."""
    arrays = [c.cast("array<double>") for c in parts]
    return df.withColumn(out, array_to_vector(F.concat(*arrays)))


def as_array(*cols: str) -> Column:
    return F.array(*[F.col(c).cast("double") for c in cols])


def fit_scaler(train: DataFrame, features: str) -> StandardScalerModel:
    """Mean and sd of the training rows only; population sd is applied by :func:`standardise`."""
    return StandardScaler(inputCol=features, outputCol="__std", withMean=True, withStd=True).fit(train)


def standardise(df: DataFrame, model: StandardScalerModel, n_train: int, features: str, out: str) -> DataFrame:
    """Scale by training mean and population sd (the fitted model holds the sample sd)."""
    factor = float(np.sqrt(n_train / (n_train - 1))) if n_train > 1 else 1.0
    scaled = model.transform(df).withColumn("__a", vector_to_array("__std"))
    return scaled.withColumn(out, array_to_vector(F.transform("__a", lambda v: v * factor))).drop("__std", "__a")


def fit_head(train: DataFrame, features: str, label: str, c: float, n: int, weight: str | None = None):
    """L2 logistic regression whose objective equals the sum-form one with inverse strength ``c``."""
    lr = LogisticRegression(
        featuresCol=features,
        labelCol=label,
        regParam=1.0 / (c * n),
        elasticNetParam=0.0,
        standardization=False,
        maxIter=100,
        tol=1e-6,
    )
    return (lr.setWeightCol(weight) if weight else lr).fit(train)


def head_logits(df: DataFrame, model, features: str) -> DataFrame:
    """Adds ``logit`` from the coefficients; rows are scored in place, without a join."""
    scored = model.setFeaturesCol(features).transform(df)
    return scored.withColumn("logit", vector_to_array("rawPrediction")[1]).drop(
        "rawPrediction", "probability", "prediction"
    )


def one_se_choice(scores: DataFrame, name: str = "c", fold: str = "fold", value: str = "auroc") -> DataFrame:
    """Smallest setting whose mean is within one standard error of the best mean."""
    per = scores.groupBy(name).agg(
        F.avg(value).alias("mean"), (F.stddev_samp(value) / F.sqrt(F.count(value))).alias("se")
    )
    best = per.agg(F.max_by(F.col("mean") - F.col("se"), F.struct(F.col("mean"), -F.col(name))).alias("t"))
    return per.withColumn("threshold", best.scalar()).withColumn(
        "chosen", F.col(name) == per.where(F.col("mean") >= best.scalar()).agg(F.min(name)).scalar()
    )


def select_head(
    df: DataFrame, features: str, label: str, split: str, fold: str, grid: Sequence[float] = C_GRID
) -> tuple[float, DataFrame, DataFrame]:
    """Fit every C on train, score the validation folds in one table, choose by one standard error.

    Returns the chosen C, the selection table and all rows with the chosen head's logit.
    """
    df = cut_lineage(df)
    usable = (F.col(split) == "train") & F.col(label).isNotNull()
    train = df.where(usable)
    n = train.count()
    scaled = standardise(df, fit_scaler(train, features), n, features, "__x")
    fit_rows = scaled.where(usable).select("__x", label).persist()
    models = {c: fit_head(fit_rows, "__x", label, c, n) for c in grid}
    held = scaled.where((F.col(fold) >= 0) & F.col(label).isNotNull())
    scored = reduce(
        DataFrame.unionByName,
        [head_logits(held, m, "__x").select(F.lit(c).alias("c"), fold, label, "logit") for c, m in models.items()],
    )
    selection = one_se_choice(metrics.auroc(scored, ["c", fold], "logit", label), "c", fold)
    chosen = selection.where("chosen").select("c").first()[0]
    fit_rows.unpersist()
    return chosen, selection, head_logits(scaled, models[chosen], "__x").drop("__x")


def platt_scores(scored: DataFrame, label: str, split: str, fold: str, l2: float = 1.0) -> DataFrame:
    """Final calibrated probability (fit on all validation rows) and the out-of-fold one.

    All ``k + 1`` calibrators are cells of one grouped fit: a validation row takes part in the
    final cell (-1) and in the cell of every fold but its own.
    """
    scored = cut_lineage(scored)
    val = scored.where((F.col(split) == "validation") & F.col(label).isNotNull())
    folds = val.select(fold).distinct().agg(F.array_sort(F.collect_set(fold)).alias("f"))
    rows = val.withColumn("__f", folds.scalar()).select(
        "logit", label, fold, F.explode(F.concat(F.array(F.lit(-1)), "__f")).alias("held")
    ).where(F.col("held") != F.col(fold))
    fits = calibrate.fit_cells(rows, ["held"], "logit", label, l2=l2)
    final = calibrate.apply_fit(scored.withColumn("held", F.lit(-1)), fits, ["held"], "logit", "prob").drop("held")
    own = fits.where("held >= 0").select(F.col("held").alias(fold), "intercept", "slope")
    joined = final.join(own, fold, "left")
    oof = 1.0 / (1.0 + F.exp(-(F.col("intercept") + F.col("slope") * F.col("logit"))))
    return joined.withColumn("oof_prob", F.when(F.col(split) == "validation", oof)).drop("intercept", "slope")


def balanced_weights(train: DataFrame, label: str, out: str = "weight") -> DataFrame:
    """n / (2 n_label) per row, the class-balanced weighting."""
    per = train.groupBy(label).agg(F.count(F.lit(1)).alias("__c"))
    total = per.agg(F.sum("__c").alias("n"), F.count(F.lit(1)).alias("k"))
    w = per.withColumn("__t", total.select(F.struct("n", "k")).scalar()).select(
        label, (F.col("__t.n") / (F.col("__t.k") * F.col("__c"))).alias(out)
    )
    return train.join(w, label)


def probe(df: DataFrame, features: str, target: str, split: str, fold: str, grid: Sequence[float] = C_GRID) -> DataFrame:
    """Probe head on the rows with a stated target; AUROC per split of the chosen head."""
    chosen, _, scored = select_head(df, features, target, split, fold, grid)
    known = scored.where(F.col(target).isNotNull())
    return metrics.auroc(known, [split], "logit", target).withColumn("c", F.lit(chosen))


def cross_fitted(df: DataFrame, features: str, label: str, fold: str, c: float = 1.0) -> DataFrame:
    """Target-assisted readout: each fold is scored by a head fitted on the other folds.

    The number of folds is a small constant. Out-of-fold calibration follows on the same folds.
    """
    df = cut_lineage(df)
    folds = sorted(r[0] for r in df.where(F.col(fold) >= 0).select(fold).distinct().collect())
    parts = []
    for k in folds:
        train = df.where((F.col(fold) != k) & (F.col(fold) >= 0) & F.col(label).isNotNull())
        n = train.count()
        scaler = fit_scaler(train, features)
        model = fit_head(standardise(train, scaler, n, features, "__x"), "__x", label, c, n)
        held = standardise(df.where(F.col(fold) == k), scaler, n, features, "__x")
        parts.append(head_logits(held, model, "__x").drop("__x"))
    scored = reduce(DataFrame.unionByName, parts)
    others = scored.where(F.col(label).isNotNull()).select("logit", label, fold).withColumn(
        "held", F.explode(F.array(*[F.lit(k) for k in folds]))
    ).where(F.col("held") != F.col(fold))
    fits = calibrate.fit_cells(others, ["held"], "logit", label, l2=1.0)
    return calibrate.apply_fit(scored.withColumn("held", F.col(fold)), fits, ["held"], "logit", "prob").drop("held")


def metadata_reference(df: DataFrame, features: str, label: str, split: str, c: float = 1.0) -> DataFrame:
    """Scores of two metadata readouts, logistic and boosted trees, in one long table."""
    df = cut_lineage(df)
    train = df.where(F.col(split) == "train").persist()
    n = train.count()
    linear = fit_head(train, features, label, c, n)
    trees = GBTClassifier(featuresCol=features, labelCol=label, maxIter=20, maxDepth=3, seed=7).fit(train)
    boosted = trees.transform(df).withColumn("score", vector_to_array("probability")[1])
    keep = [x for x in df.columns if x != features]
    out = (
        head_logits(df, linear, features)
        .select(*keep, (1.0 / (1.0 + F.exp(-F.col("logit")))).alias("score"))
        .withColumn("family", F.lit("logistic"))
        .unionByName(boosted.select(*keep, "score").withColumn("family", F.lit("boosted")))
    )
    train.unpersist()
    return out


def nuisance_basis(df: DataFrame, features: str, targets: Sequence[str], c: float = 1.0, tolerance: float = 1e-6) -> np.ndarray:
    """Orthonormal basis of the unit nuisance directions; a (targets x width) problem on the driver."""
    df = cut_lineage(df.select(features, *targets))
    directions = []
    for t in targets:
        rows = df.where(F.col(t).isNotNull())
        w = fit_head(rows, features, t, c, rows.count()).coefficients.toArray()
        directions.append(w / np.linalg.norm(w))
    _, s, vh = np.linalg.svd(np.stack(directions), full_matrices=False)
    return vh[: int((s > tolerance * s[0]).sum())]


def erase(df: DataFrame, features: str, basis: np.ndarray, out: str = "erased") -> DataFrame:
    """Remove the nuisance subspace: x - (x Q') Q, by matrix products on Arrow batches."""

    @F.pandas_udf("array<double>")
    def project(v: pd.Series) -> pd.Series:
        x = np.asarray(v.tolist(), dtype=np.float64)
        return pd.Series(list(x - (x @ basis.T) @ basis)) if len(v) else pd.Series([], dtype=object)

    return df.withColumn(out, project(vector_to_array(features)))


def fusion_results(df: DataFrame, arms: dict[str, Sequence[Column]], label: str, split: str, c: float = 1.0) -> DataFrame:
    """Every feature combination fitted under one protocol: ``(arm, split, auroc)``."""
    parts, df = [], cut_lineage(df)
    for arm, cols in arms.items():
        base = assemble_features(df, cols, "__f")
        train = base.where(F.col(split) == "train")
        n = train.count()
        scaler = fit_scaler(train, "__f")
        x = standardise(base, scaler, n, "__f", "__x")
        model = fit_head(x.where(F.col(split) == "train"), "__x", label, c, n)
        parts.append(head_logits(x, model, "__x").select(F.lit(arm).alias("arm"), split, label, "logit"))
    return metrics.auroc(reduce(DataFrame.unionByName, parts), ["arm", split], "logit", label)


def best_family(results: DataFrame, family: str, value: str) -> DataFrame:
    """Family with the best value; on a tie the alphabetically first name."""
    top = results.agg(F.max(value).alias("m"))
    return results.where(F.col(value) == top.scalar()).agg(F.min(family).alias(family), F.max(value).alias(value))


def scaled_stats(train: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Mean and population sd per column, the training statistics of a scaler as a table."""
    long = train.select(*[F.col(c).cast("double").alias(c) for c in cols]).unpivot([], list(cols), "feature", "v")
    return long.groupBy("feature").agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("sd"))


def z_scores(df: DataFrame, keys: Sequence[str], stats: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Standardised values in long form; a constant training column gives 0."""
    long = df.select(*keys, *[F.col(c).cast("double").alias(c) for c in cols]).unpivot(list(keys), list(cols), "feature", "v")
    j = same_key_join(long, stats, ["feature"])
    return j.select(*keys, "feature", F.when(F.col("sd") > 0, (F.col("v") - F.col("mean")) / F.col("sd")).otherwise(F.lit(0.0)).alias("z"))
