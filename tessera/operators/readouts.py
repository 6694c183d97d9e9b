"""Many regularised logistic readouts of one feature table at once: a grid of strengths, each with every fold held out.

Training moments (counts, sums and the Gram matrix) are kept per fold, so the scaler and the curvature of any union of
folds is a sum of what one pass has gathered. All fits then move together: a pass multiplies a batch of features by
all coefficient vectors and adds up all gradients. The steps are limited-memory quasi-Newton steps, preconditioned by the
Gram matrix, so their number does not grow with the number of features; the driver holds coefficients and moments only.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators import calibrate, metrics
from tessera.operators.heads import C_GRID, one_se_choice
from tessera.session import cut_lineage

PASSES = 200
TOLERANCE = 1e-9
_HISTORY = 12

#: Rows multiplied at a time, and how many tasks' sums one task adds.
_ROWS = 4096
_FAN_IN = 64


def summed(df: DataFrame, size: int, terms: Callable[[pd.DataFrame], np.ndarray]) -> np.ndarray:
    """The sum of ``terms(rows)``, ``size`` numbers, over all rows: in the tasks first, then over ``_FAN_IN`` tasks at a time."""

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out = np.zeros(size)
        for batch in batches:
            for a in range(0, len(batch), _ROWS):
                out += terms(batch.iloc[a : a + _ROWS])
        yield pd.DataFrame({"part": [TaskContext.get().partitionId()], "sums": [out]})

    def add(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"part": [key[0]], "sums": [np.sum(np.stack(group["sums"].to_numpy()), axis=0)]})

    schema = "part int, sums array<double>"
    parts, tasks = df.mapInPandas(partial, schema), df.rdd.getNumPartitions()
    while tasks > _FAN_IN:
        tasks = -(-tasks // _FAN_IN)
        parts = parts.groupBy(F.pmod("part", F.lit(tasks)).cast("int").alias("part")).applyInPandas(add, schema)
    return np.sum([r["sums"] for r in parts.collect()], axis=0) if tasks else np.zeros(size)


def _matrix(rows: pd.DataFrame) -> np.ndarray:
    return np.stack(rows["x"].to_numpy()).astype(np.float64)


@dataclass(frozen=True)
class GridFits:
    """Fit ``i`` leaves out fold ``held[i // len(grid)]`` (None: none) at strength ``grid[i % len(grid)]``."""

    held: tuple[int | None, ...]
    grid: tuple[float, ...]
    coefficients: np.ndarray  # features x fits, for features as they are
    intercepts: np.ndarray
    converged: np.ndarray

    def index(self, held: int | None, c: float) -> int:
        return self.held.index(held) * len(self.grid) + self.grid.index(c)

    def logits(self, df: DataFrame, features: str, fits: Sequence[int], out: str) -> DataFrame:
        """Adds the array of logits of the given fits; rows are scored in place, by matrix products on Arrow batches.

        Logits are rounded to 1e-10, so that equal rows score equally wherever they stand in a batch.
        """
        u, b = self.coefficients[:, list(fits)], self.intercepts[list(fits)]

        @F.pandas_udf("array<double>")
        def score(v: pd.Series) -> pd.Series:
            return pd.Series(list(np.round(np.stack(v.to_numpy()).astype(np.float64) @ u + b, 10))) if len(v) else pd.Series([], dtype=object)

        return df.withColumn(out, score(_as_array(df, features)))


def _as_array(df: DataFrame, features: str) -> Column:
    if dict(df.dtypes)[features] == "vector":
        return vector_to_array(features)
    return F.col(features).cast("array<double>")


def fit_grid(df: DataFrame, features: str, label: str, fold: Column | None, held: Sequence[int | None], grid: Sequence[float] = C_GRID) -> GridFits:
    """All fits of ``label`` (0 or 1) on the standardised features: each fold of ``held`` left out, each strength of ``grid``.

    The objective is the sum of log losses plus |w|^2 / (2 C) over standardised coefficients, the intercept free; mean and
    population sd are those of the fit's own training rows (a constant feature has sd 1). Rows need a label and features.
    """
    plain = df.select(_as_array(df, features).alias("x"), F.col(label).cast("double").alias("y"), (F.lit(-1) if fold is None else fold).cast("int").alias("fold"))
    rows = cut_lineage(plain.where("y IS NOT NULL AND x IS NOT NULL"))
    first = rows.select(F.size("x").alias("d")).first()
    d = first["d"] if first else 0
    held, grid = tuple(held), tuple(grid)
    folds = sorted({h for h in held if h is not None})
    place = {h: i for i, h in enumerate(folds)}
    block = 2 + d + d * d

    def moments(r: pd.DataFrame) -> np.ndarray:
        out = np.zeros((len(folds) + 1, block))
        x, y, f = _matrix(r), r["y"].to_numpy(), r["fold"].to_numpy()
        for k in np.unique(f):
            own = x[f == k]
            out[place.get(int(k), len(folds))] += np.concatenate([[len(own), y[f == k].sum()], own.sum(axis=0), (own.T @ own).ravel()])
        return out.ravel()

    per_fold = summed(rows, (len(folds) + 1) * block, moments).reshape(len(folds) + 1, block)
    n_fits, g = len(held) * len(grid), len(grid)
    n, mean, sd, values, vectors, rate = [], [], [], [], [], []
    for h in held:
        m = per_fold.sum(axis=0) - (per_fold[place[h]] if h is not None else 0.0)
        size = max(m[0], 1.0)
        mu = m[2 : 2 + d] / size
        cov = m[2 + d :].reshape(d, d) / size - np.outer(mu, mu)
        s = np.sqrt(np.maximum(np.diag(cov), 0.0))
        s = np.where(s > 1e-12 * np.maximum(np.abs(mu), 1.0), s, 1.0)
        lam, vec = np.linalg.eigh(cov * size / np.outer(s, s))
        n.append(m[0])
        mean.append(mu)
        sd.append(s)
        values.append(np.maximum(lam, 0.0))
        vectors.append(vec)
        rate.append(np.clip(m[1] / size, 1e-12, 1 - 1e-12))
    mean_of, sd_of = np.repeat(np.array(mean), g, axis=0).T, np.repeat(np.array(sd), g, axis=0).T  # features x fits
    strength = np.tile(np.array(grid), len(held))
    held_of = np.repeat(np.array([-2 if h is None else h for h in held]), g)

    def precondition(grad: np.ndarray, i: int) -> np.ndarray:
        """Solves with the curvature bound Gram / 4 + 1 / C."""
        k = i // g
        out = np.empty_like(grad)
        out[0] = grad[0] / max(n[k] / 4, 1e-12)
        out[1:] = vectors[k] @ ((vectors[k].T @ grad[1:]) / (values[k] / 4 + 1 / strength[i]))
        return out

    def losses(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Loss and gradient of every fit; ``v`` holds intercepts and standardised coefficients, (1 + features) x fits."""
        u = v[1:] / sd_of
        b = v[0] - (u * mean_of).sum(axis=0)

        def terms(r: pd.DataFrame) -> np.ndarray:
            x, y, f = _matrix(r), r["y"].to_numpy()[:, None], r["fold"].to_numpy()[:, None]
            z, used = x @ u + b, f != held_of
            residual = np.where(used, 1.0 / (1.0 + np.exp(-np.clip(z, -700, 700))) - y, 0.0)
            loss = np.where(used, np.logaddexp(0.0, z) - y * z, 0.0)
            return np.concatenate([loss.sum(axis=0), residual.sum(axis=0), (x.T @ residual).ravel()])

        s = summed(rows, n_fits * (2 + d), terms)
        loss, r0, rx = s[:n_fits], s[n_fits : 2 * n_fits], s[2 * n_fits :].reshape(d, n_fits)
        grad = np.vstack([r0, (rx - mean_of * r0) / sd_of + v[1:] / strength])
        return loss + (v[1:] ** 2).sum(axis=0) / (2 * strength), grad

    at = np.zeros((1 + d, n_fits))
    at[0] = np.repeat(np.log(rate) - np.log1p(-np.array(rate)), g)
    history: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in range(n_fits)]
    converged = np.zeros(n_fits, bool)
    loss, grad = losses(at)
    step = np.ones(n_fits)
    direction = np.zeros_like(at)
    fresh = np.ones(n_fits, bool)
    for _ in range(PASSES):
        for i in np.flatnonzero(fresh & ~converged):
            if np.abs(precondition(grad[:, i], i)).max() < TOLERANCE:
                converged[i] = True
                continue
            q, used = grad[:, i].copy(), []
            for s, y in reversed(history[i]):
                a = (s @ q) / (s @ y)
                q -= a * y
                used.append((a, s, y))
            q = precondition(q, i)
            for a, s, y in reversed(used):
                q += s * (a - (y @ q) / (s @ y))
            direction[:, i], step[i] = -q, 1.0
        if converged.all():
            break
        trial = np.where(converged, at, at + step * direction)
        new_loss, new_grad = losses(trial)
        slope = (grad * direction).sum(axis=0)
        fresh = ~converged & (new_loss <= loss + 1e-4 * step * slope + 1e-12 * np.abs(loss))
        for i in np.flatnonzero(fresh):
            s, y = trial[:, i] - at[:, i], new_grad[:, i] - grad[:, i]
            if s @ y > 1e-14 * (y @ y):
                history[i] = [*history[i], (s, y)][-_HISTORY:]
        at, grad, loss = np.where(fresh, trial, at), np.where(fresh, new_grad, grad), np.where(fresh, new_loss, loss)
        shrunk = ~fresh & ~converged
        step[shrunk] /= 2
        stuck = shrunk & (step < 1e-10)  # rounding allows no better point
        converged |= stuck & (np.abs(np.stack([precondition(grad[:, i], i) for i in range(n_fits)], axis=1)).max(axis=0) < 1e-5)
        if (stuck & ~converged).any():
            break
    u = at[1:] / sd_of
    return GridFits(held, grid, u, at[0] - (u * mean_of).sum(axis=0), converged)


def held_out_scores(fits: GridFits, df: DataFrame, features: str, label: str, fold: str) -> DataFrame:
    """``(c, fold, label, oof)``: each labelled row of a fold by the fits that left the fold out."""
    folds = [h for h in fits.held if h is not None]
    g = len(fits.grid)
    scored = fits.logits(df, features, range(len(folds) * g), "__all")
    first = F.element_at(F.create_map(*[x for i, h in enumerate(folds) for x in (F.lit(h), F.lit(i * g + 1))]), F.col(fold))
    own = scored.where(F.col(fold).isin(folds) & F.col(label).isNotNull()).select(fold, label, F.slice("__all", first, g).alias("__own"))
    long = own.select(fold, label, F.posexplode("__own").alias("i", "oof"))
    return long.select(F.element_at(F.array(*[F.lit(c) for c in fits.grid]), F.col("i") + 1).alias("c"), fold, label, "oof")


@dataclass(frozen=True)
class TargetHead:
    c: float
    selection: DataFrame
    calibrator: DataFrame  # intercept, slope, converged
    scores: DataFrame  # all rows with oof_logit (fit rows only), logit and prob


def target_head(df: DataFrame, features: str, label: str, fold: str, grid: Sequence[float] = C_GRID) -> TargetHead:
    """Target-assisted readout: strength chosen by cross-fitting, pooled out-of-fold calibration, final refit.

    Rows with a label and a fold of 0 or more take part in fitting. Each (fold, strength) is fitted without the fold; the
    smallest strength within one standard error of the best mean fold AUROC is taken. Its out-of-fold logits of all
    folds fit one calibrator (slope penalty 1), the refit on all fit rows scores every row.
    """
    df = cut_lineage(df)
    fit_rows = df.where((F.col(fold) >= 0) & F.col(label).isNotNull())
    folds = sorted(r[0] for r in fit_rows.select(fold).distinct().collect())  # a handful
    fits = fit_grid(fit_rows, features, label, F.col(fold), [*folds, None], grid)
    held = cut_lineage(held_out_scores(fits, fit_rows, features, label, fold))
    selection = cut_lineage(one_se_choice(metrics.auroc(held, ["c", fold], "oof", label), "c", fold))
    chosen = selection.where("chosen").select("c").first()[0]
    pooled = held.where(F.col("c") == chosen)
    calibrator = calibrate.fit_cells(pooled, [], "oof", label, l2=1.0)
    slope = calibrator.first()
    scored = fits.logits(df, features, [fits.index(h, chosen) for h in [*folds, None]], "__z")
    own = F.element_at(F.create_map(*[x for i, h in enumerate(folds) for x in (F.lit(h), F.lit(i + 1))]), F.col(fold))
    oof = F.when((F.col(fold) >= 0) & F.col(label).isNotNull(), F.element_at("__z", own))
    logit = F.element_at("__z", len(folds) + 1)
    prob = 1.0 / (1.0 + F.exp(-(F.lit(slope["intercept"]) + F.lit(slope["slope"]) * logit)))
    return TargetHead(chosen, selection, calibrator, scored.withColumns({"oof_logit": oof, "logit": logit, "prob": prob}).drop("__z"))


def select_readout(df: DataFrame, features: str, label: str, split: str, fold: str, grid: Sequence[float] = C_GRID) -> tuple[float, DataFrame, DataFrame]:
    """All strengths fitted on train at once; the validation folds choose one by one standard error.

    Returns the chosen strength, the selection table and all rows with the chosen ``logit``.
    """
    df = cut_lineage(df)
    fits = fit_grid(df.where(F.col(split) == "train"), features, label, None, [None], grid)
    held = df.where((F.col(fold) >= 0) & F.col(label).isNotNull()).select(features, fold, label)
    long = fits.logits(held, features, range(len(grid)), "__all").select(fold, label, F.posexplode("__all").alias("i", "logit"))
    long = long.withColumn("c", F.element_at(F.array(*[F.lit(c) for c in fits.grid]), F.col("i") + 1))
    selection = cut_lineage(one_se_choice(metrics.auroc(long, ["c", fold], "logit", label), "c", fold))
    chosen = selection.where("chosen").select("c").first()[0]
    scored = fits.logits(df, features, [fits.index(None, chosen)], "__z").withColumn("logit", F.element_at("__z", 1)).drop("__z")
    return chosen, selection, scored


def arm_results(df: DataFrame, arms: dict[str, str], label: str, split: str, fold: str, grid: Sequence[float] = C_GRID) -> DataFrame:
    """``(arm, c, split, n_pos, n_neg, auroc)`` of each arm's feature column under one protocol: :func:`select_readout`."""
    df = cut_lineage(df)
    parts = []
    for arm, features in arms.items():  # a handful, each with its own width
        c, _, scored = select_readout(df.select(features, label, split, fold), features, label, split, fold, grid)
        parts.append(scored.select(F.lit(arm).alias("arm"), F.lit(c).alias("c"), split, label, "logit"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return metrics.auroc(out.where(F.col(label).isNotNull()), ["arm", "c", split], "logit", label)
