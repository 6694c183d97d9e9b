"""Readouts fitted together against one plain fit each."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessera.operators import readouts

GRID = (0.01, 0.3, 3.0)


def plain_fit(x, y, c):
    """Newton on standardised features; returns a scorer."""
    mu, sd = x.mean(axis=0), x.std(axis=0)
    sd = np.where(sd > 0, sd, 1.0)
    m = np.column_stack([np.ones(len(x)), (x - mu) / sd])
    beta, pen = np.zeros(m.shape[1]), np.diag([0.0] + [1 / c] * x.shape[1])
    for _ in range(100):
        p = 1 / (1 + np.exp(-m @ beta))
        beta -= np.linalg.solve((m.T * (p * (1 - p))) @ m + pen + 1e-13 * np.eye(len(beta)), m.T @ (p - y) + pen @ beta)
    return lambda v: np.column_stack([np.ones(len(v)), (v - mu) / sd]) @ beta


def area(s, y):
    pos, neg = s[y == 1], s[y == 0]
    return ((pos[:, None] > neg) + 0.5 * (pos[:, None] == neg)).mean()


def data(n=240, d=4, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d)) * 10.0 ** np.arange(d) + np.arange(d) * 100
    x[:, -1] = 7.0  # a constant feature
    y = (x[:, 0] + 0.02 * x[:, 1] + rng.normal(size=n) > 2).astype(int)
    fold = rng.integers(-1, 3, n)
    return x, y, fold


def frame(spark, x, y, fold, **more):
    label = [None if v is None else int(v) for v in y]
    columns = {"u": range(len(y)), "x": list(map(list, x)), "fold": fold.astype(int)} | more
    return spark.createDataFrame(pd.DataFrame(columns)).join(spark.createDataFrame(list(enumerate(label)), "u long, y int"), "u").repartition(5)


def test_every_fold_and_strength(spark, monkeypatch):
    monkeypatch.setattr(readouts, "_FAN_IN", 2)
    monkeypatch.setattr(readouts, "_ROWS", 7)
    x, y, fold = data()
    fits = readouts.fit_grid(frame(spark, x, y, fold), "x", "y", F.col("fold"), [0, 1, 2, None], GRID)
    assert fits.converged.all()
    for h in (0, 1, 2, None):
        used = fold != (h if h is not None else -9)
        for c in GRID:
            i = fits.index(h, c)
            assert np.allclose(x @ fits.coefficients[:, i] + fits.intercepts[i], plain_fit(x[used], y[used], c)(x), atol=1e-5)


def test_target_head(spark):
    x, y, fold = data(seed=3)
    known = np.array([None if k % 17 == 0 else v for k, v in enumerate(y)], object)
    head = readouts.target_head(frame(spark, x, known, fold), "x", "y", "fold", GRID)
    fit = (fold >= 0) & np.array([v is not None for v in known])
    means, ses, oofs = {}, {}, {}
    for c in GRID:
        oof = np.full(len(y), np.nan)
        for k in range(3):
            oof[fit & (fold == k)] = plain_fit(x[fit & (fold != k)], y[fit & (fold != k)], c)(x[fit & (fold == k)])
        scores = [area(oof[fit & (fold == k)], y[fit & (fold == k)]) for k in range(3)]
        means[c], ses[c], oofs[c] = np.mean(scores), np.std(scores, ddof=1) / np.sqrt(3), oof
    best = max(GRID, key=lambda c: means[c])
    chosen = min(c for c in GRID if means[c] >= means[best] - ses[best])
    assert head.c == chosen
    a, s = np.zeros(2)
    z, t = oofs[chosen][fit], y[fit]
    for _ in range(100):
        p = 1 / (1 + np.exp(-(a + s * z)))
        h = np.array([[(p * (1 - p)).sum(), (p * (1 - p) * z).sum()], [(p * (1 - p) * z).sum(), (p * (1 - p) * z * z).sum() + 1]])
        step = np.linalg.solve(h, [(p - t).sum(), ((p - t) * z).sum() + s])
        a, s = a - step[0], s - step[1]
    final = plain_fit(x[fit], y[fit], chosen)(x)
    for r in head.scores.collect():
        u = r["u"]
        assert r["logit"] == pytest.approx(final[u], abs=1e-5) and r["prob"] == pytest.approx(1 / (1 + np.exp(-(a + s * final[u]))), abs=1e-6)
        assert (r["oof_logit"] is None) == (not fit[u]) and (not fit[u] or r["oof_logit"] == pytest.approx(oofs[chosen][u], abs=1e-5))


def test_select_readout(spark):
    x, y, fold = data(seed=5)
    split = np.where(fold < 0, "train", np.where(fold == 2, "validation", "test"))
    inner = np.where(split == "validation", np.arange(len(y)) % 3, -1)
    c, selection, scored = readouts.select_readout(frame(spark, x, y, inner, split=list(split)), "x", "y", "split", "fold", GRID)
    assert selection.count() == len(GRID)
    want = plain_fit(x[split == "train"], y[split == "train"], c)(x)
    assert all(r["logit"] == pytest.approx(want[r["u"]], abs=1e-5) for r in scored.collect())


def test_one_class_and_separable_rows_end(spark):
    x = np.arange(8.0)[:, None]
    one = readouts.fit_grid(frame(spark, x, np.ones(8, int), np.zeros(8)), "x", "y", None, [None], (1.0,))
    assert np.isfinite(one.coefficients).all() and abs(one.coefficients).max() < 1e-3
    apart = readouts.fit_grid(frame(spark, x, (x[:, 0] > 3).astype(int), np.zeros(8)), "x", "y", None, [None], (1.0,))
    assert apart.converged.all() and apart.coefficients[0, 0] > 0
