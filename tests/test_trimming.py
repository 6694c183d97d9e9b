"""Trimming by pair classes against the plain greedy path, and the match-first fixture of the study."""

import random

import numpy as np
import pandas as pd
import pytest

from tessera.operators import balance
from tessera.plans import cohort

SCHEMA = "pair_id string, neg_age double, pos_age double, neg_a string, pos_a string, neg_b string, pos_b string"


def scaled(pa, pb):
    scale = np.sqrt((pa * (1 - pa) + pb * (1 - pb)) / 2)
    smd = abs(pa - pb) / scale if scale > 0 else 0.0 if pa == pb else np.inf
    return max(smd / 0.12, abs(pa - pb) / 0.08)


def objective(rows, numeric, levels):
    if not rows:
        return np.inf
    worst = 0.0
    for i in numeric:
        seen = [(r[i], r[i + 1]) for r in rows if r[i] is not None and r[i + 1] is not None and np.isfinite(r[i]) and np.isfinite(r[i + 1])]
        if len(seen) < 2:
            return np.inf
        a, b = np.array(seen).T
        pooled, gap = np.sqrt((a.var(ddof=1) + b.var(ddof=1)) / 2), abs(a.mean() - b.mean())
        worst = max(worst, (gap / pooled if pooled > 1e-12 else 0.0 if gap < 1e-12 else np.inf) / 0.12)
    for i in levels:
        for level in {r[i] for r in rows} | {r[i + 1] for r in rows}:
            worst = max(worst, scaled(sum(r[i] == level for r in rows) / len(rows), sum(r[i + 1] == level for r in rows) / len(rows)))
    return worst


def greedy(rows, minimum, to_minimum, numeric, levels):
    rows = list(rows)
    while len(rows) > minimum and (to_minimum or objective(rows, numeric, levels) > 1):
        values = [objective(rows[:k] + rows[k + 1 :], numeric, levels) for k in range(len(rows))]
        least = min(values)
        gone = min((r[0], k) for k, r in enumerate(rows) if values[k] <= least + 1e-9)[1]
        rows.pop(gone)
    return {r[0] for r in rows}


def pairs(seed, n=40, numeric=True):
    rng = random.Random(seed)
    level = lambda: rng.choice(["x", "x", "x", "y", "z", None])
    age = lambda: rng.choice([30.0, 40.0, 55.0, None]) if numeric else 0.0
    return [(f"{rng.random():.12f}", age(), age(), level(), level(), rng.choice("pq"), rng.choice("pq")) for _ in range(n)]


@pytest.mark.parametrize("seed", range(3))
@pytest.mark.parametrize("to_minimum", [True, False])
def test_levels_with_many_ties(spark, seed, to_minimum):
    rows = pairs(seed)
    wide = spark.createDataFrame(rows, SCHEMA)
    got = {r["pair_id"] for r in balance.trim_pairs(wide, [], ["a", "b"], 15, to_minimum=to_minimum).collect()}
    named = [(*r[:3], *(x if x is not None else "[MISSING]" for x in r[3:])) for r in rows]
    assert got == greedy(named, 15, to_minimum, [], [3, 5])


def test_numeric_field_with_missing_values(spark):
    rows = pairs(7)
    rows[0] = (rows[0][0], float("nan"), 40.0, *rows[0][3:])
    wide = spark.createDataFrame(rows, SCHEMA)
    values = {r["pair_id"]: r["objective_without"] for r in balance.removal_objectives(wide, ["age"], ["a"]).collect()}
    named = [(*r[:3], *(x if x is not None else "[MISSING]" for x in r[3:])) for r in rows]
    for k, r in enumerate(named):
        assert values[r[0]] == pytest.approx(objective(named[:k] + named[k + 1 :], [1], [3]))
    got = {r["pair_id"] for r in balance.trim_pairs(wide, ["age"], ["a"], 30, to_minimum=True).collect()}
    assert got == greedy(named, 30, True, [1], [3])


def test_rounds_over_the_table_take_the_same_path(spark, monkeypatch):
    rows = pairs(11, 16)
    wide = spark.createDataFrame(rows, SCHEMA)
    one = {r["pair_id"] for r in balance.trim_pairs(wide, ["age"], ["a"], 13, to_minimum=True).collect()}
    monkeypatch.setattr(balance, "PAIRS_IN_TASK", 1)
    assert one == {r["pair_id"] for r in balance.trim_pairs(wide, ["age"], ["a"], 13, to_minimum=True).collect()}


def plain_path(a, b, na, nb, minimum):
    """Ranks removed, every pair judged in every step."""
    left, out = np.ones(len(a), bool), []
    while left.sum() > minimum:
        i = np.flatnonzero(left)
        k = len(i) - 1
        mean, var = zip(*[((v[i].sum() - v[i]) / k, ((v[i] ** 2).sum() - v[i] ** 2 - (v[i].sum() - v[i]) ** 2 / k) / (k - 1)) for v in (a, b)])
        worst = np.abs(mean[0] - mean[1]) / np.sqrt((var[0] + var[1]) / 2) / 0.12
        for level in range(int(max(na.max(), nb.max())) + 1):
            pa, pb = ((v[i] == level).sum() - (v[i] == level) for v in (na, nb))
            pa, pb = pa / k, pb / k
            scale, gap = np.sqrt((pa * (1 - pa) + pb * (1 - pb)) / 2), np.abs(pa - pb)
            worst = np.maximum(worst, np.maximum(np.where(scale > 0, gap / np.where(scale > 0, scale, 1), np.where(gap > 0, np.inf, 0)) / 0.12, gap / 0.08))
        gone = i[np.flatnonzero(worst <= worst.min() + 1e-11)[0]]
        left[gone] = False
        out.append(int(gone) + 1)
    return out


@pytest.mark.parametrize(("shift", "levels"), [(5.0, 4), (0.0, 3), (0.3, 12)])
def test_step_judges_few_classes(monkeypatch, shift, levels):
    rng = np.random.default_rng(levels)
    n, share = 12000, rng.dirichlet(np.ones(levels))
    a, b = rng.normal(shift, 1, n), rng.normal(0, 1, n)
    na, nb = rng.choice(levels, n, p=share), rng.choice(levels, n, p=share[::-1] if shift < 5 else share)
    classes = pd.DataFrame({"neg_x": a, "pos_x": b, "neg_c": na.astype(str), "pos_c": nb.astype(str), "ranks": [[k + 1] for k in range(n)]})
    judged, without = [0], balance._Numeric.without

    def counted(self, at, max_smd):
        judged[0] += 0 if at is None else len(at)
        return without(self, at, max_smd)

    monkeypatch.setattr(balance._Numeric, "without", counted)
    walk = balance._Walk(["x"], ["c"], n - 150, 0.12, 0.08, True)
    got = next(walk.removed(iter([classes])))["__rank"].tolist()
    assert got == plain_path(a, b, na, nb, n - 150)
    assert judged[0] / 150 < n / 3, judged[0] / 150


def test_path_is_walked_once(spark, tmp_path, monkeypatch):
    walked = balance._Walk.removed
    monkeypatch.setattr(balance._Walk, "removed", lambda self, batches: [(tmp_path / f"{random.random()}").touch(), *walked(self, batches)][1:])
    kept = balance.trim_pairs(spark.createDataFrame(pairs(5), SCHEMA), ["age"], ["a"], 30, to_minimum=True)
    assert kept.count() == kept.distinct().count() == 30
    assert len(list(tmp_path.iterdir())) == 1


def test_few_pairs_and_empty_table(spark):
    wide = spark.createDataFrame(pairs(3, 5), SCHEMA)
    assert balance.trim_pairs(wide, ["age"], ["a"], 5, to_minimum=True).count() == 5
    assert balance.trim_pairs(wide, ["age"], ["a"], 0, to_minimum=True).count() == 0
    assert balance.trim_pairs(wide.limit(0), ["age"], ["a"], 0).count() == 0


def test_match_first_on_the_gate_table(spark):
    """144 units, 40 / 12 / 20 of a label in three folds: a target of 10 pairs takes 20 units and leaves 124 to split."""
    rows = []
    for fold, n in (("train", 40), ("validation", 12), ("test", 20)):
        for y in (0, 1):
            rows += [(f"{fold}_{y}_{k:03d}", y, 30 + k % 10, ("female", "male")[k % 2], "never", k % 2, "WEB" if k % 3 else "ANDROID") for k in range(n)]
    units = spark.createDataFrame(rows, "uid string, label int, age int, gender string, smoker string, cough int, platform string")
    quotas = [("train", 0.70), ("validation", 0.15)]
    out = cohort.match_first(
        units, "uid", "label", ["label", "platform"], [["gender", "platform", "age"], ["gender", "platform"]], "gate", quotas, "test", 10, ["age"], ["gender", "smoker", "cough", "platform"]
    )
    got = {r["split"]: (r["n"], r["n_pairs"]) for r in out.collect()}
    assert got["matched_target"] == (20, 10) and sum(n for k, (n, _) in got.items() if k != "matched_target") == 124
