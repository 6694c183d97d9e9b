"""Replicates held as arrays against one plain computation per replicate."""

import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import bootstrap, replicates
from tessera.plans.evaluation import transport_replicates

REPS = 7


def rows(seed=1, n=60, cells=("a", "b", None)):
    rng = random.Random(seed)
    return [(c, s, u, u % 6, int(rng.random() < 0.4), rng.choice([-1.0, 0.0, 0.5, rng.gauss(0, 1)])) for c in cells for s in (0, 1) for u in range(n)]


def frame(spark, data):
    df = spark.createDataFrame(data, "arm string, seed int, u long, k int, y int, z double")
    return df.withColumn("p", 1 / (1 + F.exp(-F.col("z"))))


def drawn(df, unit, salt, scheme="multinomial"):
    out = defaultdict(dict)
    for r in bootstrap.draws(df, unit, REPS, salt, scheme=scheme).collect():
        out[r["rep"]][r[unit]] = r["times"]
    return out


def area(z, y, w):
    pos, neg = [(s, t) for s, c, t in zip(z, y, w) if c], [(s, t) for s, c, t in zip(z, y, w) if not c]
    total = sum(a for _, a in pos) * sum(b for _, b in neg)
    return sum(a * b * ((s > t) + 0.5 * (s == t)) for s, a in pos for t, b in neg) / total if total else None


def fit(z, y, w):
    b = np.zeros(2)
    x = np.column_stack([np.ones(len(z)), z])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -40, 40)))
        b = b - np.linalg.solve((x.T * (w * np.maximum(p * (1 - p), 1e-9))) @ x, x.T @ (w * (p - y)))
    return b


@pytest.mark.parametrize("cluster", ["u", "k"])
@pytest.mark.parametrize("scheme", ["multinomial", "poisson"])
@pytest.mark.parametrize("metric", bootstrap.METRICS)
def test_metric_replicates(spark, cluster, scheme, metric):
    data = rows()
    df = frame(spark, data)
    draws = drawn(df, cluster, "s", scheme)
    got = {(r["arm"], r["seed"], r["rep"]): r["value"] for r in bootstrap.replicate_metric(df, ["arm", "seed"], cluster, metric, "y", "z", "p", REPS, "s", scheme=scheme).collect()}
    assert len(got) == 3 * 2 * REPS
    for (arm, seed, rep), value in got.items():
        own = [(z, y, draws[rep].get(u if cluster == "u" else k, 0)) for a, s, u, k, y, z in data if (a, s) == (arm, seed)]
        z, y, w = map(np.array, zip(*own))
        p = np.clip(1 / (1 + np.exp(-z)), 1e-6, 1 - 1e-6)
        if metric == "auroc":
            want = area(z, y, w)
        elif not w[y == 1].sum() or not w[y == 0].sum():
            want = None
        else:
            want = (w * (np.log(np.where(y == 1, p, 1 - p)) if metric == "neg_nll" else -((p - y) ** 2))).sum() / w.sum()
        assert value == pytest.approx(want, abs=1e-9) if want is not None else value is None


@pytest.mark.parametrize(("block", "most", "chunk"), [(256, 250_000, 2 << 20), (4, 12, 50)])
def test_fits_of_all_cells_and_replicates(spark, monkeypatch, block, most, chunk):
    for name, value in (("BLOCK", block), ("MOST_FITS", most), ("_CHUNK", chunk), ("_FAN_IN", 2)):
        monkeypatch.setattr(replicates, name, value)
    data = rows(3)
    df = frame(spark, data)
    draws = drawn(df, "u", "f")
    plain = df.select("arm", "seed", "u", F.col("z").alias("__x"), F.col("y").cast("double").alias("__y"))
    keyed, cells = replicates.keyed(replicates.joined_draws(plain, bootstrap.draws(df, "u", REPS, "f"), ["u"]), ["arm", "seed"])
    got = replicates.fit_replicates(keyed.repartition(5).checkpoint(), cells, ["arm", "seed"], REPS).collect()
    assert len(got) == 6 * REPS
    for r in got:
        own = [(z, y, draws[r["rep"]].get(u, 0)) for a, s, u, _, y, z in data if (a, s) == (r["arm"], r["seed"])]
        z, y, w = map(np.array, zip(*own))
        b = fit(z, y, w)
        assert r["converged"] and np.allclose([r["intercept"], r["slope"]], b, atol=1e-6)
        assert r["n"] == w.sum() and r["n_pos"] == w[y == 1].sum()


def test_fit_that_cannot_converge_says_so(spark):
    from tessera.operators import calibrate

    d = spark.createDataFrame([("one", 1.0, 1), ("one", 2.0, 1), ("split", -1.0, 0), ("split", 1.0, 1), ("fine", 0.0, 0), ("fine", 1.0, 1), ("fine", 0.5, 1), ("fine", 0.7, 0)], "c string, x double, y int")
    got = {r["c"]: r for r in calibrate.fit_cells(d, ["c"], "x", "y").collect()}
    assert set(got) == {"one", "split", "fine"} and got["fine"]["converged"] and abs(got["split"]["slope"]) > 10
    assert all(np.isfinite(r["slope"]) and np.isfinite(r["intercept"]) for r in got.values())


def test_one_score_on_most_rows(spark):
    data = [("a", 0, u, 0, u % 2, 0.25 if u % 10 else float(u)) for u in range(400)]
    df = frame(spark, data)
    draws = drawn(df, "u", "t")
    for r in bootstrap.replicate_metric(df, ["arm"], "u", "auroc", "y", "z", "p", REPS, "t").collect():
        w = [draws[r["rep"]].get(u, 0) for _, _, u, *_ in data]
        assert r["value"] == pytest.approx(area([d[5] for d in data], [d[4] for d in data], w))


def test_transport_refits_in_every_replicate(spark):
    data = rows(5, 40, ("a", "b"))
    df = frame(spark, data)
    cal, held = df.where("u < 25"), df.where("u >= 25")
    dc, de = drawn(cal, "u", "x-cal"), drawn(held, "u", "x-eval")
    ds = defaultdict(dict)
    for r in bootstrap.draws(df, "seed", REPS, "x-seed").collect():
        ds[r["rep"]][r["seed"]] = r["times"]
    got = {(r["arm"], r["metric"], r["rep"]): r["value"] for r in transport_replicates(cal, held, ["arm"], "seed", "u", "y", "z", REPS, "x").collect()}
    assert len(got) == 2 * 3 * REPS
    for arm in "ab":
        for rep in range(REPS):
            per = {}
            for seed in ds[rep]:
                z, y, w = (np.array(v, float) for v in zip(*[(z, y, dc[rep].get(u, 0)) for a, s, u, _, y, z in data if (a, s) == (arm, seed) and u < 25]))
                b = fit(z, y, w)
                if b[1] <= 0:
                    rate = (w * y).sum() / w.sum()
                    b = np.array([np.log(rate) - np.log(1 - rate), 1e-12])
                z, y, w = (np.array(v, float) for v in zip(*[(z, y, de[rep].get(u, 0)) for a, s, u, _, y, z in data if (a, s) == (arm, seed) and u >= 25]))
                p = 1 / (1 + np.exp(-(b[0] + b[1] * z)))
                per[seed] = (area(z, y, w), (w * np.log(np.where(y == 1, p, 1 - p))).sum() / w.sum(), -(w * (p - y) ** 2).sum() / w.sum())
            for i, metric in enumerate(bootstrap.METRICS):
                want = sum(t * per[s][i] for s, t in ds[rep].items()) / sum(ds[rep].values())
                assert got[arm, metric, rep] == pytest.approx(want, abs=1e-7)


@pytest.mark.parametrize("by", [[], ["g"]])
def test_draws_are_packed_by_ranges_of_ranks(spark, monkeypatch, by):
    import hashlib

    monkeypatch.setattr(replicates, "_RANKS", 7)
    monkeypatch.setattr(replicates, "_DRAWS", 300)
    units = [(g, u) for g in ("a", None) for u in range(90)] if by else [(None, u) for u in range(90)]
    df = spark.createDataFrame(units, "g string, u long")
    sha = lambda *parts: hashlib.sha256("|".join(str(p) for p in parts if p is not None).encode()).hexdigest()
    want = defaultdict(int)
    for g in {g for g, _ in units}:
        order = sorted((u for h, u in units if h == g), key=lambda u: sha("s", u))
        for rep in range(REPS):
            for slot in range(1, len(order) + 1):
                want[g, rep, order[int(sha("s", *([g] if by else []), rep, slot)[:12], 16) % len(order)]] += 1
    got = bootstrap.draw_lists(df, "u", REPS, "s", by)
    assert {(r["g"] if by else None, rep, r["u"]): t for r in got.collect() for rep, t in zip(r["__reps"], r["__times"])} == want
    placed = spark.createDataFrame([("a", 1, 1, 2), ("a", 2, 2, 2)], "g string, u long, __r long, __n long")
    plan = replicates.multinomial_lists(placed, by, "u", REPS, "s")._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan  # no row for each replicate and slot


def test_no_task_draws_for_all_units_of_a_matrix(spark, monkeypatch):
    drawn = []
    spread = replicates._spread

    def held(units, reps):
        out = spread(units, reps)
        drawn.extend(reps * r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect())
        return out

    monkeypatch.setattr(replicates, "_DRAWS", 300)
    monkeypatch.setattr(replicates, "_spread", held)
    rows = [(arm, s, u, float(u % 7 + s * (arm == "a"))) for arm in "ab" for s in range(3) for u in range(200)]
    df = spark.createDataFrame(rows, "arm string, s int, u int, x double").coalesce(1)
    got = bootstrap.paired_matrix_interval(df, "arm", "a", "b", "s", "u", "x", REPS, "m").collect()
    assert len(got) == 1 and got[0]["observed"] == pytest.approx(1.0) and got[0]["n_units"] == 200
    assert sum(drawn) == REPS * (200 + 3) and max(drawn) <= 2 * 300  # units, then seeds


def test_poisson_draw_takes_one_hash(spark):
    plan = replicates.with_poisson(spark.range(3), ["id"], REPS, "s")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("sha2(") == 1


def test_paired_replicates_read_the_arms_once(spark):
    v = spark.createDataFrame([("a", 0, 1.0), ("b", 0, 0.25), ("a", 1, None), ("b", 1, 1.0), ("a", 2, 3.0)], "arm string, rep int, value double")
    out = bootstrap.paired_replicates(v, "arm", "a", "b")
    assert {r["rep"]: r["value"] for r in out.collect()} == {0: 0.75, 1: None}
    assert "Join" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_mean_leaves_out_cells_without_a_drawn_cluster(spark):
    rows = [("x", 0, 1, 2.0), ("x", 1, 1, 4.0), ("x", 1, 2, None), ("y", 0, 3, None)]
    df = spark.createDataFrame(rows, "c string, s int, k int, v double")
    t = drawn(df.select("k"), "k", "m")
    got = {(r["c"], r["s"], r["rep"]): r["value"] for r in bootstrap.replicate_means(df, ["c", "s"], "k", "v", REPS, "m").collect()}
    want = {}
    for rep in range(REPS):
        for cell in {(c, s) for c, s, _, _ in rows}:
            own = [(t[rep].get(k, 0), v) for c, s, k, v in rows if (c, s) == cell]
            if sum(n for n, _ in own):
                seen = [n * v for n, v in own if n and v is not None]
                want[*cell, rep] = sum(seen) / sum(n for n, _ in own) if seen else None
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) if want[k] is not None else got[k] is None for k in want)


@pytest.mark.parametrize("held", [8 << 20, 40])
def test_levels_add_up_rows_of_equal_score(spark, monkeypatch, held):
    monkeypatch.setattr(replicates, "_HELD", held)
    data = rows(9, 80, ("a", None))
    df = frame(spark, data)
    draws = drawn(df, "u", "l")
    want = defaultdict(int)
    for arm, seed, u, _, y, z in data:
        for rep in range(REPS):
            if draws[rep].get(u):
                want[arm, seed, z, y, rep] += draws[rep][u]
    plain = df.select("arm", "seed", "u", F.col("z").alias("__x"), F.col("y").cast("double").alias("__y"))
    keyed, cells = replicates.keyed(replicates.joined_draws(plain, bootstrap.draw_lists(df, "u", REPS, "l"), ["u"]), ["arm", "seed"])
    found = cells.join(replicates.levels(keyed.repartition(5), REPS, replicates.score_edges(keyed, "__x")), "__key").collect()
    assert len(found) == len({(r["arm"], r["seed"], r["__x"], r["__y"]) for r in found})  # one row a level
    assert {(r["arm"], r["seed"], r["__x"], r["__y"], rep): t for r in found for rep, t in zip(r["__reps"], r["__times"])} == want


def test_transport_steps_read_levels(spark, monkeypatch):
    read = {}
    for name in ("fit_replicates", "score_fits"):
        own = getattr(replicates, name)
        monkeypatch.setattr(replicates, name, lambda d, *a, own=own, name=name, **k: (read.update({name: d.count()}), own(d, *a, **k))[1])
    data = [("a", s, u, 0, u % 2, float(u % 3)) for s in (0, 1) for u in range(120)]
    df = frame(spark, data)
    got = transport_replicates(df.where("u < 60"), df.where("u >= 60"), ["arm"], "seed", "u", "y", "z", REPS, "x").collect()
    assert len(got) == 3 * REPS and read == {"fit_replicates": 2 * 6, "score_fits": 2 * 6}


def test_predictions_are_dealt_before_they_become_many_rows(spark, data, monkeypatch):
    from tessera.bindings import base

    want = base.Tables(spark, data).predictions().orderBy("unit_id", "arm", "seed").collect()
    monkeypatch.setattr(base, "UNITS_A_TASK", 50, raising=False)
    got = base.Tables(spark, data).predictions()
    held = [r["count"] for r in got.groupBy(F.spark_partition_id()).count().collect()]
    assert len(held) >= 6 and max(held) < len(want) / 3  # a task's aggregate holds a share of the rows
    assert got.orderBy("unit_id", "arm", "seed").collect() == want
