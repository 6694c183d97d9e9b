"""Hand-computed fixtures, properties and brute-force checks of single operators."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessera import functions as fn
from tessera.operators import balance, bootstrap, calibrate, encode, gates, heads, joins, matching, metrics, pairing, profile, retrieval, sampling, splits, validate
from tessera.operators.joins import ContractError


def frame(spark, **cols):
    return spark.createDataFrame(pd.DataFrame(cols))


def units(spark, n=240):
    """Units with one stratum that holds most rows."""
    return spark.range(n).select(
        F.col("id").alias("unit_id"),
        (F.col("id") % 4 == 0).cast("int").alias("y"),
        F.when(F.col("id") % 3 > 0, "hot").otherwise(F.concat(F.lit("s"), F.col("id") % 5)).alias("s"),
        (F.pmod(F.hash("id"), F.lit(40))).cast("long").alias("age"),
        (F.pmod(F.hash(F.col("id") + 7), F.lit(3))).alias("a"),
        (F.pmod(F.hash(F.col("id") + 9), F.lit(2))).alias("b"),
    )


# ---- splits and pairings ----


def test_split_ignores_row_order_and_meets_quotas(spark):
    u = units(spark)
    run = lambda d: {r["unit_id"]: r["split"] for r in splits.stratified_split(d, "unit_id", ["y", "s"], "x", [("train", 0.7)], "test").collect()}
    first = run(u)
    assert first == run(u.orderBy(F.desc("unit_id")).repartition(11))
    p = u.toPandas()
    for _, g in p.groupby(["y", "s"]):
        assert sum(first[k] == "train" for k in g.unit_id) == int(0.7 * len(g))


def test_folds_pool_rare_strata_and_reject_small_classes(spark):
    u = units(spark)
    p = splits.stratified_folds(u, "unit_id", "y", "s", 5, "f").toPandas()
    assert set(p.fold) == set(range(5))
    assert all(p[p.fold == k].y.nunique() == 2 for k in range(5))
    few = u.where("unit_id < 12")
    assert set(splits.stratified_folds(few, "unit_id", "y", None, 5, "f").toPandas().fold) == {-1}
    blank = u.withColumn("y", F.when(F.col("unit_id") != 3, F.col("y")))
    got = {r["unit_id"]: r["fold"] for r in splits.stratified_folds(blank, "unit_id", "y", None, 5, "f").collect()}
    assert got[3] == -1 and len(got) == 240


def test_derangement_small_fixture(spark):
    d = frame(spark, unit_id=range(7), y=[0, 0, 0, 1, 1, 1, 1], sex=["F", "F", "F", "M", "M", "M", "M"])
    p = pairing.derangement(d, "unit_id", ["y", "sex"], "p", (0, 1)).toPandas()
    for _, g in p.groupby("seed"):
        assert sorted(g.donor_id) == list(range(7)) and (g.unit_id != g.donor_id).all()
    audit = pairing.audit_pairing(pairing.derangement(d, "unit_id", ["y"], "p"), d, "unit_id", ["y", "sex"]).first()
    assert audit["bijective"] and audit["n_fixed"] == 0 and audit["n_cross_sex"] == 0


def test_singleton_stratum_fails_or_is_dropped(spark):
    d = frame(spark, unit_id=[1, 2, 3], s=["a", "a", "b"])
    with pytest.raises(ContractError):
        pairing.derangement(d, "unit_id", ["s"], "p")
    assert pairing.derangement(d, "unit_id", ["s"], "p", singletons="drop").count() == 2


# ---- matching and balance ----


def test_every_stratum_yields_all_possible_pairs(spark):
    u = units(spark)
    p = matching.match_in_tiers(u, "unit_id", "y", [["s", "a", "b"], ["s", "a"], ["s"]], "m").toPandas()
    d = u.toPandas()
    assert p.negative_id.is_unique and p.positive_id.is_unique
    assert len(p) == sum(min((g.y == 0).sum(), (g.y == 1).sum()) for _, g in d.groupby("s"))
    side = d.set_index("unit_id")
    assert (side.loc[p.negative_id].y == 0).all() and (side.loc[p.positive_id].y == 1).all()
    assert (side.loc[p.negative_id].s.values == side.loc[p.positive_id].s.values).all()


@pytest.mark.parametrize("most", [0, 1, 2])
def test_partner_counts_equal_brute_force(spark, most):
    u = units(spark)
    spec = matching.MatchSpec(equal=("s",), hamming=("a", "b"), max_hamming=most, numeric="age", caliper=5)
    got = matching.partner_counts(u, "y", spec).toPandas()
    d = u.toPandas()
    for _, x in got.iterrows():
        q = d[(d.y != x.y) & (d.s == x.s) & ((d.age - x.age).abs() <= 5)]
        assert ((q.a != x.a).astype(int) + (q.b != x.b) <= most).sum() == x.n_partner


def test_nearest_partner_equals_brute_force(spark):
    u = units(spark)
    got = matching.nearest_partner(u, "y", matching.MatchSpec(equal=("s",), hamming=("a", "b"), numeric="age"), 10.0).toPandas()
    d = u.toPandas()
    for _, x in got.iterrows():
        q = d[(d.y != x.y) & (d.s == x.s)]
        total = (q.age - x.age).abs() / 10 + (q.a != x.a).astype(int) + (q.b != x.b)
        assert np.isclose(total.min(), x.nearest_total) if len(q) else np.isnan(x.nearest_total)


def objective(w):
    a, b = w.neg_age.to_numpy(float), w.pos_age.to_numpy(float)
    worst = abs(a.mean() - b.mean()) / np.sqrt((a.var(ddof=1) + b.var(ddof=1)) / 2) / 0.12
    for level in set(w.neg_a) | set(w.pos_a):
        pa, pb = (w.neg_a == level).mean(), (w.pos_a == level).mean()
        scale = np.sqrt((pa * (1 - pa) + pb * (1 - pb)) / 2)
        worst = max(worst, abs(pa - pb) / scale / 0.12 if scale else 0.0, abs(pa - pb) / 0.08)
    return worst


def test_greedy_trimming_equals_brute_force(spark):
    u = units(spark, 80)
    pairs = matching.match_in_tiers(u, "unit_id", "y", [["s"]], "m")
    wide = balance.pair_values(pairs, u, "unit_id", ["age", "a"])
    w = wide.toPandas()
    values = balance.removal_objectives(wide, ["age"], ["a"]).toPandas().set_index("pair_id").objective_without
    for i in w.index:
        assert np.isclose(objective(w.drop(i)), values[w.pair_id[i]])
    left = w
    while len(left) > len(w) - 3:
        best = min(left.index, key=lambda i: (objective(left.drop(i)), left.pair_id[i]))
        left = left.drop(best)
    got = balance.trim_pairs(wide, ["age"], ["a"], len(w) - 3, to_minimum=True)
    assert {r["pair_id"] for r in got.collect()} == set(left.pair_id)


def test_smd_fixed_cases(spark):
    d = frame(spark, y=[0, 0, 1, 1], x=[1.0, 3.0, 2.0, 4.0], k=[5.0, 5.0, 5.0, 5.0], j=[1.0, 1.0, 2.0, 2.0])
    got = {r["field"]: r["smd"] for r in balance.continuous_smd(d, "y", ["x", "k", "j"]).collect()}
    assert np.isclose(got["x"], -1 / np.sqrt(2)) and got["k"] == 0.0 and got["j"] == float("inf")


def test_agreement_totals_equal_brute_force_with_missing_values(spark):
    u = units(spark, 60).withColumns(
        {"batch": F.col("unit_id") % 2, "a": F.when(F.col("unit_id") % 5 > 0, F.col("a")), "b": F.when(F.col("unit_id") % 7 > 0, F.col("b"))}
    ).withColumn("s", F.when(F.col("unit_id") % 35 > 0, F.col("s")))
    fields = ["a", "b", "s"]
    d = u.select("batch", *fields).toPandas().astype(object)
    d = d.where(d.notna(), None)
    for r in matching.agreement_targets(u, "batch", fields).collect():
        exact = soft = sharp = 0.0
        rows = d[d.batch == r["batch"]][fields].to_dict("records")
        own = {f: r[f] for f in fields}
        seen_self = False
        for o in rows:
            both = [f for f in fields if own[f] is not None and o[f] is not None]
            v = sum(own[f] == o[f] for f in both) / len(both) if both else 0.0
            w = [float(v >= 1 - 1e-6), v, v**4 if v >= 0.75 else 0.0]
            if o == own and not seen_self:
                w, seen_self = [max(x, 1.0) for x in w], True
            exact, soft, sharp = exact + w[0], soft + w[1], sharp + w[2]
        assert np.allclose([exact, soft, sharp], [r["exact_total"], r["soft_total"], r["sharp_total"]])


# ---- metrics and bootstrap ----


def test_auroc_ties_weights_and_one_class(spark):
    d = frame(spark, c=["a"] * 4 + ["b"] * 2, y=[0, 0, 1, 1, 1, 1], s=[0.1, 0.4, 0.4, 0.9, 0.2, 0.3], w=[1, 2, 1, 1, 1, 1])
    got = {r["c"]: r["auroc"] for r in metrics.auroc(d, ["c"], "s", "y").collect()}
    assert np.isclose(got["a"], 3.5 / 4) and got["b"] is None
    assert np.isclose(metrics.auroc(d, ["c"], "s", "y", "w").where("c = 'a'").first()["auroc"], 5 / 6)


def test_pair_clusters_need_two_rows(spark):
    good = frame(spark, p=[1, 1, 2, 2], arm=["x"] * 4)
    assert bootstrap.require_pair_clusters(good, "p", ["arm"]) is good
    with pytest.raises(ContractError):
        bootstrap.require_pair_clusters(good.limit(3), "p", ["arm"])


def test_multinomial_draws_have_exact_totals_and_repeat(spark):
    u = units(spark, 50)
    a = bootstrap.draws(u, "unit_id", 20, "d").toPandas()
    assert (a.groupby("rep").times.sum() == 50).all() and a.rep.nunique() == 20
    b = bootstrap.draws(u.repartition(7), "unit_id", 20, "d").toPandas()
    key = ["rep", "unit_id"]
    assert a.sort_values(key).reset_index(drop=True).equals(b.sort_values(key).reset_index(drop=True))
    po = bootstrap.draws(u, "unit_id", 200, "d", scheme="poisson").toPandas()
    assert abs(po.times.sum() / (50 * 200) - 1) < 0.05


def test_one_class_replicates_are_discarded_and_counted(spark):
    d = frame(spark, arm=["x"] * 3, unit=[1, 2, 3], y=[1, 1, 0], z=[2.0, 1.0, 0.0], p=[0.9, 0.8, 0.1])
    v = bootstrap.replicate_metric(d, ["arm"], "unit", "auroc", "y", "z", "p", 40, "o")
    i = bootstrap.interval(v, ["arm"], reps=40).first()
    draws = bootstrap.draws(d, "unit", 40, "o").toPandas().pivot_table(index="rep", columns="unit", values="times", fill_value=0)
    bad = ((draws[3] == 0) | (draws[1] + draws[2] == 0)).sum()
    assert i["n_discarded"] == bad and i["n_valid"] == 40 - bad


def test_logistic_cells_equal_plain_newton(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=300)
    y = (rng.random(300) < 1 / (1 + np.exp(-(0.3 + 0.8 * x)))).astype(int)
    d = frame(spark, c=["k"] * 300, x=x, y=y)
    for l2 in (0.0, 1.0):
        beta = np.array([0.0, 0.0])
        m = np.column_stack([np.ones(300), x])
        for _ in range(50):
            p = 1 / (1 + np.exp(-m @ beta))
            beta -= np.linalg.solve((m.T * (p * (1 - p))) @ m + np.diag([0, l2]), m.T @ (p - y) + np.array([0, l2 * beta[1]]))
        got = calibrate.fit_cells(d, ["c"], "x", "y", l2=l2).first()
        assert np.allclose([got["intercept"], got["slope"]], beta, atol=1e-7)


def test_monotone_fit_moves_to_the_boundary(spark):
    d = frame(spark, c=["k"] * 6, x=[3.0, 2.0, 1.0, 0.0, -1.0, 0.5], y=[0, 0, 1, 1, 1, 0])
    got = calibrate.monotone_fit(d, ["c"], "x", "y").first()
    assert got["boundary_fit"] and got["slope"] == 1e-12 and abs(got["intercept"]) < 1e-9
    moved = calibrate.apply_fit(d, calibrate.monotone_fit(d, ["c"], "x", "y"), ["c"], "x", "p")
    assert calibrate.transport_audit(moved, ["c"], "x", "p").first()["order_reversals"] == 0


def test_region_choice_ties_count_half(spark):
    d = frame(spark, clip=[1, 1, 2, 2], cell=[0, 1, 0, 1], s=[0.5, 0.5, 0.9, 0.1], q=[True, False, True, False], d=[False, True, False, True], v=[True] * 4)
    got = {r["clip"]: (r["win"], r["hit"]) for r in metrics.region_choice(d, "clip", "s", "q", "d", "v", "cell").collect()}
    assert got == {1: (0.5, 1.0), 2: (1.0, 1.0)}


# ---- retrieval and readouts ----


def test_identity_bank_has_mrr_one_in_both_paths(spark):
    eye = [list(map(float, r)) for r in np.eye(5)]
    d = frame(spark, k=range(5), v=eye)
    for limit in (0, 1 << 20):
        ranks = retrieval.cosine_ranks(d, d.select(F.col("k").alias("b"), F.col("v").alias("bv")), "k", "v", "k", "b", "bv", broadcast_bytes=limit)
        assert retrieval.retrieval_metrics(ranks, ["condition"]).first()["micro_mrr"] == 1.0


def test_ties_prefer_smaller_ids_or_average(spark):
    bank = frame(spark, b=[1, 2, 3], bv=[[1.0, 0.0]] * 3)
    q = frame(spark, k=[10, 11], g=[1, 3], v=[[1.0, 0.0]] * 2)
    got = {r["k"]: (r["rank"], r["average_rank"]) for r in retrieval.cosine_ranks(q, bank, "k", "v", "g", "b", "bv").collect()}
    assert got == {10: (1, 2.0), 11: (3, 2.0)}


def test_effective_rank_and_cka_equal_numpy(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(200, 6)) * np.arange(1, 7)
    y = x[:, :3] + rng.normal(size=(200, 3))
    d = spark.createDataFrame(pd.DataFrame({"x": list(map(list, x)), "y": list(map(list, y))}))
    s = np.linalg.svd(x - x.mean(0), compute_uv=False)
    p = s / s.sum()
    assert np.isclose(retrieval.effective_rank(d, "x").first()["effective_rank"], np.exp(-(p * np.log(p)).sum()))
    a, b = x - x.mean(0), y - y.mean(0)
    want = np.linalg.norm(a.T @ b) ** 2 / (np.linalg.norm(a.T @ a) * np.linalg.norm(b.T @ b))
    assert np.isclose(retrieval.linear_cka(d, "x", "y").first()["cka"], want)


def test_head_equals_plain_newton_and_eraser_is_orthogonal(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(200, 3))
    y = (x[:, 0] + rng.normal(size=200) > 0).astype(int)
    d = spark.createDataFrame(pd.DataFrame({"x": list(map(list, x)), "y": y}))
    d = heads.assemble_features(d, [F.col("x")])
    model = heads.fit_head(d, "features", "y", 0.5, 200)
    m, beta = np.column_stack([np.ones(200), x]), np.zeros(4)
    pen = np.diag([0, 2.0, 2.0, 2.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-m @ beta))
        beta -= np.linalg.solve((m.T * (p * (1 - p))) @ m + pen, m.T @ (p - y) + pen @ beta)
    assert np.allclose([model.intercept, *model.coefficients.toArray()], beta, atol=2e-3)
    basis = heads.nuisance_basis(d, "features", ["y"])
    erased = np.array([r["erased"] for r in heads.erase(d, "features", basis).select("erased").collect()])
    assert np.abs(erased @ basis.T).max() < 1e-9


def test_one_se_takes_the_simplest_setting_in_the_band(spark):
    d = frame(spark, c=[0.1, 0.1, 1.0, 1.0, 10.0, 10.0], fold=[0, 1] * 3, auroc=[0.70, 0.74, 0.70, 0.76, 0.50, 0.60])
    assert heads.one_se_choice(d).where("chosen").first()["c"] == 0.1


# ---- cleaning ----


def test_missing_is_not_negative(spark):
    d = frame(spark, u=["a", "a", "b", "c", "d"], c=["", "dry cough", "fever", "PNTS", None])
    got = {r["u"]: r["state"] for r in validate.multiselect_state(d, "u", "c", ["drycough"]).collect()}
    assert got == {"a": "YES", "b": "NO", "c": None, "d": None}
    box = frame(spark, x=["", "yes"]).select(fn.checkbox_union([F.col("x")], ["yes"]).alias("b"))
    assert [r["b"] for r in box.collect()] == ["NO", "YES"]


def test_localised_multiselect_keys(spark):
    d = frame(spark, u=["a"], c=["[{key: 'shortBreath', label: 'cough'}]"])
    assert validate.multiselect_state(d, "u", "c", ["shortbreath"]).first()["state"] == "YES"
    assert validate.multiselect_state(d, "u", "c", ["cough"]).first()["state"] == "NO"


@pytest.mark.parametrize(
    "raw, want",
    [("30-29", "20-29x"), ("30-39", "30-39"), ("16-19", "00-19"), ("90", "90+"), ("47", "40-49"), ("prefer not to say", "[MISSING]"), ("121", None), ("old", None)],
)
def test_age_bands(spark, raw, want):
    got = frame(spark, a=[raw]).select(fn.age_band(F.col("a")).alias("b")).first()["b"]
    assert got == ("30-39" if want == "20-29x" else want)


def test_first_reason_wins(spark):
    d = frame(spark, x=[None, "1", "5"])
    rules = [("blank", F.col("x").isNull()), ("small", F.col("x") < "3"), ("never", F.lit(False))]
    got = {r["reason"]: r["n"] for r in validate.exclusion_counts(validate.waterfall(d, rules)).collect()}
    assert got == {"blank": 1, "small": 1, "kept": 1}


def test_contracts_fail_when_violated(spark):
    d = frame(spark, k=[1, 1, 2], v=["a", "b", "zzz"])
    with pytest.raises(ContractError):
        joins.validated_join(d, d, ["k"], "many_to_one")
    with pytest.raises(ContractError):
        validate.map_strict(d, "v", {"a": "A", "b": "B"}, "m")
    with pytest.raises(ContractError):
        validate.columns_with_prefix(d, "v", forbidden=["v"])
    with pytest.raises(ContractError):
        gates.require_zero(gates.overlap_guard(d, {"g": (F.col("k") == 1, F.col("v") == "a")}))
    with pytest.raises(ContractError):
        encode.require_recorded(d.withColumn("t", F.lit("[A=1]")), "t", "B", "b")


def test_duplicate_flag_fixture(spark):
    d = frame(spark, rec=[1, 2, 3, 4], who=["a", "a", "b", "b"], raw=["r1", "r2", "r1", "r3"], pcm=["p1", "p2", "p3", "p2"])
    p = profile.duplicate_flags(d, ["raw", "pcm"], "who").toPandas().sort_values("rec")
    assert list(p.raw_elsewhere) == [True, False, True, False] and list(p.pcm_elsewhere) == [False, True, False, True]


def test_unseen_levels_are_explicit(spark):
    d = frame(spark, u=[1, 2, 3], c=["a", "b", None], tr=[True, False, False])
    arr, names = encode.one_hot_array(d, ["c"], F.col("tr"), "x")
    assert names == ["c=a", "c=UNSEEN"]
    assert [r["x"] for r in arr.orderBy("u").collect()] == [[1.0, 0.0], [0.0, 1.0], [0.0, 1.0]]


def test_window_plan_covers_the_recording(spark):
    d = frame(spark, k=[1, 2, 3], n=[50, 100, 250])
    p = sampling.window_plan(d, "n", 100).toPandas()
    assert {k: list(g.sort_values("window").start) for k, g in p.groupby("k")} == {1: [0], 2: [0], 3: [0, 75, 150]}


def test_three_significant_digits(spark):
    d = frame(spark, x=[0.0, 0.25, 12.5, 3.0, 150.4, 0.01234, 99.96])
    got = [r["t"] for r in d.select(encode.three_digits(F.col("x")).alias("t")).collect()]
    assert got == [f"{v:.3g}" for v in (0.0, 0.25, 12.5, 3.0, 150.4, 0.01234, 99.96)]


def test_trim_query_stops_at_balance_or_half_of_the_pairs(spark, monkeypatch):
    from tessera.bindings import all_queries

    seen = []
    trim = balance.trim_pairs

    def watched(wide, continuous, categorical, minimum, **options):
        seen.append((wide.count(), minimum, options.get("to_minimum", False)))
        return trim(wide, continuous, categorical, minimum, **options)

    monkeypatch.setattr(balance, "trim_pairs", watched)
    left = all_queries()["a18_trim_to_balance"](spark, "/root/testdata/sf0.001").count()
    ((n, minimum, to_minimum),) = seen
    assert (minimum, to_minimum) == (n // 2, False)
    assert n // 2 <= left <= n
