"""Missing values are told from valid ones."""

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tessera import functions as fn
from tessera.operators import gates, joins, matching, metrics, retrieval, splits
from tessera.plans import cohort


def test_age_band_of_null_is_missing(spark):
    df = spark.createDataFrame([(None,), ("",), ("30-29",), ("42",)], "raw string")
    assert [r[0] for r in df.select(fn.age_band(F.col("raw"))).collect()] == ["[MISSING]", "[MISSING]", "30-39", "40-49"]


@pytest.mark.parametrize("bad", [None, float("nan")])
def test_scores_that_are_no_numbers_are_refused(spark, bad):
    df = spark.createDataFrame([("a", 0.2, 0), ("a", 0.9, 1), ("a", bad, 1)], "cell string, score double, y int")
    with pytest.raises(PySparkException, match="NULL or NaN"):
        metrics.auroc(df, ["cell"], "score", "y").collect()


def test_a_pair_member_without_split_breaks_the_contract(spark):
    units = spark.createDataFrame([(1, 0, "target"), (2, 1, None)], "unit_id long, y int, split string")
    pairs = spark.createDataFrame([(1, 1, 2)], "pair_id long, negative_id long, positive_id long")
    got = joins.key_contract(units, pairs, "unit_id", "y", "split", "target").collect()
    assert {r["check"]: r["n_violations"] for r in got}["member_outside_target"] == 1


def bank(spark, rows):
    return spark.createDataFrame(rows, "id long, v array<double>")


def ranks(spark, queries, rows):
    asks = spark.createDataFrame(queries, "q long, gold long, v array<double>")
    return retrieval.cosine_ranks(asks, bank(spark, rows), "q", "v", "gold", "id", "v").collect()


GOOD = [(1, [1.0, 0.0]), (2, [0.0, 1.0])]


@pytest.mark.parametrize(
    ("queries", "rows"),
    [
        ([(1, 9, [1.0, 0.0])], GOOD),
        ([(1, 1, [1.0, 0.0]), (1, 1, [1.0, 0.0])], GOOD),
        ([(1, 1, [1.0, 0.0])], [*GOOD, (2, [0.5, 0.5])]),
        ([(1, 1, [1.0, 0.0])], [*GOOD, (3, [0.0, 0.0])]),
        ([(1, 1, [float("nan"), 0.0])], GOOD),
        ([(1, 1, None)], GOOD),
    ],
)
def test_ranks_refuse_lost_golds_repeated_ids_and_vectors_without_direction(spark, queries, rows):
    with pytest.raises(joins.ContractError):
        ranks(spark, queries, rows)


def test_ranks_of_sound_input(spark):
    assert [r["rank"] for r in ranks(spark, [(1, 1, [1.0, 0.1])], GOOD)] == [1]


def test_keys_of_different_types_and_null_keys_meet(spark):
    a = spark.createDataFrame([(1, "x"), (None, "y"), (3, "z")], "k int, a string")
    b = spark.createDataFrame([(1.0, "p"), (None, "q")], "k double, b string")
    got = joins.same_key_join(a, b, ["k"], "left")
    assert got.columns == ["k", "a", "b"]
    assert sorted((r["a"], r["b"]) for r in got.collect()) == [("x", "p"), ("y", "q"), ("z", None)]


def test_runs_without_losses_or_hashes_do_not_pass(spark):
    schema = "arm string, seed int, init_hash string, order_hash string, first_loss double, last_loss double, n_steps int"
    rows = [("a", 1, None, "o", 2.0, 1.0, 5), ("b", 1, "i", "o", None, 1.0, 5), ("a", 2, "i", None, 2.0, float("nan"), None), ("b", 2, "i", "o", float("inf"), 1.0, 5)]
    got = {r["check"]: r["n_violations"] for r in gates.run_manifest_audit(spark.createDataFrame(rows, schema), ["a", "b"], [1, 2], 5).collect()}
    assert got == {"run_missing": 0, "run_unexpected": 0, "run_repeated": 0, "init_differs_between_arms": 1, "order_differs_between_arms": 1, "schedule_differs": 1, "loss_not_decreased": 3}


def test_primary_folds_need_both_classes(spark):
    one = spark.createDataFrame([(i, 1) for i in range(20)], "u long, y int")
    assert {r["fold"] for r in splits.stratified_folds(one, "u", "y", None, 5, "f").collect()} == {-1}
    with pytest.raises(joins.ContractError):
        splits.stratified_folds(one, "u", "y", None, 5, "f", required=True)


def test_values_that_are_not_finite_match_nothing(spark):
    rows = [(1, 0, float("nan")), (2, 1, float("nan")), (3, 0, float("inf")), (4, 1, float("inf")), (5, 0, 30.0), (6, 1, 31.0), (7, 1, None)]
    units = spark.createDataFrame(rows, "u long, y int, age double")
    spec = matching.MatchSpec(equal=[], hamming=[], max_hamming=0, numeric="age", caliper=2.0)
    got = {r["u"]: r["n_partner"] for r in matching.partner_counts(units, "y", spec).collect()}
    assert got == {1: 0, 2: 0, 3: 0, 4: 0, 5: 1, 6: 1, 7: 0}


def test_match_first_trims_the_target_to_size(spark):
    units = spark.createDataFrame([(i, i % 2, "f" if i < 16 else "m", 30.0 + i) for i in range(28)], "u long, y int, sex string, age double")
    run = lambda n: {
        r["split"]: (r["n"], r["n_pairs"])
        for r in cohort.match_first(units, "u", "y", ["y"], [["sex"]], "s", [("train", 0.5)], "test", n, ["age"], ["sex"]).collect()
    }
    got = run(10)
    assert got["matched_target"] == (20, 10) and sum(n for n, _ in got.values()) == 28
    with pytest.raises(joins.ContractError):
        run(15)
