"""Identifiers inside texts, paired matrices, overlap of groups, nearest partners over many fields."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import bootstrap, matching, profile
from tessera.operators.joins import ContractError
from tessera.sinks import tables as sinks


def test_identifiers_inside_texts(spark):
    ids = spark.createDataFrame([("train_1_000",), ("P-7",), ("12",), (None,), ("--",)], "uid string")
    rows = [("kept Train 1 000.", 12, ["a", "p-7 b"], "412"), ("train_1_0001", 12, ["c"], "x12"), (None, 7, None, "n = 12")]
    report = spark.createDataFrame(rows, "note string, n long, names array<string>, code string")
    got = {r["column"]: r["n_cells"] for r in sinks.identifier_leaks(report, ids, "uid").collect()}
    assert got == {"note": 1, "names": 1, "code": 1}  # the count 12 is an aggregate, 412 and x12 are other words
    assert sinks.identifier_leaks(report.select("n"), ids, "uid").count() == 0
    assert sinks.identifier_leaks(report, ids.where("uid = '--'"), "uid").count() == 0


def test_report_with_an_identifier_is_refused(spark, tmp_path):
    ids = spark.createDataFrame([("train_1_000",)], "uid string")
    report = spark.createDataFrame([("GO", "first: train_1_000", 3)], "verdict string, note string, n int")
    with pytest.raises(ContractError):
        sinks.write_public_report(report, ["verdict", "note", "n"], str(tmp_path / "a"), ids, "uid")
    sinks.write_public_report(report, ["verdict", "n"], str(tmp_path / "b"), ids, "uid")
    assert spark.read.json(str(tmp_path / "b")).columns == ["n", "verdict"]


def test_arms_must_cover_the_same_cells(spark):
    rows = [(a, s, u, float(s + u)) for a in "ab" for s in range(3) for u in range(4)]
    run = lambda r: bootstrap.paired_matrix_interval(spark.createDataFrame(r, "arm string, seed int, unit int, v double"), "arm", "a", "b", "seed", "unit", "v", 20, "s")
    one = run([(a, s, u, v + (a == "a") * (s - 1)) for a, s, u, v in rows]).first()
    assert (one["observed"], one["n_positive"], one["n_negative"], one["n_zero"], one["n_units"]) == (0.0, 1, 1, 1, 4)
    for broken in (rows[1:], rows + rows[:1], rows[:-1] + [("b", 2, 3, None)]):
        with pytest.raises(ContractError):
            run(broken)


def test_overlap_of_groups(spark):
    rng = random.Random(4)
    rows = [(i, rng.choice(["x", "y", "z", None])) for i in range(40) for _ in range(3)] + [(None, "x"), (None, "z")]
    got = {(r["a"], r["b"]): r["n_common"] for r in profile.overlap_matrix(spark.createDataFrame(rows, "item int, g string"), "item", "g").collect()}
    want = {}
    for a, b in itertools.combinations("xyz", 2):
        n = len({i for i, g in rows if g == a} & {i for i, g in rows if g == b})
        want |= {(a, b): n} if n else {}
    assert got == want


def test_nearest_over_many_fields_with_missing_values(spark):
    rng = random.Random(8)
    fields = ["f1", "f2", "f3", "f4", "f5", "f6"]
    rows = [(u, rng.randint(0, 1), rng.choice("st"), rng.choice([1.0, 5.0, 40.0, None]), *[rng.choice(["p", "q", None]) for _ in fields]) for u in range(70)] + [(99, 0, "alone", 1.0, *"pppppp")]
    units = spark.createDataFrame(rows, "u int, y int, s string, age double, " + ", ".join(f"{f} string" for f in fields))
    spec = matching.MatchSpec(equal=("s",), hamming=tuple(fields), numeric="age")
    near = {r["u"]: (r["nearest_total"], r["nearest_hamming"]) for r in matching.nearest_partner(units, "y", spec, 10.0).collect()}
    least = {r["u"]: r["nearest_mismatches"] for r in matching.nearest_mismatches(units, "y", spec).collect()}
    for r in rows:
        others = [q for q in rows if q[1] != r[1] and q[2] == r[2]]
        ham = lambda q: sum(a != b for a, b in zip(q[4:], r[4:]))  # noqa: B023, E731
        assert least[r[0]] == (min(map(ham, others)) if others else None)
        both = [(round(abs(q[3] - r[3]) / 10 + ham(q), 9), ham(q)) for q in others if q[3] is not None and r[3] is not None]
        assert near[r[0]] == (min(both) if both else (None, None))


def test_median_norm_leaves_out_what_has_no_norm(spark):
    d = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],), ([float("nan"), 1.0],), ([6.0, 8.0],)], "v array<double>")
    got = profile.embedding_audit(d, "v").first()
    assert got["median_norm"] == 5.0 and got["n_not_finite"] == 1 and got["n_zero"] == 1
    w = profile.window_histogram(d.select(F.size("v").alias("windows")), "windows").collect()
    assert [(r[0], r["n"]) for r in w] == [(2, 4)]
