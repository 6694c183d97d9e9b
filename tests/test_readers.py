"""Many small files with different headers, both folder layouts, and the one-pass vocabulary."""

import pytest
from pyspark.sql import functions as F

from tessera.operators import encode, quantiles
from tessera.operators.joins import ContractError
from tessera.sources import recordings, tables

ALIASES = {"uid": ["uid", "user_id"], "age": ["age", "age band"], "sex": ["sex"]}


def test_files_with_different_headers(spark, tmp_path):
    for k in range(300):
        folder = tmp_path / ("android", "ios", "web")[k % 3] / str(k % 7)
        folder.mkdir(parents=True, exist_ok=True)
        head, row = [("Uid;Age;Note", f'u{k};30;"a;b"'), ("USER_ID,sex", f'u{k},"f, x"'), ("﻿uid,Age Band,extra,uid", f"u{k},40-49,e,other"), ("name,age", "n,1")][k % 4]
        (folder / f"m{k}.csv").write_text(f"{head}\n{row}\n" + ("" if k % 2 else f"{head}\n"), encoding="utf-8")
    (tmp_path / "web" / "empty.csv").write_text("")
    (tmp_path / "web" / "other.txt").write_text("uid\nx\n")
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("reader", "reader")
    merged, skipped = tables.read_many(spark, str(tmp_path), "*.csv", ALIASES, "uid")
    jobs = len(tracker.getJobIdsForGroup("reader"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert jobs < 10  # not one for each file
    got = {r["uid"]: (r["age"], r["sex"], r["platform"]) for r in merged.collect()}
    assert skipped == 75 and len(got) == 225
    for k in range(300):
        want = [("30", None), (None, "f, x"), ("40-49", None)][k % 4] if k % 4 < 3 else None
        if want:
            assert got[f"u{k}"][:2] == want
    assert "unionAll" not in merged._jdf.queryExecution().toString() and merged._jdf.queryExecution().optimizedPlan().toString().count("Relation [") == 1


def test_no_file_with_the_key(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x,y\n1,2\n")
    with pytest.raises(ContractError):
        tables.read_many(spark, str(tmp_path), "*.csv", ALIASES, "uid")


def test_both_layouts_and_modalities(spark, tmp_path):
    names = [
        "u1/2020/x_cough.wav", "u1/2020/05/deep_Cough.FLAC", "u1/2020/breath.wav", "u1/2020/._cough.wav", "u1/2020/cough.txt",
        "form-app-users/u2/cough.ogg", "form-app-users/u2/a/b/cough.mp3", "form-app-users/cough.wav", "u3/cough.wav", "cough.wav",
    ]
    for n in names:
        (tmp_path / n).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / n).write_bytes(b"x")
    allowed = spark.createDataFrame([("u1",), ("u2",), ("u2",)], "unit string")
    found = lambda **k: sorted((r["unit"], r["path"].split(tmp_path.name + "/")[1], r["modality"]) for r in recordings.discover(spark, str(tmp_path), allowed, "unit", **k).collect())
    assert found() == [("u1", names[1], "cough"), ("u1", names[0], "cough"), ("u2", names[6], "cough"), ("u2", names[5], "cough")]
    assert found(modalities=("breath",)) == [("u1", names[2], "breath")]
    manifest = spark.createDataFrame([("u1", "a.wav", "COUGH"), ("u1", "/abs/b.wav", "cough"), ("u2", "c.wav", "voice"), ("u3", "d.wav", "cough"), ("u1", "a.wav", "cough")], "unit string, path string, modality string")
    got = sorted(r["path"] for r in recordings.discover(spark, "/root/audio/", allowed, "unit", manifest).collect())
    assert got == ["/abs/b.wav", "/root/audio/a.wav"]
    assert recordings.discover(spark, "", allowed, "unit", manifest.drop("modality")).count() == 3


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1].count("Exchange")


def test_vocabulary_in_one_pass(spark, monkeypatch):
    rows = [(u, "lang", ["en", "de", None][u % 3], u % 3 == 2) for u in range(90)] + [(u, "n", str(u % 40), False) for u in range(90)] + [(u, "mixed", "7" if u % 2 else "x", False) for u in range(90)]
    rows = spark.createDataFrame(rows, "u int, field string, value string, missing boolean")
    train = spark.createDataFrame([(u,) for u in range(60)] * 2, "u int")
    one = encode.encoded_nodes(rows, "u", train, "s")
    assert exchanges(one) <= 6
    got = {(r["u"], r["field"]): (r["value_id"], r["missing"]) for r in one.collect()}
    assert len(got) == 270 and all((v == 0) == (f == "lang" and u % 3 == 2) for (u, f), (v, _) in got.items())
    monkeypatch.setattr(encode, "VOCABULARY_BYTES", 0)
    assert got == {(r["u"], r["field"]): (r["value_id"], r["missing"]) for r in encode.encoded_nodes(rows, "u", train, "s").collect()}
    values = sorted(u % 40 for u in range(60))
    edges = [values[0] * 0 + q for q in [r["quantile"] for r in quantiles.exact_quantile(spark.createDataFrame([(float(v),) for v in values], "v double"), "v", [i / 10 for i in range(1, 10)]).orderBy("probability").collect()]]
    bins = {}
    for (u, f), (v, _) in got.items():
        if f == "n":
            bins.setdefault(sum(e < u % 40 for e in edges), set()).add(v)
    assert all(len(ids) == 1 for ids in bins.values()) and len(bins) == 10


def test_counted_quantiles(spark):
    d = spark.createDataFrame([("a", 1.0, 3), ("a", 2.0, 1), ("b", 5.0, 2)], "k string, v double, n int")
    long = d.withColumn("i", F.explode(F.sequence(F.lit(1), F.col("n"))))
    p = [0.0, 0.3, 0.5, 0.9, 1.0]
    assert sorted(map(tuple, quantiles.exact_quantile(d, "v", p, ["k"], "n").collect())) == sorted(map(tuple, quantiles.exact_quantile(long, "v", p, ["k"]).collect()))
