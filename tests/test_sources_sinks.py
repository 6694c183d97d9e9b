"""Readers, waveform jobs, sinks and the incremental job on real files."""

import wave

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessera.operators.joins import ContractError
from tessera.sinks import tables as sinks
from tessera.sources import recordings, tables, waveform
from tessera.streaming import ingest


def write_wav(path, samples, rate=16000, width=2):
    path.parent.mkdir(parents=True, exist_ok=True)
    with wave.open(str(path), "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(width)
        w.setframerate(rate)
        w.writeframes(samples)


def tone(n=9600, seed=0):
    return (np.random.default_rng(seed).normal(size=n) * 3000).astype("<i2")


def test_bom_and_separator(spark, tmp_path):
    f = tmp_path / "m.csv"
    f.write_text("﻿Uid;Age\na;30-39\nb;\n", encoding="utf-8")
    df = tables.read_table(spark, str(f))
    assert df.columns == ["Uid", "Age"] and df.count() == 2


def test_unique_reader_rejects_repeats_and_blanks(spark, tmp_path):
    for name, body in (("dup", "k,v\n1,a\n1,b\n"), ("blank", "k,v\n1,a\n ,b\n")):
        f = tmp_path / f"{name}.csv"
        f.write_text(body)
        with pytest.raises(ContractError):
            tables.read_unique(spark, str(f), "k")


def test_ratings_are_strict(spark, tmp_path):
    good, bad = tmp_path / "g.csv", tmp_path / "b.csv"
    good.write_text("FILENAME, QUALITY\nu1_x, 2\nu2_x, 0\n")
    bad.write_text("FILENAME, QUALITY\nu1_x, 3\n")
    assert {tuple(r) for r in tables.read_ratings(spark, str(good), "_x").collect()} == {("u1", 2), ("u2", 0)}
    with pytest.raises(ContractError):
        tables.read_ratings(spark, str(bad), "_x")


def test_discovery_is_limited_to_allowed_units(spark, tmp_path):
    for u in ("u1", "u2", "u3"):
        write_wav(tmp_path / u / "cough.wav", tone().tobytes())
    (tmp_path / "u1" / "notes.txt").write_text("x")
    allowed = spark.createDataFrame(pd.DataFrame({"unit_id": ["u1", "u3"]}))
    assert {r["unit_id"] for r in recordings.discover(spark, str(tmp_path), allowed, "unit_id").collect()} == {"u1", "u3"}


def test_waveform_qc_measures_and_never_drops(spark, tmp_path):
    x = tone()
    write_wav(tmp_path / "ok.wav", x.tobytes())
    write_wav(tmp_path / "copy.wav", x.tobytes())
    write_wav(tmp_path / "zero.wav", np.zeros(9600, "<i2").tobytes())
    write_wav(tmp_path / "short.wav", tone(100).tobytes())
    (tmp_path / "broken.wav").write_bytes(b"RIFF" + b"0" * 100)
    (tmp_path / "empty.wav").write_bytes(b"RIFF")
    q = waveform.waveform_qc(spark, str(tmp_path)).toPandas()
    q["name"] = q.path.str.split("/").str[-1]
    q = q.set_index("name")
    assert len(q) == 6
    assert q.failure["zero.wav"] == "all_zero" and q.failure["short.wav"] == "too_short"
    assert q.failure["empty.wav"] == "empty_or_header_only" and q.failure["broken.wav"].startswith("decode:")
    assert q.qc_pass["ok.wav"] and q.pcm_sha256["ok.wav"] == q.pcm_sha256["copy.wav"]
    assert np.isclose(q.rms["ok.wav"], np.sqrt(np.mean((x / 32768.0) ** 2)), rtol=1e-6) and q.duration_s["ok.wav"] == 0.6


@pytest.mark.parametrize("width", [1, 3, 4])
def test_other_sample_widths(spark, tmp_path, width):
    v = np.array([0, 64, -64, 32] * 4000)
    if width == 1:
        raw = (v + 128).astype(np.uint8).tobytes()
    elif width == 3:
        raw = b"".join(int(k * 65536).to_bytes(3, "little", signed=True) for k in v)
    else:
        raw = (v * 2**24).astype("<i4").tobytes()
    write_wav(tmp_path / "w.wav", raw, width=width)
    row = waveform.waveform_qc(spark, str(tmp_path)).first()
    assert row["peak"] == 0.5 and np.isclose(row["rms"], np.sqrt(np.mean((v / 128) ** 2))) and row["qc_pass"]


def test_incremental_qc_processes_each_file_once(spark, tmp_path):
    root, out, mark = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "mark")
    write_wav(root / "a.wav", tone(seed=1).tobytes())
    assert ingest.stream_waveform_qc(spark, str(root), out, mark).count() == 1
    write_wav(root / "b.wav", tone(seed=2).tobytes())
    assert ingest.stream_waveform_qc(spark, str(root), out, mark).count() == 2
    assert ingest.stream_waveform_qc(spark, str(root), out, mark).count() == 2


def test_no_clobber_and_frozen_predictions(spark, tmp_path):
    d = spark.range(50).withColumn("v", F.col("id") * 2)
    p = str(tmp_path / "t")
    assert sinks.write_if_same(d, p) == "written" and sinks.write_if_same(d.repartition(3), p) == "identical"
    with pytest.raises(ContractError):
        sinks.write_if_same(d.withColumn("v", F.col("id")), p)
    f = str(tmp_path / "f")
    sinks.freeze_predictions(d, f)
    assert sinks.open_frozen(spark, f).count() == 50
    d.limit(1).write.mode("append").parquet(f)
    with pytest.raises(ContractError):
        sinks.open_frozen(spark, f)


def test_public_report_refuses_identifiers(spark, tmp_path):
    d = spark.createDataFrame(pd.DataFrame({"group": ["x", "p7"], "n": [1, 2]}))
    ids = spark.createDataFrame(pd.DataFrame({"unit_id": ["p7", "p8"]}))
    with pytest.raises(ContractError):
        sinks.write_public_report(d, ["group", "n"], str(tmp_path / "r"), ids, "unit_id")
    sinks.write_public_report(d, ["n"], str(tmp_path / "ok"), ids, "unit_id")
