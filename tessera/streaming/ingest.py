"""Resumable file jobs. The checkpoint records which files are done; each file is processed once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.joins import coverage_gaps, duplicated_keys
from tessera.sources.waveform import measure_waveforms

_FILE_SCHEMA = "path string, modificationTime timestamp, length long, content binary"


def run_available(stream: DataFrame, out: str, checkpoint: str) -> None:
    """Process everything that is new, then stop; the file sink commits each batch exactly once."""
    query = (
        stream.writeStream.format("parquet")
        .option("path", out)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def stream_waveform_qc(
    spark: SparkSession, root: str, out: str, checkpoint: str, min_seconds: float = 0.5, files_per_batch: int = 1000
) -> DataFrame:
    """QC of the recordings that arrived since the last run; returns all results so far."""
    files = (
        spark.readStream.format("binaryFile")
        .schema(_FILE_SCHEMA)
        .option("pathGlobFilter", "*.wav")
        .option("recursiveFileLookup", "true")
        .option("maxFilesPerTrigger", files_per_batch)
        .load(root)
    )
    run_available(measure_waveforms(files, min_seconds), out, checkpoint)
    return spark.read.parquet(out)


def stream_table(spark: SparkSession, source: str, transform, out: str, checkpoint: str, files_per_batch: int = 100) -> DataFrame:
    """Incremental row-wise transform of a growing Parquet folder."""
    schema = spark.read.parquet(source).schema
    files = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)
    run_available(transform(files), out, checkpoint)
    return spark.read.parquet(out)


def progress(expected: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Exactly-once record: how many keys are done, open, unexpected or repeated."""
    gaps = coverage_gaps(expected, done, [key])
    n = lambda df, name: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("state"), "n")
    return (
        n(done.select(key).distinct(), "done")
        .unionByName(n(gaps.where("gap = 'missing'"), "open"))
        .unionByName(n(gaps.where("gap = 'extra'"), "unexpected"))
        .unionByName(n(duplicated_keys(done, [key]), "repeated"))
    )
