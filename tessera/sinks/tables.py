"""Row-level manifests, public reports, content digests and frozen predictions."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.operators.joins import ContractError
from tessera.session import cut_lineage

_PARTS = 4
_HEX = 12


def content_digest(df: DataFrame) -> DataFrame:
    """One row ``(n_rows, digest)`` that depends on the multiset of rows, not on order or partitioning.

    Each row is hashed; four 48-bit pieces of the hashes are summed exactly as decimals, and the
    sums with the row count are hashed again.
    """
    cols = sorted(df.columns)
    row = F.sha2(F.to_json(F.struct(*cols), {"ignoreNullFields": "false"}), 256)
    piece = lambda i: F.conv(F.substring(F.col("h"), 1 + _HEX * i, _HEX), 16, 10).cast("decimal(38,0)")
    sums = df.select(row.alias("h")).agg(
        F.count(F.lit(1)).alias("n_rows"), *[F.coalesce(F.sum(piece(i)), F.lit(0)).alias(f"s{i}") for i in range(_PARTS)]
    )
    joined = F.concat_ws("|", F.col("n_rows").cast("string"), *[F.col(f"s{i}").cast("string") for i in range(_PARTS)])
    return sums.select("n_rows", F.sha2(joined, 256).alias("digest"))


def digest_value(df: DataFrame) -> str:
    return content_digest(df).first()["digest"]


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def write_manifest(df: DataFrame, path: str, fmt: str = "parquet", order: Sequence[str] = ()) -> None:
    """Private row-level table; never overwrites. The job commit makes it all or nothing."""
    out = df.orderBy(*order) if order else df
    writer = out.write.mode("errorifexists")
    writer.option("header", "true").csv(path) if fmt == "csv" else writer.format(fmt).save(path)


def write_if_same(df: DataFrame, path: str) -> str:
    """Write once; a second run must produce the same rows. Returns ``written`` or ``identical``."""
    spark = df.sparkSession
    if not _exists(spark, path):
        write_manifest(df, path)
        return "written"
    held = spark.read.parquet(path)
    if sorted(held.columns) != sorted(df.columns) or digest_value(held) != digest_value(df):
        raise ContractError(f"{path} holds different content")
    return "identical"


def _text_columns(df: DataFrame) -> list[str]:
    """Columns that can hold an identifier: everything that is not a number, a date, a flag or bytes."""
    plain = (T.NumericType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType, T.BinaryType)
    return [f.name for f in df.schema if not isinstance(f.dataType, plain)]


def _tokens(text: Column) -> Column:
    """Maximal runs of letters and digits, in lower case."""
    return F.filter(F.split(F.lower(text), "[^\\p{L}\\p{N}]+"), lambda w: w != "")


def identifier_leaks(report: DataFrame, ids: DataFrame, unit: str) -> DataFrame:
    """Per column, the cells of the report that contain an identifier, alone or inside a longer text.

    Texts and identifiers are cut into tokens; an identifier of g tokens is looked for among the g-token runs of the
    texts, by an equi-join, for each length that identifiers have. Columns of numbers are aggregates and are not searched;
    nested columns are searched as JSON. Case and the characters between tokens do not matter.
    """
    columns = _text_columns(report)
    if not columns:
        return report.sparkSession.createDataFrame([], "column string, n_cells long")
    shown = [F.col(c) if dict(report.dtypes)[c] == "string" else F.to_json(F.struct(c)) for c in columns]
    text = report.select(F.monotonically_increasing_id().alias("__row"), *[x.alias(c) for x, c in zip(shown, columns, strict=True)])
    cells = cut_lineage(text.unpivot(["__row"], columns, "column", "value").select("__row", "column", _tokens(F.col("value")).alias("w")))
    wanted = cut_lineage(ids.select(_tokens(F.col(unit).cast("string")).alias("w")).where(F.size("w") > 0).select(F.size("w").alias("g"), F.concat_ws(" ", "w").alias("run")).distinct())
    lengths = [r["g"] for r in wanted.select("g").distinct().collect()]  # token counts of identifiers: a handful
    starts = F.explode(F.filter(F.array(*[F.lit(g) for g in lengths]), lambda g: g <= F.size("w"))) if lengths else None
    if starts is None:
        return report.sparkSession.createDataFrame([], "column string, n_cells long")
    runs = cells.select("__row", "column", "w", starts.alias("g")).select(
        "__row", "column", "g", F.explode(F.transform(F.sequence(F.lit(1), F.size("w") - F.col("g") + 1), lambda i: F.concat_ws(" ", F.slice("w", i, F.col("g"))))).alias("run")
    )
    hits = runs.distinct().join(wanted, ["g", "run"], "left_semi").select("__row", "column").distinct()
    return hits.groupBy("column").agg(F.count(F.lit(1)).alias("n_cells"))


def write_public_report(df: DataFrame, allowed: Sequence[str], path: str, ids: DataFrame, unit: str) -> None:
    """JSON report of allow-listed columns; refused when a text in it contains an identifier."""
    shown = df.select(*[c for c in allowed if c in df.columns])
    if identifier_leaks(shown, ids, unit).limit(1).count():
        raise ContractError("the report would publish an identifier")
    shown.write.mode("errorifexists").json(path)


def freeze_predictions(df: DataFrame, path: str) -> str:
    """First phase: write predictions, read them back, and store their digest beside them."""
    spark = df.sparkSession
    write_manifest(df, path)
    digest = digest_value(spark.read.parquet(path))
    note = spark.range(1).select(F.lit(json.dumps({"digest": digest})).alias("value"))
    note.coalesce(1).write.mode("errorifexists").text(f"{path}.digest")
    return digest


def open_frozen(spark: SparkSession, path: str) -> DataFrame:
    """Second phase: metrics may only read predictions whose digest still holds."""
    stored = json.loads(spark.read.text(f"{path}.digest").first()[0])["digest"]
    df = spark.read.parquet(path)
    if digest_value(df) != stored:
        raise ContractError(f"{path} changed after it was frozen")
    return df
