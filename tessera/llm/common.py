"""Registry of this subpackage's queries and the few steps its operators share."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.session import ensure_checkpoint_dir

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

#: Stands for a null id inside an operator; ids are 64-bit and this one is refused nowhere, it merely sorts first.
NO_ID = -(1 << 63)


def query(name: str, sql: str | None = None):
    def wrap(fn: Callable[[SparkSession, str], DataFrame]):
        assert name not in QUERIES, name
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return wrap


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def plain(df: DataFrame, id_col: str, text_col: str | None = None) -> DataFrame:
    """Only the columns an operator reads, under names of its own: ``id`` (null as ``NO_ID``) and ``text`` (null as empty)."""
    cols = [F.coalesce(df[id_col].cast("long"), F.lit(NO_ID)).alias("id")]
    if text_col:
        cols.append(F.coalesce(df[text_col], F.lit("")).alias("text"))
    return df.select(*cols)


def given_id(name: str) -> Column:
    """The id as the caller gave it."""
    return F.when(F.col("id") != NO_ID, F.col("id")).alias(name)


def shared_folder(spark: SparkSession) -> str:
    """New folder below ``spark.checkpoint.dir``, which all executors see."""
    return f"{ensure_checkpoint_dir(spark)}/{uuid.uuid4().hex}"


def materialised(df: DataFrame) -> DataFrame:
    """The rows as a reliable checkpoint, computed once. Survives lost executors."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def arrow_schema(ddl: str) -> tuple[T.StructType, pa.Schema]:
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = T.StructType.fromDDL(ddl)
    return schema, to_arrow_schema(schema)


def text_batches(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of about ``size`` bytes of text: their rows, the UTF-8 bytes and the first byte of each text."""
    from tessera.llm.words import slices

    for batch in batches:
        texts = batch.column(batch.schema.get_field_index("text"))
        for a, b, data, row_start in slices(texts, size):
            yield batch.slice(a, b - a), data, row_start


def ids_of(rows: pa.RecordBatch) -> np.ndarray:
    return rows.column(rows.schema.get_field_index("id")).to_numpy(zero_copy_only=False).astype(np.int64)


def list_array(values: np.ndarray, counts: np.ndarray) -> pa.ListArray:
    """``counts[i]`` consecutive values for row i."""
    offsets = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))


def stored(df: DataFrame, **options: str | int) -> DataFrame:
    """The rows as a compressed table in the shared folder, computed once. For tables too large for a plain checkpoint."""
    path = shared_folder(df.sparkSession)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def repeated(df: DataFrame, key: str) -> DataFrame:
    """Rows whose ``key`` occurs in two rows or more. Keys are counted before the shuffle; a hot key's rows may be split."""
    counts = df.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select(key)
    return df.join(counts, key, "left_semi")


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root) for every node of a graph of 64-bit ids: root is the least node reachable.

    Alternates two steps until nothing changes: each node's larger neighbours, then its smaller ones, are
    linked to the least node seen. Both are aggregates and joins, so a node with very many links is never
    gathered in one task, and edges stay at most as many as given. Each round is checkpointed.
    """
    links = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u != v").distinct()
    links, last = materialised(links), None
    while True:
        state = links.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")), F.lit(0))).first()
        if tuple(state) == last:
            return links.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
                links.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
            )
        last = tuple(state)
        both = links.union(links.select("v", "u"))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        links = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = links.groupBy("u").agg(F.min("v").alias("m"))
        joined = links.join(low, "u")
        links = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").union(low.select("u", F.col("m").alias("v")))
        links = materialised(links.distinct())
