"""Registry, derived study tables on the driver tables, and the SQL text of the same tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import hash_unit, salted_sha, sigmoid
from tessera.session import ensure_checkpoint_dir

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

#: Study units of one task where a unit becomes many rows.
UNITS_A_TASK = 20_000


class Tables:
    """Lazy access to the driver tables and to study tables derived from them."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __call__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def scratch(self) -> str:
        """New folder in the shared checkpoint location."""
        return f"{ensure_checkpoint_dir(self.spark)}/{uuid.uuid4().hex}"

    def units(self) -> DataFrame:
        """Labelled documents as study units."""
        return self("documents").join(self("labels"), "doc_id").select(
            F.col("doc_id").alias("unit_id"), F.col("quality").alias("y"), "toxic", "lang", "source", "n_chars", "text"
        )

    def customers(self) -> DataFrame:
        """Customers as study units; a negative balance is the positive label."""
        return self("customer").select(
            F.col("c_custkey").alias("unit_id"),
            (F.col("c_acctbal") < 0).cast("int").alias("y"),
            F.col("c_mktsegment").alias("segment"),
            F.col("c_nationkey").alias("nation"),
            F.col("c_acctbal").alias("balance"),
        )

    def predictions(self) -> DataFrame:
        """Prediction cube: hash-noise scores of two arms and three seeds per labelled document.

        Units are dealt over tasks before they become many rows: one task may read all of them, and aggregates per unit
        hold every row of a task.
        """
        arms = F.array(*[F.struct(F.lit(a).alias("arm"), F.lit(s).alias("signal")) for a, s in ARMS.items()])
        tasks = max(1, -(-self("labels").count() // UNITS_A_TASK))
        d = self.units().drop("text").repartition(tasks, "unit_id").withColumn("a", F.explode(arms)).withColumn(
            "seed", F.explode(F.array(*[F.lit(s) for s in SEEDS]))
        )
        noise = hash_unit(salted_sha("pred", F.col("a.arm"), "seed", "unit_id"))
        logit = F.round((2 * F.col("y") - 1) * F.col("a.signal") + 5.0 * (noise - 0.5), 2)
        d = d.withColumns({"arm": F.col("a.arm"), "logit": logit}).drop("a")
        return d.withColumn("prob", sigmoid(F.col("logit")))


ARMS = {"audio": 0.5, "fusion": 1.0}
SEEDS = (0, 1, 2)


def H(expr: str) -> str:
    """SQL of the leading 12 hex digits of SHA-256 as a number."""
    return f"(('0x' || substr(sha256({expr}), 1, 12))::BIGINT)"


def HU(expr: str) -> str:
    """The same as a double in [0, 1)."""
    return f"({H(expr)}::DOUBLE / 281474976710656.0::DOUBLE)"


UNITS = """units AS (SELECT d.doc_id AS unit_id, l.quality AS y, l.toxic, d.lang, d.source, d.n_chars, d.text
  FROM documents d JOIN labels l ON d.doc_id = l.doc_id)"""
CUST = """cust AS (SELECT c_custkey AS unit_id, (c_acctbal < 0)::INT AS y, c_mktsegment AS segment,
  c_nationkey AS nation, c_acctbal AS balance FROM customer)"""
PREDS = f"""arms(arm, signal) AS (VALUES ('audio', 0.5::DOUBLE), ('fusion', 1.0::DOUBLE)),
seeds(seed) AS (VALUES (0), (1), (2)),
preds0 AS (SELECT u.unit_id, u.y, u.toxic, u.lang, u.source, u.n_chars, a.arm, s.seed,
  round((2 * u.y - 1) * a.signal + 5.0::DOUBLE * ({HU("'pred|' || a.arm || '|' || s.seed || '|' || u.unit_id")} - 0.5::DOUBLE), 2) AS logit
  FROM units u, arms a, seeds s),
preds AS (SELECT *, 1.0::DOUBLE / (1.0::DOUBLE + exp(-logit)) AS prob FROM preds0)"""


def query(name: str, sql: str | None = None):
    def wrap(fn: Callable[[Tables], DataFrame]):
        assert name not in QUERIES, name
        QUERIES[name] = lambda spark, folder: fn(Tables(spark, folder))
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return wrap


def rounded(df: DataFrame, *cols: str, places: int = 6) -> DataFrame:
    """Round the listed double columns, as the reference SQL does."""
    return df.withColumns({c: F.round(F.col(c).cast("double"), places) for c in cols})


def r(expr: str, places: int = 6) -> str:
    return f"(round(({expr})::DOUBLE, {places}) + 0.0::DOUBLE)"


def count_n():
    return F.count(F.lit(1)).alias("n")
