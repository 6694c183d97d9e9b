"""Deterministic check sets and extremes."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import salted_sha


def check_set(df: DataFrame, unit: str, cells: Sequence[tuple[str, Column, int]], total: int, salt: str) -> DataFrame:
    """Priority check set ``(unit, cell)``: each cell adds up to its quota in hash order, no unit twice.

    A unit belongs to its first matching selection; places of a later cell taken by an earlier
    one are refilled. A cell can therefore only use its ``sum of quotas so far`` smallest hashes.
    Those are found for all cells in one pass; what reaches the driver is bounded by the quotas.
    """
    need = [sum(q for _, _, q in cells[: i + 1]) for i in range(len(cells))]
    flags = F.array(*[F.when(c, F.lit(i)) for i, (_, c, _) in enumerate(cells)])
    d = df.withColumn("__h", salted_sha(salt, unit)).select(
        unit, "__h", F.substring("__h", 1, 2).alias("__b"), F.explode(F.array_compact(flags)).alias("__cell")
    )
    limit = F.element_at(F.array(*[F.lit(n) for n in need]), F.col("__cell") + 1)
    near = Window.partitionBy("__cell", "__b").orderBy("__h")
    final = Window.partitionBy("__cell").orderBy("__h")
    first = d.withColumn("__r", F.row_number().over(near)).where((F.col("__r") <= max(need)) & (F.col("__r") <= limit))
    top = first.withColumn("__r", F.row_number().over(final)).where((F.col("__r") <= max(need)) & (F.col("__r") <= limit))
    taken: dict = {}
    candidates: dict[int, list] = {}
    for row in top.select(unit, "__cell", "__r").collect():
        candidates.setdefault(row["__cell"], []).append((row["__r"], row[unit]))
    for i, (name, _, quota) in enumerate(cells):
        free = [u for _, u in sorted(candidates.get(i, [])) if u not in taken]
        taken.update({u: name for u in free[:quota]})
    chosen = list(taken.items())[:total]
    schema = f"{unit} {dict(df.dtypes)[unit]}, cell string, position int"
    return df.sparkSession.createDataFrame([(u, c, i) for i, (u, c) in enumerate(chosen)], schema)


def stratified_heads(df: DataFrame, unit: str, strata: Sequence[str], quota: int, salt: str) -> DataFrame:
    """The ``quota`` smallest hashes of every stratum.

    Rows are cut to ``quota`` per (stratum, hash bucket) first, so a huge stratum is reduced in
    parallel before its final ranking.
    """
    d = df.withColumn("__h", salted_sha(salt, unit)).withColumn("__b", F.substring(F.col("__h"), 1, 2))
    near = Window.partitionBy(*strata, "__b").orderBy("__h")
    final = Window.partitionBy(*strata).orderBy("__h")
    first = d.withColumn("__r", F.row_number().over(near)).where(F.col("__r") <= quota)
    return first.withColumn("__r", F.row_number().over(final)).where(F.col("__r") <= quota).drop("__h", "__b", "__r")


def extremes(df: DataFrame, unit: str, fields: Sequence[str], k: int) -> DataFrame:
    """The k smallest and k largest units per field, ids breaking ties."""
    parts = []
    for f in fields:
        for side, order in (("smallest", F.col(f).asc()), ("largest", F.col(f).desc())):
            parts.append(
                df.where(F.col(f).isNotNull()).orderBy(order, F.col(unit)).limit(k).select(
                    F.lit(f).alias("field"), F.lit(side).alias("side"), unit, F.col(f).cast("double").alias("value")
                )
            )
    return reduce(DataFrame.unionByName, parts)


def window_plan(df: DataFrame, samples: str, window: int) -> DataFrame:
    """Evenly spaced window starts that cover the whole recording; a short one gets one window at 0."""
    n = F.col(samples)
    count = F.greatest(F.ceil(n / F.lit(window)), F.lit(1)).cast("int")
    last = (n - window).cast("double")
    starts = F.transform(
        F.sequence(F.lit(0), count - 1),
        lambda i: F.when(count == 1, F.lit(0)).otherwise(F.bround(i * last / (count - 1), 0)).cast("long"),
    )
    return df.select("*", F.posexplode(starts).alias("window", "start"))
