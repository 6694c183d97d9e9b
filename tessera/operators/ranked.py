"""Exact ranks and running totals in groups of any size.

A group may hold a large share of all rows, so no function here sorts a whole group in one
task. Rows are split into ordered buckets (leading hash digits, or value ranges), the bucket
totals are prefix-summed in a table of at most ``buckets`` rows per group, and the exact
position is the offset of the bucket plus the position inside it.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.session import cut_lineage

HASH_DIGITS = 3
RANGE_BUCKETS = 128
SUB_BUCKETS = 16
_NULL_KEY = "\u0000"


def _keyed(df: DataFrame, by: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """Non-null text companions of the keys: a plain equi-join and one partitioning serve both."""
    names = [f"__k{i}" for i in range(len(by))]
    types = dict(df.dtypes)
    # adding 0.0 gives -0.0 and 0.0 one text form, as grouping does
    plain = [F.col(c) + F.lit(0.0) if types.get(c) in ("double", "float") else F.col(c) for c in by]
    cols = {n: F.coalesce(c.cast("string"), F.lit(_NULL_KEY)) for n, c in zip(names, plain)}
    return df.withColumns(cols) if cols else df, names


def _offsets(df: DataFrame, keys: list[str], amounts: dict[str, Column]) -> DataFrame:
    """Totals per (keys, bucket) turned into the sums of all earlier buckets."""
    totals = df.groupBy(*keys, "__bucket").agg(*[F.sum(a).alias(f"__t_{n}") for n, a in amounts.items()])
    # bounded: at most one row per bucket in each window partition
    group = Window.partitionBy(*(keys or [F.lit(0)]))
    earlier = group.orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    return totals.select(
        *keys,
        "__bucket",
        *[F.coalesce(F.sum(f"__t_{n}").over(earlier), F.lit(0)).alias(f"__o_{n}") for n in amounts],
        *[F.sum(f"__t_{n}").over(group).alias(f"__g_{n}") for n in amounts],
    )


def ranked(
    df: DataFrame,
    by: Sequence[str],
    hash_col: str,
    out: str = "rank",
    size: str | None = None,
    digits: int = HASH_DIGITS,
) -> DataFrame:
    """1-based rank inside ``by`` in ascending order of a hex hash that is unique per row.

    ``size`` names an extra column with the number of rows of the group (no further shuffle).
    """
    base, keys = _keyed(df, by)
    base = base.withColumn("__bucket", F.coalesce(F.substring(hash_col, 1, digits), F.lit("")))
    offsets = _offsets(base, keys, {"n": F.lit(1)})
    local = Window.partitionBy(*keys, "__bucket").orderBy(hash_col)
    return (
        base.join(offsets, [*keys, "__bucket"])
        .withColumn(out, (F.col("__o_n") + F.row_number().over(local)).cast("long"))
        .withColumns({size: F.col("__g_n")} if size else {})
        .drop(*keys, "__bucket", "__o_n", "__g_n")
    )


def ranked_sides(df: DataFrame, by: Sequence[str], side: str, hash_col: str) -> DataFrame:
    """Rank inside (``by``, ``side``) as ``rank``, with both side sizes of the group as ``n0`` and ``n1``."""
    base, keys = _keyed(df, by)
    base = base.withColumn("__bucket", F.coalesce(F.substring(hash_col, 1, HASH_DIGITS), F.lit("")))
    amounts = {str(s): (F.col(side) == s).cast("long") for s in (0, 1)}
    offsets = _offsets(base, keys, amounts)
    local = Window.partitionBy(*keys, "__bucket", side).orderBy(hash_col)
    before = F.when(F.col(side) == 0, F.col("__o_0")).otherwise(F.col("__o_1"))
    return (
        base.join(offsets, [*keys, "__bucket"])
        .withColumns({"rank": before + F.row_number().over(local), "n0": F.col("__g_0"), "n1": F.col("__g_1")})
        .drop(*keys, "__bucket", "__o_0", "__o_1", "__g_0", "__g_1")
    )


def range_edges(df: DataFrame, col: str, buckets: int = RANGE_BUCKETS, error: float = 0.002) -> list[float]:
    """At most ``buckets + 1`` cut points. They only spread the work; results never depend on them."""
    probs = [i / buckets for i in range(buckets + 1)]
    edges = df.select(F.col(col).cast("double").alias("v")).stat.approxQuantile("v", probs, error)
    return sorted({e for e in edges if math.isfinite(e)})


def with_range_bucket(df: DataFrame, value: str, edges: Sequence[float], out: str = "__bucket") -> DataFrame:
    """Number of the value range a row falls into, non-decreasing in the value.

    A balanced comparison tree finds the range between two edges; each range is cut into
    ``SUB_BUCKETS`` equal parts.
    """

    def tree(low: int, high: int) -> str:
        if low == high:
            return str(low)
        mid = (low + high) // 2
        return f"IF(__rv <= {edges[mid]!r}D, {tree(low, mid)}, {tree(mid + 1, high)})"

    placed = df.withColumn("__rv", F.col(value).cast("double")).withColumn("__rc", F.expr(tree(0, len(edges))))
    if len(edges) < 2:
        return placed.withColumnsRenamed({"__rc": out}).drop("__rv")
    cuts = f"array({', '.join(f'{e!r}D' for e in edges)})"
    low, high = f"element_at({cuts}, greatest(__rc, 1))", f"element_at({cuts}, least(__rc + 1, {len(edges)}))"
    part = f"CAST(floor({SUB_BUCKETS} * (__rv - {low}) / ({high} - {low})) AS INT)"
    inner = f"IF(__rc = 0 OR __rc = {len(edges)}, 0, greatest(0, least({SUB_BUCKETS - 1}, {part})))"
    return placed.withColumn(out, F.expr(f"__rc * {SUB_BUCKETS} + {inner}")).drop("__rv", "__rc")


def running_total(
    df: DataFrame,
    by: Sequence[str],
    order: str,
    amounts: dict[str, Column],
    edges: Sequence[float] | None = None,
    then: Sequence[str] = (),
) -> DataFrame:
    """Adds ``<name>_before``, the sum of ``amounts[name]`` over earlier rows of the group, and ``<name>_total``.

    ``order`` is numeric; with ``then`` it must be distinct inside a group (aggregate ties first).
    The input is checkpointed: it is read for the edges, the bucket totals and the rows, and
    what comes before it (joins, large aggregates) should run once.
    """
    df = cut_lineage(df)
    if edges is None:
        edges = range_edges(df, order)
    base, keys = _keyed(df, by)
    base = with_range_bucket(base, order, edges)
    offsets = _offsets(base, keys, amounts)
    local = Window.partitionBy(*keys, "__bucket").orderBy(order, *then)
    earlier = local.rowsBetween(Window.unboundedPreceding, -1)
    added = {
        f"{n}_before": F.col(f"__o_{n}") + F.coalesce(F.sum(a).over(earlier), F.lit(0)) for n, a in amounts.items()
    } | {f"{n}_total": F.col(f"__g_{n}") for n in amounts}
    return (
        base.join(offsets, [*keys, "__bucket"])
        .withColumns(added)
        .drop(*keys, "__bucket", *[f"__{p}_{n}" for n in amounts for p in "og"])
    )


def ranked_by_value(
    df: DataFrame,
    by: Sequence[str],
    value: str,
    tie_hash: str,
    out: str = "rank",
    descending: bool = False,
) -> DataFrame:
    """1-based rank by a numeric value, ties in hash order; a heavily repeated value is split too."""
    signed = -F.col(value).cast("double") if descending else F.col(value).cast("double")
    base = df.withColumn("__v", signed + F.lit(0.0))
    levels = base.groupBy(*by, "__v").agg(F.count(F.lit(1)).alias("__n"))
    placed = running_total(levels, by, "__v", {"__n": F.col("__n")}).drop("__n")
    inside = ranked(base, [*by, "__v"], tie_hash, out="__r")
    left, keys = _keyed(inside, [*by, "__v"])
    right, _ = _keyed(placed, [*by, "__v"])
    return (
        left.join(right.select(*keys, "__n_before"), keys)
        .withColumn(out, (F.col("__n_before") + F.col("__r")).cast("long"))
        .drop(*keys, "__n_before", "__r", "__v")
    )


def nearest_value(
    queries: DataFrame, pool: DataFrame, by: Sequence[str], value: str, out: str = "gap"
) -> DataFrame:
    """Distance from every query row to the nearest pool value of its group (NULL when none).

    An as-of lookup in both directions over the union of query and pool values. The value just
    outside a range bucket is carried in from the bucket extremes.
    """
    points = queries.select(*by, value).distinct().withColumn("__p", F.lit(None).cast("double"))
    held = pool.select(*by, value).distinct().withColumn("__p", F.col(value).cast("double"))
    both = cut_lineage(points.unionByName(held))
    edges = range_edges(both, "__p")
    both, keys = _keyed(both, by)
    both = with_range_bucket(both, value, edges)
    ends = both.groupBy(*keys, "__bucket").agg(F.min("__p").alias("__lo"), F.max("__p").alias("__hi"))
    w = Window.partitionBy(*(keys or [F.lit(0)])).orderBy("__bucket")
    ends = ends.select(
        *keys,
        "__bucket",
        F.max("__hi").over(w.rowsBetween(Window.unboundedPreceding, -1)).alias("__below"),
        F.min("__lo").over(w.rowsBetween(1, Window.unboundedFollowing)).alias("__above"),
    )
    v = F.col(value).cast("double")
    seen = (Window.unboundedPreceding, Window.currentRow)
    local = Window.partitionBy(*keys, "__bucket")
    lower = F.max("__p").over(local.orderBy(v).rangeBetween(*seen))
    upper = F.min("__p").over(local.orderBy(v.desc()).rangeBetween(*seen))
    placed = (
        both.join(ends, [*keys, "__bucket"])
        .withColumns({"__l": F.coalesce(lower, F.col("__below")), "__u": F.coalesce(upper, F.col("__above"))})
        .where(F.col("__p").isNull())
        .withColumn("__d", F.least(v - F.col("__l"), F.col("__u") - v))
        .select(*keys, F.col(value).alias("__v"), "__d")
    )
    left, _ = _keyed(queries, by)
    return (
        left.join(placed, [*[left[k] == placed[k] for k in keys], left[value] == placed["__v"]], "left")
        .select(*[left[c] for c in queries.columns], placed["__d"].alias(out))
    )
