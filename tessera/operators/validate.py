"""Cohort cleaning rules: counted exclusions, value audits, consistency collapse."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import canonical, is_unsafe, mapped
from tessera.operators.joins import ContractError


def exclusion_reason(rules: Sequence[tuple[str, Column]]) -> Column:
    """Name of the first rule that holds; NULL keeps the row."""
    return F.coalesce(*[F.when(cond, F.lit(name)) for name, cond in rules])


def waterfall(df: DataFrame, rules: Sequence[tuple[str, Column]]) -> DataFrame:
    """Rows with a ``reason`` column; kept rows have NULL there."""
    return df.withColumn("reason", exclusion_reason(rules))


def exclusion_counts(judged: DataFrame) -> DataFrame:
    return judged.groupBy(F.coalesce("reason", F.lit("kept")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def number_problem(c: Column, low: float | None, high: float | None, allow_missing: bool = True) -> Column:
    """NULL when the cell is a finite number in range, else the kind of problem."""
    text = canonical(c)
    v = text.try_cast("double")
    outside = F.lit(False)
    if low is not None:
        outside = outside | (v < low)
    if high is not None:
        outside = outside | (v > high)
    missing = F.when(text.isNull(), F.lit(None if allow_missing else "missing"))
    return F.coalesce(
        missing,
        F.when(text.isNotNull() & v.isNull(), F.lit("not_a_number")),
        F.when(F.isnan(v) | (F.abs(v) == float("inf")), F.lit("not_finite")),
        F.when(outside, F.lit("out_of_range")),
    )


def unsafe_values(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Per column, how many cells may not be rendered or used as identifiers."""
    bad = [F.sum(is_unsafe(F.col(c)).cast("long")).alias(c) for c in cols]
    return df.agg(*bad).unpivot([], list(cols), "column", "n_unsafe")


def map_strict(df: DataFrame, col: str, values: Mapping[str, str], out: str) -> DataFrame:
    """Vocabulary mapping that fails on the first unknown value; blank stays NULL."""
    unknown = df.where(canonical(F.col(col)).isNotNull() & mapped(F.col(col), values).isNull())
    hit = unknown.select(col).limit(1).collect()
    if hit:
        raise ContractError(f"{col}: unknown value {hit[0][0]!r}")
    return df.withColumn(out, mapped(F.col(col), values))


def unknown_values(df: DataFrame, col: str, values: Mapping[str, str]) -> DataFrame:
    """Counts of every value outside the vocabulary."""
    return (
        df.where(canonical(F.col(col)).isNotNull() & mapped(F.col(col), values).isNull())
        .groupBy(F.col(col).alias("value"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


def value_audit(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Per column: distinct stated values, missing cells, most frequent count.

    Counts per (column, value) come first, so a value shared by most rows is combined map-side.
    """
    texts = df.select(*[canonical(F.col(c)).alias(c) for c in cols])
    counts = texts.unpivot([], list(cols), "column", "value").groupBy("column", "value").agg(
        F.count(F.lit(1)).alias("n")
    )
    return counts.groupBy("column").agg(
        F.count("value").alias("n_distinct"),
        F.sum(F.when(F.col("value").isNull(), F.col("n")).otherwise(0)).alias("n_missing"),
        F.max(F.when(F.col("value").isNotNull(), F.col("n"))).alias("top_count"),
    )


def columns_with_prefix(df: DataFrame, prefix: str, forbidden: Sequence[str] = ()) -> list[str]:
    """Sorted column names with a prefix; fails when one of them is on the forbidden list."""
    names = sorted(c for c in df.columns if c.startswith(prefix))
    leaked = sorted(set(names) & set(forbidden))
    if leaked:
        raise ContractError(f"excluded columns would be used as features: {leaked}")
    return names


def require_columns(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    absent = sorted(set(cols) - set(df.columns))
    if absent:
        raise ContractError(f"missing columns: {absent}")
    return df


def collapse_static(
    df: DataFrame, unit: str, fields: Sequence[str], normaliser: Callable[[Column], Column] = canonical
) -> DataFrame:
    """One row per unit. A field with one stated value keeps it; several values are a conflict.

    ``min`` and ``max`` over the stated values decide this with map-side partial aggregation,
    and no list of values is ever collected.
    """
    aggs = []
    for f in fields:
        v = normaliser(F.col(f))
        aggs += [F.min(v).alias(f"__lo_{f}"), F.max(v).alias(f"__hi_{f}")]
    g = df.groupBy(unit).agg(*aggs)
    same = {f: F.col(f"__lo_{f}") == F.col(f"__hi_{f}") for f in fields}
    conflict = exclusion_reason([(f"conflicting_{f}", ~same[f]) for f in fields])
    return g.select(unit, *[F.when(same[f], F.col(f"__lo_{f}")).alias(f) for f in fields], conflict.alias("reason"))


def label_conflicts(df: DataFrame, unit: str, session: str, status: str, label: str) -> DataFrame:
    """How many units or sessions carry more than one raw status or mapped label."""
    two = lambda c: (F.min(c) != F.max(c)).cast("long")
    per_session = df.groupBy(unit, session).agg(
        F.min(status).alias("s0"), F.max(status).alias("s1"), F.min(label).alias("l0"), F.max(label).alias("l1")
    )
    per_unit = per_session.groupBy(unit).agg(
        F.max((F.col("l0") != F.col("l1")).cast("long")).alias("within"),
        (F.min("s0") != F.max("s1")).cast("long").alias("raw"),
        (F.min("l0") != F.max("l1")).cast("long").alias("strict"),
    )
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return per_unit.agg(
        F.count(F.lit(1)).alias("n_units"),
        zero("raw").alias("n_raw_conflict"),
        zero("strict").alias("n_label_conflict"),
        zero("within").alias("n_within_session"),
        zero(F.when((F.col("strict") == 1) & (F.coalesce("within", F.lit(0)) == 0), 1).otherwise(0)).alias(
            "n_across_sessions_only"
        ),
    )


def multiselect_codes(c: Column) -> Column:
    """Array of codes in a free-text multi-select cell (``key: 'x'`` entries, else word tokens)."""
    keyed = F.regexp_extract_all(c, F.lit(r"(?i)key\s*:\s*[\"']([^\"']+)[\"']"), F.lit(1))
    tokens = F.regexp_extract_all(c, F.lit(r"[A-Za-z][A-Za-z0-9_+ -]*"), F.lit(0))
    raw = F.when(F.size(keyed) > 0, keyed).otherwise(tokens)
    return F.filter(F.transform(raw, lambda t: F.regexp_replace(F.lower(F.trim(t)), "[^a-z0-9+]", "")), lambda t: t != "")


# Codes that state no answer in a multi-select cell.
NO_ANSWER = ("pnts", "ptns", "prefernottosay", "localizedstringkey")


def multiselect_state(df: DataFrame, unit: str, cell: str, positive: Sequence[str]) -> DataFrame:
    """Per unit YES when any row ever names a positive code, NO when others were named, else NULL."""
    codes = F.coalesce(multiselect_codes(canonical(F.col(cell))), F.array().cast("array<string>"))
    named = F.exists(codes, lambda t: t.isin(*positive))
    informative = F.exists(codes, lambda t: ~t.isin(*NO_ANSWER))
    level = F.when(named, 2).when(informative, 1).otherwise(0)
    return df.groupBy(unit).agg(F.max(level).alias("__l")).select(
        unit, F.when(F.col("__l") == 2, F.lit("YES")).when(F.col("__l") == 1, F.lit("NO")).alias("state")
    )


def repair_identity(df: DataFrame, uid: str, folder: str, platform: str, shared: str) -> DataFrame:
    """Where one platform writes a constant uid, the folder name is the identity."""
    return df.withColumn(uid, F.when(F.col(platform) == shared, F.col(folder)).otherwise(F.col(uid)))


def rare_to_other(df: DataFrame, col: str, at_least: int, out: str, other: str = "OTHER") -> DataFrame:
    """Levels with fewer than ``at_least`` rows become OTHER.

    The kept levels number at most rows / ``at_least``; AQE broadcasts them when they are few.
    """
    kept = df.groupBy(col).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") >= at_least).select(
        F.col(col), F.lit(True).alias("__kept")
    )
    joined = df.join(kept, col, "left")
    return joined.withColumn(out, F.when(F.col("__kept"), F.col(col)).otherwise(F.lit(other))).drop("__kept")
