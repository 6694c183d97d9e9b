"""Deterministic splits and folds from salted hashes. Row order and partitioning never matter."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import half_even, salted_sha
from tessera.operators.joins import ContractError
from tessera.operators.ranked import ranked


def stratified_split(
    df: DataFrame,
    unit: str,
    strata: Sequence[str],
    salt: str,
    quotas: Sequence[tuple[str, float]],
    rest: str,
    out: str = "split",
    keep_both: bool = False,
) -> DataFrame:
    """Hash order inside each stratum; ``floor(fraction * n)`` units to each named part, others to ``rest``.

    ``keep_both`` applies to a single quota: with two or more units neither part may be empty.
    """
    r = ranked(df.withColumn("__h", salted_sha(salt, unit)), strata, "__h", out="__r", size="__n")
    position = F.col("__r") - 1
    taken: Column = F.lit(0).cast("long")
    choice = None
    for name, fraction in quotas:
        quota = F.floor(F.lit(float(fraction)) * F.col("__n"))
        if keep_both:
            clamped = F.least(F.greatest(quota, F.lit(1)), F.col("__n") - 1)
            quota = F.when(F.col("__n") >= 2, clamped).otherwise(quota)
        taken = taken + quota
        hit = position < taken
        choice = F.when(hit, F.lit(name)) if choice is None else choice.when(hit, F.lit(name))
    return r.withColumn(out, choice.otherwise(F.lit(rest))).drop("__h", "__r", "__n")


def rounded_split(
    df: DataFrame, unit: str, signature: str, salt: str, fraction: float, names: tuple[str, str], rare_below: int = 2
) -> DataFrame:
    """Two-way split with a half-even rounded quota; rare signatures are pooled into one stratum."""
    counts = df.groupBy(signature).agg(F.count(F.lit(1)).alias("__c"))
    pooled = df.join(counts, signature).withColumn(
        "stratum", F.when(F.col("__c") < rare_below, F.lit("RARE")).otherwise(F.col(signature))
    )
    r = ranked(pooled.withColumn("__h", salted_sha(salt, unit)), ["stratum"], "__h", out="__r", size="__n")
    quota = half_even(F.lit(float(fraction)) * F.col("__n"))
    return r.withColumn(
        "split", F.when(F.col("__r") - 1 < quota, F.lit(names[0])).otherwise(F.lit(names[1]))
    ).drop("__h", "__r", "__n", "__c")


def signature_of(df: DataFrame, unit: str, who: str, what: str) -> DataFrame:
    """Per unit the sorted ``who:what`` list as one text (the raters of one unit are few)."""
    entry = F.concat_ws(":", F.col(who).cast("string"), F.col(what).cast("string"))
    return df.groupBy(unit).agg(F.array_join(F.array_sort(F.collect_set(entry)), "|").alias("signature"))


def stratified_folds(
    df: DataFrame, unit: str, label: str, source: str | None, k: int, salt: str, out: str = "fold", required: bool = False
) -> DataFrame:
    """Folds ``0..k-1`` stratified by label and source. NULL labels get -1.

    Strata below ``k`` rows are pooled per label. If a label has fewer than ``k`` rows in all, or there is only one
    label, some fold would lack a class: with ``required`` (primary folds) this is a ``ContractError``, else (probe
    folds) no fold is formed and every row gets -1.
    """
    parts = [F.col(label).cast("string")]
    parts.append(F.coalesce(F.col(source).cast("string"), F.lit("NA")) if source else F.lit("ALL"))
    named = df.withColumn("__s", F.when(F.col(label).isNotNull(), F.concat_ws("|", *parts)))
    sizes = named.groupBy("__s", label).agg(F.count(F.lit(1)).alias("__c"))
    smallest = (
        sizes.where(F.col(label).isNotNull())
        .groupBy(label)
        .agg(F.sum("__c").alias("c"))
        .agg(F.when(F.count(F.lit(1)) > 1, F.min("c")).otherwise(0).alias("c"))
    )
    if required and smallest.first()["c"] < k:
        raise ContractError(f"a class has fewer than {k} rows")
    pooled = (
        named.join(sizes.where(F.col("__s").isNotNull()).select("__s", "__c"), "__s", "left")
        .withColumn(
            "__s",
            F.when(F.col("__c") < k, F.concat_ws("|", F.col(label).cast("string"), F.lit("RARE"))).otherwise(F.col("__s")),
        )
        .withColumn("__h", salted_sha(salt, unit))
    )
    r = ranked(pooled, ["__s"], "__h", out="__r").withColumn("__least", smallest.scalar())
    usable = F.col(label).isNotNull() & (F.col("__least") >= k)
    fold = F.when(usable, (F.col("__r") - 1) % k).otherwise(F.lit(-1)).cast("int")
    return r.withColumn(out, fold).drop("__s", "__c", "__h", "__r", "__least")


def group_split(df: DataFrame, group: str, salt: str, fraction: float, names: tuple[str, str]) -> DataFrame:
    """Split whole groups (all rows of one patient go to one side)."""
    groups = df.select(group).distinct()
    placed = stratified_split(groups, group, [], salt, [(names[0], fraction)], names[1])
    return df.join(placed, group)


def straddling_groups(df: DataFrame, group: str, split: str) -> DataFrame:
    """Groups with rows on more than one side."""
    return df.groupBy(group).agg(F.min(split).alias("a"), F.max(split).alias("b")).where("a != b").select(group)


def drop_straddling(df: DataFrame, group: str, split: str) -> DataFrame:
    """Strict form: a group found on both sides is removed from both."""
    return df.join(straddling_groups(df, group, split), group, "left_anti")


def split_agreement(a: DataFrame, b: DataFrame, unit: str, split: str) -> DataFrame:
    joined = a.select(unit, F.col(split).alias("sa")).join(b.select(unit, F.col(split).alias("sb")), unit)
    same = (F.col("sa") == F.col("sb")).cast("double")
    return joined.agg(F.count(F.lit(1)).alias("n"), F.avg(same).alias("agreement"))


def index_session(df: DataFrame, unit: str, session: str, salt: str) -> DataFrame:
    """One session per unit: the one with the smallest salted hash."""
    return df.groupBy(unit).agg(F.min_by(session, salted_sha(salt, unit, session)).alias(session))


def split_by_label(df: DataFrame, split: str, label: str, labels: Sequence[int] = (0, 1)) -> DataFrame:
    """Split x label counts with the total, one row per split."""
    cols = [F.sum((F.col(label) == v).cast("long")).alias(f"n_{v}") for v in labels]
    return df.groupBy(split).agg(*cols, F.count(F.lit(1)).alias("n"))


def stratum_support(df: DataFrame, strata: Sequence[str]) -> DataFrame:
    return df.groupBy(*strata).agg(F.count(F.lit(1)).alias("n"), (F.count(F.lit(1)) == 1).alias("singleton"))


def drop_singletons(df: DataFrame, strata: Sequence[str]) -> DataFrame:
    """Rows of strata with at least two members (a lone unit has no other donor)."""
    alone = stratum_support(df, strata).where("singleton")
    return df.join(alone, [df[s].eqNullSafe(alone[s]) for s in strata], "left_anti")
