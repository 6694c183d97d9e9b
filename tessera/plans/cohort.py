"""Cohort freezing: split with balance report, split-first and match-first protocols, and the data gate."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators import balance, gates, joins, matching, splits
from tessera.session import cut_lineage


def split_and_balance(
    units: DataFrame,
    unit: str,
    label: str,
    strata: Sequence[str],
    fields: Sequence[str],
    salt: str,
    quotas: Sequence[tuple[str, float]],
    rest: str,
) -> DataFrame:
    """Level balance of every split, with the number of units found in more than one split."""
    s = splits.stratified_split(units.select(unit, label, *dict.fromkeys([*[x for x in strata if x != label], *fields])), unit, strata, salt, quotas, rest)
    levels = balance.level_smd(s, label, fields, ["split"])
    repeated = joins.duplicated_keys(s, [unit]).agg(F.count(F.lit(1)).alias("n_overlap"))
    return levels.withColumn("n_overlap", repeated.scalar())


def split_first(
    units: DataFrame, unit: str, label: str, strata: Sequence[str], tiers, salt: str, quotas, rest: str
) -> DataFrame:
    """Split all units, then match inside the held-out part: sizes per split and the pair count."""
    s = splits.stratified_split(units, unit, strata, salt, quotas, rest)
    pairs = matching.match_in_tiers(s.where(F.col("split") == rest), unit, label, tiers, f"{salt}-match")
    n = pairs.agg(F.count(F.lit(1)).alias("n"))
    return s.groupBy("split").agg(F.count(F.lit(1)).alias("n")).withColumn("n_pairs", n.scalar())


def match_first(
    units: DataFrame,
    unit: str,
    label: str,
    strata: Sequence[str],
    tiers,
    salt: str,
    quotas,
    rest: str,
    target_pairs: int | None = None,
    continuous: Sequence[str] = (),
    categorical: Sequence[str] = (),
) -> DataFrame:
    """Freeze the matched target first, then split only the remaining units.

    With ``target_pairs`` the target is trimmed to exactly so many pairs, for the balance of the fields listed.
    """
    pairs = matching.match_in_tiers(units, unit, label, tiers, f"{salt}-match")
    if target_pairs is not None:
        pairs = cut_lineage(pairs)
        found = pairs.count()
        if found < target_pairs:
            raise joins.ContractError(f"{found} pairs, {target_pairs} wanted")
        wide = balance.pair_values(pairs, units, unit, [*continuous, *categorical])
        kept = balance.trim_pairs(wide, continuous, categorical, target_pairs, to_minimum=True)
        pairs = pairs.join(kept.select("pair_id"), "pair_id", "left_semi")
    members = joins.pair_members(pairs).select(F.col("member_id").alias(unit))
    rest_units = units.join(members, unit, "left_anti")
    s = splits.stratified_split(rest_units, unit, strata, salt, quotas, rest).select(unit, "split")
    every = s.unionByName(members.withColumn("split", F.lit("matched_target")))
    n = pairs.agg(F.count(F.lit(1)).alias("n"))
    return every.groupBy("split").agg(F.count(F.lit(1)).alias("n")).withColumn("n_pairs", n.scalar())


def data_gate(
    units: DataFrame,
    pairs: DataFrame,
    unit: str,
    label: str,
    continuous: Sequence[str],
    categorical: Sequence[str],
    min_pairs: int,
    max_smd: float,
    max_difference: float,
) -> DataFrame:
    """Named feasibility checks of a frozen cohort."""
    member = joins.pair_members(pairs).select(F.col("member_id").alias(unit), F.col("member_label").alias("side"))
    matched = units.join(member, unit)
    summary = balance.balance_summary(matched, "side", continuous, categorical, (), max_smd, max_difference)
    repeated = joins.duplicated_keys(units, [unit]).agg(F.count(F.lit(1)).alias("v"))
    wrong = matched.agg(F.coalesce(F.sum((F.col("side") != F.col(label)).cast("long")), F.lit(0)).alias("v"))
    return gates.checks_table(
        [
            ("unit_keys_unique", repeated, 0, "=="),
            ("enough_pairs", pairs.agg(F.count(F.lit(1)).alias("v")), min_pairs, ">="),
            ("pair_labels_agree", wrong, 0, "=="),
            ("max_abs_smd", summary.select("max_abs_smd"), max_smd, "<="),
            ("max_level_difference", summary.select("max_difference"), max_difference, "<="),
        ]
    )
