"""Joins with stated key contracts."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class ContractError(ValueError):
    """A key, coverage or vocabulary contract does not hold."""


def same_key_join(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join in which NULL keys are equal to each other; the key columns of ``left`` are kept.

    Keys of different types meet in their common type, so 1 and 1.0 are equal.
    """
    other = {c: f"__same_{c}" for c in on}
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(k)) for c, k in other.items()])
    return left.join(right.withColumnsRenamed(other), same, how).drop(*other.values())


BROADCAST_ROWS = 100_000


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast hint behind a row count; a larger table is left to a shuffled join.

    For narrow tables of one row per cell that are already materialised.
    """
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def duplicated_keys(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """Key values that occur more than once, with their count."""
    return df.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def require_unique(df: DataFrame, key: Sequence[str], name: str) -> DataFrame:
    if duplicated_keys(df, key).limit(1).count():
        raise ContractError(f"{name}: key {list(key)} is not unique")
    return df


def validated_join(
    left: DataFrame, right: DataFrame, on: Sequence[str], validate: str, how: str = "inner"
) -> DataFrame:
    """Equi-join that fails unless the sides named by ``validate`` have unique keys.

    ``validate`` is ``one_to_one``, ``many_to_one`` or ``one_to_many``.
    """
    if validate not in ("one_to_one", "many_to_one", "one_to_many"):
        raise ValueError(validate)
    if validate != "many_to_one":
        require_unique(left, on, "left side")
    if validate != "one_to_many":
        require_unique(right, on, "right side")
    return left.join(right, list(on), how)


def assemble(base: DataFrame, key: str, parts: Sequence[tuple[DataFrame, Sequence[str]]]) -> DataFrame:
    """One row per unit: every part is pruned to its columns before the join."""
    return reduce(
        lambda acc, part: validated_join(acc, part[0].select(key, *part[1]), [key], "many_to_one", "left"),
        parts,
        base,
    )


def membership(ids: DataFrame, records: DataFrame, key: str, label: str) -> DataFrame:
    """Status of every listed id: ``not_found``, ``conflict`` (several labels), ``unlabelled`` or ``found``."""
    facts = records.groupBy(key).agg(
        F.count(F.lit(1)).alias("n_records"),
        F.count_distinct(label).alias("n_labels"),
        F.min(label).alias("label"),
    )
    found = F.coalesce(F.col("n_records"), F.lit(0))
    return ids.select(key).distinct().join(facts, key, "left").select(
        key,
        found.alias("n_records"),
        F.when(found == 0, F.lit("not_found"))
        .when(F.col("n_labels") > 1, F.lit("conflict"))
        .when(F.col("n_labels") == 0, F.lit("unlabelled"))
        .otherwise(F.lit("found"))
        .alias("status"),
        F.when(F.col("n_labels") == 1, F.col("label")).alias("label"),
    )


def coverage_gaps(expected: DataFrame, present: DataFrame, key: Sequence[str]) -> DataFrame:
    """Keys on one side only: ``missing`` from ``present``, or ``extra`` in it."""
    want, have = expected.select(*key).distinct(), present.select(*key).distinct()
    return (
        want.join(have, list(key), "left_anti")
        .withColumn("gap", F.lit("missing"))
        .unionByName(have.join(want, list(key), "left_anti").withColumn("gap", F.lit("extra")))
    )


def violations(checks: Sequence[tuple[str, DataFrame, Column]]) -> DataFrame:
    """One ``(check, n_violations)`` row per named condition."""
    rows = [
        df.agg(F.coalesce(F.sum(F.coalesce(bad, F.lit(False)).cast("long")), F.lit(0)).alias("n_violations")).select(
            F.lit(name).alias("check"), "n_violations"
        )
        for name, df, bad in checks
    ]
    return reduce(DataFrame.unionByName, rows)


def key_contract(
    units: DataFrame, pairs: DataFrame, unit: str, label: str, split: str, target: str
) -> DataFrame:
    """Contracts of a frozen cohort with its pairs; every count is 0 when all hold. A NULL label or split is a violation."""
    members = pair_members(pairs).join(units.select(F.col(unit).alias("member_id"), label, split), "member_id", "left")
    repeats = members.groupBy("member_id").agg(F.count(F.lit(1)).alias("n"))
    return violations(
        [
            ("unit_repeated", duplicated_keys(units, [unit]), F.lit(True)),
            ("unit_blank", units, F.col(unit).isNull()),
            ("member_unknown", members, F.col(label).isNull()),
            ("member_label_disagrees", members, ~F.col(label).eqNullSafe(F.col("member_label"))),
            ("member_outside_target", members, ~F.col(split).eqNullSafe(F.lit(target))),
            ("member_in_several_pairs", repeats, F.col("n") > 1),
        ]
    )


def pair_members(pairs: DataFrame) -> DataFrame:
    """Long form of a pair table: one row per member, with the label the pair gives it."""
    return pairs.select(
        "pair_id",
        F.explode(
            F.array(
                F.struct(F.lit(0).alias("member_label"), F.col("negative_id").alias("member_id")),
                F.struct(F.lit(1).alias("member_label"), F.col("positive_id").alias("member_id")),
            )
        ).alias("m"),
    ).select("pair_id", "m.member_label", "m.member_id")


def attach_pair(units: DataFrame, pairs: DataFrame, unit: str) -> DataFrame:
    """Pair id on both members, NULL for unmatched units."""
    return units.join(pair_members(pairs).select(F.col("member_id").alias(unit), "pair_id"), unit, "left")


def apply_donor(units: DataFrame, pairing: DataFrame, unit: str, cols: Sequence[str]) -> DataFrame:
    """Pairing table with the listed columns of the unit and, prefixed ``donor_``, of its donor."""
    own = units.select(F.col(unit).alias("unit_id"), *cols)
    other = units.select(F.col(unit).alias("donor_id"), *[F.col(c).alias(f"donor_{c}") for c in cols])
    return pairing.join(own, "unit_id").join(other, "donor_id")


def per_distinct(df: DataFrame, col: str, out: str, fn) -> DataFrame:
    """Evaluate ``fn`` once per distinct value and map it back to every row.

    Repeats are dropped map-side, and the join key is the SHA-256 of the value instead of a long text.
    """
    keyed = df.withColumn("__d", F.sha2(F.col(col), 256))
    once = keyed.select("__d", col).distinct().select("__d", fn(F.col(col)).alias(out))
    return keyed.join(once, "__d", "left").drop("__d")


def link_sessions(sessions: DataFrame, files: DataFrame, shared_platform: str, shared_uid: str, word: str) -> DataFrame:
    """Recordings of each ``(uid, folder, platform, listed_name)`` session, one row per file.

    On the shared platform all users have one uid, so the folder alone identifies the session.
    Files are linked by the exact folder and only if their name holds ``word``; ``listed`` marks the
    file the metadata names. A session without files keeps one row with NULL path.
    """
    owner = F.when(F.col("platform") == shared_platform, F.lit(shared_uid)).otherwise(F.col("uid"))
    wanted = sessions.withColumn("__s", F.concat_ws("/", owner, "folder"))
    held = files.where(F.lower("file_name").contains(word)).select(
        F.concat_ws("/", "uid", "folder").alias("__s"), "file_name", "path"
    )
    return wanted.join(held, "__s", "left").select(
        "uid", "folder", "platform", "path", F.coalesce(F.col("file_name") == F.col("listed_name"), F.lit(False)).alias("listed")
    )
