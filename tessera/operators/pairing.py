"""Controlled pairings: every unit gets another unit of its stratum as donor."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import salted_sha
from tessera.operators.joins import ContractError, same_key_join
from tessera.operators.ranked import ranked
from tessera.operators.splits import drop_singletons, stratum_support
from tessera.session import cut_lineage


def derangement(
    df: DataFrame, unit: str, strata: Sequence[str], salt: str, seeds: Sequence[int] = (0,), singletons: str = "fail"
) -> DataFrame:
    """``(seed, unit_id, donor_id)``: one cycle per stratum in hash order, so no unit is its own donor.

    The donor is found by joining rank ``r`` to rank ``r % n + 1``; a stratum of any size spreads
    over all tasks. Lone units fail, or are left out with ``singletons='drop'``.
    """
    if singletons == "fail":
        if stratum_support(df, strata).where("singleton").limit(1).count():
            raise ContractError(f"a stratum of {list(strata)} has a single unit")
        base = df
    else:
        base = drop_singletons(df, strata)
    spread = base.select(unit, *strata).withColumn("seed", F.explode(F.array(*[F.lit(s) for s in seeds])))
    keys = ["seed", *strata]
    r = cut_lineage(
        ranked(spread.withColumn("__h", salted_sha(salt, "seed", unit)), keys, "__h", out="__r", size="__n").drop("__h")
    )
    left = r.withColumn("__r", F.col("__r") % F.col("__n") + 1)
    right = r.select(*keys, "__r", F.col(unit).alias("donor_id"))
    return same_key_join(left, right, [*keys, "__r"]).select("seed", F.col(unit).alias("unit_id"), "donor_id")


def audit_pairing(pairing: DataFrame, units: DataFrame, unit: str, held: Sequence[str]) -> DataFrame:
    """Per seed: bijection, fixed points, and how many pairs cross each attribute that must be held."""
    own = units.select(F.col(unit).alias("unit_id"), *held)
    other = units.select(F.col(unit).alias("donor_id"), *[F.col(c).alias(f"donor_{c}") for c in held])
    joined = pairing.join(own, "unit_id").join(other, "donor_id")
    crossed = [
        F.sum((~F.col(c).eqNullSafe(F.col(f"donor_{c}"))).cast("long")).alias(f"n_cross_{c}") for c in held
    ]
    facts = joined.groupBy("seed").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum((F.col("unit_id") == F.col("donor_id")).cast("long")).alias("n_fixed"),
        *crossed,
    )
    # distinct donors by two-level counting rather than one set per seed
    donors = pairing.groupBy("seed", "donor_id").agg(F.count(F.lit(1)).alias("c")).groupBy("seed").agg(
        F.count(F.lit(1)).alias("n_donors"), F.max("c").alias("max_use")
    )
    return facts.join(donors, "seed").withColumn(
        "bijective", (F.col("n_donors") == F.col("n")) & (F.col("max_use") == 1)
    )


def pairing_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows in one pairing only; empty when two runs used the same pairing."""
    cols = ["seed", "unit_id", "donor_id"]
    return a.select(cols).exceptAll(b.select(cols)).unionByName(b.select(cols).exceptAll(a.select(cols)))


def collision_rate(pairing: DataFrame, units: DataFrame, unit: str, text: str) -> DataFrame:
    """Share of pairs whose donor carries the same text (compared through its hash)."""
    own = units.select(F.col(unit).alias("unit_id"), F.sha2(F.col(text), 256).alias("t"))
    other = own.select(F.col("unit_id").alias("donor_id"), F.col("t").alias("u"))
    same = (F.col("t") == F.col("u")).cast("double")
    return (
        pairing.join(own, "unit_id").join(other, "donor_id").groupBy("seed").agg(
            F.count(F.lit(1)).alias("n"), F.avg(same).alias("collision_rate")
        )
    )


def shuffled_records(df: DataFrame, unit: str, fields: Sequence[str], mode: str, salt: str) -> DataFrame:
    """Control records, one row per (unit, field): ``record``, ``field``, ``constant`` or ``anonymous``.

    ``record`` takes all fields from one donor; ``field`` uses its own donor for every field;
    ``constant`` gives every unit the record with the smallest hash; ``anonymous`` keeps the
    values and hides which field they belong to.
    """
    cells = df.select(unit, *[F.col(f).cast("string").alias(f) for f in fields]).unpivot(
        [unit], list(fields), "field", "value"
    )
    if mode == "anonymous":
        return cells.select(F.col(unit).alias("unit_id"), F.lit("value").alias("field"), "value")
    if mode == "constant":
        chosen = df.select(
            F.min_by(F.struct(*[F.col(f).cast("string").alias(f) for f in fields]), salted_sha(salt, unit)).alias("r")
        )
        fixed = df.select(F.col(unit).alias("unit_id")).withColumn("r", chosen.scalar())
        return fixed.select("unit_id", "r.*").unpivot(["unit_id"], list(fields), "field", "value")
    if mode == "record":
        pairs = derangement(df, unit, [], salt).drop("seed")
        moved = cells.withColumnRenamed(unit, "donor_id")
        return pairs.join(moved, "donor_id").select("unit_id", "field", "value")
    if mode == "field":
        keyed = ranked(cells.withColumn("__h", salted_sha(salt, "field", unit)), ["field"], "__h", "__r", "__n").drop("__h")
        left = keyed.select(F.col(unit).alias("unit_id"), "field", (F.col("__r") % F.col("__n") + 1).alias("__r"))
        return left.join(keyed.select("field", "__r", "value"), ["field", "__r"]).select("unit_id", "field", "value")
    raise ValueError(mode)
