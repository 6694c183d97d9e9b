"""Matching inside strata and pair-support counts, without forming all candidate pairs of a stratum."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce
from itertools import combinations
from math import comb

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import hash_unit, salted_sha
from tessera.operators.joins import same_key_join
from tessera.operators.ranked import nearest_value, ranked_sides, running_total
from tessera.session import cut_lineage


@dataclass(frozen=True)
class MatchSpec:
    """What makes an opposite-label unit an acceptable partner."""

    equal: tuple[str, ...]
    hamming: tuple[str, ...] = ()
    max_hamming: int = 0
    numeric: str | None = None
    caliper: float | None = None


def pair_cost(
    numeric: Mapping[str, tuple[float, float, float]], categorical: Mapping[str, float], tie: Column | None = None
) -> Column:
    """Cost of a row with ``neg_``/``pos_`` columns.

    ``numeric`` maps a field to (weight, scale, penalty when either value is missing);
    ``categorical`` maps a field to the weight of a mismatch. ``tie`` in [0, 1) adds at most 1e-9.
    """
    parts = [
        F.lit(w) * F.coalesce(F.abs(F.col(f"neg_{f}") - F.col(f"pos_{f}")) / F.lit(scale), F.lit(penalty))
        for f, (w, scale, penalty) in numeric.items()
    ]
    parts += [
        F.lit(w) * (~F.col(f"neg_{f}").eqNullSafe(F.col(f"pos_{f}"))).cast("double") for f, w in categorical.items()
    ]
    total = reduce(lambda a, b: a + b, parts, F.lit(0.0))
    return total if tie is None else total + tie * F.lit(1e-9)


def pair_tie(salt: str) -> Column:
    return hash_unit(salted_sha(salt, "negative_id", "positive_id"))


def match_in_tiers(
    units: DataFrame, unit: str, label: str, tiers: Sequence[Sequence[str]], salt: str
) -> DataFrame:
    """One-to-one pairs of opposite labels, ``min(n0, n1)`` of them per stratum of the last tier.

    The tiers run from the finest cell (all covariates equal or in the same band) to the bare
    stratum. In each tier both sides of a cell are ranked by hash and equal ranks are paired;
    the surplus of the larger side goes on to the next tier. Work and rows stay linear in the
    units whatever the stratum sizes are.
    """
    every = list(dict.fromkeys(c for keys in tiers for c in keys))
    left = units.select(unit, label, *every).withColumn("__h", salted_sha(salt, unit))
    found: list[DataFrame] = []
    for depth, keys in enumerate(tiers):
        placed = cut_lineage(ranked_sides(left, keys, label, "__h"))
        within = placed.where(F.col("rank") <= F.least("n0", "n1"))
        neg = within.where(F.col(label) == 0).select(*keys, "rank", F.col(unit).alias("negative_id"))
        pos = within.where(F.col(label) == 1).select(*keys, "rank", F.col(unit).alias("positive_id"))
        found.append(
            same_key_join(neg, pos, [*keys, "rank"]).select("negative_id", "positive_id", F.lit(depth).alias("tier"))
        )
        left = placed.where(F.col("rank") > F.least("n0", "n1")).drop("rank", "n0", "n1")
    pairs = reduce(DataFrame.unionByName, found)
    identity = F.substring(salted_sha(f"{salt}-pair", "negative_id", "positive_id"), 1, 16)
    return cut_lineage(pairs.select(identity.alias("pair_id"), "negative_id", "positive_id", "tier"))


def _masks(fields: Sequence[str], most: int) -> list[tuple[int, ...]]:
    return [s for size in range(most + 1) for s in combinations(range(len(fields)), size)]


def _masked(df: DataFrame, fields: Sequence[str], masks: Sequence[tuple[int, ...]], weight: Sequence[int]) -> DataFrame:
    """One row per mask: fields in the mask are blanked, the others form ``__key`` with the mask number."""
    entries = F.array(
        *[
            F.struct(
                F.lit(i).alias("mask"),
                F.lit(len(m)).alias("width"),
                F.lit(weight[i]).cast("long").alias("coef"),
                F.array(*[F.lit(j not in m) for j in range(len(fields))]).alias("keep"),
            )
            for i, m in enumerate(masks)
        ]
    )
    d = df.withColumn("__m", F.explode(entries))
    shown = [
        F.when(F.col("__m.keep")[j], F.coalesce(F.col(f).cast("string"), F.lit("\u0000"))).otherwise(F.lit("*"))
        for j, f in enumerate(fields)
    ]
    key = F.concat_ws("\u0001", F.col("__m.mask").cast("string"), *shown)
    return d.select(*df.columns, key.alias("__key"), F.col("__m.width").alias("__width"), F.col("__m.coef").alias("__coef"))


def _coefficients(k: int, most: int) -> list[int]:
    """Weights per mask size that turn counts of 'agrees outside the mask' into 'at most ``most`` differ'."""
    c: list[int] = []
    for d in range(most, -1, -1):
        # partners at distance d are inside comb(k-d, j-d) masks of size j; the weighted sum must be 1
        c.insert(0, 1 - sum(c[j - d - 1] * comb(k - d, j - d) for j in range(d + 1, most + 1)))
    return c


def _cells(df: DataFrame, spec: MatchSpec, label: str) -> DataFrame:
    num = [spec.numeric] if spec.numeric else []
    return cut_lineage(df.groupBy(label, *spec.equal, *spec.hamming, *num).agg(F.count(F.lit(1)).alias("__c")))


def _finite(v: Column) -> Column:
    """False for NULL, NaN and infinities, which lie within no caliper."""
    return F.coalesce(F.abs(v.cast("double")) < float("inf"), F.lit(False))


def partner_counts(units: DataFrame, label: str, spec: MatchSpec, out: str = "n_partner") -> DataFrame:
    """Per unit, the number of opposite-label units that satisfy ``spec``. Exact, and no pairs are formed.

    Units are reduced to covariate cells. 'At most m of k fields differ' is inclusion-exclusion
    over the masks of at most m fields; the caliper is a difference of two running counts.
    """
    cells = _cells(units, spec, label)
    masks = _masks(spec.hamming, spec.max_hamming)
    by_size = _coefficients(len(spec.hamming), spec.max_hamming)
    weights = [by_size[len(m)] for m in masks]
    wide = _masked(cells, spec.hamming, masks, weights)
    keys = ["__side", *spec.equal, "__key"]
    pool = wide.withColumn("__side", 1 - F.col(label))
    asks = wide.withColumn("__side", F.col(label))
    if spec.numeric is None:
        held = pool.groupBy(*keys).agg(F.sum("__c").alias("__held"))
        hits = same_key_join(asks, held, keys).withColumn("__hit", F.col("__coef") * F.col("__held"))
    else:
        v = F.col(spec.numeric).cast("double")
        band = F.lit(float(spec.caliper))
        held = pool.where(_finite(v)).groupBy(*keys, v.alias("__at")).agg(F.sum("__c").alias("__w")).withColumn("__kind", F.lit(1))
        ends = asks.where(_finite(v)).select(
            *keys, F.explode(F.array(F.struct((v - band).alias("__at"), F.lit(0).alias("__kind")), F.struct((v + band).alias("__at"), F.lit(2).alias("__kind")))).alias("e")
        ).select(*keys, "e.*").distinct().withColumn("__w", F.lit(0).cast("long"))
        steps = running_total(held.unionByName(ends), keys, "__at", {"__w": F.col("__w")}, then=["__kind"])
        marks = steps.where(F.col("__kind") != 1).select(*keys, "__at", "__kind", F.col("__w_before").alias("__cum"))
        asked = asks.where(_finite(v)).withColumn("e", F.explode(F.array(F.struct((v - band).alias("__at"), F.lit(0).alias("__kind")), F.struct((v + band).alias("__at"), F.lit(2).alias("__kind"))))).select("*", "e.*").drop("e")
        hits = same_key_join(asked, marks, [*keys, "__at", "__kind"]).withColumn(
            "__hit", F.col("__coef") * F.when(F.col("__kind") == 2, F.col("__cum")).otherwise(-F.col("__cum"))
        )
    cell = [label, *spec.equal, *spec.hamming, *([spec.numeric] if spec.numeric else [])]
    per_cell = hits.groupBy(*cell).agg(F.sum("__hit").alias(out))
    joined = same_key_join(units, per_cell, cell, "left")
    return joined.withColumn(out, F.coalesce(out, F.lit(0)).cast("long"))


def _lattice(cells: DataFrame, spec: MatchSpec, label: str, answer, done):
    """Walks the subsets of differing fields by size, over covariate cells that are still open.

    At size s the open cells and the other side of their strata are spread over the subsets of s fields; ``answer`` gives
    ``(cell..., __new)`` structs, of which the least is kept; ``done(best, s)`` tells which cells no larger subset can
    improve. Cells leave as they are answered, so the 2^k subsets are formed for those only that need them.
    """
    cell = [label, *spec.equal, *spec.hamming, *([spec.numeric] if spec.numeric else [])]
    stratum = ["__side", *spec.equal]
    other = cut_lineage(cells.withColumn("__side", 1 - F.col(label)))
    asking = cells.withColumn("__side", F.col(label))
    asking = cut_lineage(same_key_join(asking, other.select(*stratum).distinct(), stratum, "left_semi"))  # no partner at all: no answer
    held: list[DataFrame] = []
    best = asking.select(*cell, F.lit(None).cast("struct<t: double, h: int, g: double>").alias("__best"))
    for size in range(len(spec.hamming) + 1):
        masks = list(combinations(range(len(spec.hamming)), size))
        zero = [0] * len(masks)
        strata = asking.select(*stratum).distinct()
        pool = _masked(same_key_join(other, strata, stratum, "left_semi"), spec.hamming, masks, zero)
        found = answer(_masked(asking, spec.hamming, masks, zero), pool, ["__side", *spec.equal, "__key"], cell)
        best = cut_lineage(same_key_join(best, found, cell, "left").withColumn("__best", F.least("__best", "__new")).drop("__new"))
        open_ = ~F.coalesce(done(F.col("__best"), size), F.lit(False))
        held.append(best.where(~open_))
        best = best.where(open_)
        if size == len(spec.hamming) or not best.limit(1).count():
            held.append(best)
            break
        asking = cut_lineage(same_key_join(asking, best.select(*cell), cell, "left_semi"))
    return reduce(DataFrame.unionByName, held), cell


def nearest_partner(units: DataFrame, label: str, spec: MatchSpec, scale: float) -> DataFrame:
    """Distance to the closest opposite-label unit equal on ``spec.equal``.

    Total = gap / ``scale`` + number of differing fields. For a subset of fields that may differ, the nearest numeric
    value is an as-of lookup; a larger subset costs at least one more, so a cell is done once its best total is at most
    the size of the next subset.
    """
    cells = _cells(units.where(_finite(F.col(spec.numeric))), spec, label).drop("__c")

    def answer(asks: DataFrame, pool: DataFrame, keys: list[str], cell: list[str]) -> DataFrame:
        near = nearest_value(asks, pool.select(*keys, spec.numeric), keys, spec.numeric, "__gap").where(F.col("__gap").isNotNull())
        total = F.round(F.col("__gap") / F.lit(scale) + F.col("__width"), 9)
        return near.groupBy(*cell).agg(F.min(F.struct(total.alias("t"), F.col("__width").alias("h"), F.col("__gap").alias("g"))).alias("__new"))

    best, cell = _lattice(cells, spec, label, answer, lambda b, size: b["t"] <= size + 1)
    return same_key_join(units, best, cell, "left").select(
        *units.columns,
        F.col("__best.g").alias("nearest_gap"),
        F.col("__best.h").alias("nearest_hamming"),
        F.col("__best.t").alias("nearest_total"),
    )


def nearest_mismatches(
    units: DataFrame, label: str, spec: MatchSpec, diagnostic: str | None = None
) -> DataFrame:
    """Fewest differing fields to any opposite-label unit equal on ``spec.equal``.

    With ``diagnostic``, also the share of fully matching partners that agree on that extra field.
    """
    bare = MatchSpec(equal=spec.equal, hamming=spec.hamming)
    cells = _cells(units, bare, label).drop("__c")

    def answer(asks: DataFrame, pool: DataFrame, keys: list[str], cell: list[str]) -> DataFrame:
        hit = same_key_join(asks, pool.select(*keys).distinct(), keys, "left_semi")
        new = F.struct(F.min("__width").cast("double").alias("t"), F.min("__width").alias("h"), F.lit(0.0).alias("g"))
        return hit.groupBy(*cell).agg(new.alias("__new"))

    best, cell = _lattice(cells, bare, label, answer, lambda b, size: b.isNotNull())
    best = best.select(*cell, F.col("__best.h").alias("nearest_mismatches"))
    out = same_key_join(units, best, cell, "left")
    if diagnostic:
        exact = [*spec.equal, *spec.hamming]
        flipped = units.withColumn(label, 1 - F.col(label))
        strict = flipped.groupBy(label, *exact).agg(F.count(F.lit(1)).alias("__s"))
        same = flipped.groupBy(label, *exact, diagnostic).agg(F.count(F.lit(1)).alias("__d"))
        out = same_key_join(out, strict, [label, *exact], "left")
        out = same_key_join(out, same, [label, *exact, diagnostic], "left")
        share = F.when(F.col("__s") > 0, F.coalesce(F.col("__d"), F.lit(0)) / F.col("__s"))
        out = out.withColumn("strict_agreement", share).drop("__s", "__d")
    return out


def cross_domain_positives(units: DataFrame, label: str, domain: str, out: str = "n_positive") -> DataFrame:
    """Per unit, same-label units of other domains: n(label) - n(label, domain)."""
    per = units.groupBy(label, domain).agg(F.count(F.lit(1)).alias("__d"))
    total = per.groupBy(label).agg(F.sum("__d").alias("__l"))
    counts = per.join(total, label).select(label, domain, (F.col("__l") - F.col("__d")).alias(out))
    return same_key_join(units, counts, [label, domain])


def positive_tiers(
    units: DataFrame, label: str, source: str, first: str, second: str, enough: int = 2
) -> DataFrame:
    """Same-label units of other sources, split by how many of two attributes differ (0, 1, 2).

    ``n_best`` is the size of the most different tier that has at least ``enough`` units, else 0.
    All counts come from cell counts by inclusion-exclusion.
    """
    cell = [label, source, first, second]
    cells = units.groupBy(*cell).agg(F.count(F.lit(1)).alias("__n"))

    def other_source(keys: Sequence[str], name: str) -> DataFrame:
        whole = cells.groupBy(label, *keys).agg(F.sum("__n").alias("__w"))
        own = cells.groupBy(label, source, *keys).agg(F.sum("__n").alias("__o"))
        both = same_key_join(own, whole, [label, *keys])
        return both.select(label, source, *keys, (F.col("__w") - F.col("__o")).alias(name))

    out = same_key_join(cells, other_source([], "__any"), [label, source])
    out = same_key_join(out, other_source([first], "__first"), [label, source, first])
    out = same_key_join(out, other_source([second], "__second"), [label, source, second])
    out = same_key_join(out, other_source([first, second], "__both"), [label, source, first, second])
    two = F.col("__any") - F.col("__first") - F.col("__second") + F.col("__both")
    tiers = out.select(
        *cell,
        F.col("__any").alias("n_other_source"),
        two.alias("n_differ_2"),
        (F.col("__any") - two - F.col("__both")).alias("n_differ_1"),
        F.col("__both").alias("n_differ_0"),
    )
    best = F.coalesce(*[F.when(F.col(f"n_differ_{d}") >= enough, F.col(f"n_differ_{d}")) for d in (2, 1, 0)], F.lit(0))
    return same_key_join(units, tiers.withColumn("n_best", best), cell)


def agreement_share(fields: Sequence[str], other: str = "donor_") -> Column:
    """Share of jointly stated fields that agree, for listed pairs with ``<field>`` and ``<other><field>``."""
    both = [F.col(f).isNotNull() & F.col(f"{other}{f}").isNotNull() for f in fields]
    stated = reduce(lambda a, b: a + b, [b.cast("int") for b in both])
    equal = reduce(lambda a, b: a + b, [(b & (F.col(f) == F.col(f"{other}{f}"))).cast("int") for b, f in zip(both, fields)])
    return F.when(stated > 0, equal / stated).otherwise(F.lit(0.0))


def agreement_targets(
    df: DataFrame, batch: str, fields: Sequence[str], threshold: float = 0.75, power: int = 4
) -> DataFrame:
    """Normalising totals of the target weights inside training batches, per distinct record of a batch.

    Agreement of two records is the share of jointly stated fields that are equal. The weights of an
    anchor row are ``exact`` (full agreement), ``soft`` (the share) and ``sharp`` (share^power from
    the threshold on); the anchor itself always weighs 1.

    No pairs are formed. Every record is counted under each subset of its stated fields; a count
    under subset S covers all records that agree at least on S, and inclusion-exclusion over S
    turns the weight of 'agrees on exactly e of m fields' into one coefficient per (size of S, m).
    """
    k = len(fields)
    stated = F.expr(" + ".join(f"IF(`{f}` IS NULL, 0, {1 << i})" for i, f in enumerate(fields)))
    records = cut_lineage(df.groupBy(batch, *fields).agg(F.count(F.lit(1)).alias("n"))).withColumn("__have", stated)
    subsets = F.array(*[F.lit(m) for m in range(1 << k)])
    spread = records.withColumn("__s", F.explode(subsets)).where(F.col("__s").bitwiseAND(F.col("__have")) == F.col("__s"))
    shown = [
        F.when(F.col("__s").bitwiseAND(F.lit(1 << i)) > 0, F.col(f).cast("string")).otherwise(F.lit("*"))
        for i, f in enumerate(fields)
    ]
    spread = spread.withColumn("__key", F.concat_ws("\u0001", F.col("__s").cast("string"), *shown))
    pool = spread.groupBy(batch, "__key", F.col("__have").alias("__other")).agg(F.sum("n").alias("__m"))
    weights = {
        "exact_total": lambda v: float(v >= 1.0 - 1e-6),
        "soft_total": lambda v: v,
        "sharp_total": lambda v: v**power if v >= threshold else 0.0,
    }

    def coefficient(weight, size: int, joint: int) -> float:
        if joint == 0:
            return 0.0
        return sum((-1) ** (size - e) * comb(size, e) * weight(e / joint) for e in range(size + 1))

    joint = F.bit_count(F.col("__have").bitwiseAND(F.col("__other")))
    cell = F.bit_count("__s") * (k + 1) + joint + 1
    j = same_key_join(spread, pool, [batch, "__key"])
    sums = []
    for name, weight in weights.items():
        table = F.array(*[F.lit(coefficient(weight, s, m)) for s in range(k + 1) for m in range(k + 1)])
        lonely = F.when(F.max("__have") == 0, F.lit(1.0)).otherwise(F.lit(0.0))
        sums.append((F.sum(F.element_at(table, cell) * F.col("__m")) + lonely).alias(name))
    return j.groupBy(batch, *fields, "n").agg(*sums)
