"""Covariate balance between the two label sides, and greedy trimming of a pair table to balance."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import or_missing, smd_continuous, smd_level
from tessera.operators.joins import same_key_join
from tessera.operators.ranked import ranked
from tessera.session import cut_lineage

NEG_POS = ("negative", "positive")


def _oriented(neg: Column, pos: Column, direction: str) -> tuple[Column, Column]:
    if direction == "negative-positive":
        return neg, pos
    if direction == "positive-negative":
        return pos, neg
    raise ValueError(direction)


def continuous_smd(
    df: DataFrame, label: str, fields: Sequence[str], by: Sequence[str] = (), direction: str = "negative-positive"
) -> DataFrame:
    """Standardised mean difference per numeric field, sample variances, rows with a value only."""
    cells = df.select(*by, label, *[F.col(f).cast("double").alias(f) for f in fields]).unpivot(
        [*by, label], list(fields), "field", "value"
    )
    side = lambda s: F.when(F.col(label) == s, F.col("value"))
    g = cells.groupBy(*by, "field").agg(
        F.avg(side(0)).alias("m0"),
        F.avg(side(1)).alias("m1"),
        F.var_samp(side(0)).alias("v0"),
        F.var_samp(side(1)).alias("v1"),
        F.count(side(0)).alias("n0"),
        F.count(side(1)).alias("n1"),
    )
    (ma, mb), (va, vb) = _oriented(F.col("m0"), F.col("m1"), direction), _oriented(F.col("v0"), F.col("v1"), direction)
    return g.select(*by, "field", "n0", "n1", "m0", "m1", smd_continuous(ma, va, mb, vb).alias("smd"))


def level_smd(
    df: DataFrame, label: str, fields: Sequence[str], by: Sequence[str] = (), direction: str = "negative-positive"
) -> DataFrame:
    """Standardised and plain difference of the share of every category level."""
    cells = df.select(*by, label, *[or_missing(F.col(f)).alias(f) for f in fields]).unpivot(
        [*by, label], list(fields), "field", "level"
    )
    count = lambda s: F.sum((F.col(label) == s).cast("long"))
    levels = cells.groupBy(*by, "field", "level").agg(count(0).alias("c0"), count(1).alias("c1"))
    totals = df.groupBy(*by).agg(count(0).alias("n0"), count(1).alias("n1"))
    if by:
        joined = same_key_join(levels, totals, by)
    else:
        joined = levels.withColumn("__t", totals.select(F.struct("n0", "n1")).scalar()).select("*", "__t.*").drop("__t")
    p0, p1 = F.col("c0") / F.col("n0"), F.col("c1") / F.col("n1")
    pa, pb = _oriented(p0, p1, direction)
    return joined.select(
        *by, "field", "level", "n0", "n1", p0.alias("p0"), p1.alias("p1"),
        smd_level(pa, pb).alias("smd"), (pa - pb).alias("difference"),
    )


def balance_summary(
    df: DataFrame,
    label: str,
    continuous: Sequence[str],
    categorical: Sequence[str],
    by: Sequence[str] = (),
    max_smd: float = 0.12,
    max_difference: float = 0.08,
) -> DataFrame:
    """Largest absolute SMD and level difference, the scaled objective, and whether both limits hold."""
    parts = []
    if continuous:
        parts.append(
            continuous_smd(df, label, continuous, by).select(*by, "smd", F.lit(0.0).alias("difference"))
        )
    if categorical:
        parts.append(level_smd(df, label, categorical, by).select(*by, "smd", "difference"))
    rows = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    g = rows.groupBy(*by).agg(
        F.max(F.abs("smd")).alias("max_abs_smd"), F.max(F.abs("difference")).alias("max_difference")
    )
    objective = F.greatest(F.col("max_abs_smd") / max_smd, F.col("max_difference") / max_difference)
    return g.withColumns({"objective": objective, "passed": objective <= 1.0})


def pair_values(pairs: DataFrame, units: DataFrame, unit: str, fields: Sequence[str]) -> DataFrame:
    """Pair table with ``neg_<field>`` and ``pos_<field>``."""
    neg = units.select(F.col(unit).alias("negative_id"), *[F.col(f).alias(f"neg_{f}") for f in fields])
    pos = units.select(F.col(unit).alias("positive_id"), *[F.col(f).alias(f"pos_{f}") for f in fields])
    return pairs.join(neg, "negative_id").join(pos, "positive_id")


def exact_mismatches(wide: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Per exact field, the number of pairs that disagree."""
    bad = [F.sum((~F.col(f"neg_{f}").eqNullSafe(F.col(f"pos_{f}"))).cast("long")).alias(f) for f in fields]
    return wide.agg(*bad).unpivot([], list(fields), "field", "n_mismatch")


def _patterns(fields: Sequence[str]) -> list[str]:
    return [f"{side}_{f}" for f in fields for side in ("neg", "pos")]


def _both(f: str) -> tuple[Column, Column, Column]:
    """Both sides of a numeric field, and whether both are finite values."""
    a, b = F.col(f"neg_{f}").cast("double"), F.col(f"pos_{f}").cast("double")
    return a, b, F.coalesce((F.abs(a) < float("inf")) & (F.abs(b) < float("inf")), F.lit(False))


def _level_gap(pa: Column, pb: Column, max_smd: float, max_difference: float) -> Column:
    return F.greatest(F.abs(smd_level(pa, pb)) / max_smd, F.abs(pa - pb) / max_difference)


def removal_objectives(
    wide: DataFrame,
    continuous: Sequence[str],
    categorical: Sequence[str],
    max_smd: float = 0.12,
    max_difference: float = 0.08,
) -> DataFrame:
    """For every pair, the balance objective of the table without it, in closed form.

    Pairs that agree in all fields form a class and share one objective, so the work is done per class. Sums over all
    pairs are one aggregate row, from which a class subtracts its own values. Removing a pair changes the counts of at
    most two levels of a field; of the others only the worst matters, which is among the three worst of the field.
    """
    pattern = _patterns([*continuous, *categorical])
    classes = cut_lineage(wide.groupBy(*pattern).agg(F.count(F.lit(1)).alias("__n")).withColumn("__class", F.monotonically_increasing_id()))
    n = F.col("__n")
    sums: list[Column] = [F.sum("__n").alias("n")]
    for f in continuous:
        a, b, seen = _both(f)
        for name, v in (("a", a), ("b", b), ("aa", a * a), ("bb", b * b)):
            sums.append(F.coalesce(F.sum(F.when(seen, n * v)), F.lit(0.0)).alias(f"{name}_{f}"))
        sums.append(F.coalesce(F.sum(F.when(seen, n)), F.lit(0)).alias(f"k_{f}"))
    totals = classes.agg(*sums)
    totals = totals.select(F.struct(*totals.columns))
    base = classes.withColumn("__t", totals.scalar())
    after = F.col("__t.n") - 1
    worst: list[Column] = [F.lit(0.0)]
    for f in continuous:
        a, b, seen = _both(f)
        own = lambda v: F.when(seen, v).otherwise(F.lit(0.0))  # noqa: B023, E731
        k = F.col(f"__t.k_{f}") - seen.cast("long")
        mean, var = [], []
        for name, v in (("a", a), ("b", b)):
            s = F.col(f"__t.{name}_{f}") - own(v)
            ss = F.col(f"__t.{name}{name}_{f}") - own(v * v)
            mean.append(s / k)
            var.append(F.greatest((ss - s * s / k) / (k - 1), F.lit(0.0)))
        value = smd_continuous(mean[0], var[0], mean[1], var[1])
        worst.append(F.when(k >= 2, F.abs(value) / max_smd).otherwise(F.lit(float("inf"))))
    if categorical:
        gap = lambda ca, cb: _level_gap(ca / after, cb / after, max_smd, max_difference)
        cells = classes.select(
            "__class", "__n",
            F.explode(F.array(*[
                F.struct(F.lit(f).alias("field"), or_missing(F.col(f"neg_{f}")).alias("ln"), or_missing(F.col(f"pos_{f}")).alias("lp")) for f in categorical
            ])).alias("c"),
        ).select("__class", "__n", "c.*")
        side = lambda level, i: F.struct(F.col(level).alias("level"), F.when(F.lit(i == 0), n).otherwise(0).alias("a"), F.when(F.lit(i == 1), n).otherwise(0).alias("b"))
        levels = (
            cells.select("field", F.explode(F.array(side("ln", 0), side("lp", 1))).alias("s"))
            .groupBy("field", "s.level").agg(F.sum("s.a").alias("ca"), F.sum("s.b").alias("cb"))
        )
        levels = cut_lineage(levels.withColumn("__t", totals.scalar()).withColumn("gap", gap(F.col("ca"), F.col("cb"))).drop("__t"))
        place = F.row_number().over(Window.partitionBy("field").orderBy(F.desc("gap"), "level"))
        three = levels.withColumn("k", place).where("k <= 3").groupBy("field").agg(F.collect_list(F.struct("level", "gap")).alias("three"))
        n_side = levels.select("field", F.col("level").alias("ln"), F.col("ca").alias("can"), F.col("cb").alias("cbn"))
        p_side = levels.select("field", F.col("level").alias("lp"), F.col("ca").alias("cap"), F.col("cb").alias("cbp"))
        judged = cells.join(n_side, ["field", "ln"]).join(p_side, ["field", "lp"]).join(three, "field").withColumn("__t", totals.scalar())
        equal = (F.col("ln") == F.col("lp")).cast("long")
        others = F.filter("three", lambda x: (x["level"] != F.col("ln")) & (x["level"] != F.col("lp")))
        own_gap = F.greatest(
            gap(F.col("can") - 1, F.col("cbn") - equal), gap(F.col("cap") - equal, F.col("cbp") - 1), F.coalesce(F.array_max(F.transform(others, lambda x: x["gap"])), F.lit(0.0))
        )
        per_class = judged.groupBy("__class").agg(F.max(own_gap).alias("__levels"))
        base = base.join(per_class, "__class")
        worst.append(F.col("__levels"))
    objective = F.when(after < 1, F.lit(float("inf"))).otherwise(F.greatest(*worst))
    found = base.select(*pattern, objective.alias("objective_without"))
    return same_key_join(wide, found, pattern)


#: Pairs whose classes one task may hold while it trims (8 bytes a pair, and the fields of a class).
PAIRS_IN_TASK = 4_000_000


def trim_pairs(
    wide: DataFrame,
    continuous: Sequence[str],
    categorical: Sequence[str],
    minimum: int,
    max_smd: float = 0.12,
    max_difference: float = 0.08,
    to_minimum: bool = False,
) -> DataFrame:
    """Remove the pair whose removal helps most until balance holds (or exactly ``minimum`` remain).

    The exact greedy path; of equal objectives the least ``pair_id`` goes. Each step depends on the one before, so
    the path is walked in one task, over classes of pairs that agree in all fields: Spark ranks the pairs and
    aggregates the classes; the task gets a class's fields and ranks, and returns the ranks to remove. A step bounds
    the objective over blocks of classes and judges only those that may be best, so its time grows with about the root
    of the number of classes. Above ``PAIRS_IN_TASK`` pairs every step is a round of jobs over the whole table instead,
    with the same result.
    """
    pattern = _patterns([*continuous, *categorical])
    current = cut_lineage(ranked(wide, [], "pair_id", out="__rank"))
    n = current.count()
    if n <= minimum:
        return current.drop("__rank")
    walk = _Walk(list(continuous), list(categorical), minimum, max_smd, max_difference, to_minimum)
    if n > PAIRS_IN_TASK:
        return _trimmed_by_rounds(current, walk).drop("__rank")
    typed = [F.col(c).cast("double").alias(c) for c in _patterns(continuous)] + [or_missing(F.col(c)).alias(c) for c in _patterns(categorical)]
    classes = current.select("__rank", *typed).groupBy(*pattern).agg(F.sort_array(F.collect_list("__rank")).alias("ranks"))  # at most PAIRS_IN_TASK in all
    removed = cut_lineage(classes.repartition(1).mapInPandas(walk.removed, "__rank long"))  # walked once, however often it is read
    return current.join(removed, "__rank", "left_anti").drop("__rank")


def _trimmed_by_rounds(current: DataFrame, walk: _Walk) -> DataFrame:
    n = current.count()
    fields = (walk.continuous, walk.categorical, walk.max_smd, walk.max_difference)
    while n > walk.minimum:
        if not walk.to_minimum:
            row = balance_summary(_long_sides(current, [*walk.continuous, *walk.categorical]), "side", fields[0], fields[1], (), *fields[2:]).first()
            if row["objective"] is None or row["objective"] <= 1.0:
                break
        first = removal_objectives(current, *fields).orderBy("objective_without", "pair_id").limit(1).select("pair_id")
        current, n = cut_lineage(current.join(first, "pair_id", "left_anti")), n - 1
    return current


@dataclass(frozen=True)
class _Walk:
    """The greedy path over the classes of a pair table."""

    continuous: list[str]
    categorical: list[str]
    minimum: int
    max_smd: float
    max_difference: float
    to_minimum: bool

    def _gap(self, pa: np.ndarray, pb: np.ndarray) -> np.ndarray:
        scale, difference = np.sqrt(np.maximum(pa * (1 - pa) + pb * (1 - pb), 0.0) / 2), np.abs(pa - pb)  # classes without pairs may lie outside [0, 1]
        smd = np.divide(difference, scale, out=np.where(difference == 0, 0.0, np.inf), where=scale > 0)
        return np.maximum(smd / self.max_smd, difference / self.max_difference)

    def removed(self, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        classes = pd.concat(list(batches), ignore_index=True)
        if classes.empty:
            return
        path, out = _Path(self, classes), []
        while path.n > self.minimum and (self.to_minimum or path.objective() > 1.0):
            out.append(path.remove(path.best()))
        yield pd.DataFrame({"__rank": np.array(out, np.int64)})


class _Numeric:
    """A numeric field of the classes: values, running sums over the pairs left, and the box of every block."""

    def __init__(self, a: np.ndarray, b: np.ndarray, left: np.ndarray):
        self.seen = (np.isfinite(a) & np.isfinite(b)).astype(float)
        self.a, self.b = np.where(self.seen > 0, a, 0.0), np.where(self.seen > 0, b, 0.0)
        total = lambda v: (left * self.seen * v).sum(dtype=np.longdouble)
        self.sums = [total(v) for v in (1.0, self.a, self.b, self.a * self.a, self.b * self.b)]  # in more digits, since they run over the whole path
        some = self.seen > 0
        self.reach = [(np.longdouble(v[some].min()), np.longdouble(v[some].max())) if some.any() else (np.longdouble(0),) * 2 for v in (self.a, self.b, self.a - self.b)]
        self.unseen = None if some.all() else np.flatnonzero(~some)[:1]

    def remove(self, i: int) -> None:
        a, b = np.longdouble(self.a[i]), np.longdouble(self.b[i])
        self.sums = [s - self.seen[i] * v for s, v in zip(self.sums, (1, a, b, a * a, b * b), strict=True)]

    def without(self, at: np.ndarray | None, max_smd: float) -> np.ndarray:
        """Scaled SMD without one pair of the classes ``at``; of all pairs for None."""
        n, sa, sb, saa, sbb = (float(s) for s in self.sums)
        a, b, seen = (np.zeros(1),) * 3 if at is None else (self.a[at], self.b[at], self.seen[at])
        k, mean, var = n - seen, [], []
        with np.errstate(divide="ignore", invalid="ignore"):
            for v, s, ss in ((a, sa, saa), (b, sb, sbb)):
                s, ss = s - v, ss - v * v
                mean.append(s / k)
                var.append(np.maximum((ss - s * s / k) / (k - 1), 0.0))
            pooled, gap = np.sqrt((var[0] + var[1]) / 2), np.abs(mean[0] - mean[1])
            smd = np.where(pooled > 0, gap / pooled, np.where(gap == 0, 0.0, np.inf))
        return np.where(k >= 2, smd / max_smd, np.inf)

    def drift(self, then: Sequence[np.longdouble], max_smd: float) -> float:
        """A lower limit, over all classes, of :meth:`without` now by its value at the sums ``then``; 0 if unknown.

        The gap's quotient is monotone in a - b; the variance has moved by a concave quadratic in a and b.
        """
        (n0, sa0, sb0, saa0, sbb0), (n1, sa1, sb1, saa1, sbb1) = then, self.sums
        k0, k1 = n0 - 1, n1 - 1
        if k1 < 2:
            return 0.0
        gap0, gap1 = [sa0 - sb0 - d for d in self.reach[2]], [sa1 - sb1 - d for d in self.reach[2]]
        if not (min(gap0) > 0 and min(gap1) > 0 or max(gap0) < 0 and max(gap1) < 0):
            return 0.0
        gap = min(g1 / g0 for g0, g1 in zip(gap0, gap1, strict=True)) * k0 / k1
        moved, least, most = np.longdouble(0), np.longdouble(0), np.longdouble(0)
        c2 = (1 + 1 / k0) / (k0 - 1) - (1 + 1 / k1) / (k1 - 1)
        for (lo, hi), s0, ss0, s1, ss1 in ((self.reach[0], sa0, saa0, sa1, saa1), (self.reach[1], sb0, sbb0, sb1, sbb1)):
            c0 = (ss1 - s1 * s1 / k1) / (k1 - 1) - (ss0 - s0 * s0 / k0) / (k0 - 1)
            c1 = 2 * s1 / (k1 * (k1 - 1)) - 2 * s0 / (k0 * (k0 - 1))
            moved += c0 + max(c1 * v + c2 * v * v for v in (lo, hi, min(max(-c1 / (2 * c2), lo), hi) if c2 < 0 else lo))
            then_var = lambda v, s0=s0, ss0=ss0: (ss0 - v * v - (s0 - v) ** 2 / k0) / (k0 - 1)
            least, most = least + min(then_var(lo), then_var(hi)), most + then_var(min(max(s0 / n0, lo), hi))
        grown = 1 + moved / (least if moved > 0 else most) if least > 0 else np.longdouble(0)
        out = gap / np.sqrt(grown) if grown > 0 else 0.0
        if self.unseen is not None:
            before, now = self._plain(then, max_smd), self._plain(self.sums, max_smd)
            out = min(out, now / before if 0 < before < np.inf else 0.0)
        return float(out) * (1 - 1e-12)

    def _plain(self, sums: Sequence[np.longdouble], max_smd: float) -> float:
        """:meth:`without` for a class that has no value, at the given sums."""
        now, self.sums = self.sums, list(sums)
        try:
            return float(self.without(self.unseen, max_smd)[0])
        finally:
            self.sums = now

    def boxed(self, blocks: np.ndarray) -> None:
        self.box = np.zeros((7, len(blocks)))
        for i in range(len(blocks)):
            self.fit(i, blocks[i][blocks[i] >= 0])

    def fit(self, i: int, at: np.ndarray) -> None:
        """The box of block ``i`` around the classes ``at``; its classes are alike in having a value."""
        if len(at):
            a, b = self.a[at], self.b[at]
            d = a - b
            self.box[:, i] = a.min(), a.max(), b.min(), b.max(), d.min(), d.max(), self.seen[at[0]]

    def bounds(self, max_smd: float, upper: bool) -> tuple[np.ndarray, np.ndarray | None]:
        """Limits of :meth:`without` over each block, with room for rounding.

        The gap of the means is linear in a - b. A variance without a value is concave in it: least at an end of the
        block's range, greatest at the value next to the mean.
        """
        n, sa, sb, saa, sbb = (float(s) for s in self.sums)
        a0, a1, b0, b1, d0, d1, seen = self.box
        k = np.maximum(n - seen, 2.0)
        room_gap = 1e-14 * (abs(sa) + abs(sb) + saa**0.5 + sbb**0.5) / k
        room_var = 1e-13 * (saa + sbb) / (k - 1)
        var = lambda v, s, ss: (ss - v * v - (s - v) ** 2 / k) / (k - 1)
        top = (var(np.minimum(np.maximum(sa / (k + 1), a0), a1), sa, saa) + var(np.minimum(np.maximum(sb / (k + 1), b0), b1), sb, sbb)) / 2 + room_var
        near = np.maximum(np.maximum(sa - sb - d1, d0 - (sa - sb)) / k - room_gap, 0.0)
        low = np.where(top > 0, near / np.sqrt(np.where(top > 0, top, 1.0)), 0.0) * ((1 - 1e-12) / max_smd)
        few = n - seen < 2
        low = np.where(few, np.inf, low)
        if not upper:
            return low, None
        least = (np.minimum(var(a0, sa, saa), var(a1, sa, saa)) + np.minimum(var(b0, sb, sbb), var(b1, sb, sbb))) / 2 - room_var
        far = np.maximum(np.abs(sa - sb - d0), np.abs(sa - sb - d1)) / k + room_gap
        high = np.where(least > 0, far / np.sqrt(np.where(least > 0, least, 1.0)), np.inf) * ((1 + 1e-12) / max_smd)
        return low, np.where(few, np.inf, high)


#: Blocks judged together, and the fewest classes a pattern of levels must have on average for blocks of one pattern.
_AT_ONCE = 16
_OF_ONE_PATTERN = 512


class _Path:
    """State of the greedy path. A step judges a short list of classes if the best one is sure to stand there. Else it
    bounds the objective over blocks of classes near each other in the numeric fields, and judges one by one only the
    classes of blocks, or of patterns of levels, that may hold the best one."""

    def __init__(self, walk: _Walk, classes: pd.DataFrame):
        self.walk = walk
        self.ranks = [np.asarray(r, np.int64) for r in classes.ranks]
        self.left = np.array([len(r) for r in self.ranks])
        self.head = np.array([r[0] for r in self.ranks])
        self.n = int(self.left.sum())
        weight = self.left.astype(float)
        self.numeric = [_Numeric(classes[f"neg_{f}"].to_numpy(float), classes[f"pos_{f}"].to_numpy(float), weight) for f in walk.continuous]
        size, codes, self.counts = len(classes), [], []
        for f in walk.categorical:
            both, names = pd.factorize(pd.concat([classes[f"neg_{f}"], classes[f"pos_{f}"]]))
            ln, lp = both[:size], both[size:]
            codes += [ln, lp]
            self.counts.append((np.bincount(ln, weight, len(names)), np.bincount(lp, weight, len(names))))
        patterns, self.pattern = np.unique(np.stack(codes, axis=1), axis=0, return_inverse=True) if codes else (np.zeros((1, 0), int), np.zeros(size, int))
        self.pattern = self.pattern.ravel()
        self.levels = [(patterns[:, 2 * i], patterns[:, 2 * i + 1]) for i in range(len(walk.categorical))]
        self.alive = np.bincount(self.pattern, minlength=len(patterns))
        self.by_pattern, self.ends = np.argsort(self.pattern, kind="stable"), np.cumsum(self.alive)
        self.pure = size >= _OF_ONE_PATTERN * len(patterns) or len(patterns) == 1
        alike = np.stack([x.seen for x in self.numeric] + [self.pattern if self.pure else np.zeros(size)], axis=1)
        width = max(32, int(size**0.5 / 5))
        parts = _near(alike, [v for x in self.numeric for v in (x.a, x.b)], width)
        self.blocks = np.full((len(parts), width), -1)
        for i, part in enumerate(parts):
            self.blocks[i, : len(part)] = part
        self.block = np.empty(size, int)
        self.block[self.blocks[self.blocks >= 0]] = np.nonzero(self.blocks >= 0)[0]
        for x in self.numeric:
            x.boxed(self.blocks)
        self.of = self.pattern[self.blocks[:, 0]]
        self.first = np.array([self.head[p].min() for p in parts])
        self.filled = np.array([len(p) for p in parts])
        self.short, self.limit, self.then = None, 0.0, []
        self.lasted, self.wait, self.pause = 0, 0, 1

    def objective(self) -> float:
        parts = [float(x.without(None, self.walk.max_smd)[0]) for x in self.numeric]
        return max([0.0, *parts, *[float(self.walk._gap(ca / self.n, cb / self.n).max()) for ca, cb in self.counts]])

    def _worst_levels(self) -> np.ndarray:
        """Per pattern the worst gap of any level without one of its pairs; inf for a pattern that has none."""
        out, after, gap = np.zeros(len(self.alive)), self.n - 1, self.walk._gap
        for (ca, cb), (ln, lp) in zip(self.counts, self.levels, strict=True):
            gaps = gap(ca / after, cb / after)
            worst, equal = np.argsort(-gaps, kind="stable")[:3], ln == lp
            others = np.where((worst[:, None] == ln) | (worst[:, None] == lp), 0.0, gaps[worst][:, None]).max(axis=0)
            own = np.maximum(gap((ca[ln] - 1) / after, (cb[ln] - equal) / after), gap((ca[lp] - equal) / after, (cb[lp] - 1) / after))
            out = np.maximum(out, np.maximum(others, own))
        return np.where(self.alive > 0, out, np.inf)

    def _of_short(self, levels: np.ndarray) -> int | None:
        """The best class if it is sure to stand in the short list: of the classes with the least numeric objective when
        the list was made. All others had ``limit`` at least, and have since kept a share of it that :meth:`drift` gives.
        """
        max_smd = self.walk.max_smd
        for fresh in (False, True):
            if fresh:
                self.wait -= 1
                if self.wait > 0:
                    return None
                items = np.flatnonzero(self.left > 0)
                size = 4 * int(len(items) ** 0.5)
                if not self.numeric or len(items) <= 2 * size:
                    return None
                values = np.maximum.reduce([x.without(items, max_smd) for x in self.numeric])
                place = np.argpartition(values, size)
                self.short, self.limit, self.then = items[place[:size]], float(values[place[size]]), [x.sums for x in self.numeric]
                self.lasted = 0
            if self.short is None:
                continue
            items = self.short[self.left[self.short] > 0]
            if len(items):
                values = np.maximum.reduce([levels[self.pattern[items]], *[x.without(items, max_smd) for x in self.numeric]])
                least = values.min()
                if least < self.limit * min(x.drift(t, max_smd) for x, t in zip(self.numeric, self.then, strict=True)):
                    self.lasted += 1
                    tied = items[values == least]
                    return int(tied[np.argmin(self.head[tied])])
            self.short = None
            if fresh or self.lasted < 16:  # a list that does not last is made less often
                self.wait = self.pause = min(2 * self.pause, 4096)
            else:
                self.wait = self.pause = 1
        return None

    def best(self) -> int:
        """The class whose pair is best removed; of equal ones that of the least rank."""
        if self.n < 2:
            return int(np.argmax(self.left > 0))
        levels, max_smd = self._worst_levels(), self.walk.max_smd
        found = self._of_short(levels)
        if found is not None:
            return found
        floor = levels[self.of] if self.pure else np.full(len(self.blocks), levels.min())
        open_, high = self.filled > 0, np.zeros(len(floor))
        known = floor
        for x in self.numeric:
            low, top = x.bounds(max_smd, self.pure)
            floor = np.maximum(floor, low)
            high = np.maximum(high, top) if self.pure else high
        value, at = np.inf, -1

        def judge(items: np.ndarray) -> None:
            nonlocal value, at
            values = levels[self.pattern[items]]
            for x in self.numeric:
                values = np.maximum(values, x.without(items, max_smd))
            least = values.min()
            if least <= value:
                tied = items[values == least]
                i = tied[np.argmin(self.head[tied])]
                if least < value or at < 0 or self.head[i] < self.head[at]:
                    value, at = least, int(i)

        if self.pure:  # blocks whose levels decide have one value: their least rank is enough
            whole = np.flatnonzero(open_ & (high <= known))
            if len(whole):
                open_[whole] = False
                tied = whole[known[whole] == known[whole].min()]
                row = self.blocks[tied[np.argmin(self.first[tied])]]
                judge(row[row >= 0])
        while True:
            todo = np.flatnonzero(open_ & (floor <= value))
            if not len(todo):
                return at
            if at >= 0 and not self.pure:
                few = np.flatnonzero(levels <= value)
                if self.alive[few].sum() < self.filled[todo].sum():
                    items = np.concatenate([self.by_pattern[self.ends[p - 1] if p else 0 : self.ends[p]] for p in few])
                    judge(items[self.left[items] > 0])
                    return at
            if len(todo) > 2 * _AT_ONCE:
                todo = todo[np.argpartition(floor[todo], _AT_ONCE)[:_AT_ONCE]]
            open_[todo] = False
            items = self.blocks[todo].ravel()
            judge(items[items >= 0])

    def remove(self, i: int) -> int:
        """Takes the least rank of class ``i``."""
        rank, b, p = int(self.head[i]), self.block[i], self.pattern[i]
        self.n -= 1
        self.left[i] -= 1
        for x in self.numeric:
            x.remove(i)
        for (ca, cb), (ln, lp) in zip(self.counts, self.levels, strict=True):
            ca[ln[p]] -= 1
            cb[lp[p]] -= 1
        if self.left[i]:
            self.head[i] = self.ranks[i][-self.left[i]]
        else:
            self.alive[p] -= 1
            self.filled[b] -= 1
            self.blocks[b][self.blocks[b] == i] = -1
        at = self.blocks[b][self.blocks[b] >= 0]
        if len(at):
            self.first[b] = self.head[at].min()
            if not self.left[i]:
                for x in self.numeric:
                    x.fit(b, at)
        return rank


def _near(alike: np.ndarray, values: list[np.ndarray], width: int) -> list[np.ndarray]:
    """Rows in blocks of at most ``width`` that agree in ``alike``, halved at the median of the widest of ``values``."""
    _, group = np.unique(alike, axis=0, return_inverse=True)
    order = np.argsort(group.ravel(), kind="stable")
    todo = np.split(order, np.cumsum(np.bincount(group.ravel()))[:-1])
    scale = [max(float(v.std()), 1e-300) for v in values]
    out = []
    while todo:
        rows = todo.pop()
        if len(rows) <= width:
            out.append(rows)
            continue
        if values:
            v = max(((v[rows] / s) for v, s in zip(values, scale, strict=True)), key=np.ptp)
            rows = rows[np.argpartition(v, len(rows) // 2)]
        todo += [rows[: len(rows) // 2], rows[len(rows) // 2 :]]
    return out


def _long_sides(wide: DataFrame, fields: Sequence[str]) -> DataFrame:
    """One row per pair member, labelled by side."""
    row = lambda i, s: F.struct(F.lit(i).alias("side"), *[F.col(f"{s}_{f}").alias(f) for f in fields])
    return wide.select("pair_id", F.explode(F.array(row(0, "neg"), row(1, "pos"))).alias("m")).select("pair_id", "m.*")
