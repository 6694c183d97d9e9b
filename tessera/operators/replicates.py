"""Many replicates of a statistic in one pass: arrays over replicates, not a row for each.

A row of data carries the draws of its unit as two short lists (replicate numbers and how often the unit was drawn). A task
adds its rows up into one array over replicates per cell; the tasks' arrays are added in two levels, so no task reads more
than a share of them. Logistic fits take Newton steps for all cells and replicates at once, AUROC adds arrays over ranges
of the score. The only tables that leave Spark are coefficients: cells x replicates, of ``MOST_FITS`` at a time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import hash_below, hash_unit, poisson_weight, salted_sha
from tessera.operators.joins import same_key_join
from tessera.operators.ranked import range_edges, with_range_bucket
from tessera.session import cut_lineage

#: Replicates worked on at a time, and the most coefficients pairs that tasks are sent at once.
BLOCK = 256
MOST_FITS = 250_000

#: Values of one array operation in a task.
_CHUNK = 2 << 20

#: Partial arrays of a cell that one task adds at the first level.
_FAN_IN = 256

#: Rows behind one range of scores, and the most ranges.
_RANGE_ROWS = 200_000
_MOST_RANGES = 4096


def keyed(df: DataFrame, cell: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """``df`` with the cell as one text column ``__key``, and the table (cell..., __key)."""
    key = F.to_json(F.struct(*[F.col(c) for c in cell]), {"ignoreNullFields": "false"}) if cell else F.lit("")
    df = df.withColumn("__key", key)
    return df, df.select(*cell, "__key").distinct()


def draw_lists(draws: DataFrame, unit: Sequence[str]) -> DataFrame:
    """``(unit..., rep, times)`` as one row per unit with ``__reps`` and ``__times``, which hold at most one entry a replicate."""
    d = draws.groupBy(*unit).agg(F.sort_array(F.collect_list(F.struct(F.col("rep").cast("int").alias("rep"), F.col("times").cast("int").alias("times")))).alias("d"))
    return d.select(*unit, F.col("d.rep").alias("__reps"), F.col("d.times").alias("__times"))


#: Draws made by one task, and ranks that meet in one group of draws.
_DRAWS = 4_000_000
_RANKS = 4096


def _spread(units: DataFrame, reps: int) -> DataFrame:
    """Materialised units over as many tasks as their draws need; a table of units is small, its draws are not."""
    n = units.count() * reps
    few = units.sparkSession.sparkContext.defaultParallelism if n > _DRAWS // 16 else 1
    return units.repartition(max(few, -(-n // _DRAWS)))


def with_poisson(df: DataFrame, unit: Sequence[str], reps: int, salt: str) -> DataFrame:
    """``df`` with Poisson draws computed from the unit in place: no join and no shuffle. One hash is taken a draw."""
    numbers = F.sequence(F.lit(0), F.lit(reps - 1))
    uniform = F.transform(numbers, lambda rep: hash_unit(salted_sha(salt, rep, *[F.col(c) for c in unit])))
    return df.withColumns({"__reps": numbers, "__times": F.transform(uniform, lambda u: poisson_weight(u))})


def poisson_lists(units: DataFrame, unit: Sequence[str], reps: int, salt: str) -> DataFrame:
    """``(unit..., __reps, __times)`` with Poisson draws, one row per distinct unit."""
    return with_poisson(_spread(cut_lineage(units.select(*unit).distinct()), reps), unit, reps, salt)


def multinomial_lists(placed: DataFrame, by: Sequence[str], unit: str, reps: int, salt: str) -> DataFrame:
    """``(by..., unit, __reps, __times)`` of units drawn at least once. ``placed``: materialised by..., unit, rank ``__r`` and
    group size ``__n``.

    Slot ``__r`` of a replicate takes the unit whose rank its hash names. A row holds the hits of a slot in all replicates;
    tasks pack them by range of ranks, four bytes a hit, and a range's hits are counted together.
    """
    hit = lambda rep: hash_below(salted_sha(salt, *[F.col(c) for c in by], rep, F.col("__r")), F.col("__n"))
    group = F.to_json(F.struct(*[F.col(c) for c in by]), {"ignoreNullFields": "false"}) if by else F.lit("")
    placed = placed.withColumn("__group", group)
    slots = _spread(placed, reps).select("__group", F.transform(F.sequence(F.lit(0), F.lit(reps - 1)), hit).alias("hits"))

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for group, at in batch.groupby("__group", sort=False).indices.items():
                hits = np.stack(batch["hits"].to_numpy()[at])
                rank, rep = hits.ravel(), np.tile(np.arange(reps), len(hits))
                order = np.argsort(rank // _RANKS, kind="stable")
                rank, packed = rank[order], ((rank % _RANKS) * reps + rep).astype(np.uint32)[order]
                ends = np.flatnonzero(np.diff(rank // _RANKS)) + 1
                parts = np.split(packed, ends)
                yield pd.DataFrame({"__group": group, "__range": rank[np.r_[0, ends]] // _RANKS, "packed": [p.tobytes() for p in parts]})

    def count(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        hit, times = np.unique(np.frombuffer(b"".join(rows["packed"]), np.uint32), return_counts=True)
        rank, first = np.unique(hit // reps, return_index=True)
        lists = lambda v: np.split(v.astype(np.int32), first[1:])
        return pd.DataFrame({"__group": key[0], "__r": 1 + key[1] * _RANKS + rank.astype(np.int64), "__reps": lists(hit % reps), "__times": lists(times)})

    packed = slots.mapInPandas(pack, "__group string, __range long, packed binary")
    lists = packed.groupBy("__group", "__range").applyInPandas(count, "__group string, __r long, __reps array<int>, __times array<int>")
    return placed.select("__group", "__r", *by, unit).join(lists, ["__group", "__r"]).select(*by, unit, "__reps", "__times")


def weights(rows: pd.DataFrame, low: int, high: int) -> np.ndarray:
    """Rows x replicates ``low .. high - 1``."""
    out = np.zeros((len(rows), high - low))
    if len(rows):
        counts = rows["__reps"].map(len).to_numpy()
        rep = np.concatenate(rows["__reps"].to_numpy()).astype(np.int64) if counts.sum() else np.empty(0, np.int64)
        times = np.concatenate(rows["__times"].to_numpy()) if counts.sum() else np.empty(0)
        row = np.repeat(np.arange(len(rows)), counts)
        own = (rep >= low) & (rep < high)
        out[row[own], rep[own] - low] = times[own]
    return out


def array_sums(df: DataFrame, width: int, reps: int, terms: Callable[[str, pd.DataFrame, np.ndarray], np.ndarray], low: int = 0) -> DataFrame:
    """``(__key, sums)``: per cell the sum of ``terms(key, rows, weights)``, a ``width`` x ``reps`` array laid out flat."""
    step = max(1, _CHUNK // max(reps, 1))

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for key, at in batch.groupby("__key", sort=False).indices.items():
                own = sums.setdefault(key, np.zeros((width, reps)))
                for a in range(0, len(at), step):
                    rows = batch.iloc[at[a : a + step]]
                    own += terms(key, rows, weights(rows, low, low + reps))
        if sums:
            part = TaskContext.get().partitionId()
            yield pd.DataFrame({"__key": list(sums), "__part": part, "sums": [v.ravel() for v in sums.values()]})

    def add(group: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"__key": [group["__key"].iloc[0]], "__part": [0], "sums": [np.sum(np.stack(group["sums"].to_numpy()), axis=0)]})

    schema = "__key string, __part int, sums array<double>"
    parts = df.mapInPandas(partial, schema)
    tasks = df.rdd.getNumPartitions()
    while tasks > _FAN_IN:
        tasks = -(-tasks // _FAN_IN)
        parts = parts.withColumn("__part", F.pmod("__part", F.lit(tasks)).cast("int")).groupBy("__key", "__part").applyInPandas(lambda k, g: add(g).assign(__part=k[1]), schema)
    return parts.groupBy("__key").applyInPandas(add, schema).select("__key", "sums")


def _blocks(reps: int, cells: int) -> Iterator[tuple[int, int]]:
    size = max(1, min(BLOCK, MOST_FITS // max(cells, 1)))
    for low in range(0, reps, size):
        yield low, min(size, reps - low)


ITERATIONS = 80
TOLERANCE = 1e-10


def fit_replicates(data: DataFrame, cells: DataFrame, cell: Sequence[str], reps: int, l2: float = 0.0, fixed_slope: bool = False) -> DataFrame:
    """``(cell..., rep, intercept, slope, n, n_pos, converged)`` of weighted logistic fits of ``__y`` on ``__x``.

    ``data``: __key, __x, __y and the draws (``__reps``, ``__times``); it should be materialised, since every step reads it.
    Newton steps end when no coefficient moves by ``TOLERANCE`` or after ``ITERATIONS``; ``converged`` tells which. A cell and
    replicate of one class has no finite optimum: it does not converge, or stops where the loss is flat.
    """
    cells = cut_lineage(cells)
    n_cells = cells.count()
    groups = -(-n_cells // MOST_FITS) or 1
    rows: list[pd.DataFrame] = []
    for g in range(groups):
        part = data if groups == 1 else data.where(F.pmod(F.xxhash64("__key"), F.lit(groups)) == g)
        for low, size in _blocks(reps, -(-n_cells // groups)):
            rows.append(_newton(part, low, size, l2, fixed_slope))
    found = pd.concat(rows, ignore_index=True)
    fits = data.sparkSession.createDataFrame(found, "__key string, rep int, intercept double, slope double, n double, n_pos double, converged boolean")
    return cells.join(fits, "__key").drop("__key")


def _newton(data: DataFrame, low: int, reps: int, l2: float, fixed_slope: bool) -> pd.DataFrame:
    def moments(_: str, rows: pd.DataFrame, w: np.ndarray) -> np.ndarray:
        x, y = rows["__x"].to_numpy(float), rows["__y"].to_numpy(float)
        return np.stack([w.sum(axis=0), y @ w, x @ w])

    start = {r["__key"]: np.array(r["sums"]).reshape(3, reps) for r in array_sums(data, 3, reps, moments, low).collect()}
    keys = list(start)
    n, n_pos, sx = (np.stack([start[k][i] for k in keys]) if keys else np.zeros((0, reps)) for i in range(3))
    with np.errstate(divide="ignore", invalid="ignore"):
        rate = np.clip(n_pos / n, 1e-12, 1 - 1e-12)
        b0 = np.log(rate) - np.log(1 - rate) - (sx / n if fixed_slope else 0.0)
    b1 = np.full_like(b0, 1.0 if fixed_slope else 0.0)
    done = ~(n > 0)
    converged = np.zeros_like(done)
    for _ in range(ITERATIONS):
        if done.all():
            break
        active = {k: (b0[i], b1[i], np.flatnonzero(~done[i])) for i, k in enumerate(keys) if not done[i].all()}

        def step(key: str, rows: pd.DataFrame, w: np.ndarray, active=active) -> np.ndarray:
            out = np.zeros((5, reps))
            if key in active:
                c0, c1, at = active[key]
                x, y = rows["__x"].to_numpy(float)[:, None], rows["__y"].to_numpy(float)[:, None]
                p = 1.0 / (1.0 + np.exp(-np.clip(c0[at] + c1[at] * x, -40.0, 40.0)))
                r, h = w[:, at] * (p - y), w[:, at] * np.maximum(p * (1.0 - p), 1e-9)
                out[:, at] = np.stack([r.sum(axis=0), (r * x).sum(axis=0), h.sum(axis=0), (h * x).sum(axis=0), (h * x * x).sum(axis=0)])
            return out

        sums = {r["__key"]: np.array(r["sums"]).reshape(5, reps) for r in array_sums(data, 5, reps, step, low).collect()}
        g0, g1, h00, h01, h11 = (np.stack([sums[k][i] for k in keys]) for i in range(5))
        g1, h11 = g1 + l2 * b1, h11 + l2
        with np.errstate(divide="ignore", invalid="ignore"):
            if fixed_slope:
                s0, s1 = g0 / h00, np.zeros_like(g0)
            else:
                det = h00 * h11 - h01 * h01
                s0 = np.where(det > 0, (h11 * g0 - h01 * g1) / det, 0.0)
                s1 = np.where(det > 0, (h00 * g1 - h01 * g0) / det, 0.0)
        b0 = np.where(done, b0, np.clip(b0 - s0, -100.0, 100.0))
        b1 = np.where(done, b1, np.clip(b1 - s1, -100.0, 100.0))
        small = ~done & (np.maximum(np.abs(s0), np.abs(s1)) < TOLERANCE)
        converged |= small
        done |= small
    flat = lambda v: v.ravel()
    return pd.DataFrame(
        {
            "__key": np.repeat(np.array(keys, object), reps), "rep": np.tile(np.arange(low, low + reps), len(keys)),
            "intercept": flat(b0), "slope": flat(b1), "n": flat(n), "n_pos": flat(n_pos), "converged": flat(converged),
        }
    )


def additive(df: DataFrame, cells: DataFrame, reps: int, columns: Sequence[str]) -> DataFrame:
    """``(cell..., rep, columns...)``: weighted sums of numeric columns for every replicate, of keyed rows with draws."""

    def terms(_: str, rows: pd.DataFrame, w: np.ndarray) -> np.ndarray:
        return np.stack([rows[c].to_numpy(float) @ w for c in columns])

    sums = array_sums(df.select("__key", "__reps", "__times", *columns), len(columns), reps, terms)
    return unpacked(sums, cells, reps, columns)


def unpacked(sums: DataFrame, cells: DataFrame, reps: int, columns: Sequence[str]) -> DataFrame:
    """Arrays laid out flat as one row per cell and replicate."""
    part = [F.slice("sums", i * reps + 1, reps).alias(c) for i, c in enumerate(columns)]
    rows = sums.select("__key", F.posexplode(F.arrays_zip(*part))).select("__key", F.col("pos").alias("rep"), *[F.col("col")[c].alias(c) for c in columns])
    return cells.join(rows, "__key").drop("__key")


def score_edges(rows: DataFrame, score: str) -> list[float]:
    """Cut points between ranges of the score, for materialised rows."""
    return range_edges(rows, score, min(max(rows.count() // _RANGE_ROWS, 8), _MOST_RANGES))


#: Rows of arrays a task holds while it adds up rows of equal score, in values.
_HELD = 8 << 20


def _merged(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of equal score and class added up."""
    order = np.lexsort((y, x))
    x, y = x[order], y[order]
    new = np.flatnonzero(np.r_[True, (x[1:] != x[:-1]) | (y[1:] != y[:-1])])
    return x[new], y[new], np.add.reduceat(w[order], new, axis=0, dtype=np.int32)


def _task_levels(df: DataFrame, reps: int, label: str) -> DataFrame:
    """``(__key, __x, __y, w)``: the rows of a task with equal score and class (of type ``label``) added up, draws as int32 bytes."""
    kind = {"int": int, "double": float}[label]

    def packed(held: dict[str, list[tuple]]) -> Iterator[pd.DataFrame]:
        for key, parts in held.items():
            for x, y, w in parts:
                for a in range(0, len(x), max(1, _CHUNK // reps)):
                    part = slice(a, a + max(1, _CHUNK // reps))
                    yield pd.DataFrame({"__key": key, "__x": x[part], "__y": y[part], "w": [s.tobytes() for s in w[part]]})

    def combine(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[str, list[tuple]] = {}
        size = 0
        for batch in batches:
            for key, at in batch.groupby("__key", sort=False).indices.items():
                for a in range(0, len(at), max(1, _CHUNK // reps)):
                    rows = batch.iloc[at[a : a + max(1, _CHUNK // reps)]]
                    part = _merged(rows["__x"].to_numpy(float), rows["__y"].to_numpy(kind), weights(rows, 0, reps).astype(np.int32))
                    held.setdefault(key, []).append(part)
                    size += part[2].size
            if size > _HELD:
                held = {k: [_merged(*[np.concatenate(v) for v in zip(*parts, strict=True)])] for k, parts in held.items()}
                size = sum(parts[0][2].size for parts in held.values())
                if size > _HELD // 2:  # scores hardly repeat
                    yield from packed(held)
                    held, size = {}, 0
        yield from packed({k: [_merged(*[np.concatenate(v) for v in zip(*parts, strict=True)])] for k, parts in held.items()})

    return df.mapInPandas(combine, f"__key string, __x double, __y {label}, w binary")


def _fit_score(score: str) -> Column:
    unfit = F.col(score).isNull() | F.isnan(F.col(score).cast("double"))
    return F.when(unfit, F.raise_error(F.lit("a score is NULL or NaN"))).otherwise(F.col(score)).cast("double")


def levels(df: DataFrame, reps: int, edges: Sequence[float]) -> DataFrame:
    """Keyed rows ``__x``, ``__y`` with draws, those of equal cell, score and class added up to one, in the same form.

    Fits and losses depend on a row by its score and class alone, so they may read these rows instead. Tasks add up their
    own rows, then ranges of the score (``edges``, :func:`score_edges`) meet.
    """

    def meet(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        w = np.frombuffer(b"".join(rows["w"]), np.int32).reshape(len(rows), reps)
        x, y, w = _merged(rows["__x"].to_numpy(float), rows["__y"].to_numpy(float), w)
        hit = [np.flatnonzero(v).astype(np.int32) for v in w]
        return pd.DataFrame({"__key": key[0], "__x": x, "__y": y, "__reps": hit, "__times": [v[h] for v, h in zip(w, hit, strict=True)]})

    rows = df.select("__key", _fit_score("__x").alias("__x"), F.col("__y").cast("double").alias("__y"), "__reps", "__times")
    rows = with_range_bucket(_task_levels(rows, reps, "double"), "__x", edges)
    return rows.groupBy("__key", "__bucket").applyInPandas(meet, "__key string, __x double, __y double, __reps array<int>, __times array<int>")


def auroc(df: DataFrame, cells: DataFrame, cell: Sequence[str], score: str, label: str, reps: int, edges: Sequence[float] | None = None) -> DataFrame:
    """``(cell..., rep, auroc)`` with average-rank ties, of keyed rows with draws; NULL for a replicate of one class.

    Tasks add up rows of equal score first. Ranges of the score then meet, each with arrays of its positives, its negatives
    and the pairs won inside it; a cell's ranges are put together from those arrays alone. With ``edges``
    (:func:`score_edges`) the rows are read once and not materialised.
    """
    df = df.select("__key", _fit_score(score).alias("__x"), F.col(label).cast("int").alias("__y"), "__reps", "__times")
    if edges is None:
        df = cut_lineage(df)
        edges = score_edges(df, "__x")

    def inside(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        w = np.frombuffer(b"".join(rows["w"]), np.int32).reshape(len(rows), reps).astype(float)
        x, y = rows["__x"].to_numpy(), rows["__y"].to_numpy()
        order = np.argsort(x, kind="stable")
        starts = np.flatnonzero(np.r_[True, x[order][1:] != x[order][:-1]])
        pos = np.add.reduceat(np.where((y == 1)[order, None], w[order], 0.0), starts, axis=0)
        neg = np.add.reduceat(np.where((y == 0)[order, None], w[order], 0.0), starts, axis=0)
        won = (pos * (np.cumsum(neg, axis=0) - neg / 2)).sum(axis=0)
        return pd.DataFrame({"__key": [key[0]], "__bucket": [key[1]], "sums": [np.concatenate([pos.sum(axis=0), neg.sum(axis=0), won]).tobytes()]})

    def across(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("__bucket")
        pos, neg, won = (np.stack([np.frombuffer(s, np.float64)[i * reps : (i + 1) * reps] for s in rows["sums"]]) for i in range(3))
        total = (won + pos * (np.cumsum(neg, axis=0) - neg)).sum(axis=0)
        pairs = pos.sum(axis=0) * neg.sum(axis=0)
        with np.errstate(divide="ignore", invalid="ignore"):
            return pd.DataFrame({"__key": key[0], "rep": np.arange(reps, dtype=np.int32), "auroc": np.where(pairs > 0, total / pairs, np.nan)})

    rows = with_range_bucket(_task_levels(df, reps, "int"), "__x", edges)
    ranges = rows.groupBy("__key", "__bucket").applyInPandas(inside, "__key string, __bucket int, sums binary")
    per = ranges.groupBy("__key").applyInPandas(across, "__key string, rep int, auroc double")  # at most _MOST_RANGES x 16 ranges
    return cells.join(per, "__key").select(*cell, "rep", F.nanvl("auroc", F.lit(None).cast("double")).alias("auroc"))


def score_fits(df: DataFrame, cells: DataFrame, fits: DataFrame, cell: Sequence[str], reps: int, eps: float) -> DataFrame:
    """``(cell..., rep, nll, brier, n, n_pos)``: weighted sums of the losses of refitted scores over held-out rows (``__x``, ``__y``).

    Coefficients are sent to the tasks as arrays, of at most ``MOST_FITS`` fits at a time.
    """
    known = cut_lineage(keyed(fits, cell)[0].select("__key", "rep", "intercept", "slope"))
    n_cells = cells.count()
    groups = -(-n_cells // MOST_FITS) or 1
    out: list[DataFrame] = []
    for g in range(groups):
        part = lambda d: d if groups == 1 else d.where(F.pmod(F.xxhash64("__key"), F.lit(groups)) == g)  # noqa: B023, E731
        for low, size in _blocks(reps, -(-n_cells // groups)):
            held = part(known).where(F.col("rep").between(low, low + size - 1)).toPandas()  # at most MOST_FITS
            coefficients: dict[str, np.ndarray] = {}
            for key, own in held.groupby("__key"):
                c = np.full((2, size), np.nan)
                c[:, own["rep"].to_numpy() - low] = own[["intercept", "slope"]].to_numpy().T
                coefficients[key] = c

            def terms(key: str, rows: pd.DataFrame, w: np.ndarray, coefficients=coefficients, size=size) -> np.ndarray:
                x, y = rows["__x"].to_numpy(float)[:, None], rows["__y"].to_numpy(float)[:, None]
                c = coefficients.get(key, np.full((2, size), np.nan))
                p = 1.0 / (1.0 + np.exp(-(c[0] + c[1] * x)))
                q = np.clip(p, eps, 1.0 - eps)
                with np.errstate(divide="ignore"):
                    loss = -np.where(y == 1, np.log(q), np.log(1.0 - q))
                return np.stack([(w * loss).sum(axis=0), (w * (p - y) ** 2).sum(axis=0), w.sum(axis=0), (w * y).sum(axis=0)])

            sums = array_sums(part(df), 4, size, terms, low)
            out.append(unpacked(sums, cells, size, ["nll", "brier", "n", "n_pos"]).withColumn("rep", F.col("rep") + low))
    found = out[0]
    for more in out[1:]:
        found = found.unionByName(more)
    return found


def plain_rows(df: DataFrame, cell: Sequence[str], x: str, label: str, weight: str | Column | None = None) -> tuple[DataFrame, DataFrame]:
    """Keyed levels (cell, score, label) with their weight as the draw of a single replicate, and the cells."""
    w = F.lit(1) if weight is None else F.col(weight) if isinstance(weight, str) else weight
    levels = df.groupBy(*cell, F.col(x).cast("double").alias("__x"), F.col(label).cast("double").alias("__y")).agg(F.sum(w).cast("double").alias("__w"))
    rows, cells = keyed(levels, cell)
    rows = cut_lineage(rows.select(*cell, "__key", "__x", "__y", F.array(F.lit(0)).alias("__reps"), F.array("__w").alias("__times")))
    return rows, rows.select(*cell, "__key").distinct()


def joined_draws(df: DataFrame, draws: DataFrame, unit: Sequence[str]) -> DataFrame:
    """``df`` with draws joined on the unit: lists, or a row for each (unit, rep)."""
    return same_key_join(df, draws if "__reps" in draws.columns else draw_lists(draws, unit), unit)
