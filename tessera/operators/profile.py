"""Descriptive audits of cohorts, texts, recordings and embeddings."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import cosine, l2_norm, or_missing, salted_sha
from tessera.operators import bootstrap
from tessera.operators.joins import same_key_join
from tessera.operators.quantiles import exact_quantile, quantile_array, quantile_summary
from tessera.operators.ranked import ranked
from tessera.session import cut_lineage


def text_key(text: str) -> Column:
    """Grouping key of a long text: its hash, so that texts themselves are not shuffled."""
    return F.sha2(F.col(text), 256)


def missingness(df: DataFrame, fields: Sequence[str], label: str, group: str) -> DataFrame:
    """Missing fraction per field overall, by label and by group.

    Rows are reduced to counts per (label, group) first; the grouping sets run on those counts.
    """
    counts = df.groupBy(label, group).agg(
        F.count(F.lit(1)).alias("__n"), *[F.sum(F.col(f).isNull().cast("long")).alias(f) for f in fields]
    )
    cells = counts.unpivot([label, group, "__n"], list(fields), "field", "__m")
    sets = [[F.col("field")], [F.col("field"), F.col(label)], [F.col("field"), F.col(group)]]
    g = cells.groupingSets(sets, "field", label, group).agg(
        F.grouping_id().alias("__g"), (F.sum("__m") / F.sum("__n")).alias("missing_fraction")
    )
    # grouping bits: field is always present; 1 = label shown, 2 = group shown, 3 = overall
    scope = F.when(F.col("__g") == 3, F.lit("overall")).when(F.col("__g") == 1, F.lit(label)).otherwise(F.lit(group))
    shown = F.when(F.col("__g") == 1, F.col(label).cast("string")).when(F.col("__g") == 2, F.col(group).cast("string"))
    return g.select("field", scope.alias("scope"), F.coalesce(shown, F.lit("ALL")).alias("level"), "missing_fraction")


def contingency(df: DataFrame, row: str, col: str) -> DataFrame:
    """Counts with row and column shares; totals come from the cell table, not from the rows."""
    cells = df.groupBy(row, col).agg(F.count(F.lit(1)).alias("n"))
    # cells are vocabulary-sized, so windows over them are small
    return cells.withColumns(
        {
            "row_share": F.col("n") / F.sum("n").over(Window.partitionBy(row)),
            "column_share": F.col("n") / F.sum("n").over(Window.partitionBy(col)),
        }
    )


def profile_diversity(df: DataFrame, text: str, by: Sequence[str] = ()) -> DataFrame:
    """Distinct profiles, modal share, share of rows with a duplicate, effective number exp(entropy)."""
    counts = df.groupBy(*by, text_key(text).alias("__t")).agg(F.count(F.lit(1)).alias("__c"))
    c = F.col("__c").cast("double")
    total = F.sum(c)
    # entropy of p = c / total is log(total) - sum(c log c) / total
    return counts.groupBy(*by).agg(
        F.sum("__c").alias("n"),
        F.count(F.lit(1)).alias("n_unique"),
        (F.max("__c") / total).alias("modal_share"),
        (F.sum(F.when(F.col("__c") > 1, c).otherwise(0.0)) / total).alias("shared_fraction"),
        F.exp(F.log(total) - F.sum(c * F.log(c)) / total).alias("effective_number"),
    )


def population_coverage(df: DataFrame, label: str, populations: dict[str, Column]) -> DataFrame:
    """Size, positive rate and retained share of overlapping populations in one pass."""
    flags = F.array(*[F.struct(F.lit(n).alias("population"), c.alias("member")) for n, c in populations.items()])
    total = df.agg(F.count(F.lit(1)).alias("n"))
    return (
        df.select(label, F.explode(F.filter(flags, lambda f: f["member"])).alias("f"))
        .groupBy(F.col("f.population").alias("population"))
        .agg(F.count(F.lit(1)).alias("n"), F.avg(F.col(label).cast("double")).alias("positive_rate"))
        .withColumn("retained", F.col("n") / total.scalar())
    )


def duplicate_signatures(df: DataFrame, signatures: dict[str, Sequence[str]]) -> DataFrame:
    """Rows beyond the first per signature (same name; same frames, size and amplitude; ...)."""
    parts = []
    for name, cols in signatures.items():
        per = df.groupBy(*cols).agg(F.count(F.lit(1)).alias("c"))
        parts.append(
            per.agg(
                F.sum("c").alias("n"), F.count(F.lit(1)).alias("n_distinct"), F.sum(F.col("c") - 1).alias("n_duplicate")
            ).select(F.lit(name).alias("signature"), "*")
        )
    return reduce(DataFrame.unionByName, parts)


def recording_totals(df: DataFrame, unit: str, duration: str) -> DataFrame:
    """Per unit: number of recordings and total / shortest / longest duration."""
    return df.groupBy(unit).agg(
        F.count(F.lit(1)).alias("n_recordings"),
        F.sum(duration).alias("total_duration"),
        F.min(duration).alias("min_duration"),
        F.max(duration).alias("max_duration"),
    )


def recording_lists(df: DataFrame, unit: str, path: str, salt: str = "files", at_most: int = 1000) -> DataFrame:
    """Sorted file lists ``(unit, part, n_files, files)`` of at most ``at_most`` files each.

    A unit within that size has one part, its complete list. A larger unit is spread over several
    parts in hash order, so that no unit has to fit into one row.
    """
    r = ranked(df.select(unit, path).withColumn("__h", salted_sha(salt, path)), [unit], "__h", "__r")
    return r.groupBy(unit, F.floor((F.col("__r") - 1) / at_most).alias("part")).agg(
        F.count(F.lit(1)).alias("n_files"),
        F.array_join(F.sort_array(F.collect_list(F.col(path).cast("string"))), "|").alias("files"),
    )


def domains_with_both(df: DataFrame, domain: str, label: str) -> DataFrame:
    return df.groupBy(domain).agg(
        F.sum((F.col(label) == 0).cast("long")).alias("n_0"),
        F.sum((F.col(label) == 1).cast("long")).alias("n_1"),
        ((F.min(label) == 0) & (F.max(label) == 1)).alias("has_both"),
    )


def leaked_texts(df: DataFrame, text: str, forbidden: Sequence[str]) -> DataFrame:
    """Per forbidden token the number of texts that contain it."""
    lowered = df.select(F.lower(text).alias("__low"))
    counts = [F.sum(F.col("__low").contains(t.lower()).cast("long")).alias(t) for t in forbidden]
    return lowered.agg(*counts).unpivot([], list(forbidden), "token", "n_texts")


def text_resolution(df: DataFrame, condition: str, text: str) -> DataFrame:
    """Distinct rendered texts per condition, counted in two levels."""
    return (
        df.groupBy(condition, text_key(text).alias("__t"))
        .agg(F.count(F.lit(1)).alias("__c"))
        .groupBy(condition)
        .agg(F.count(F.lit(1)).alias("n_texts"), F.sum("__c").alias("n_rows"))
    )


def batch_collision_floor(df: DataFrame, unit: str, text: str, batch: int, epochs: int, salt: str) -> DataFrame:
    """Mean log K per epoch, K = identical texts in the row's batch (itself included)."""
    spread = df.select(unit, text_key(text).alias("__t")).withColumn(
        "epoch", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1)))
    )
    r = ranked(spread.withColumn("__h", salted_sha(salt, "epoch", unit)), ["epoch"], "__h", "__r")
    cells = r.groupBy("epoch", F.floor((F.col("__r") - 1) / batch).alias("batch"), "__t").agg(
        F.count(F.lit(1)).cast("double").alias("c")
    )
    return cells.groupBy("epoch").agg(
        (F.sum(F.col("c") * F.log("c")) / F.sum("c")).alias("mean_log_k"),
        F.sum("c").cast("long").alias("n"),
        (F.max("batch") + 1).cast("long").alias("n_batches"),
    )


def expected_collision(df: DataFrame, text: str, batch: int) -> DataFrame:
    """E[log K] and E[K] for independent draws: K = 1 + Binomial(batch - 1, share of the text).

    The binomial sum is taken per distinct count of a text, so its work does not grow with the rows.
    """
    counts = df.groupBy(text_key(text).alias("__t")).agg(F.count(F.lit(1)).alias("c"))
    sizes = counts.groupBy("c").agg(F.count(F.lit(1)).alias("m"))
    total = sizes.agg(F.sum(F.col("c") * F.col("m")).alias("n"))
    s = sizes.withColumn("n", total.scalar()).withColumn("p", F.col("c") / F.col("n"))
    trials = batch - 1
    log_choose = [0.0]

    for j in range(1, trials + 1):
        log_choose.append(log_choose[-1] + math.log((trials - j + 1) / j))
    terms = s.withColumn(
        "t",
        F.explode(F.array(*[F.struct(F.lit(j).alias("j"), F.lit(log_choose[j]).alias("lc")) for j in range(batch)])),
    )
    j = F.col("t.j")
    p = F.col("p")
    mass = F.when(p < 1, F.exp(F.col("t.lc") + j * F.log(p) + (trials - j) * F.log(1 - p))).otherwise(
        (j == trials).cast("double")
    )
    weight = p * F.col("m")
    return terms.agg(
        F.sum(weight * mass * F.log(j + 1)).alias("expected_log_k"), F.sum(weight * mass * (j + 1)).alias("expected_k")
    )


def embedding_audit(df: DataFrame, vector: str) -> DataFrame:
    """Counts, shape, finiteness and norm range of an embedding table; the median norm is exact, over vectors with a norm."""
    df = cut_lineage(df.select(l2_norm(F.col(vector)).alias("__norm"), F.col(vector)))
    known = df.where(F.col("__norm").isNotNull() & ~F.isnan("__norm") & (F.col("__norm") < float("inf")))
    median = exact_quantile(known, "__norm", [0.5], []).select("quantile")
    norm = l2_norm(F.col(vector))
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return df.select(norm.alias("norm"), finite.alias("finite"), F.size(vector).alias("dim")).agg(
        F.count(F.lit(1)).alias("n"),
        F.min("dim").alias("min_dim"),
        F.max("dim").alias("max_dim"),
        F.sum((~F.col("finite")).cast("long")).alias("n_not_finite"),
        F.sum((F.col("norm") == 0).cast("long")).alias("n_zero"),
        F.min("norm").alias("min_norm"),
        F.avg("norm").alias("mean_norm"),
        F.max("norm").alias("max_norm"),
    ).withColumn("median_norm", median.scalar())


def window_histogram(df: DataFrame, windows: str) -> DataFrame:
    """How many recordings have each number of windows."""
    return df.groupBy(windows).agg(F.count(F.lit(1)).alias("n"))


def mean_vectors(df: DataFrame, keys: Sequence[str], vector: str, out: str = "vector") -> DataFrame:
    """Element-wise mean per key: partial sums per (key, position), so a huge key is combined map-side."""
    cells = df.select(*keys, F.posexplode(F.col(vector).cast("array<double>")).alias("pos", "x"))
    means = cells.groupBy(*keys, "pos").agg(F.avg("x").alias("x"))
    packed = means.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("pos", "x"))).alias("v"))
    return packed.select(*keys, F.transform("v", lambda e: e["x"]).alias(out))


def pooled_vectors(df: DataFrame, unit: str, recording: str, vector: str) -> DataFrame:
    """Windows -> recording mean -> unit mean, every recording with equal weight."""
    return mean_vectors(mean_vectors(df, [unit, recording], vector), [unit], "vector")


def max_vectors(df: DataFrame, keys: Sequence[str], vector: str, out: str = "vector") -> DataFrame:
    """Element-wise maximum per key."""
    cells = df.select(*keys, F.posexplode(F.col(vector).cast("array<double>")).alias("pos", "x"))
    top = cells.groupBy(*keys, "pos").agg(F.max("x").alias("x"))
    packed = top.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("pos", "x"))).alias("v"))
    return packed.select(*keys, F.transform("v", lambda e: e["x"]).alias(out))


def seed_summary(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """Mean, population sd and sign agreement over seeds."""
    sign = F.signum(value)
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_seeds"),
        F.avg(value).alias("mean"),
        F.stddev_pop(value).alias("sd"),
        (F.min(sign) == F.max(sign)).alias("same_sign"),
    )


def comparison_table(metrics: DataFrame, arm: str, metric: str, value: str, baseline: str, names: Sequence[str]) -> DataFrame:
    """Arms as rows, metrics as columns, plus the difference of each metric from the baseline arm."""
    wide = metrics.groupBy(arm).pivot(metric, list(names)).agg(F.avg(value))
    base = wide.where(F.col(arm) == baseline).select(F.struct(*names))
    return wide.withColumn("__b", base.scalar()).select(
        arm, *names, *[(F.col(n) - F.col(f"__b.{n}")).alias(f"delta_{n}") for n in names]
    )


def grid_deltas(df: DataFrame, grid: Sequence[str], arm: str, value: str, a: str, b: str) -> DataFrame:
    """Per grid cell and seed the difference of two arms, summarised over seeds."""
    wide = df.groupBy(*grid, "seed").pivot(arm, [a, b]).agg(F.avg(value))
    return seed_summary(wide.withColumn("delta", F.col(a) - F.col(b)), grid, "delta")


def grid_delta_intervals(
    df: DataFrame, grid: Sequence[str], arm: str, value: str, a: str, b: str, reps: int, salt: str
) -> DataFrame:
    """:func:`grid_deltas` with a bootstrap interval of each mean over seeds: struct ``ci`` (low, high).

    Seeds are redrawn, the same draws for every grid cell. A seed without both arms in a cell takes no part in it.
    """
    wide = df.groupBy(*grid, "seed").pivot(arm, [a, b]).agg(F.avg(value))
    deltas = cut_lineage(wide.withColumn("delta", F.col(a) - F.col(b)).where("delta IS NOT NULL"))
    v = bootstrap.replicate_means(deltas, grid, "seed", "delta", reps, salt)
    i = bootstrap.interval(v, grid, reps=reps).select(*grid, F.struct(F.col("ci_low").alias("low"), F.col("ci_high").alias("high")).alias("ci"))
    return same_key_join(seed_summary(deltas, grid, "delta"), i, grid)


def acquisition_medians(df: DataFrame, source: str, values: Sequence[str], clip: str) -> DataFrame:
    """Exact medians of the listed columns and the clipping rate, per source."""
    rates = df.groupBy(source).agg(
        F.count(F.lit(1)).alias("n"), F.avg((F.col(clip) > 0).cast("double")).alias("clipping_rate")
    )
    long = df.select(source, *[F.col(v).cast("double").alias(v) for v in values]).unpivot([source], list(values), "field", "value")
    q = exact_quantile(long, "value", [0.5], [source, "field"])
    wide = q.groupBy(source).pivot("field", list(values)).agg(F.max("quantile"))
    return same_key_join(rates, wide.withColumnsRenamed({v: f"median_{v}" for v in values}), [source])


def shared_hashes(df: DataFrame, digest: str, within: str) -> DataFrame:
    """Content hashes found under more than one value of ``within`` (split or identity)."""
    g = df.groupBy(digest).agg(F.count(F.lit(1)).alias("n"), F.min(within).alias("a"), F.max(within).alias("b"))
    return g.agg(
        F.count(F.lit(1)).alias("n_hashes"),
        F.coalesce(F.sum((F.col("n") > 1).cast("long")), F.lit(0)).alias("n_repeated"),
        F.coalesce(F.sum((F.col("a") != F.col("b")).cast("long")), F.lit(0)).alias("n_shared"),
    )


def overlap_matrix(df: DataFrame, item: str, group: str) -> DataFrame:
    """Items common to each pair of groups.

    Items in the same set of groups collapse to one signature with a count before pairs are formed, so pairs grow with
    the signatures, not with the items. NULL groups are left out.
    """
    sets = df.where(F.col(group).isNotNull()).groupBy(item).agg(F.array_sort(F.collect_set(group)).alias("g"))
    signatures = sets.where(F.size("g") > 1).groupBy("g").agg(F.count(F.lit(1)).alias("n"))
    a = signatures.select("g", "n", F.posexplode("g").alias("i", "a"))
    both = a.select("a", "n", F.explode(F.slice("g", F.col("i") + 2, F.size("g"))).alias("b"))
    return both.groupBy("a", "b").agg(F.sum("n").alias("n_common"))


def keep_one_owner(df: DataFrame, digest: str, owner: str, file: str, salt: str) -> DataFrame:
    """Duplicate removal: per content hash one owner (smallest salted hash), per owner one file.

    Adds ``owner_excluded`` (another owner keeps this content) and ``repeat`` (same owner, later file).
    """
    kept = df.groupBy(digest).agg(
        F.min_by(F.col(owner), salted_sha(salt, owner)).alias("__owner"), F.min(owner).alias("__a"), F.max(owner).alias("__b")
    )
    first = df.groupBy(digest, owner).agg(F.min(file).alias("__file"))
    facts = first.join(kept, digest).select(
        digest, owner, "__file", ((F.col("__a") != F.col("__b")) & (F.col(owner) != F.col("__owner"))).alias("owner_excluded")
    )
    return df.join(facts, [digest, owner]).withColumn("repeat", F.col(file) != F.col("__file")).drop("__file")


def excluded_owners(judged: DataFrame, owner: str) -> DataFrame:
    """Owners that lose at least one content hash to another owner."""
    return judged.where("owner_excluded").select(owner).distinct()


def duplicate_flags(df: DataFrame, digests: Sequence[str], owner: str) -> DataFrame:
    """Per row and hash column, whether the hash also occurs under another owner; recordings per owner."""
    out = df
    for d in digests:
        facts = df.where(F.col(d).isNotNull()).groupBy(d).agg((F.min(owner) != F.max(owner)).alias(f"{d}_elsewhere"))
        out = out.join(facts, d, "left").withColumn(f"{d}_elsewhere", F.coalesce(f"{d}_elsewhere", F.lit(False)))
    sizes = df.groupBy(owner).agg(F.count(F.lit(1)).alias("n_recordings"))
    return out.join(sizes, owner)


def one_field_apart(records: DataFrame, fields: Sequence[str], order: str, vector: str | None = None, at_least: int = 1) -> DataFrame:
    """Per field, consecutive records (in ``order``) equal in all other fields and different in it.

    ``records`` are distinct, so a group has at most one row per value of the field. With a
    vector column the mean cosine of the pairs is reported too.
    """
    parts = []
    for f in fields:
        rest = [c for c in fields if c != f]
        w = Window.partitionBy(*rest).orderBy(order)
        d = records.withColumn("__p", F.lag(f).over(w))
        if vector:
            d = d.withColumn("__v", F.lag(vector).over(w))
        hit = d.where(F.col("__p").isNotNull() & (F.col("__p") != F.col(f)))
        aggs = [F.count(F.lit(1)).alias("n_pairs")]
        if vector:
            aggs.append(F.avg(cosine(F.col(vector), F.col("__v"))).alias("mean_cosine"))
        parts.append(hit.agg(*aggs).select(F.lit(f).alias("field"), "*"))
    return reduce(DataFrame.unionByName, parts).where(F.col("n_pairs") >= at_least)


def monotone_check(df: DataFrame, by: Sequence[str], dose: str, value: str, tolerance: float = 0.0) -> DataFrame:
    """Whether a value never falls along an ordered grid (one row per dose)."""
    w = Window.partitionBy(*(by or [F.lit(0)])).orderBy(dose)
    steps = df.withColumn("__s", F.col(value) - F.lag(value).over(w))
    return steps.groupBy(*by).agg(
        F.min("__s").alias("min_step"), F.coalesce(F.min("__s") >= -tolerance, F.lit(True)).alias("non_decreasing")
    )


def quantile_bucket(df: DataFrame, value: str, names: Sequence[str], out: str) -> DataFrame:
    """Right-closed quantile classes with edges from all rows (two edges for terciles)."""
    k = len(names)
    edges = quantile_array(df, value, [i / k for i in range(1, k)])
    d = df.withColumn("__e", edges.select("q").scalar())
    bucket = F.lit(names[-1])
    for i in reversed(range(k - 1)):
        bucket = F.when(F.col(value) <= F.col("__e")[i], F.lit(names[i])).otherwise(bucket)
    return d.withColumn(out, F.when(F.col(value).isNotNull(), bucket)).drop("__e")


def missing_as_level(c: str) -> Column:
    return or_missing(F.col(c))
