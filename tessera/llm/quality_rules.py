"""Quality rules learned as a decision list, in DataFrame operations only.

Base statistics of whole texts are Spark expressions. Rules are grown by sequential covering: from the labelled
rows, conjunctions of thresholds that single out bad documents are grown condition by condition, pruned on held-out
rows, and put in order; each rule is learned on the rows that no earlier rule has taken. The outcome is an
ordered conditional expression, readable as text, that scores all documents without a model object.

Learning touches labelled statistics only: one row of eight numbers per document, at most ``sample`` rows (the
least hashes of their ids). Every growing step is one aggregate of conditional counts.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import materialised, query, table

SEPARATORS = r"[\x20\x09-\x0D]+"
_BLANKS = " \t\n\x0b\x0c\r"
_SYMBOLS = "#*$%&|<>"
#: Words in a window of the repetition statistic.
WINDOW = 8

#: Ratios that rules may test, as expressions of the base statistics.
FEATURES = {
    "words": "n_words",
    "word_length": "word_chars / greatest(n_words, 1)",
    "symbols_per_char": "n_symbols / greatest(word_chars, 1)",
    "duplicate_lines": "n_dup_lines / greatest(n_lines, 1)",
    "repeated_words": "n_repeat_words / greatest(n_words, 1)",
    "capitals": "n_capitals / greatest(word_chars, 1)",
    "exclamations": "n_exclamations / greatest(n_words, 1)",
    "distinct_words": "n_distinct / greatest(n_words, 1)",
}


def _count_of(text: Column, characters: str) -> Column:
    return (F.char_length(text) - F.char_length(F.translate(text, characters, ""))).cast("long")


def _window_hashes(hashes: Column) -> Column:
    """Hash of every window of words, from the words' hashes."""
    last = F.size(hashes) - WINDOW
    windows = F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: F.xxhash64(*[F.get(hashes, i + k) for k in range(WINDOW)]))
    return F.when(last >= 0, windows).otherwise(F.array().cast("array<bigint>"))


def with_base(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Add n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed, and the helpers of the rules.

    A null text has no words. All counts are of the whole text.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    df = docs.withColumn("_text", text)
    df = df.withColumn("_words", F.filter(F.split("_text", SEPARATORS), lambda w: w != ""))
    df = df.withColumn("_lines", F.filter(F.split("_text", "\n"), lambda x: F.translate(x, _BLANKS, "") != ""))
    df = df.withColumn("_hashes", F.transform("_words", lambda w: F.xxhash64(w)))
    df = df.withColumn("_windows", _window_hashes(F.col("_hashes")))
    capitals = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    df = df.select(
        *docs.columns,
        F.size("_words").cast("long").alias("n_words"),
        F.char_length(F.translate("_text", _BLANKS, "")).cast("long").alias("word_chars"),
        _count_of(F.col("_text"), _SYMBOLS).alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.size("_lines").cast("long").alias("n_lines"),
        _count_of(F.col("_text"), capitals).alias("n_capitals"),
        _count_of(F.col("_text"), "!").alias("n_exclamations"),
        F.size(F.array_distinct("_hashes")).cast("long").alias("n_distinct"),
        F.when(F.size(F.array_distinct("_windows")) < F.size("_windows"), F.col("_windows")).alias("_windows"),
    )
    # only texts with a repeated window go on: sort (window, place), keep the places of windows equal to a neighbour
    pairs = F.sort_array(F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    df = df.withColumn("_sorted", pairs)
    n = F.size("_sorted")
    nothing = F.struct(F.lit(None).cast("bigint").alias("h"), F.lit(None).cast("int").alias("i"))
    beside = F.zip_with(
        F.zip_with("_sorted", F.concat(F.array(nothing), F.slice("_sorted", 1, n - 1)), lambda x, y: F.struct(x["i"].alias("i"), x["h"].alias("h"), (x["h"] == y["h"]).alias("before"))),
        F.concat(F.slice("_sorted", 2, n - 1), F.array(nothing)),
        lambda x, y: F.when(F.coalesce(x["before"], F.lit(False)) | F.coalesce(x["h"] == y["h"], F.lit(False)), x["i"]),
    )
    df = df.withColumn("_places", F.sort_array(F.filter(beside, lambda i: i.isNotNull())))
    k = F.size("_places")
    gaps = F.zip_with(F.slice("_places", 1, k - 1), F.slice("_places", 2, k - 1), lambda a, b: F.least(b - a, F.lit(WINDOW)))
    covered = F.aggregate(gaps, F.lit(WINDOW).cast("long"), lambda t, x: t + x)
    # the partition test is always true; it keeps the optimizer from copying these expressions into filters on the result
    repeats = F.when(F.col("_windows").isNotNull(), covered).otherwise(F.lit(0)).cast("long")
    df = df.withColumn("n_repeat_words", F.when(F.spark_partition_id() >= 0, repeats).otherwise(F.lit(0)))
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return df.drop("_windows", "_sorted", "_places").withColumn("base_failed", failed)


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def sql(self) -> str:
        return f"({FEATURES[self.feature]}) {'>' if self.above else '<='} {self.threshold!r}D"


@dataclass(frozen=True)
class Rule:
    """Documents that meet all conditions are bad; precision on the labelled rows that reached the rule."""

    conditions: tuple[Condition, ...]
    precision: float
    covered: int

    def sql(self) -> str:
        return " AND ".join(c.sql() for c in self.conditions)


def _precision(bad: int, good: int) -> float:
    """Laplace estimate."""
    return (bad + 1) / (bad + good + 2)


def learn_rules(
    labelled: DataFrame,
    most_rules: int = 8,
    most_conditions: int = 3,
    least_precision: float = 0.98,
    least_covered: int = 5,
    cuts: int = 12,
) -> list[Rule]:
    """Sequential covering over rows with the base statistics and ``bad`` (0 or 1).

    A rule starts empty and gains the condition with the greatest information gain (bad rows covered times the rise of
    log precision) on two thirds of the rows; then it loses conditions from the end while the precision on the other
    third does not fall. Learning ends when a rule falls short of ``least_precision`` or ``least_covered``.
    Without labels, or with labels of one kind, the list is empty.
    """
    points = [i / (cuts + 1) for i in range(1, cuts + 1)]
    labelled = materialised(labelled.select("bad", (F.pmod("_order", F.lit(3)) == 0).alias("prune"), *[F.expr(e).cast("double").alias(name) for name, e in FEATURES.items()]))
    # thresholds at the quantiles of the bad rows and of the good rows
    found: dict[str, set[float]] = {name: set() for name in FEATURES}
    for row in labelled.groupBy("bad").agg(*[F.percentile_approx(name, points, 10000).alias(name) for name in FEATURES]).collect():
        for name in FEATURES:
            found[name] |= {round(float(v), 6) for v in row[name] or []}
    cut_at = {name: sorted(found[name]) for name in FEATURES}
    names = list(FEATURES)

    def place(name: str) -> Column:
        return F.size(F.filter(F.array(*[F.lit(t) for t in cut_at[name]]).cast("array<double>"), lambda t: t < F.col(name)))

    # the cell of a row: for each feature, how many thresholds lie below its value
    cells = materialised(labelled.groupBy("bad", "prune", F.array(*[place(n) for n in names]).alias("at")).agg(F.count(F.lit(1)).alias("n")))

    def met(c: Condition) -> Column:
        at, j = F.get("at", F.lit(names.index(c.feature))), cut_at[c.feature].index(c.threshold)
        return at > j if c.above else at <= j

    def meets(rows: DataFrame, conditions: list[Condition] | tuple[Condition, ...]) -> DataFrame:
        for c in conditions:
            rows = rows.where(met(c))
        return rows

    def totals(rows: DataFrame) -> tuple[int, int]:
        out = rows.agg(*[F.coalesce(F.sum(F.when(F.col("bad") == b, F.col("n"))), F.lit(0)) for b in (1, 0)]).first()
        return out[0], out[1]

    def options(rows: DataFrame) -> list[tuple[int, int, Condition]]:
        """(bad, good, condition) for all conditions, from one aggregate by feature and cell."""
        sums = rows.select("bad", "n", F.posexplode("at")).groupBy("pos", "col", "bad").agg(F.sum("n").alias("n")).collect()
        out = []
        for i, name in enumerate(names):
            own = [(r["col"], r["bad"], r["n"]) for r in sums if r["pos"] == i]
            for j, t in enumerate(cut_at[name]):
                for above in (True, False):
                    hit = [sum(n for at, b, n in own if b == kind and (at > j) == above) for kind in (1, 0)]
                    out.append((hit[0], hit[1], Condition(name, above, t)))
        return out

    rules: list[Rule] = []
    rest = cells
    while len(rules) < most_rules:
        grow, prune = rest.where("NOT prune"), rest.where("prune")
        chosen: list[Condition] = []
        bad, good = totals(grow)
        while len(chosen) < most_conditions and good and bad >= least_covered:
            now = _precision(bad, good)
            gains = [
                (b * (math.log2(_precision(b, g)) - math.log2(now)), -k, b, g, c)
                for k, (b, g, c) in enumerate(options(meets(grow, chosen)))
                if b >= least_covered
            ]
            if not gains or max(gains)[0] <= 0:
                break
            _, _, bad, good, best = max(gains)
            chosen.append(best)
        shorter = [chosen[:k] for k in range(len(chosen), 0, -1)]
        if not shorter:
            break
        held = [totals(meets(prune, s)) for s in shorter]
        best_at = max(range(len(shorter)), key=lambda k: (_precision(*held[k]), len(shorter[k])))
        b, g = totals(meets(rest, shorter[best_at]))
        rule = Rule(tuple(shorter[best_at]), b / max(b + g, 1), b + g)
        held_bad, held_good = held[best_at]
        if b < least_covered or b < least_precision * (b + g) or held_bad < 0.9 * (held_bad + held_good):
            break
        rules.append(rule)
        taken = met(rule.conditions[0])
        for c in rule.conditions[1:]:
            taken = taken & met(c)
        rest = rest.where(~taken)
    return rules


def decision(rules: list[Rule]) -> Column:
    """Number of the first rule that a row with base statistics meets, or 0: an ordered CASE."""
    out = None
    for i, rule in enumerate(rules, 1):
        out = F.when(F.expr(rule.sql()), i) if out is None else out.when(F.expr(rule.sql()), i)
    return F.lit(0) if out is None else out.otherwise(0)


def quality_rules(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    sample: int = 20_000,
    **learning: float,
) -> DataFrame:
    """Every row of ``docs`` as row (struct of all its columns), with the base statistics, base_failed, rule (first rule met, 0 for none) and kept.

    kept is false where base_failed, or where a learned rule says that the document is bad. Labels: 1 good, 0 bad;
    null labels and labels without a document are passed over. Rows are never dropped or merged; a null text has
    no words and fails the base rule. Only the labelled rows are read for learning, at most ``sample`` of them; their
    ids, so many at most, are broadcast. Columns of ``docs`` may have any name.
    """
    labelled = labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_label")).where("_id IS NOT NULL AND _label IN (0, 1)")
    labelled = labelled.groupBy("_id").agg(F.min("_label").alias("_label"))
    chosen = labelled.withColumn("_order", F.xxhash64("_id")).orderBy("_order", "_id").limit(sample)
    texts = docs.select(docs[id_col].alias("_id"), docs[text_col].alias("_given"))
    learn = with_base(texts.join(F.broadcast(chosen), "_id"), "_given").drop("_given").where("NOT base_failed").withColumn("bad", 1 - F.col("_label"))
    rules = learn_rules(learn, **learning)
    packed = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), docs[text_col].alias("_given"))
    scored = with_base(packed, "_given").drop("_given").withColumn("rule", decision(rules))
    return scored.withColumn("kept", ~F.col("base_failed") & (F.col("rule") == 0))


BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


@query("op5_quality_rules")
def op5(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return quality_rules(docs, table(spark, folder, "labels")).select("row.doc_id", *BASE, "base_failed", "kept", "rule")
