"""Quality classifier by co-training of two views.

One classifier sees the words of a text, the other only what is known about the page (language, source, length). In each
round both score all unlabelled documents, and each hands its most confident pseudo-labels, equally many of both kinds, to
the other's training rows. At the end each view is calibrated on held-out labelled rows, the two calibrated views are
combined by a logistic model of their logits, and all documents are scored.

Texts are read once: a stored table keeps each document's features as small numbers. A round is two passes over it, one
that counts scores and one that keeps the rows beyond the resulting thresholds. Only labelled rows are bounded (``sample``);
pseudo-labels are a ``share`` of all unlabelled rows, taken anew in every round. The models are fitted by pyspark.ml.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel, VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import NO_ID, arrow_schema, given_id, materialised, query, stored, table
from tessera.llm.words import SLICE, lower_ascii, mix, slices, space_words

VIEWS = ("text", "page")
PAGE_BITS = 10

#: Ranges of the logit in which a round counts scores, and the logit beyond which they are one range.
_RANGES, _TOP = 4000, 40.0

#: Partitions of the training rows: every step of a fit is a job over them.
_TRAINING_PARTS = 8


def featured(docs: DataFrame, page_cols: list[str], text_bits: int, id_col: str, text_col: str) -> DataFrame:
    """id, text and page: the distinct hashed words of a text (A-Z in lower case), and the hashed fields with the length's magnitude."""
    schema, arrow = arrow_schema("id long, text array<int>, page array<int>")
    fields = [F.pmod(F.xxhash64(F.lit(c), F.coalesce(docs[c].cast("string"), F.lit("?"))), F.lit(1 << PAGE_BITS)).cast("int") for c in page_cols]
    text = F.coalesce(docs[text_col], F.lit(""))
    size = F.pmod(F.xxhash64(F.lit("size"), F.floor(2 * F.log2(F.char_length(text) + 1))), F.lit(1 << PAGE_BITS)).cast("int")
    plain = docs.select(F.coalesce(docs[id_col].cast("long"), F.lit(NO_ID)).alias("id"), text.alias("text"), F.array_distinct(F.array(*fields, size)).alias("page"))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, row_start in slices(batch.column("text"), SLICE):
                words = space_words(lower_ascii(data), row_start)
                place = (mix(words.hashes()) & np.uint64((1 << text_bits) - 1)).astype(np.int64)
                keys = np.unique((words.text_of_word() << text_bits) | place)
                counts = np.bincount(keys >> text_bits, minlength=b - a)
                offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
                text = pa.ListArray.from_arrays(pa.array(offsets), pa.array((keys & ((1 << text_bits) - 1)).astype(np.int32)))
                own = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([own.column("id"), text.cast(arrow.field("text").type), own.column("page").cast(arrow.field("page").type)], schema=arrow)

    return plain.mapInArrow(hashed, schema)


@dataclass(frozen=True)
class View:
    """A linear model over hashed features: ``weights`` by feature number."""

    weights: np.ndarray
    intercept: float

    def logits(self, features: pa.ListArray) -> np.ndarray:
        counts = np.diff(features.offsets.to_numpy())
        flat = self.weights[features.flatten().to_numpy()]
        return self.intercept + np.bincount(np.repeat(np.arange(len(counts)), counts), flat, len(counts))


def _fit(rows: DataFrame, view: str, bits: int) -> View:
    vectors = CountVectorizerModel.from_vocabulary([str(i) for i in range(1 << bits)], inputCol="w", outputCol="x")  # feature i at place i
    train = vectors.setBinary(True).transform(rows.select(F.col(view).cast("array<string>").alias("w"), "good")).select("x", "good")
    model = LogisticRegression(featuresCol="x", labelCol="good", regParam=0.003, maxIter=40).fit(train)
    return View(model.coefficients.toArray(), float(model.intercept))


def _confident(unlabelled: DataFrame, models: dict[str, View], confident: float, share: float) -> DataFrame | None:
    """view, text, page, good: rows that ``view`` is surest of, ``share`` of all rows of each kind and at least ``confident``.

    A first pass counts logits by range; where a range would exceed the share, the least hashes of ids in it are taken.
    """
    width, least = _TOP / _RANGES, float(np.log(confident / (1 - confident)))

    def ranges(z: np.ndarray) -> np.ndarray:
        return np.minimum((np.abs(z) / width).astype(np.int64), _RANGES - 1)

    schema, arrow = arrow_schema("sums array<long>")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((len(VIEWS), 2, _RANGES), np.int64)
        for batch in batches:
            for v, view in enumerate(VIEWS):
                z = models[view].logits(batch.column(view))
                sure = np.abs(z) >= least
                np.add.at(sums[v], ((z[sure] > 0).astype(np.int64), ranges(z[sure])), 1)
        yield pa.RecordBatch.from_arrays([pa.array([sums.ravel()], arrow.field("sums").type)], schema=arrow)

    parts = unlabelled.mapInArrow(count, schema)
    totals = parts.select(F.posexplode("sums").alias("i", "n")).where("n > 0").groupBy("i").agg(F.sum("n").alias("n")).collect()  # at most 16,000
    sums = np.zeros(len(VIEWS) * 2 * _RANGES, np.int64)
    for r in totals:
        sums[r["i"]] = r["n"]
    sums = sums.reshape(len(VIEWS), 2, _RANGES)
    most = max(1, int(share * unlabelled.count()))
    cuts: dict[str, list[tuple[int, float]]] = {}
    for v, view in enumerate(VIEWS):
        n = min(most, *(int(sums[v, k].sum()) for k in (0, 1)))
        if not n:
            continue
        cuts[view] = []
        for k in (0, 1):
            beyond = np.cumsum(sums[v, k][::-1])[::-1]
            edge = int(np.flatnonzero(beyond >= n)[-1])
            above = int(beyond[edge] - sums[v, k][edge])
            cuts[view].append((edge, (n - above) / int(sums[v, k][edge])))
    if not cuts:
        return None
    pick, pick_arrow = arrow_schema("view string, text array<int>, page array<int>, good int")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("id").to_numpy(zero_copy_only=False).astype(np.int64)
            lot = mix(ids.view(np.uint64) + np.uint64(1)).astype(np.float64) / 2.0**64
            for view, edges in cuts.items():
                z = models[view].logits(batch.column(view))
                own, kind = ranges(z), (z > 0).astype(np.int64)
                edge, part = np.array([e for e, _ in edges])[kind], np.array([f for _, f in edges])[kind]
                at = np.flatnonzero((np.abs(z) >= least) & ((own > edge) | ((own == edge) & (lot < part))))
                if len(at):
                    rows = batch.take(pa.array(at))
                    yield pa.RecordBatch.from_arrays([pa.array([view] * len(at)), rows.column("text"), rows.column("page"), pa.array(kind[at].astype(np.int32))], schema=pick_arrow)

    return materialised(unlabelled.mapInArrow(keep, pick).repartition(_TRAINING_PARTS))


def cotrain(labelled: DataFrame, unlabelled: DataFrame, text_bits: int, rounds: int = 2, confident: float = 0.95, share: float = 0.02) -> dict[str, View]:
    """Both views after ``rounds`` of exchange. ``labelled``: text, page, good; ``unlabelled``: id, text, page."""
    bits = dict(zip(VIEWS, (text_bits, PAGE_BITS), strict=True))
    models = {v: _fit(labelled, v, bits[v]) for v in VIEWS}
    for _ in range(rounds):
        handed = _confident(unlabelled, models, confident, share)
        if handed is None:
            break
        for view, other in (VIEWS, VIEWS[::-1]):
            own = handed.where(F.col("view") == view).select(*VIEWS, "good")
            models[other] = _fit(labelled.select(*VIEWS, "good").union(own), other, bits[other])
    return models


def _scored(rows: DataFrame, models: dict[str, View], keep: str) -> DataFrame:
    """The column ``keep`` and both logits."""
    kind = dict(rows.dtypes)[keep]
    schema, arrow = arrow_schema(f"{keep} {kind}, text_z double, page_z double")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            z = [pa.array(models[v].logits(batch.column(v))) for v in VIEWS]
            yield pa.RecordBatch.from_arrays([batch.column(keep), *z], schema=arrow)

    return rows.select(keep, *VIEWS).mapInArrow(score, schema)


def _line(rows: DataFrame, columns: list[str]) -> tuple[np.ndarray, float]:
    rows = VectorAssembler(inputCols=columns, outputCol="x").transform(rows)
    model = LogisticRegression(featuresCol="x", labelCol="good", regParam=0.001).fit(rows)
    return model.coefficients.toArray(), float(model.intercept)


def _two_kinds(rows: DataFrame) -> bool:
    return rows.select("good").distinct().limit(2).count() == 2


def classify_quality(
    docs: DataFrame,
    labels: DataFrame,
    page_cols: list[str],
    id_col: str = "doc_id",
    text_col: str = "text",
    good: Column | None = None,
    sample: int = 20_000,
    rounds: int = 2,
    text_bits: int = 16,
    confident: float = 0.95,
    share: float = 0.02,
) -> DataFrame:
    """One row per row of ``docs``: id, p_text, p_page (calibrated), score (combined) and kept (score of one half or more).

    ``good`` is a condition on ``labels`` (default: quality is 1 and toxic is not 1); rows for which it is null are passed over.
    At most ``sample`` labelled rows (least hashes of their ids) are learned from; a fifth of them is held out for
    calibration. Where either part would hold one kind only, all labelled rows serve for both. A null text has no
    words, a null field is a value of its own, null ids are kept as null and have no label. With labels of one kind, or none,
    among the documents nothing can be learned: the probabilities are null and every row is kept. An empty table gives an
    empty table.
    """
    good = (F.col("quality") == 1) & (F.coalesce(F.col("toxic"), F.lit(0)) != 1) if good is None else good
    known = labels.select(F.col(id_col).cast("long").alias("id"), good.cast("int").alias("good")).where("id IS NOT NULL AND good IS NOT NULL")
    known = known.groupBy("id").agg(F.min("good").alias("good")).withColumn("order", F.xxhash64("id"))
    known = materialised(known.orderBy("order", "id").limit(sample))
    rows = stored(featured(docs, page_cols, text_bits, id_col, text_col))
    labelled = materialised(rows.join(F.broadcast(known), "id").select(*VIEWS, "good", F.pmod(F.col("order"), F.lit(5)).alias("fold")).repartition(_TRAINING_PARTS))
    if not _two_kinds(labelled):
        return rows.select(given_id(id_col), *(F.lit(None).cast("double").alias(c) for c in ("p_text", "p_page", "score")), F.lit(True).alias("kept"))
    train, held = labelled.where("fold != 0"), labelled.where("fold = 0")
    if not (_two_kinds(train) and _two_kinds(held)):
        train = held = labelled
    unlabelled = rows.join(F.broadcast(known.select("id")), "id", "left_anti")  # at most ``sample`` ids
    models = cotrain(train, unlabelled, text_bits, rounds, confident, share)
    scored = _scored(held, models, "good")
    # Platt scaling of each view, then a logistic model of both calibrated logits
    lines = {v: _line(scored, [f"{v}_z"]) for v in VIEWS}
    calibrated = {v: F.lit(float(w[0])) * F.col(f"{v}_z") + F.lit(b) for v, (w, b) in lines.items()}
    weights, intercept = _line(scored.select("good", *(c.alias(f"{v}_c") for v, c in calibrated.items())), [f"{v}_c" for v in VIEWS])
    both = sum((F.lit(float(w)) * calibrated[v] for w, v in zip(weights, VIEWS, strict=True)), F.lit(intercept))
    sigmoid = lambda c: 1 / (1 + F.exp(-c))
    out = _scored(rows, models, "id").select("id", *(sigmoid(c).alias(f"p_{v}") for v, c in calibrated.items()), sigmoid(both).alias("score"))
    return out.select(given_id(id_col), "p_text", "p_page", "score", (F.col("score") >= 0.5).alias("kept"))


@query("op2_cotraining")
def op2(spark: SparkSession, folder: str) -> DataFrame:
    return classify_quality(table(spark, folder, "documents"), table(spark, folder, "labels"), ["lang", "source"])
