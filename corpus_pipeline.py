"""Training-data pipeline over ``documents``: each stage calls one operator of ``tessera.llm``.

Rules first, since they are cheapest and drop junk; then near copies, so that later stages see each text once; then
repeated passages; then benchmark passages, judged on the text as it will be used; then packing.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import shared_folder
from tessera.llm.decontaminate import occurrences
from tessera.llm.jaccard import jaccard_groups
from tessera.llm.packing import pack_documents
from tessera.llm.quality_rules import quality_rules
from tessera.llm.substring import dedup_substrings


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that neither the base rule nor a learned rule rejects."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality_rules(docs, labels).where("kept").select("row.*")


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least id of each Jaccard group; of equal rows all stay, and rows without an id stay."""
    groups = jaccard_groups(docs)
    gone = groups.where("component_id IS NOT NULL AND doc_id != component_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without words of windows that occur earlier; an untouched text stays as it is, an emptied one goes."""
    cut = dedup_substrings(docs).where("n_removed > 0").dropDuplicates(["doc_id"]).select(F.col("doc_id").alias("id"), F.struct("n_words", "n_removed", "kept").alias("cut"))
    own = {"text": F.col("cut.kept"), "n_chars": F.char_length("cut.kept").cast("long")}
    names = {c: f"given_{i}" for i, c in enumerate(docs.columns)}  # so that no column clashes with the operator's
    rows = docs.toDF(*names.values())
    joined = rows.join(cut, F.col(names["doc_id"]) == F.col("id"), "left").where("cut IS NULL OR cut.n_removed < cut.n_words")
    return joined.select(*[(F.when(F.col("cut").isNotNull(), own[c]).otherwise(F.col(n)) if c in own else F.col(n)).alias(c) for c, n in names.items()])


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item occurs."""
    found = occurrences(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), free_ends=True).select("doc_id").distinct()
    return docs.join(found, "doc_id", "left_anti").select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences of 4096 tokens."""
    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality_rules", rules),
    ("near_copies", near_copies),
    ("repeated_passages", repeated_passages),
    ("decontamination", decontamination),
    ("packing", packing),
]

#: Learned rules and tokenizers have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again before the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = shared_folder(spark)
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
