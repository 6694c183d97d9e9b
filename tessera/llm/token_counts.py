"""Token counts per document from flat token files without an index, by a separator scan.

A flat file is a row of blocks of ids, cut anywhere; only the end-of-document id tells documents apart.
Each block is searched on its own (one vector comparison). Boundaries are then stitched by a prefix scan
over the blocks' sums (ids, separators, last separator), so a document may span any number of blocks.
Blocks are rows of a Parquet data set: file, block, width (bytes of an id), ids (little-endian, unsigned).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import arrow_schema, given_id, ids_of, materialised, plain, query, shared_folder, table, text_batches
from tessera.llm.tokens import encoder

FLAT = "file string, block int, width int, ids binary"
NAMES = "file string, block int, names array<long>"


def write_flat_tokens(
    docs: DataFrame,
    path: str,
    tokenizer: str,
    end_id: int,
    block_ids: int = 1 << 19,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> None:
    """Write every text's ids and ``end_id`` as flat files, in the order in which the rows are read, without a shuffle.

    An ``end_id`` that a text itself yields is refused: nothing would tell it from the end of that text. Null texts are empty (the end id alone). Below ``path``: ``kind=tokens`` has the flat files, in which nothing
    tells where a document begins; ``kind=names`` lists each file's document ids in order (``block``: ordinal of the first).
    """
    schema, arrow = arrow_schema("kind string, file string, block int, width int, ids binary, names array<long>")

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        file = f"{TaskContext.get().partitionId():08d}"
        encode = encoder(tokenizer, "byte-level")
        kind = "<u4" if max(encode.tokenizer.get_vocab_size(), end_id + 1) > 1 << 16 else "<u2"
        number, named, waiting = 0, 0, np.empty(0, kind)

        def row(*values: object) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(values, arrow, strict=True)], schema=arrow)

        for rows, data, row_start in text_batches(batches, 1 << 20):
            ids, counts = encode.encode_bytes(data, row_start)
            if (ids == end_id).any():
                raise ValueError(f"a text yields the id {end_id}, which is to end documents")
            ends = np.cumsum(counts + 1) - 1
            whole = np.full(len(ids) + len(ends), end_id, kind)
            inner = np.ones(len(whole), bool)
            inner[ends] = False
            whole[inner] = ids
            yield row("names", file, named, None, None, ids_of(rows))
            named += rows.num_rows
            waiting = np.concatenate([waiting, whole])
            while len(waiting) >= block_ids:
                yield row("tokens", file, number, waiting.itemsize, waiting[:block_ids].tobytes(), None)
                number, waiting = number + 1, waiting[block_ids:]
        if len(waiting):
            yield row("tokens", file, number, waiting.itemsize, waiting.tobytes(), None)

    flat = plain(docs, id_col, text_col).mapInArrow(blocks, schema)
    flat.write.option("compression", "zstd").partitionBy("kind").parquet(path)


def count_tokens(spark: SparkSession, path: str, end_id: int) -> DataFrame:
    """One row per document of flat files: file, ordinal, start, n_tokens (with the separator), closed.

    Ids behind a file's last separator are a document that is not closed. Neither empty blocks nor
    empty files give rows. Every id equal to ``end_id`` closes a document, so a document may hold
    the separator alone.
    """
    schema, arrow = arrow_schema("file string, block int, n_ids long, ends array<int>")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                file, block, width, data = (batch.column(i)[r].as_py() for i in range(4))
                ids = np.frombuffer(data, f"<u{width}")
                values = [file, block, len(ids), np.flatnonzero(ids == end_id)]
                yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(values, arrow, strict=True)], schema=arrow)

    found = materialised(spark.read.schema(FLAT).parquet(path).mapInArrow(scan, schema))
    sums = found.select("file", "block", "n_ids", F.size("ends").alias("n_ends"), F.try_element_at("ends", F.lit(-1)).alias("last"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("offset", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))
    sums = sums.withColumn("last", F.col("offset") + F.col("last"))
    sums = sums.select(
        "file",
        "block",
        "offset",
        F.coalesce(F.sum("n_ends").over(before), F.lit(0)).alias("ordinal"),
        F.coalesce(F.max("last").over(before) + 1, F.lit(0)).alias("open_since"),
    )
    ends = found.join(sums, ["file", "block"]).select(
        "file", "offset", "ordinal", "open_since", "ends", F.posexplode("ends").alias("k", "end")
    )
    start = F.when(F.col("k") == 0, F.col("open_since")).otherwise(F.col("offset") + F.get("ends", F.col("k") - 1) + 1)
    closed = ends.select(
        "file",
        (F.col("ordinal") + F.col("k")).alias("ordinal"),
        start.alias("start"),
        (F.col("offset") + F.col("end") + 1 - start).alias("n_tokens"),
        F.lit(True).alias("closed"),
    )
    last_end = F.max(F.col("offset") + F.try_element_at("ends", F.lit(-1))) + 1
    tails = found.join(sums, ["file", "block"]).groupBy("file").agg(
        F.sum(F.size("ends")).cast("long").alias("ordinal"),
        F.coalesce(last_end, F.lit(0)).cast("long").alias("start"),
        F.sum("n_ids").alias("total"),
    )
    tails = tails.where("total > start").select(
        "file", "ordinal", "start", (F.col("total") - F.col("start")).alias("n_tokens"), F.lit(False).alias("closed")
    )
    return closed.unionByName(tails)


def with_document_ids(counts: DataFrame, names: str, id_col: str = "doc_id") -> DataFrame:
    """Name the documents of flat files by the list that was written beside them. Null ids stay null."""
    listed = counts.sparkSession.read.schema(NAMES).parquet(names).select("file", "block", F.posexplode("names").alias("k", "id"))
    listed = listed.select("file", (F.col("block") + F.col("k")).cast("long").alias("ordinal"), "id")
    return counts.join(listed, ["file", "ordinal"]).select(given_id(id_col), "file", "ordinal", "start", "n_tokens", "closed")


#: The first id beyond byte_bpe_50k's vocabulary. Its own end of text, 50256, also stands for a text's "<|endoftext|>".
END_ID = 50257


@query("op10_token_counts")
def op10(spark: SparkSession, folder: str) -> DataFrame:
    path = shared_folder(spark)
    write_flat_tokens(table(spark, folder, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"), END_ID)
    return with_document_ids(count_tokens(spark, f"{path}/kind=tokens", END_ID), f"{path}/kind=names")
