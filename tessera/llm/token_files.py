"""Token files: one concatenated id array per block, with Elias-Fano coded document ends.

File format (a Parquet data set, so that it can be written to and read from any store
that Spark reaches). One row per block of consecutive documents, ascending in the document id:

========== ======= ====================================================================
shard      int     range of document ids, ascending
block      int     place of the block in its shard, from 0
n_docs     long    documents in the block
n_ids      long    ids in the block
doc_ids    binary  signed 64-bit document ids, little-endian
ids        binary  unsigned ids of ``width`` bytes, little-endian, documents end to end
width      int     2 or 4
low_bits   int     bits of each document end held in ``low``
low        binary  low bits of the ends, packed, least significant bit first
high       binary  upper parts in unary: bit ``(end >> low_bits) + i`` is set for document i
========== ======= ====================================================================

The end of document i is ``select1(high, i) - i`` over its low bits: about 2 + log2(n_ids / n_docs)
bits per document instead of 64. ``EliasFano`` answers single ends without decoding the rest.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import arrow_schema, given_id, ids_of, plain, query, shared_folder, table, text_batches
from tessera.llm.tokens import encoder

#: Bytes of text in a block (a longer document is a block of its own).
BLOCK = 2 << 20

FORMAT = (
    "shard int, block int, n_docs long, n_ids long, doc_ids binary, ids binary, width int, low_bits int, low binary, high binary"
)


class EliasFano:
    """Non-decreasing non-negative integers in near-minimal space, with select."""

    #: Set bits between two sampled places of the upper part.
    STEP = 256

    def __init__(self, n: int, low_bits: int, low: bytes, high: bytes):
        self.n, self.low_bits = n, low_bits
        self.low = np.frombuffer(low, np.uint8)
        self.high = np.frombuffer(high, np.uint8)
        ones = np.bitwise_count(self.high).astype(np.int64)
        self.ones_before = np.concatenate([[0], np.cumsum(ones)])[:: self.STEP // 8]

    @staticmethod
    def encode(values: np.ndarray) -> tuple[int, bytes, bytes]:
        """``(low_bits, low, high)``."""
        n = len(values)
        if not n:
            return 0, b"", b""
        values = values.astype(np.int64)
        low_bits = max(0, int(values[-1]) // n).bit_length() - 1
        low_bits = max(low_bits, 0)
        at = np.arange(n)
        high = np.zeros((int(values[-1]) >> low_bits) + n, np.uint8)
        high[(values >> low_bits) + at] = 1
        low = (values[:, None] >> np.arange(low_bits)) & 1
        return low_bits, np.packbits(low.astype(np.uint8).ravel(), bitorder="little").tobytes(), np.packbits(high, bitorder="little").tobytes()

    def _low(self, i: int) -> int:
        value = 0
        for k in range(self.low_bits):
            bit = i * self.low_bits + k
            value |= (int(self.low[bit >> 3]) >> (bit & 7) & 1) << k
        return value

    def select(self, i: int) -> int:
        """Value i: the place of the i-th set bit, found from the nearest sample on."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        sample = int(np.searchsorted(self.ones_before, i, side="right")) - 1
        byte, seen = sample * (self.STEP // 8), int(self.ones_before[sample])
        while seen + (c := int(self.high[byte]).bit_count()) <= i:
            seen, byte = seen + c, byte + 1
        for bit in range(8):
            if self.high[byte] >> bit & 1:
                if seen == i:
                    return (byte * 8 + bit - i) << self.low_bits | self._low(i)
                seen += 1
        raise AssertionError

    def all(self) -> np.ndarray:
        """All values at once."""
        if not self.n:
            return np.empty(0, np.int64)
        places = np.flatnonzero(np.unpackbits(self.high, bitorder="little"))[: self.n]
        value = (places - np.arange(self.n)) << self.low_bits
        if self.low_bits:
            bits = np.unpackbits(self.low, bitorder="little")[: self.n * self.low_bits].reshape(self.n, self.low_bits)
            value |= bits.astype(np.int64) @ (1 << np.arange(self.low_bits))
        return value


def write_token_files(
    docs: DataFrame, path: str, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text"
) -> None:
    """Write every text's ids and ``end_id`` in ascending document order.

    Null texts are empty (the end id alone); null ids come first; repeated ids stay next to each
    other; an empty table writes no block. Texts are range-partitioned by id before they are
    encoded, so each is encoded once.
    """
    schema, arrow = arrow_schema(FORMAT)

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard = TaskContext.get().partitionId()
        encode = encoder(tokenizer, "byte-level").encode_bytes
        wide = encoder(tokenizer, "byte-level").tokenizer.get_vocab_size() > 1 << 16
        for number, (rows, data, row_start) in enumerate(text_batches(batches, BLOCK)):
            ids, counts = encode(data, row_start)
            ends = np.cumsum(counts + 1)
            whole = np.full(int(ends[-1]), end_id, "<u4" if wide else "<u2")
            inner = np.ones(len(whole), bool)
            inner[ends - 1] = False
            whole[inner] = ids
            row = [shard, number, len(counts), len(whole), ids_of(rows).astype("<i8").tobytes(), whole.tobytes(), whole.itemsize]
            row += EliasFano.encode(ends)
            yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, arrow, strict=True)], schema=arrow)

    ordered = plain(docs, id_col, text_col).repartitionByRange("id").sortWithinPartitions("id")
    ordered.mapInArrow(blocks, schema).write.option("compression", "zstd").parquet(path)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """One row per document from the files: id, start (ids before it in the whole corpus), n_tokens, ids_crc32.

    Starts come from the blocks' sizes: sums per shard, of which there are few, then inside each shard.
    """
    files = spark.read.schema(FORMAT).parquet(path)
    sizes = files.select("shard", "block", "n_ids")
    shards = sizes.groupBy("shard").agg(F.sum("n_ids").alias("_n"))
    earlier = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shards = shards.select("shard", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_shard_start"))
    inside = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.withColumn("_in_shard", F.coalesce(F.sum("n_ids").over(inside), F.lit(0))).join(shards, "shard")
    starts = starts.select("shard", "block", (F.col("_shard_start") + F.col("_in_shard")).alias("block_start"))
    schema, arrow = arrow_schema("shard int, block int, id long, first long, n_tokens long, ids_crc32 long")

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                row = {name: batch.column(i)[r].as_py() for i, name in enumerate(batch.schema.names)}
                ends = EliasFano(row["n_docs"], row["low_bits"], row["low"], row["high"]).all()
                first = np.concatenate([[0], ends[:-1]])
                ids = np.frombuffer(row["ids"], f"<u{row['width']}").astype("<u4")
                sums = [zlib.crc32(ids[a:b]) for a, b in zip(first.tolist(), ends.tolist(), strict=True)]
                n = row["n_docs"]
                columns = [np.full(n, row["shard"]), np.full(n, row["block"]), np.frombuffer(row["doc_ids"], "<i8"), first, ends - first, sums]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

    found = files.drop("n_ids").mapInArrow(documents, schema)
    return found.join(starts, ["shard", "block"]).select(
        "id", (F.col("block_start") + F.col("first")).alias("start"), "n_tokens", "ids_crc32"
    )


@query("op6_token_files")
def op6(spark: SparkSession, folder: str) -> DataFrame:
    path = shared_folder(spark)
    write_token_files(table(spark, folder, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"), end_id=2)
    return read_token_files(spark, path).select(given_id("doc_id"), "start", "n_tokens", "ids_crc32")
