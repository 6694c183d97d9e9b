"""Best-fit decreasing packing of token pieces into fixed-size sequences.

Pieces of equal length are interchangeable, so the packing needs only how many pieces
of each length there are: a table bounded by the capacity, whatever the corpus. The
plan takes lengths in descending order and puts each run of equal pieces into the
tightest open sequences, found with a segment tree over the remaining capacities. It
yields runs (first rank, count, first sequence, offset); Spark ranks the pieces of each
length and joins them to the runs. The result is that of best-fit decreasing over the
whole corpus, one piece at a time.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import arrow_schema, given_id, ids_of, materialised, plain, query, table, text_batches
from tessera.llm.tokens import encoder

#: Bytes of text encoded at a time.
_SLICE = 1 << 20


class RemainingCapacities:
    """Segment tree over remaining capacities 0..capacity that have open sequences."""

    def __init__(self, capacity: int):
        self.size = 1
        while self.size <= capacity:
            self.size *= 2
        self.open = [False] * (2 * self.size)

    def set(self, remaining: int, is_open: bool) -> None:
        i = remaining + self.size
        self.open[i] = is_open
        while i > 1:
            i //= 2
            self.open[i] = self.open[2 * i] or self.open[2 * i + 1]

    def tightest(self, at_least: int) -> int | None:
        """The smallest remaining capacity of at least ``at_least`` that is open."""
        i = at_least + self.size
        if self.open[i]:
            return at_least
        while i > 1:
            if i % 2 == 0 and self.open[i + 1]:
                i += 1
                while i < self.size:
                    i = 2 * i if self.open[2 * i] else 2 * i + 1
                return i - self.size
            i //= 2
        return None


def plan_runs(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Runs ``(length, first_rank, count, first_sequence, offset)`` of best-fit decreasing.

    The pieces of a run lie in consecutive sequences at the same offset. Work and output depend
    on the number of different lengths, not on the number of pieces. Lengths of 0 take no place
    and go to sequence 0.
    """
    tree = RemainingCapacities(capacity)
    spans: dict[int, list[tuple[int, int]]] = {}  # remaining -> runs of consecutive sequences
    runs: list[tuple[int, int, int, int, int]] = []
    sequences = 0

    def leave(remaining: int, first: int, many: int) -> None:
        if remaining:
            spans.setdefault(remaining, []).append((first, many))
            tree.set(remaining, True)

    for length in sorted((n for n, c in counts.items() if n > 0 and c), reverse=True):
        if length > capacity:
            raise ValueError(f"a piece of {length} tokens exceeds {capacity}")
        rank, left = 0, counts[length]
        while left:
            remaining = tree.tightest(length)
            if remaining is None:
                remaining = capacity
                each = capacity // length
                first, many = sequences, -(-left // each)
                sequences += many
            else:
                each = remaining // length
                first, many = spans[remaining].pop()
                if not spans[remaining]:
                    tree.set(remaining, False)
            # one piece after the other would fill the tightest sequence before the next is touched
            full = min(many, left // each)
            last = min(left - full * each, each) if full < many else 0
            for group, size, pieces in ((first, full, each), (first + full, min(last, 1), last)):
                if size:
                    for k in range(pieces):
                        runs.append((length, rank, size, group, capacity - remaining + k * length))
                        rank += size
                    leave(remaining - pieces * length, group, size)
            used = full + min(last, 1)
            if used < many:
                leave(remaining, first + used, many - used)
            left = counts[length] - rank
    if counts.get(0):
        runs.append((0, 0, counts[0], 0, 0))
    return runs


def token_pieces(
    docs: DataFrame, tokenizer: str, capacity: int, end_id: int, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Pieces of at most ``capacity`` ids of every text's ids and ``end_id``: id, piece, start, length, ids_crc32."""
    schema, arrow = arrow_schema("id long, piece int, start long, length long, ids_crc32 long")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer, "spaceless").encode_bytes
        for rows, data, row_start in text_batches(batches, _SLICE):
            ids, counts = encode(data, row_start)
            out: list[tuple[int, int, int, int, int]] = []
            at = 0
            for key, n in zip(ids_of(rows).tolist(), counts.tolist(), strict=True):
                own = np.append(ids[at : at + n], np.uint32(end_id)).astype("<u4")
                at += n
                for piece, start in enumerate(range(0, n + 1, capacity)):
                    part = own[start : start + capacity]
                    out.append((key, piece, start, len(part), zlib.crc32(part.tobytes())))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), arrow, strict=True)], schema=arrow)

    return plain(docs, id_col, text_col).mapInArrow(cut, schema)


def packed(pieces: DataFrame, capacity: int, keys: list[str], length_col: str = "length") -> DataFrame:
    """Each row of ``pieces`` with ``sequence_id`` and ``offset``.

    Every sequence is gapless from 0. Pieces of one length are ranked by ``keys``; rows that agree in
    all keys take different places, in any order. An empty table gives an empty table.
    ``pieces`` is read several times and should be materialised. Ranks come from two levels: rows are
    dealt to parts by a hash of their keys, ranked in (length, part), and the parts' counts, of which
    there are at most capacity times parts, are summed. A common length is thus spread over the parts.
    """
    spark = pieces.sparkSession
    parts = max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
    part = F.pmod(F.xxhash64(*keys), F.lit(parts)).cast("int")
    rows = pieces.withColumns({"_len": F.col(length_col).cast("int"), "_part": part})
    counts = rows.groupBy("_len", "_part").agg(F.count(F.lit(1)).alias("_n"))
    by_length = Window.partitionBy("_len").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.withColumn("_before", F.coalesce(F.sum("_n").over(by_length), F.lit(0))).drop("_n")
    # at most one row per length: bounded by the capacity
    totals = {r["_len"]: r["n"] for r in counts.groupBy("_len").agg(F.sum("_n").alias("n")).collect()}
    runs = plan_runs(totals, capacity)
    plan = spark.createDataFrame(
        runs or [(-1, 0, 0, 0, 0)], "_len int, _first long, _count long, _sequence long, _offset long"
    )
    # runs of a length follow one another, so a rank's run is the one with the greatest first rank up to it
    steps = plan.groupBy("_len").agg(
        F.array_sort(F.collect_list(F.struct("_first", "_count", "_sequence", "_offset"))).alias("_runs")
    )
    ranked = rows.withColumn("_rank", F.row_number().over(Window.partitionBy("_len", "_part").orderBy(*keys)) - 1)
    ranked = ranked.join(before, ["_len", "_part"]).withColumn("_rank", F.col("_rank") + F.col("_before"))
    placed = ranked.join(F.broadcast(steps), "_len").withColumn(
        "_run",
        F.filter("_runs", lambda r: (r["_first"] <= F.col("_rank")) & (F.col("_rank") < r["_first"] + r["_count"]))[0],
    )
    return placed.select(
        *pieces.columns,
        (F.col("_run._sequence") + F.col("_rank") - F.col("_run._first")).alias("sequence_id"),
        F.col("_run._offset").alias("offset"),
    )


def pack_documents(
    docs: DataFrame,
    tokenizer: str,
    capacity: int = 4096,
    end_id: int = 1,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Pieces of all documents packed by best-fit decreasing over the whole corpus.

    One row per piece: the id, piece, start, length, ids_crc32, sequence_id and offset. A null or empty text is one piece with
    the end id alone. Null ids are kept; repeated rows are packed one by one; other columns of ``docs``
    are not read.
    """
    pieces = materialised(token_pieces(docs, tokenizer, capacity, end_id, id_col, text_col))
    return packed(pieces, capacity, ["id", "piece", "ids_crc32"]).select(
        given_id(id_col), "piece", "start", "length", "ids_crc32", "sequence_id", "offset"
    )


@query("op3_best_fit_packing")
def op3(spark: SparkSession, folder: str) -> DataFrame:
    return pack_documents(table(spark, folder, "documents"), public_tokenizers.path("word_bpe_49k.json"))
