"""Stupid-backoff language-model scores, computed relationally.

Texts are taken in slices. Every slice is exploded into its distinct n-grams of all orders, told apart by 64-bit hashes, with
their counts. The n-gram count tables are partitioned by ranges of the hash: a slice sends each range its n-grams, sorted and
counted, so a frequent n-gram is one entry per slice; the range adds the counts of all slices and answers each slice with the
totals of its own n-grams. Answers are joined to the slices, n-grams not found back off to the next lower order at a factor
``alpha``, and the logarithms are summed per document.

The slices are a stored table, so a lost executor repeats single slices and ranges and finds the same slices again. A range holds
the n-grams of about ``BLOCK_TEXT`` bytes of text at any size of the corpus.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import arrow_schema, given_id, ids_of, plain, query, stored, table, text_batches
from tessera.llm.words import SLICE, Words, from_bytes, lower_ascii, mix, rolling, space_words, to_bytes

#: Bytes of text behind one hash range of the count tables.
BLOCK_TEXT = 16 << 20

#: Bytes of a row group of the slices' table, which bounds what a reader decodes at once.
_ROW_GROUP = 16 << 20


def slices(docs: DataFrame) -> DataFrame:
    """Runs of texts, one row each: slice (random), n_words, n_bytes, ids, row_start and data (compressed bytes, A-Z in lower case)."""
    schema, arrow = arrow_schema("slice long, n_words long, n_bytes long, ids binary, row_start binary, data binary")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, row_start in text_batches(batches, SLICE):
            data = lower_ascii(data)
            n = int(space_words(data, row_start).first[-1])
            row = (uuid.uuid4().int >> 65, n, len(data), ids_of(rows).tobytes(), row_start.astype(np.int64).tobytes(), pa.compress(data.tobytes(), "zstd", asbytes=True))
            yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, arrow, strict=True)], schema=arrow)

    return docs.mapInArrow(cut, schema)


def words_of(batch: pa.RecordBatch, r: int) -> Words:
    row_start = np.frombuffer(batch.column("row_start")[r].as_py(), np.int64)
    data = pa.decompress(batch.column("data")[r].as_py(), int(row_start[-1]), "zstd")
    return space_words(np.frombuffer(data, np.uint8), row_start)


def ngrams(words: Words, order: int) -> tuple[list[np.ndarray], np.ndarray]:
    """For n = 1 .. order the last words of all n-grams, and the hashes of all of them end to end."""
    h = words.hashes()
    place = np.arange(len(h)) - words.first[words.text_of_word()]
    last = [np.flatnonzero(place >= n - 1) for n in range(1, order + 1)]
    keys = [mix(rolling(h, n)[at - n + 1] + np.uint64(n)) for n, at in enumerate(last, 1)]
    return last, np.concatenate(keys)


def range_totals(parts: DataFrame, order: int, blocks: int) -> DataFrame:
    """slice, block and totals: for each slice's distinct n-grams of a hash range, ascending, how often they occur in all slices."""
    send, send_arrow = arrow_schema("slice long, block int, keys binary, counts binary")
    schema, arrow = arrow_schema("slice long, block int, totals binary")

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                keys, counts = np.unique(ngrams(words_of(batch, r), order)[1], return_counts=True)
                if not len(keys):
                    continue
                block = ((keys >> np.uint64(32)) * np.uint64(blocks) >> np.uint64(32)).astype(np.int64)
                cuts = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1], [True]]))
                steps = np.diff(keys, prepend=np.uint64(0))
                number = batch.column("slice")[r].as_py()
                out = []
                for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                    own = steps[a:b].copy()
                    own[0] = keys[a]
                    out.append((number, int(block[a]), to_bytes(own), to_bytes(counts[a:b].astype(np.uint64))))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), send_arrow, strict=True)], schema=send_arrow)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked: dict[int, list[tuple[int, np.ndarray, np.ndarray]]] = {}
        for batch in batches:
            for number, block, keys, counts in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                asked.setdefault(block, []).append((number, np.cumsum(from_bytes(keys), dtype=np.uint64), from_bytes(counts)))
        for block in list(asked):
            slices_of, keys_of, counts_of = zip(*asked.pop(block), strict=True)
            sizes = [len(k) for k in keys_of]
            keys = np.concatenate(keys_of)
            del keys_of
            order_of = np.argsort(keys)
            keys = keys[order_of]
            new = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
            del keys
            sums = np.add.reduceat(np.concatenate(counts_of)[order_of], new)
            totals = np.empty(len(order_of), np.uint64)
            totals[order_of] = np.repeat(sums, np.diff(np.append(new, len(order_of))))
            for number, end, size in zip(slices_of, np.cumsum(sizes).tolist(), sizes, strict=True):
                row = (number, block, to_bytes(totals[end - size : end]))
                yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, arrow, strict=True)], schema=arrow)

    return parts.select("slice", "row_start", "data").mapInArrow(ask, send).repartitionById(blocks, F.col("block")).mapInArrow(add, schema)


def backoff_scores(
    docs: DataFrame, order: int = 2, alpha: float = 0.4, least: int = 2, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per row of ``docs``: the id, n_words, score (sum of log S) and mean_score (score / n_words, null without words).

    S of a word after its context is count(n-gram) / count(context) for the longest n-gram that occurs at least ``least`` times
    in the whole table (and whose context does), times ``alpha`` for each order backed off; at order 1 it is count(word) / all
    words, for any count. Counts run over all documents, the scored one included, and repeated rows each count.

    Words are runs of characters other than blanks and \\x09-\\x0D, with A-Z in lower case. A null or empty text
    scores 0. Null ids are kept. An empty table gives an empty table.
    """
    parts = stored(slices(plain(docs, id_col, text_col)), **{"parquet.block.size": _ROW_GROUP})
    size, total = parts.agg(F.coalesce(F.sum("n_bytes"), F.lit(0)), F.coalesce(F.sum("n_words"), F.lit(0))).first()
    answers = range_totals(parts, order, 1 + size // BLOCK_TEXT)
    answers = answers.groupBy("slice").agg(F.array_sort(F.collect_list(F.struct("block", "totals"))).alias("answers"))
    joined = parts.join(answers, "slice", "left").select("ids", "row_start", "data", F.col("answers.totals").alias("totals"))
    schema, arrow = arrow_schema("id long, n_words long, score double")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                words = words_of(batch, r)
                logs = np.zeros(int(words.first[-1]))
                if len(logs):
                    last, keys = ngrams(words, order)
                    which = np.unique(keys, return_inverse=True)[1]
                    count = np.concatenate([from_bytes(t) for t in batch.column("totals")[r].as_py()])[which].astype(np.float64)
                    below, at = np.zeros(0), 0
                    for n, ends in enumerate(last, 1):
                        own = np.zeros(len(logs))
                        own[ends] = count[at : at + len(ends)]
                        at += len(ends)
                        if n == 1:
                            logs = np.log(own) - np.log(total) + np.log(alpha) * (order - 1)
                        else:
                            hit = np.flatnonzero(own >= least)
                            logs[hit] = np.log(own[hit]) - np.log(below[hit - 1]) + np.log(alpha) * (order - n)
                        below = own
                sums = np.bincount(words.text_of_word(), logs, len(words.counts))
                columns = [np.frombuffer(batch.column("ids")[r].as_py(), np.int64), words.counts, sums]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

    scored = joined.mapInArrow(score, schema)
    return scored.select(given_id(id_col), "n_words", "score", F.when(F.col("n_words") > 0, F.col("score") / F.col("n_words")).alias("mean_score"))


@query("op4_stupid_backoff")
def op4(spark: SparkSession, folder: str) -> DataFrame:
    return backoff_scores(table(spark, folder, "documents"))
