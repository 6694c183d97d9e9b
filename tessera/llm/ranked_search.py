"""Ranked lexical search by the Best Position Algorithm over distributed blocks of impact lists.

Documents are cut into blocks. A block holds an impact list for each query term, which it sorts once the corpus statistics
are known: its documents by descending score contribution. A query reads its lists from the top, a run of positions at a
time. Every document met is scored in full by direct accesses to the query's other lists, which also tells its position
there. So a list's *best position* (all positions before it have been seen, by whatever access) lies at or beyond the last
position read, and the bound on all unseen documents, the sum of the contributions at the best positions, falls sooner.
Reading stops when it is strictly below the query's tenth score so far: an unseen document with an equal score could have
a smaller id. A task carries that tenth score from block to block.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import NO_ID, ORACLE, arrow_schema, given_id, ids_of, plain, query, stored, table, text_batches
from tessera.llm.words import Words, lower_ascii, ranges, split_words

#: Bytes of text behind one block, and its most cells of the table of positions (terms x documents).
BLOCK_TEXT = 8 << 20
BLOCK_CELLS = 16 << 20

#: Bytes of queries whose terms are sent to all tasks at once; a longer single query is sent whole.
QUERY_BYTES = 8 << 20

#: Positions read at first; each further turn reads twice as many.
STRIDE = 16

_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[:128] = [not chr(c).isalnum() for c in range(128)]


def term_words(data: np.ndarray, row_start: np.ndarray) -> Words:
    """Terms: maximal runs of ASCII letters, digits and all other characters from U+0080 on; A-Z in lower case."""
    return split_words(lower_ascii(data), row_start, _SEPARATOR[data])


@dataclass
class Queries:
    """``ids``; ``terms``: the terms' hashes, ascending; ``first``, ``own``: each query's terms as indices into ``terms``."""

    ids: np.ndarray
    terms: np.ndarray
    first: np.ndarray
    own: np.ndarray


def queries_of(rows: list[tuple[int, str]]) -> Queries:
    """Rows with one id are one query; a query's terms count once."""
    data = "\x00".join(t for _, t in rows).encode()
    sizes = np.array([len(t.encode()) + 1 for _, t in rows])
    row_start = np.concatenate([[0], np.cumsum(sizes)])
    row_start[-1] = len(data)
    words = term_words(np.frombuffer(data, np.uint8), row_start)
    ids, which = np.unique(np.array([i for i, _ in rows], np.int64), return_inverse=True)
    terms, number = np.unique(words.hashes(), return_inverse=True)
    pairs = np.unique(np.stack([which[words.text_of_word()], number]), axis=1)
    return Queries(ids, terms, np.searchsorted(pairs[0], np.arange(len(ids) + 1)), pairs[1])


def index_blocks(docs: DataFrame, terms: np.ndarray) -> DataFrame:
    """One row per block: n_docs and n_terms of all its documents with a term, and the postings of the given terms.

    ids, n (terms with repeats) and the postings doc, tf, which lie by (term, doc); terms, counts: the terms that occur
    and their numbers of documents.
    """
    schema, arrow = arrow_schema("n_docs long, n_terms long, ids binary, n binary, terms array<int>, counts array<int>, doc binary, tf binary")
    most = max(64, BLOCK_CELLS // max(len(terms), 1))

    def block(ids: np.ndarray, words: Words) -> pa.RecordBatch:
        counts = words.counts
        at = np.minimum(np.searchsorted(terms, h := words.hashes()), max(len(terms) - 1, 0))
        hit = np.flatnonzero(terms[at] == h) if len(terms) else np.empty(0, np.int64)
        doc_of = words.text_of_word()[hit]
        key, tf = np.unique(at[hit] * np.int64(len(counts)) + doc_of, return_counts=True)
        term, doc = key // len(counts), key % len(counts)
        held, new = np.unique(doc, return_inverse=True)  # documents without any of the terms need no place
        some, df = np.unique(term, return_counts=True)
        row = ((counts > 0).sum(), counts.sum(), ids[held].tobytes(), counts[held].astype(np.int64).tobytes(), some.tolist(), df.tolist(), new.astype(np.int32).tobytes(), tf.astype(np.int32).tobytes())
        return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, arrow, strict=True)], schema=arrow)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, row_start in text_batches(batches, BLOCK_TEXT):
            ids = ids_of(rows)
            for a in range(0, len(ids), most):
                starts = row_start[a : a + most + 1]
                yield block(ids[a : a + most], term_words(data[starts[0] : starts[-1]], starts - starts[0]))

    return docs.mapInArrow(cut, schema)


class Lists:
    """Impact lists of one block. ``place``: position of each document in each term's list, -1 where it is absent."""

    def __init__(self, weight: np.ndarray, n_docs: int, n_terms: int, row: dict):
        self.ids = np.frombuffer(row["ids"], np.int64)
        n = np.frombuffer(row["n"], np.int64)
        if len(n) and int(n.max()) * 90 * n_docs >= 1 << 63:
            m = np.array([10 + 90 * int(x) * n_docs // n_terms for x in n], np.int64)
        else:
            m = 10 + 90 * n * n_docs // max(n_terms, 1)
        df = np.array(row["counts"], np.int64)
        doc, tf = np.frombuffer(row["doc"], np.int32), np.frombuffer(row["tf"], np.int32).astype(np.int64)
        term = np.repeat(np.arange(len(df)), df)
        impact = weight[np.array(row["terms"], np.int64)][term] * (1_000_000_000 * tf // (1000 * tf + 8 * m[doc]))
        order = np.lexsort((-impact, term))
        self.doc, self.impact = doc[order], impact[order]
        self.start = np.concatenate([[0], np.cumsum(df)])
        self.place = np.full((len(df), len(self.ids)), -1, np.int16 if len(self.ids) < 1 << 15 else np.int32)
        self.place[term, self.doc] = np.arange(len(doc)) - self.start[term]
        self.row_of = {t: i for i, t in enumerate(row["terms"])}

    def search(self, terms: np.ndarray, best: list[tuple[int, int]], k: int) -> int:
        """Brings ``best``, the (-score, id) of a query's ``k`` best documents so far, up to date; returns the accesses made."""
        rows = np.array([self.row_of[t] for t in terms.tolist() if t in self.row_of], np.int64)
        if not len(rows):
            return 0
        begin, size = self.start[rows], self.start[rows + 1] - self.start[rows]
        # what has been seen of the lists, end to end; the place behind each list stays unseen and contributes nothing
        flat = np.concatenate([[0], np.cumsum(size + 1)])
        seen = np.zeros(flat[-1], bool)
        impact = np.zeros(flat[-1], np.int64)
        impact[ranges(flat[:-1], size)] = self.impact[ranges(begin, size)]
        met = np.zeros(len(self.ids), bool)
        position, depth, stride, accesses = flat[:-1].copy(), 0, STRIDE, 0
        while True:
            bound = int(impact[position].sum())
            if bound <= 0 or (len(best) == k and bound < -best[-1][0]):
                return accesses
            room = np.clip(size - depth, 0, stride)
            new = np.unique(self.doc[ranges(begin + np.minimum(depth, size), room)])
            new = new[~met[new]]
            met[new] = True
            depth, stride = depth + stride, stride * 2
            if not len(new):
                if depth >= size.max():
                    return accesses
                continue
            place = self.place[rows[:, None], new[None, :]].astype(np.int64)  # direct accesses
            accesses += place.size
            found = place >= 0
            at = flat[:-1, None] + place
            seen[at[found]] = True
            scores = np.where(found, impact[np.where(found, at, 0)], 0).sum(axis=0)
            least = -best[-1][0] if len(best) == k else 1
            good = np.flatnonzero(scores >= least)
            if len(good):
                best[:] = sorted(best + list(zip((-scores[good]).tolist(), self.ids[new[good]].tolist(), strict=True)))[:k]
            unseen = np.flatnonzero(~seen)
            position = unseen[np.searchsorted(unseen, position)]


def lexical_search(
    docs: DataFrame, items: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text"
) -> DataFrame:
    """(item, rank, id, score) of the ``k`` documents with the highest score above 0 for each item.

    Terms are maximal runs of characters other than ASCII punctuation, blanks and controls, A-Z in lower case. With N
    documents that have a term, L terms in all, df documents holding a term, n terms of a document and tf occurrences:
    the term's weight is w = floor(1000 ln((2N + 2) / (2 df + 1))), m = 10 + (90 n N) div L, and a document's score is
    the sum over the item's distinct terms of w * ((10^9 tf) div (1000 tf + 8 m)), exact in integers.

    Equal scores rank by ascending id, a null id first. Every row counts as a document, so repeated rows appear
    repeatedly. A null or empty text has no terms. Item rows of one id (null is one, too) are one item with the terms of
    all. An item without terms or without a document that scores has no rows; empty tables give an empty table. Items
    are searched in groups of about ``QUERY_BYTES``, each in one pass over the texts.
    """
    docs, items = plain(docs, id_col, text_col), plain(items, item_col, item_text_col).distinct()
    groups = 1 + int(items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]) // QUERY_BYTES
    parts = []
    for g in range(groups):
        rows = items.where(F.pmod(F.xxhash64("id"), F.lit(groups)) == g).collect()  # about QUERY_BYTES
        if rows:
            parts.append(_search_group(docs, queries_of(sorted(map(tuple, rows))), k))
    if not parts:
        parts = [docs.sparkSession.createDataFrame([], "item long, id long, score long")]
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    rank = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), "id"))
    top = found.withColumn("rank", rank).where(F.col("rank") <= k)
    item = F.when(F.col("item") != NO_ID, F.col("item")).alias(item_col)
    return top.select(item, "rank", given_id(id_col), "score")


def _search_group(docs: DataFrame, queries: Queries, k: int) -> DataFrame:
    blocks = stored(index_blocks(docs, queries.terms))
    n_docs, n_terms = blocks.agg(F.coalesce(F.sum("n_docs"), F.lit(0)), F.coalesce(F.sum("n_terms"), F.lit(0))).first()
    counted = blocks.select(F.explode(F.arrays_zip("terms", "counts")).alias("t")).groupBy("t.terms").agg(F.sum("t.counts").alias("df"))
    weight = np.zeros(len(queries.terms), np.int64)
    for term, df in counted.collect():  # at most the group's terms
        weight[term] = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))
    schema, arrow = arrow_schema("item long, id long, score long")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[list[tuple[int, int]]] = [[] for _ in queries.ids]
        for batch in batches:
            for r in range(batch.num_rows):
                lists = Lists(weight, n_docs, n_terms, {c: batch.column(c)[r].as_py() for c in batch.schema.names})
                for q, own in enumerate(best):
                    lists.search(queries.own[queries.first[q] : queries.first[q + 1]], own, k)
        rows = [(int(i), d, -s) for i, own in zip(queries.ids, best, strict=True) for s, d in own]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), arrow, strict=True)], schema=arrow)

    return blocks.mapInArrow(search, schema)


@query("op13_best_position_search")
def op13(spark: SparkSession, folder: str) -> DataFrame:
    return lexical_search(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


_TERMS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
ORACLE["op13_best_position_search"] = f"""
    WITH listed AS (SELECT doc_id, {_TERMS} AS terms FROM documents),
    sizes AS (SELECT doc_id, CAST(len(terms) AS BIGINT) AS n FROM listed WHERE len(terms) > 0),
    totals AS (SELECT count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS n_terms FROM sizes),
    postings AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(terms) AS term FROM listed) GROUP BY doc_id, term),
    item_terms AS (SELECT DISTINCT item_id, unnest({_TERMS}) AS term FROM benchmark),
    weights AS (
        SELECT term, CAST(floor(1000 * ln((2 * n_docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w
        FROM postings, totals GROUP BY term, n_docs),
    scored AS (
        SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * n_docs) // n_terms)))) AS BIGINT) AS score
        FROM item_terms JOIN postings USING (term) JOIN weights USING (term) JOIN sizes USING (doc_id), totals
        GROUP BY item_id, doc_id),
    placed AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scored WHERE score > 0)
    SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM placed WHERE rank <= 10"""
