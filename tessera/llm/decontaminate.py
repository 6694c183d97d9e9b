"""Benchmark decontamination: an exact filter by shared word pairs, then exact edit distances.

A benchmark item occurs in a text where a window has an edit distance (in words) of at most a fifth of the item's
length. Windows have as many words as the item or, with free ends, any number within the distance. Within an edit
distance of k, a window shares at least m - 1 - 2k neighbouring word pairs with an item of m words. Every word of every
text goes through this filter, and all that passes it is verified, so no occurrence is lost, however long the item or
strong the edits.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import arrow_schema, given_id, ids_of, plain, query, table, text_batches
from tessera.llm.words import SLICE, lower_ascii, ranges, rolling, space_words

#: Items of fewer words tell nothing and are passed over.
LEAST_WORDS = 5
#: Bytes of item texts sent to every task at once; more items are worked in several passes.
ITEM_BYTES = 8 << 20

#: Item words aligned with texts at a time.
BATCH_WORDS = 1 << 16

_MAP_BITS = 22


def edit_distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Edit distance of each row of ``x`` and the same row of ``y`` (rows of m words each)."""
    n, m = x.shape
    before = np.tile(np.arange(m + 1, dtype=np.int16)[:, None], (1, n))
    for i in range(m):
        now = np.empty_like(before)
        now[0] = i + 1
        change = before[:-1] + (x[:, i] != y.T)
        np.minimum(change, before[1:] + 1, out=change)
        for j in range(m):
            now[j + 1] = np.minimum(change[j], now[j] + 1)
        before = now
    return before[m].astype(np.int64)


def best_stretches(texts: np.ndarray, widths: np.ndarray, items: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The stretch of each text nearest to the item of the same row: edit distance, first word, end.

    Rows of ``texts`` and ``items`` count up to their ``widths`` and ``lengths``; what follows is not read. Of equally
    near stretches, the one that starts first, then the shortest. Semi-global alignment: both ends in the text are free.
    """
    n, longest = items.shape
    edit = texts.shape[1] + 1  # a value is distance * edit + start, so that the least value has the least start
    kind = np.int32 if edit * (longest + 2) < 1 << 31 else np.int64
    # value - i * edit at item place i: a left-out item word then costs nothing, and a running minimum passes it on
    now, row = np.zeros((longest + 1, n), kind), np.arange(n)
    best, end = now[lengths, row] + (lengths * edit).astype(kind), np.zeros(n, np.int64)
    y = np.ascontiguousarray(items.T)
    for j in range(texts.shape[1]):
        after = now + kind(edit)
        after[0] = j + 1
        np.minimum(after[1:], now[:-1] - (y == texts[:, j]) * kind(edit), out=after[1:])
        now = np.minimum.accumulate(after, axis=0)
        value = now[lengths, row] + (lengths * edit).astype(kind)
        better = (value < best) & (j < widths)
        best[better], end[better] = value[better], j + 1
    return (best // edit).astype(np.int64), (best % edit).astype(np.int64), end


@dataclass
class Items:
    """Benchmark items as word hashes, by length."""

    ids: dict[int, np.ndarray] = field(default_factory=dict)
    words: dict[int, np.ndarray] = field(default_factory=dict)
    # neighbouring pairs of all items, ascending, and the item of each, as a number
    pairs: np.ndarray = field(default_factory=lambda: np.empty(0, np.uint64))
    pair_item: np.ndarray = field(default_factory=lambda: np.empty(0, np.int64))
    # of each item number: its words, and its row among the items of that length
    length: np.ndarray = field(default_factory=lambda: np.empty(0, np.int64))
    row: np.ndarray = field(default_factory=lambda: np.empty(0, np.int64))
    table: np.ndarray = field(default_factory=lambda: np.zeros(1 << _MAP_BITS, bool))

    @staticmethod
    def of(rows: list[tuple[int, str]]) -> Items:
        out, by_length = Items(), {}
        for key, text in rows:
            data = lower_ascii(np.frombuffer((text or "").encode(), np.uint8))
            h = space_words(data, np.array([0, len(data)])).hashes()
            if len(h) >= LEAST_WORDS:
                by_length.setdefault(len(h), []).append((key, h))
        for m, own in sorted(by_length.items()):
            out.ids[m] = np.array([k for k, _ in own])
            out.words[m] = np.stack([h for _, h in own])
        if by_length:
            out.length = np.concatenate([np.full(len(out.ids[m]), m) for m in out.ids])
            out.row = np.concatenate([np.arange(len(out.ids[m])) for m in out.ids])
            own = [np.unique(rolling(h, 2)[:-1]) for m in out.ids for h in out.words[m]]
            pairs, item = np.concatenate(own), np.repeat(np.arange(len(own)), [len(x) for x in own])
            order = np.argsort(pairs, kind="stable")
            out.pairs, out.pair_item = pairs[order], item[order]
            out.table[out.pairs >> np.uint64(64 - _MAP_BITS)] = True
        return out


def _dense_hits(items: Items, pairs: np.ndarray, first: np.ndarray, den: int, extra: int) -> tuple[np.ndarray, ...]:
    """Item number, text, first and last place of all runs of as many of an item's pairs as a window must hold.

    A window has at most ``extra`` words of every ``den`` of the item more than the item.
    """
    at = np.flatnonzero(items.table[pairs >> np.uint64(64 - _MAP_BITS)])
    lo, hi = np.searchsorted(items.pairs, pairs[at]), np.searchsorted(items.pairs, pairs[at], side="right")
    item, place = items.pair_item[ranges(lo, hi - lo)], np.repeat(at, hi - lo)
    order = np.lexsort((place, item))
    item, place = item[order], place[order]
    text = np.searchsorted(first, place, side="right") - 1
    m = items.length[item]
    need = m - 1 - 2 * (m // den)
    j = np.arange(len(item))
    last = j + need - 1
    ok = last < len(item)
    j, last = j[ok], last[ok]
    same = (item[j] == item[last]) & (text[j] == text[last]) & (place[last] - place[j] <= m[j] + extra * (m[j] // den) - 2)
    j, last = j[same], last[same]
    return item[j], text[j], place[j], place[last]


def windows_to_try(items: Items, pairs: np.ndarray, first: np.ndarray, den: int) -> tuple[np.ndarray, np.ndarray]:
    """(item number, start word) of all windows of the item's size that hold enough of the item's pairs.

    ``pairs``: hash of the pair at each word; ``first``: first word of each text, and the end.
    """
    item, text, begin, last = _dense_hits(items, pairs, first, den, 0)
    m = items.length[item]
    low = np.maximum(last - (m - 2), first[text])
    high = np.minimum(begin, first[text + 1] - m)
    size = np.maximum(high - low + 1, 0)
    found = np.stack([np.repeat(item, size), ranges(low, size)])
    found = np.unique(found, axis=1)
    return found[0], found[1]


def stretches_to_try(items: Items, pairs: np.ndarray, first: np.ndarray, den: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(item number, text, start word, end) of stretches that together hold all windows, of any size, with enough of the item's pairs.

    Each such window lies wholly inside a stretch; a stretch is at most four of the item's largest windows long.
    """
    item, text, begin, last = _dense_hits(items, pairs, first, den, 1)
    if not len(item):
        return item, text, begin, last
    m = items.length[item]
    largest = m + m // den
    low, high = np.maximum(last + 2 - largest, first[text]), np.minimum(begin + largest, first[text + 1])
    # ordered by item and place, both ends ascend within an item and a text
    new = np.ones(len(item), bool)
    new[1:] = (item[1:] != item[:-1]) | (text[1:] != text[:-1]) | (low[1:] > high[:-1])
    head = np.flatnonzero(new)
    item, text, largest = item[head], text[head], largest[head]
    low, high = low[head], high[np.append(head[1:], len(new)) - 1]
    parts = np.maximum(-(-(high - low - largest) // (3 * largest)), 1)
    low = np.repeat(low, parts) + 3 * np.repeat(largest, parts) * ranges(np.zeros(len(parts), np.int64), parts)
    high = np.minimum(low + 4 * np.repeat(largest, parts), np.repeat(high, parts))
    return np.repeat(item, parts), np.repeat(text, parts), low, high


def occurrences(
    docs: DataFrame,
    benchmark: DataFrame,
    den: int = 5,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    free_ends: bool = False,
) -> DataFrame:
    """The best occurrence of each item in each document: id, item, start_word, n_words, distance, similarity.

    Words are runs of characters other than blanks and \\x09-\\x0D, with A-Z in lower case. An occurrence is a window of the item's
    number of words within a word edit distance of a fifth (one in ``den``) of it; the best has the least distance, then
    the least start. With ``free_ends``, windows of all sizes count (an inserted or left-out word is one edit, and a text may
    be shorter than the item); of equally near windows with the least start, the shortest is given. Null and empty texts, and items of fewer than five words, have none. Null ids are kept as null.
    Repeated rows give repeated results; repeated items are separate items. Empty tables give an empty table.

    Items are sent to the tasks in blocks of at most ``ITEM_BYTES``, so a large benchmark takes several passes.
    """
    given = benchmark.select(F.coalesce(F.col(item_col).cast("long"), F.lit(-(1 << 63))).alias("item"), F.coalesce(F.col(item_text_col), F.lit("")).alias("text"))
    volume = given.agg(F.sum(F.octet_length("text") + 8)).first()[0] or 0
    passes = 1 + int(volume) // ITEM_BYTES
    schema, arrow = arrow_schema("id long, item_id long, start_word long, n_words long, distance long, similarity double")
    spark = docs.sparkSession
    rows = plain(docs, id_col, text_col)
    out = None
    for turn in range(passes):
        block = given.where(F.pmod(F.xxhash64("item", "text"), F.lit(passes)) == turn).collect()  # about ITEM_BYTES
        items = Items.of([tuple(r) for r in block])
        if items.ids:
            found = rows.mapInArrow(_search(spark.sparkContext.broadcast(items), arrow, den, free_ends), schema)
            out = found if out is None else out.union(found)
    if out is None:
        out = spark.createDataFrame([], schema)
    return out.select(
        given_id(id_col),
        F.when(F.col("item_id") != -(1 << 63), F.col("item_id")).alias(item_col),
        "start_word",
        "n_words",
        "distance",
        "similarity",
    )


def _matches(items: Items, data: np.ndarray, row_start: np.ndarray, den: int) -> list[tuple[int, int, int, int, int, int]]:
    """(text, item, start word, words, distance, item's words), the best per text and item."""
    words = space_words(lower_ascii(data), row_start)
    h = words.hashes()
    if len(h) < LEAST_WORDS:
        return []
    item, start = windows_to_try(items, rolling(h, 2), words.first, den)
    best: dict[tuple[int, int, int], tuple[int, int]] = {}
    for m in np.unique(items.length[item]).tolist():
        of_length = np.flatnonzero(items.length[item] == m)
        for a in range(0, len(of_length), 1 << 11):
            part = of_length[a : a + (1 << 11)]
            row, at = items.row[item[part]], start[part]
            windows = h[at[:, None] + np.arange(m)]
            distance = edit_distances(windows, items.words[m][row])
            text = np.searchsorted(words.first, at, side="right") - 1
            for k in np.flatnonzero(distance <= m // den).tolist():
                place, entry = (int(text[k]), m, int(row[k])), (int(distance[k]), int(at[k] - words.first[text[k]]))
                best[place] = min(best.get(place, entry), entry)
    return [(text, int(items.ids[m][i]), s, m, d, m) for (text, m, i), (d, s) in best.items()]


def _stretches(items: Items, data: np.ndarray, row_start: np.ndarray, den: int) -> list[tuple[int, int, int, int, int, int]]:
    """As ``_matches``, over windows of all sizes."""
    words = space_words(lower_ascii(data), row_start)
    h = words.hashes()
    if len(h) < 2:
        return []
    item, text, low, high = stretches_to_try(items, rolling(h, 2), words.first, den)
    best: dict[tuple[int, int], tuple[int, int, int]] = {}
    order = np.argsort(items.length[item], kind="stable")  # rows of a batch are of about one length
    at = 0
    while at < len(order):
        m = int(items.length[item[order[at]]])
        part = order[at : at + max(1, BATCH_WORDS // m)]
        part = part[items.length[item[part]] <= m + m // 4]
        at += len(part)
        lengths, widths = items.length[item[part]], high[part] - low[part]
        theirs = np.zeros((len(part), int(lengths.max())), np.uint64)
        for k, i in enumerate(item[part].tolist()):
            theirs[k, : lengths[k]] = items.words[int(lengths[k])][items.row[i]]
        place = low[part][:, None] + np.arange(int(widths.max()))
        distance, start, end = best_stretches(h[np.minimum(place, len(h) - 1)], widths, theirs, lengths)
        start, end = start + low[part] - words.first[text[part]], end + low[part] - words.first[text[part]]
        for k in np.flatnonzero(distance <= lengths // den).tolist():
            key, entry = (int(text[part[k]]), int(item[part[k]])), (int(distance[k]), int(start[k]), int(end[k]))
            best[key] = min(best.get(key, entry), entry)
    ids = {i: int(items.ids[int(items.length[i])][items.row[i]]) for _, i in best}
    return [(t, ids[i], s, e - s, d, int(items.length[i])) for (t, i), (d, s, e) in best.items()]


def _search(shared, arrow: pa.Schema, den: int, free_ends: bool):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = shared.value
        for rows, data, row_start in text_batches(batches, SLICE):
            found = (_stretches if free_ends else _matches)(items, data, row_start, den)
            if found:
                ids = ids_of(rows)
                out = [(int(ids[t]), item, s, n, d, 1 - d / m) for t, item, s, n, d, m in found]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), arrow, strict=True)], schema=arrow)

    return search


def without_benchmark(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` in which no item occurs. Rows with a null id stay."""
    found = occurrences(docs, benchmark, id_col=id_col, free_ends=True).select(id_col).distinct()
    return docs.join(found, id_col, "left_anti")


@query("op7_decontamination")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    return occurrences(table(spark, folder, "documents"), table(spark, folder, "benchmark"), free_ends=True)
