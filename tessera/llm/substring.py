"""Exact substring deduplication by level-wise doubling.

A window of ``window`` words is removed where its word sequence also starts earlier. Windows of
``base`` words that occur once cannot lie in a repeated longer window, so only those that repeat are
extended to twice the length, and again, until the full length or until no candidate survives.

Two things keep the levels small at any corpus size, and both are exact:

* The first level holds one ``base``-word window per full window, its *anchor*: the one with the least
  hash (the leftmost of equals). Equal windows have equal anchors at equal places.
* The full windows of a document that share an anchor form a *unit*, a stretch of text. A unit whose
  stretch occurs earlier is removed as a whole; only the first occurrence of each stretch goes through
  the levels. Long copies thus cost a row per unit, and only their edges are compared window by window.

The extension of an anchor at offset o of its window stays inside the window: to the right where
there is room, else to the left. All hashes are of whole words; full windows are compared by 128 bits.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import NO_ID, arrow_schema, given_id, ids_of, list_array, plain, query, repeated, stored, table, text_batches
from tessera.llm.words import SLICE, Words, as_signed, mix, ranges, rolling, space_words

_SECOND = 0xD6E8FEB86659FD93  # multiplier of the second hash
_EXPANDED = 4 << 20  # words of stretches hashed at a time
_SALT = np.uint64(0x2545F4914F6CDD1D)


@dataclass
class Units:
    """Runs of full windows with one anchor: first and last start word, the anchor's first word (all in the slice)."""

    lo: np.ndarray
    hi: np.ndarray
    anchor: np.ndarray

    def spans(self, window: int) -> np.ndarray:
        return self.hi + window - self.lo


def least(values: np.ndarray, width: int) -> np.ndarray:
    """Place of the leftmost least of ``values[i : i + width]`` for every i."""
    at = np.arange(len(values))
    have = 1
    while have * 2 <= width:
        a, b = at[: len(at) - have], at[have:]
        at = np.where(values[b] < values[a], b, a)
        have *= 2
    if have < width:
        a, b = at[: len(at) - (width - have)], at[width - have :]
        at = np.where(values[b] < values[a], b, a)
    return at


def units_of(words: Words, hashes: np.ndarray, window: int, base: int) -> tuple[Units, np.ndarray]:
    """The units of all texts of a slice, and the hashes of all ``base``-word windows."""
    short = rolling(hashes, base)
    room = np.maximum(words.counts - window + 1, 0)
    start = ranges(words.first[:-1], room)
    if not len(start):
        return Units(start, start, start), short
    anchor = least(short[: len(hashes) - base + 1], window - base + 1)[start]
    begins = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
    ends = np.append(begins[1:], len(start)) - 1
    return Units(start[begins], start[ends], anchor[begins]), short


def stretch_hashes(hashes: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """64-bit hash of ``hashes[start : start + length]``, for stretches of any lengths (at least 1).

    Each word is mixed with its place before it is added, so no pattern of words makes two stretches agree.
    """
    own, out = mix(hashes ^ _SALT), np.empty(len(start), np.uint64)
    upto = np.cumsum(length)
    a = 0
    while a < len(start):  # bounded expansion; a longer single stretch goes alone
        b = max(a + 1, int(np.searchsorted(upto, upto[a] - length[a] + _EXPANDED, side="right")))
        begin = upto[a:b] - length[a:b] - (upto[a] - length[a])
        place = ranges(np.zeros(b - a, np.int64), length[a:b]).astype(np.uint64)
        mixed = mix(own[ranges(start[a:b], length[a:b])] + place * np.uint64(_SECOND))
        out[a:b] = mix(np.add.reduceat(mixed, begin) + length[a:b].astype(np.uint64))
        a = b
    return out


def extensions(window: int, base: int) -> dict[int, np.ndarray]:
    """For each length between ``base`` and ``window``: where the extended anchor starts, relative to the anchor, by the anchor's offset."""
    place = np.arange(window - base + 1)
    offsets, length, out = place.copy(), base, {}
    while length * 4 <= window:
        place = np.where(place + 2 * length <= window, place, place - length)
        length *= 2
        out[length] = place - offsets
    return out


def _check(window: int, base: int) -> None:
    if base < 1 or window < 2 * base or (window // base) & (window // base - 1) or window % base:
        raise ValueError("the window must be the base times a power of two")


def anchors(docs: DataFrame, window: int, base: int) -> DataFrame:
    """One row per document and different unit: anchor (hash), stretch (hash), id, lo (its first start in the document)."""
    schema, arrow = arrow_schema("anchor long, stretch long, id long, lo int")

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, row_start in text_batches(batches, SLICE):
            words = space_words(data, row_start)
            hashes = words.hashes()
            units, short = units_of(words, hashes, window, base)
            text = np.searchsorted(words.first, units.lo, side="right") - 1
            stretch = stretch_hashes(hashes, units.lo, units.spans(window))
            order = np.lexsort((units.lo, stretch, text))
            new = np.ones(len(order), bool)
            new[1:] = (text[order[1:]] != text[order[:-1]]) | (stretch[order[1:]] != stretch[order[:-1]])
            keep = np.sort(order[new])
            columns = [as_signed(short[units.anchor[keep]]), as_signed(stretch[keep]), ids_of(rows)[text[keep]], units.lo[keep] - words.first[text[keep]]]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

    return docs.mapInArrow(find, schema)


def candidates(docs: DataFrame, window: int, base: int) -> DataFrame:
    """Full windows of the units listed in ``lows``, grouped by how their anchor is extended.

    One row per unit and extension: id, k<length> (hash of the extended anchor, one column per length
    between base and window), first (start word), w1 and w2 (128-bit hashes of its windows, consecutive starts).
    """
    shifts = extensions(window, base)
    names = [f"k{n}" for n in shifts]
    schema, arrow = arrow_schema(f"id long, first int, {''.join(f'{n} long, ' for n in names)}w1 array<long>, w2 array<long>")

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, row_start in text_batches(batches, SLICE):
            words = space_words(data, row_start)
            hashes = words.hashes()
            units, _ = units_of(words, hashes, window, base)
            lows = rows.column(rows.schema.get_field_index("lows"))
            listed = lows.flatten().to_numpy() + np.repeat(words.first[:-1], lows.value_lengths().to_numpy())
            chosen = np.isin(units.lo, listed)
            lo, hi, anchor = units.lo[chosen], units.hi[chosen], units.anchor[chosen]
            start = ranges(lo, hi - lo + 1)
            unit = np.repeat(np.arange(len(lo)), hi - lo + 1)
            offset = anchor[unit] - start
            moved = [s[offset] for s in shifts.values()]
            new = np.ones(len(start), bool)
            new[1:] = unit[1:] != unit[:-1]
            for m in moved:
                new[1:] |= m[1:] != m[:-1]
            begins = np.flatnonzero(new)
            counts = np.diff(np.append(begins, len(start)))
            text = np.searchsorted(words.first, start[begins], side="right") - 1
            columns: list[np.ndarray | pa.Array] = [ids_of(rows)[text], start[begins] - words.first[text]]
            for length, m in zip(shifts, moved, strict=True):
                at = anchor[unit[begins]] + m[begins]
                columns.append(as_signed(mix(rolling(hashes, length)[at] + (m[begins] + 1).astype(np.uint64))))
            columns.append(list_array(as_signed(rolling(hashes, window)[start]), counts))
            columns.append(list_array(as_signed(rolling(mix(hashes ^ _SALT), window, _SECOND)[start]), counts))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) if isinstance(c, np.ndarray) else c.cast(f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

    return docs.mapInArrow(extend, schema)


def cut(docs: DataFrame, window: int, base: int) -> DataFrame:
    """Each text (with the lists ``firsts`` and ``later``) as its words, those to remove, and what is kept.

    Units whose start is not in ``firsts`` go; so do the windows that start in ``later``.
    """
    schema, arrow = arrow_schema("id long, n_words long, n_removed long, kept string, removed array<struct<start:int,length:int>>")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, row_start in text_batches(batches, SLICE):
            words = space_words(data, row_start)
            units, _ = units_of(words, words.hashes(), window, base)
            ids = ids_of(rows)
            n = len(words.start)
            text_of = words.text_of_word()

            def listed(name: str, rows: pa.RecordBatch = rows, first: np.ndarray = words.first) -> np.ndarray:
                lists = rows.column(rows.schema.get_field_index(name))
                lengths = np.nan_to_num(lists.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)
                return lists.flatten().to_numpy(zero_copy_only=False) + np.repeat(first[:-1], lengths)

            gone = ~np.isin(units.lo, listed("firsts"))
            later = listed("later")
            edge = np.zeros(n + 1, np.int64)
            np.add.at(edge, units.lo[gone], 1)
            np.add.at(edge, units.hi[gone] + window, -1)
            np.add.at(edge, later, 1)
            np.add.at(edge, later + window, -1)
            out = np.cumsum(edge[:-1]) > 0
            out &= ids[text_of] != NO_ID if n else out
            stay = np.flatnonzero(~out)
            length = words.end[stay] - words.start[stay] + 1
            source = ranges(words.start[stay], length)
            text_bytes = np.append(data, np.uint8(32))[source]
            if len(stay):
                text_bytes[np.cumsum(length) - 1] = 32
            # the blank behind a text's last word is left out
            last = np.flatnonzero(np.append(text_of[stay][1:] != text_of[stay][:-1], len(stay) > 0)) if len(stay) else stay
            kept_bytes = np.delete(text_bytes, np.cumsum(length)[last] - 1)
            sizes = np.zeros(len(ids), np.int64)
            np.add.at(sizes, text_of[stay], length)
            sizes[text_of[stay[last]]] -= 1
            offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
            kept = pa.StringArray.from_buffers(len(ids), pa.py_buffer(offsets.tobytes()), pa.py_buffer(kept_bytes.tobytes()))
            starts = np.flatnonzero(out & np.concatenate([[True], ~out[:-1] | (text_of[1:] != text_of[:-1])])) if n else stay
            stops = np.flatnonzero(out & np.concatenate([~out[1:] | (text_of[1:] != text_of[:-1]), [True]])) + 1 if n else stay
            per_text = np.bincount(text_of[starts], minlength=len(ids))
            spans = pa.StructArray.from_arrays(
                [pa.array(starts - words.first[text_of[starts]], pa.int32()), pa.array(stops - starts, pa.int32())], ["start", "length"]
            )
            spans = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(per_text)]), pa.int32()), spans)
            removed = np.bincount(text_of[out], minlength=len(ids))
            columns = [pa.array(ids), pa.array(words.counts, pa.int64()), pa.array(removed, pa.int64()), kept, spans]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

    return docs.mapInArrow(keep, schema)


def dedup_substrings(
    docs: DataFrame, window: int = 20, base: int = 5, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Remove every word covered by a window of ``window`` words that also starts earlier in the table.

    Earlier: in a smaller id, or further left in the same document; windows are judged on the input.
    Returns per row: the id, n_words, n_removed, kept (the words that stay, joined by one blank) and
    removed (stretches as start and length in words).

    Null and empty texts have no words. Rows with a null id take no part in the comparison and lose nothing.
    An id stands for one text: repeated equal rows are one document and get equal results.
    Texts shorter than the window lose nothing. An empty table gives an empty table.
    """
    _check(window, base)
    rows = plain(docs, id_col, text_col)
    known = rows.where(F.col("id") != NO_ID)
    # a document's units are unique, so the least id also has the unit's first place
    firsts = anchors(known, window, base).groupBy("anchor", "stretch").agg(F.min("id").alias("id"), F.min_by("lo", "id").alias("lo"))
    firsts = stored(firsts.drop("stretch"))
    lows = repeated(firsts, "anchor").groupBy("id").agg(F.collect_list("lo").alias("lows"))
    found = stored(candidates(known.join(lows, "id"), window, base))
    for length in extensions(window, base):
        found = repeated(found, f"k{length}")
    pairs = found.select("id", "first", F.posexplode(F.arrays_zip("w1", "w2")).alias("k", "w"))
    windows = pairs.select("id", (F.col("first") + F.col("k")).alias("s"), "w.w1", "w.w2")
    earliest = windows.groupBy("w1", "w2").agg(F.min(F.struct("id", "s")).alias("e"), F.count(F.lit(1)).alias("n")).where("n > 1")
    later = windows.join(earliest, ["w1", "w2"]).where((F.col("id") != F.col("e.id")) | (F.col("s") != F.col("e.s")))
    later = later.groupBy("id").agg(F.collect_list("s").alias("later"))
    kept_units = firsts.groupBy("id").agg(F.collect_list("lo").alias("firsts"))
    lists = kept_units.join(later, "id", "left")
    return cut(rows.join(lists, "id", "left"), window, base).select(given_id(id_col), "n_words", "n_removed", "kept", "removed")


@query("op1_substring_dedup")
def op1(spark: SparkSession, folder: str) -> DataFrame:
    found = dedup_substrings(table(spark, folder, "documents"), window=20)
    return found.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept"), 256).alias("kept_sha256"))
