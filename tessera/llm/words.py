"""Word boundaries and hashes of whole batches of texts, as numpy passes over Arrow's own buffers.

A batch holds the UTF-8 bytes of many texts end to end. Words are maximal runs of
bytes that are not separators, cut at text ends; they are hashed by blocks of eight bytes,
all words at once, so no Python object is made for a word (but for those over ``LONG``
bytes). Batches are worked in slices of ``SLICE`` bytes, which bounds memory; a single
longer text is a slice of its own and takes about ten times its bytes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import blake2b

import numpy as np
import pyarrow as pa

#: Bytes of text worked on at a time.
SLICE = 2 << 20

#: Words of more bytes are hashed one by one, by BLAKE2b.
LONG = 64

_MULTIPLIER = 0x9E3779B97F4A7C15  # odd, so that it has an inverse modulo 2**64
_MIX = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every input bit over the 64 bits of the result (a bijection)."""
    x = x ^ (x >> np.uint64(33))
    x = x * _MIX[0]
    x ^= x >> np.uint64(29)
    x *= _MIX[1]
    x ^= x >> np.uint64(32)
    return x


#: Keeps the first k bytes of a block.
_FIRST_BYTES = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


@dataclass
class Words:
    """Words of a slice of texts.

    ``data``: bytes of all texts; ``row_start``: first byte of each text, and the end;
    ``start``/``end``: bytes of each word; ``first``: index of each text's first word, and the number of words.
    """

    data: np.ndarray
    row_start: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def hashes(self) -> np.ndarray:
        """64-bit hash of each word's bytes. Words of up to eight bytes never collide with others of their length."""
        length = self.end - self.start
        out = mix(length.astype(np.uint64) * np.uint64(_MULTIPLIER))
        padded = np.concatenate([self.data, np.zeros(8, np.uint8)])
        block_at = np.ndarray(len(self.data) + 1, np.dtype("<u8"), padded, strides=(1,))  # the eight bytes from each place on
        at, done = np.flatnonzero(length <= LONG), 0
        while len(at):
            left = length[at] - done
            block = block_at[self.start[at] + done] & _FIRST_BYTES[np.minimum(left, 8)]
            out[at] = mix(out[at] ^ block)
            at, done = at[left > 8], done + 8
        for i in np.flatnonzero(length > LONG):
            out[i] = int.from_bytes(blake2b(self.data[self.start[i] : self.end[i]].tobytes(), digest_size=8).digest(), "little")
        return out

    def text_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.counts)), self.counts)

    def windows(self, size: int, hashes: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Start words of all windows of ``size`` words inside one text, and the windows' hashes."""
        h = self.hashes() if hashes is None else hashes
        room = np.maximum(self.counts - size + 1, 0)
        at = ranges(self.first[:-1], room)
        return at, rolling(h, size)[at]


def ranges(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """``start[i] .. start[i] + length[i] - 1`` for every i, end to end."""
    total = int(length.sum())
    if not total:
        return np.empty(0, np.int64)
    before = np.cumsum(length) - length
    return np.repeat(start - before, length) + np.arange(total)


def rolling(h: np.ndarray, size: int, base: int = _MULTIPLIER) -> np.ndarray:
    """Hash of ``h[i : i + size]`` for every i (windows past the end are cut short, and not to be used)."""
    n = len(h)
    out = np.zeros(n, np.uint64)
    for k in range(size):  # few passes over the words; exact for any window length
        part = h[k:]
        out[: len(part)] += part * np.uint64(pow(base, k + 1, 1 << 64))
    return mix(out)


def as_signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def slices(texts: pa.Array, size: int = SLICE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """``(from_row, to_row, bytes, row_start)`` for runs of about ``size`` bytes. A null text is empty."""
    texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = texts.fill_null("")
    n = len(texts)
    if not n:
        return
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + n + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    row = 0
    while row < n:
        stop = int(np.searchsorted(offsets, offsets[row] + size, side="right")) - 1
        stop = min(max(stop, row + 1), n)
        yield row, stop, data[offsets[row] : offsets[stop]], offsets[row : stop + 1] - offsets[row]
        row = stop


def lower_ascii(data: np.ndarray) -> np.ndarray:
    """A-Z in lower case, all other bytes unchanged."""
    return data + (((data >= 65) & (data <= 90)).astype(np.uint8) << 5)


def space_words(data: np.ndarray, row_start: np.ndarray) -> Words:
    """Words ``[^\\x20\\x09-\\x0D]+`` of each text."""
    return split_words(data, row_start, (data == 32) | ((data >= 9) & (data <= 13)))


def split_words(data: np.ndarray, row_start: np.ndarray, separator: np.ndarray) -> Words:
    n = len(data)
    inside = ~separator
    begins = inside.copy()
    begins[1:] &= separator[:-1]
    ends = np.zeros(n + 1, bool)
    ends[1:n] = separator[1:] & inside[:-1]
    if n:
        ends[n] = inside[-1]
    cuts = row_start[(row_start > 0) & (row_start < n)]
    begins[cuts] = inside[cuts]
    ends[cuts] |= inside[cuts - 1]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends)
    first = np.searchsorted(start, row_start)
    return Words(data, row_start, start, end, first)


def to_bytes(values: np.ndarray) -> bytes:
    """64-bit values as eight byte planes: the high bytes of small values compress away."""
    return values.view(np.uint8).reshape(-1, 8).T.tobytes()


def from_bytes(data: bytes) -> np.ndarray:
    planes = np.frombuffer(data, np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).view(np.uint64).ravel()
