"""Token ids of whole texts by a public tokenizer, with the ids of repeated words kept per worker.

Byte-pair encoding never merges across a word boundary of the tokenizer's own splitting
rule, so a text's ids are the ids of its words end to end. A slice of texts is cut into words
as numpy passes over its bytes; its distinct words (by hash) are looked up, and only words
that this Python worker has not met are handed to the tokenizer. At most ``MEMORY`` words are
kept, further ones are encoded once per slice.

* ``"spaceless"``: white space separates words and leaves no ids (texts are cut at blanks and newlines).
* ``"byte-level"``: a blank or newline belongs to the word behind it
  (texts with runs of white space, or with white space at an end, are encoded whole).
"""

from __future__ import annotations

import os
from itertools import chain

import numpy as np
from tokenizers import Tokenizer

from tessera.llm.words import LONG, Words, ranges, split_words

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core

#: Words whose ids a worker keeps, at about 40 bytes each.
MEMORY = 1_500_000

_kept: dict[tuple[str, str], Encoder] = {}


def encoder(path: str, kind: str) -> Encoder:
    """The worker's encoder for a tokenizer file."""
    if (path, kind) not in _kept:
        _kept[path, kind] = Encoder(path, kind)
    return _kept[path, kind]


def _has_odd_space(data: np.ndarray, row_start: np.ndarray) -> np.ndarray:
    """Per text: does it have white space other than single blanks and newlines between words?"""
    space = (data == 32) | (data == 10)
    odd = ((data >= 9) & (data <= 13) & (data != 10)) | ((data >= 28) & (data <= 31))
    odd[:-1] |= space[:-1] & space[1:]
    # white space beyond ASCII: U+0085, U+00A0, U+1680, U+2000-200A, U+2028, U+2029, U+202F, U+205F, U+3000
    at = np.flatnonzero((data == 0xC2) | ((data >= 0xE1) & (data <= 0xE3)))
    if len(at):
        padded = np.concatenate([data, np.zeros(2, np.uint8)])
        x, y, z = padded[at], padded[at + 1], padded[at + 2]
        wide = (x == 0xC2) & ((y == 0x85) | (y == 0xA0)) | (x == 0xE1) & (y == 0x9A) & (z == 0x80) | (x == 0xE3) & (y == 0x80) & (z == 0x80)
        wide |= (x == 0xE2) & (((y == 0x80) & ((z <= 0x8A) | (z == 0xA8) | (z == 0xA9) | (z == 0xAF))) | ((y == 0x81) & (z == 0x9F)))
        odd[at[wide]] = True
    total = np.concatenate([[0], np.cumsum(odd)])
    out = total[row_start[1:]] > total[row_start[:-1]]
    full = np.flatnonzero(np.diff(row_start) > 0)
    out[full] |= space[row_start[full]] | space[row_start[full + 1] - 1]
    return out


class Encoder:
    def __init__(self, path: str, kind: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.byte_level = kind == "byte-level"
        self.hashes = np.empty(0, np.uint64)  # of the kept words, ascending
        self.start = np.empty(0, np.int64)  # where their ids begin in ``ids``, and how many there are
        self.length = np.empty(0, np.int64)
        self.ids = np.empty(0, np.uint32)

    def _words(self, data: np.ndarray, row_start: np.ndarray) -> Words:
        space = (data == 32) | (data == 10)
        if not self.byte_level:
            return split_words(data, row_start, space)
        begins = space
        begins[row_start[:-1][np.diff(row_start) > 0]] = True
        for i in np.flatnonzero(_has_odd_space(data, row_start)):
            begins[row_start[i] + 1 : row_start[i + 1]] = False
        start = np.flatnonzero(begins)
        return Words(data, row_start, start, np.append(start[1:], len(data)), np.searchsorted(start, row_start))

    def encode_bytes(self, data: np.ndarray, row_start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids end to end (unsigned 32-bit), and the number of ids of each text; ``data``: the UTF-8 bytes of the texts."""
        words = self._words(data, row_start)
        found, at, which = np.unique(words.hashes(), return_index=True, return_inverse=True)
        place = np.minimum(np.searchsorted(self.hashes, found), max(len(self.hashes) - 1, 0))
        known = self.hashes[place] == found if len(self.hashes) else np.zeros(len(found), bool)
        begin, length = np.zeros(len(found), np.int64), np.zeros(len(found), np.int64)
        begin[known], length[known] = self.start[place[known]], self.length[place[known]]
        source, new = self.ids, np.flatnonzero(~known)
        if len(new):
            first, last = words.start[at[new]], words.end[at[new]]
            raw = data.tobytes()
            encoded = [e.ids for e in self.tokenizer.encode_batch_fast([raw[a:b].decode() for a, b in zip(first.tolist(), last.tolist(), strict=True)], add_special_tokens=False)]
            length[new] = [len(e) for e in encoded]
            begin[new] = len(source) + np.cumsum(length[new]) - length[new]
            source = np.concatenate([source, np.fromiter(chain.from_iterable(encoded), np.uint32)])
            self._keep(found[new], begin[new], length[new], source, np.flatnonzero(last - first <= LONG))
        total = np.concatenate([[0], np.cumsum(length[which])])
        return source[ranges(begin[which], length[which])], np.diff(total[words.first])

    def _keep(self, hashes: np.ndarray, begin: np.ndarray, length: np.ndarray, source: np.ndarray, short: np.ndarray) -> None:
        """Takes the short ones of the new words, as far as there is room."""
        own = short[: max(MEMORY - len(self.hashes), 0)]
        if not len(own):
            return
        ids = source[ranges(begin[own], length[own])]
        start = len(self.ids) + np.cumsum(length[own]) - length[own]
        merged = np.concatenate([self.hashes, hashes[own]])
        order = np.argsort(merged, kind="stable")
        self.hashes = merged[order]
        self.start = np.concatenate([self.start, start])[order]
        self.length = np.concatenate([self.length, length[own]])[order]
        self.ids = np.concatenate([self.ids, ids])

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        raw = [t.encode() for t in texts]
        return self.encode_bytes(np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64))
