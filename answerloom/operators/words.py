"""Terms inside words: every part of a word is looked up by a hash of its characters.

The different words of a few texts are searched at once, then each text takes the different
terms of its words. No text meets another one, so nothing is exchanged or written.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Bytes of words that are searched at once, and places in words; a row or word of more goes alone.
BYTES = 1 << 19
PLACES = 1 << 20
_START = np.uint64(0xCBF29CE484222325)
_BASE = np.uint64(0x9E3779B97F4A7C15)
#: The most bits of a length's bitmap, as a power of two.
_BITS = 22


def _characters(strings: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The code points of all strings in a row, and how many each has."""
    together = pa.ListArray.from_arrays(pa.array([0, len(strings)], pa.int32()), strings)
    whole = pc.binary_join(together, pa.scalar("", strings.type))
    line = np.frombuffer(whole[0].as_py().encode("utf-32-le"), dtype="<u4")
    return line, pc.utf8_length(strings).to_numpy(zero_copy_only=False).astype(np.int64)


def _spread(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """first, first + 1, … of each, ``count`` numbers each."""
    ends = np.cumsum(count)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(first - ends + count, count)


def _cuts(ends: np.ndarray, most: int) -> list[int]:
    """Where to cut items that end there, so that a part holds about ``most``, one item at least."""
    return [0, *(np.flatnonzero(np.diff(ends // most)) + 1).tolist(), len(ends)]


def _different(codes: np.ndarray, limit: int) -> np.ndarray:
    """The different codes in order; all are below ``limit``."""
    if limit > 16 * len(codes):
        codes = np.sort(codes)  # np.unique counts by a hash table, which takes several times as long
        return codes[np.diff(codes, prepend=-1) != 0]
    seen = np.zeros(limit, dtype=bool)
    seen[codes] = True
    return np.flatnonzero(seen)


class TermIndex:
    """Different terms, by length and hash; hits are compared character by character."""

    def __init__(self, terms: pa.Array):
        self.terms = terms
        self.chars, size = _characters(terms)
        self.start = np.cumsum(size) - size
        self.tables = {}
        for length in np.unique(size).tolist():
            of = np.flatnonzero(size == length)
            codes = np.full(len(of), _START)
            for j in range(length):
                codes = (codes ^ self.chars[self.start[of] + j]) * _BASE
            order = np.argsort(codes)
            values, first, count = np.unique(codes[order], return_index=True, return_counts=True)
            bits = min(_BITS, (16 * len(of)).bit_length())
            bitmap = np.zeros(1 << bits, dtype=bool)
            bitmap[values >> np.uint64(64 - bits)] = True
            self.tables[length] = bitmap, np.uint64(64 - bits), values, first, count, of[order]
        self.longest = max(self.tables, default=0)

    def pairs(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(word, term): the different terms that each word holds, in the order of the words."""
        line, size = _characters(words)
        ends = np.cumsum(size)
        limit = len(words) * len(self.terms)
        codes = [np.zeros(0, dtype=np.int64)]
        for low in range(0, len(line), PLACES):
            place = np.arange(low, min(low + PLACES, len(line)))
            word = np.searchsorted(ends, place, side="right")
            at, term = self._beginning(line, place, ends[word] - place)
            codes.append(_different(word[at - low] * len(self.terms) + term, limit))
        code = codes[-1] if len(codes) <= 2 else _different(np.concatenate(codes), limit)
        return code // len(self.terms), code % len(self.terms)

    def _beginning(self, line: np.ndarray, place: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place, term) of every term that begins at a place and has room in what is left."""
        code = np.full(len(place), _START)
        places, terms = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
        for length in range(1, self.longest + 1):
            room = left >= length
            place, left, code = place[room], left[room], code[room]
            if not len(place):
                break
            code = (code ^ line[place + (length - 1)]) * _BASE
            if length not in self.tables:
                continue
            bitmap, shift, values, first, count, of = self.tables[length]
            near = np.flatnonzero(bitmap[code >> shift])
            row = np.minimum(np.searchsorted(values, code[near]), len(values) - 1)
            same = values[row] == code[near]
            near, row = near[same], row[same]
            at, term = np.repeat(place[near], count[row]), of[_spread(first[row], count[row])]
            for j in range(length):  # few hits drop out: hashes of 64 bits agree
                same = line[at + j] == self.chars[self.start[term] + j]
                if not same.all():
                    at, term = at[same], term[same]
            places.append(at)
            terms.append(term)
        return np.concatenate(places), np.concatenate(terms)

    def in_rows(self, words: pa.ListArray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(row, term): the different terms that the words of each row hold, some rows at a time."""
        count = pc.fill_null(pc.list_value_length(words), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        flat, first = words.flatten(), np.append(0, np.cumsum(count))
        held = np.append(0, np.cumsum(pc.binary_length(flat).to_numpy(), dtype=np.int64))
        rows = _cuts(held[first[1:]], BYTES)
        for top, bottom in itertools.pairwise(rows):
            row = np.repeat(np.arange(bottom - top), count[top:bottom])
            base, limit = int(first[top]), (bottom - top) * len(self.terms)
            codes = [np.zeros(0, dtype=np.int64)]
            for low, high in itertools.pairwise(_cuts(held[base + 1 : int(first[bottom]) + 1] - held[base], BYTES)):
                part = flat.slice(base + low, high - low).dictionary_encode()
                word, term = self.pairs(part.dictionary)
                terms = np.bincount(word, minlength=len(part.dictionary))
                which = part.indices.to_numpy()
                mine = np.repeat(row[low:high], terms[which])
                hits = term[_spread((np.cumsum(terms) - terms)[which], terms[which])]
                codes.append(_different(mine * len(self.terms) + hits, limit))
            code = codes[-1] if len(codes) <= 2 else _different(np.concatenate(codes), limit)
            if len(code):
                yield top + code // len(self.terms), code % len(self.terms)


def terms_of_rows(terms: pa.Array) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For batches of (key, words): (key, term) for the different terms in the words of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = TermIndex(terms)
        for batch in batches:
            for row, term in index.in_rows(batch.column(1)):
                found = [batch.column(0).take(pa.array(row)), terms.take(pa.array(term))]
                yield pa.RecordBatch.from_arrays(found, [batch.schema.names[0], "term"])

    return run
