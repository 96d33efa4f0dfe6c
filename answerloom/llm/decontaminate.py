"""Benchmark passages in documents: shared q-grams by diagonal, then banded alignment.

An item of ``m`` characters with at most ``k`` edits shares at least ``m + 1 - q - k*q`` of
its q-grams with the passage that holds it (the q-gram lemma), and all of them lie within
``k`` diagonals of each other. Every q-gram of a document that some item has is looked up;
hits are counted by item and by diagonal band. Bands are twice as wide as they are apart, so
every match is whole in one of them. A band that meets the item's bound is aligned within
its band, and reported if the edit budget holds. Items shorter than one q-gram allow no edits;
they are looked up whole, by their own length, in the same scan.

Only the items travel, in blocks of a checked size, each with a scan of its own; documents are
neither shuffled nor cut.
"""

from __future__ import annotations

import bisect
import functools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from answerloom.llm.common import bounded_batches, fresh, id_and_text, stored

Q = 8
#: Share of an item's length that may differ.
MAX_EDITS = 0.08
#: Characters of items that one scan takes; a larger benchmark is dealt to several scans.
MAX_ITEM_CHARS = 20_000_000
#: Hash parts for each block, so that blocks can be filled evenly.
PARTS = 64
CHUNK_CHARS = 1 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BITS = 22
_BREAK = 0x110000  # no character: q-grams across it match nothing


def plain_codes(text: str) -> np.ndarray:
    """Lower-case code points with every blank as a space, as many as the text has."""
    low = text.lower()
    if len(low) != len(text):
        low = "".join(c.lower()[0] for c in text)
    for blank in "\t\n\x0b\x0c\r ":
        if blank in low:
            low = low.replace(blank, " ")
    return np.frombuffer(low.encode("utf-32-le", "surrogatepass"), dtype="<u4")


def _grams(codes: np.ndarray, size: int = Q) -> np.ndarray:
    """A 64-bit value for each run of ``size`` characters."""
    n = len(codes) - size + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    wide = codes.astype(np.uint64)
    out = wide[:n].copy()
    for i in range(1, size):
        out *= _BASE
        out += wide[i : i + n]
    out ^= out >> np.uint64(29)
    return out * _BASE


def budget(length: int) -> int:
    """Edits allowed for an item: ``MAX_EDITS`` of it, less where no q-gram bound is left."""
    return max(0, min(int(length * MAX_EDITS), (length - Q) // Q))


def banded_distance(item: np.ndarray, region: np.ndarray, low: int, high: int, most: int) -> tuple[int, int] | None:
    """Least edits of ``item`` against any part of ``region``, and where that part ends.

    Cell (i, j) is computed for ``low <= j - i <= high`` only. None beyond ``most`` edits.
    """
    width = high - low + 1
    far = np.int64(1 << 30)
    steps = np.arange(width)
    places = np.arange(low, high + 1)
    row = np.where((places >= 0) & (places <= len(region)), 0, far).astype(np.int64)
    for i in range(1, len(item) + 1):
        places = places + 1  # column j of each cell of row i
        inside = (places >= 1) & (places <= len(region))
        same = np.zeros(width, dtype=bool)
        same[inside] = region[places[inside] - 1] == item[i - 1]
        best = row + ~same
        best[:-1] = np.minimum(best[:-1], row[1:] + 1)
        best[places == 0] = i
        best[(places < 0) | (places > len(region))] = far
        row = np.minimum.accumulate(best - steps) + steps  # runs of inserted characters
        row[(places < 0) | (places > len(region))] = far
        if row.min() > most:
            return None
    at = int(row.argmin())
    return (int(row[at]), int(places[at])) if row[at] <= most else None


class ShortItems:
    """Items of one length below ``Q``: the different texts sorted by value, with their items."""

    def __init__(self, items: list[tuple[object, np.ndarray]]):
        self.keys: dict[bytes, list[object]] = {}
        for key, codes in items:
            self.keys.setdefault(codes.tobytes(), []).append(key)
        self.size = len(items[0][1])
        texts = [np.frombuffer(t, dtype="<u4") for t in self.keys]
        self.values = np.unique(np.concatenate([_grams(t, self.size) for t in texts]))

    def places(self, line: np.ndarray) -> Iterator[tuple[int, list[object]]]:
        """(place, items) of every copy in ``line``; the characters themselves are compared."""
        grams = _grams(line, self.size)
        at = np.minimum(np.searchsorted(self.values, grams), len(self.values) - 1)
        for place in np.flatnonzero(self.values[at] == grams).tolist():
            keys = self.keys.get(line[place : place + self.size].tobytes())
            if keys:
                yield place, keys


class ItemIndex:
    """q-grams of all items: a bitmap first, then sorted values with their postings."""

    def __init__(self, items: list[tuple[object, str]]):
        codes = [(key, plain_codes(text)) for key, text in items]
        self.items = [(key, c) for key, c in codes if len(c) >= Q]
        short: dict[int, list[tuple[object, np.ndarray]]] = {}
        for key, c in codes:
            if 0 < len(c) < Q:
                short.setdefault(len(c), []).append((key, c))
        self.short = [ShortItems(group) for _, group in sorted(short.items())]
        lengths = np.array([len(c) for _, c in self.items], dtype=np.int64)
        self.lengths = lengths
        self.edits = np.array([budget(n) for n in lengths.tolist()], dtype=np.int64)
        self.bound = lengths + 1 - Q - Q * self.edits
        #: Distance of neighbouring bands: a power of two above twice the budget.
        self.shift = np.array([max(3, int(2 * k).bit_length()) for k in self.edits], dtype=np.int64)
        grams = [_grams(c) for _, c in self.items] or [np.zeros(0, dtype=np.uint64)]
        values = np.concatenate(grams)
        owner = np.repeat(np.arange(len(self.items), dtype=np.int32), [len(g) for g in grams][: len(self.items)])
        offset = np.concatenate([np.arange(len(g), dtype=np.int32) for g in grams])
        del grams
        order = np.argsort(values, kind="stable")
        self.owner, self.offset = owner[order], offset[order]
        values = values[order]
        del owner, offset, order
        new = np.ones(len(values), dtype=bool)
        new[1:] = values[1:] != values[:-1]
        self.first = np.flatnonzero(new)
        self.values, self.count = values[self.first], np.diff(np.append(self.first, len(values)))
        self.bitmap = np.zeros(1 << _BITS, dtype=bool)
        self.bitmap[self.values >> np.uint64(64 - _BITS)] = True

    def matches(self, texts: list[str | None]) -> list[list[tuple[object, int, int, int]]]:
        """For each text the (item, start, end, edits) of every passage found."""
        found: list[list[tuple[object, int, int, int]]] = [[] for _ in texts]
        if not self.items and not self.short:
            return found
        held: list[tuple[int, np.ndarray]] = []
        size = 0
        for i, text in enumerate(texts):
            codes = plain_codes(text or "")
            held.append((i, codes))
            size += len(codes) + 1
            if size >= CHUNK_CHARS:
                self._scan(held, found)
                held, size = [], 0
        self._scan(held, found)
        return found

    def _scan(self, held: list[tuple[int, np.ndarray]], found) -> None:
        if not held:
            return
        gap = np.array([_BREAK], dtype="<u4")
        line = np.concatenate([x for _, c in held for x in (c, gap)])
        starts = np.cumsum([0, *(len(c) + 1 for _, c in held)])
        for short in self.short:
            self._scan_short(short, line, starts, held, found)
        if self.items:
            self._scan_long(line, starts, held, found)
        for i, _ in held:
            found[i].sort(key=lambda x: (x[1], x[2], str(x[0])))

    @staticmethod
    def _scan_short(short: ShortItems, line, starts, held, found) -> None:
        free: dict[tuple[int, object], int] = {}  # where the last copy of an item ended
        for place, keys in short.places(line):
            doc = int(np.searchsorted(starts, place, side="right")) - 1
            start = place - int(starts[doc])
            for key in keys:
                if free.get((doc, key), 0) <= start:
                    free[doc, key] = start + short.size
                    found[held[doc][0]].append((key, start, start + short.size, 0))

    def _scan_long(self, line, starts, held, found) -> None:
        grams = _grams(line)
        near = np.flatnonzero(self.bitmap[grams >> np.uint64(64 - _BITS)])
        at = np.minimum(np.searchsorted(self.values, grams[near]), len(self.values) - 1)
        real = self.values[at] == grams[near]
        near, at = near[real], at[real]
        doc_of = np.searchsorted(starts, near, side="right") - 1
        # Documents with fewer hits than the least bound of any item hold none.
        enough = np.bincount(doc_of, minlength=len(held))[doc_of] >= self.bound.min()
        near, at, doc_of = near[enough], at[enough], doc_of[enough]
        cuts = np.flatnonzero(np.diff(doc_of)) + 1
        for part, gram, docs in zip(np.split(near, cuts), np.split(at, cuts), np.split(doc_of, cuts), strict=True):
            if len(part):
                i, codes = held[docs[0]]
                found[i] += self._in_document(codes, part - starts[docs[0]], gram)

    def _in_document(self, codes, places, grams) -> list[tuple[object, int, int, int]]:
        repeat = self.count[grams]
        total = int(repeat.sum())
        inner = np.arange(total) - np.repeat(np.cumsum(repeat) - repeat, repeat)
        posting = np.repeat(self.first[grams], repeat) + inner
        owner = self.owner[posting]
        diagonal = np.repeat(places, repeat) - self.offset[posting]
        likely = np.bincount(owner, minlength=len(self.items))[owner] >= self.bound[owner]
        owner, diagonal = owner[likely], diagonal[likely]
        if not len(owner):
            return []
        band = diagonal >> self.shift[owner]
        both = np.concatenate([band, band - 1])
        keys = np.stack([np.concatenate([owner, owner]), both])
        bands, counts = np.unique(keys, axis=1, return_counts=True)
        good = counts >= self.bound[bands[0]]
        matches: dict[tuple[int, int, int], int] = {}
        for item, b in bands[:, good].T.tolist():
            step = 1 << int(self.shift[item])
            low, high = b * step, (b + 2) * step - 1
            hit = self._align(item, codes, low, high)
            if hit:
                start, end, edits = hit
                matches[item, start, end] = min(edits, matches.get((item, start, end), edits))
        best: list[tuple[object, int, int, int]] = []
        taken: dict[int, list[tuple[int, int]]] = {}  # places of an item in order, none overlaps
        for (item, start, end), edits in sorted(matches.items(), key=lambda x: (x[1], x[0])):
            mine = taken.setdefault(item, [])
            at = bisect.bisect_left(mine, (end,))  # the places before it begin before this end
            if at and mine[at - 1][1] > start:
                continue
            mine.insert(at, (start, end))
            best.append((self.items[item][0], start, end, edits))
        return best

    def _align(self, item: int, codes, low: int, high: int) -> tuple[int, int, int] | None:
        """Best place of an item between two diagonals: start, end and edits."""
        text, most = self.items[item][1], int(self.edits[item])
        first = max(0, low - most)
        region = codes[first : max(first, high + len(text) + most)]
        exact = _find(region, text)
        if exact >= 0:
            return first + exact, first + exact + len(text), 0
        end = banded_distance(text, region, low - most - first, high + most - first, most)
        if end is None:
            return None
        edits, stop = end
        # Backwards from the end: the least edits fix the start.
        back = region[max(0, stop - len(text) - most) : stop][::-1]
        start = banded_distance(text[::-1], back, -most, most, most)
        length = start[1] if start else len(text)
        return first + stop - length, first + stop, edits


def _find(region: np.ndarray, item: np.ndarray) -> int:
    """Place of an exact copy, or -1."""
    data, want = region.tobytes(), item.tobytes()
    at = data.find(want)
    while at >= 0 and at % 4:
        at = data.find(want, at + 1)
    return at // 4 if at >= 0 else -1


@functools.lru_cache(maxsize=1)
def _index(items: tuple[tuple[object, str], ...]) -> ItemIndex:
    return ItemIndex(list(items))


def item_blocks(
    benchmark: DataFrame, item_col: str = "item_id", text_col: str = "text", most: int | None = None
) -> Iterator[tuple[tuple[object, str], ...]]:
    """The benchmark as blocks of (item, text) of at most ``most`` characters, one at a time.

    Items are dealt by hash to parts, and parts fill blocks; a part of more characters, such as
    one very long item, is a block of its own. One block at least, which may be empty. Null texts
    and texts of blanks alone are no passages and are left out.
    """
    most = most or MAX_ITEM_CHARS
    rows = benchmark.select(F.col(item_col).alias("item"), F.col(text_col).alias("text"))
    rows = rows.where(F.col("text").rlike(r"[^\t-\r ]"))
    size = rows.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    groups: list[list[int] | None] = [None]
    part = F.pmod(F.xxhash64("item", "text"), F.lit(PARTS * -(-size // most) or 1))
    if size > most:
        sizes = rows.groupBy(part.alias("part")).agg(F.sum(F.length("text")).alias("size")).collect()
        groups, room = [], 0
        for r in sorted(sizes, key=lambda r: r["part"]):
            if not groups or r["size"] > room:
                groups.append([])
                room = most
            groups[-1].append(r["part"])
            room -= r["size"]
    for group in groups:
        mine = rows if group is None else rows.where(part.isin(group))
        yield tuple(sorted(((r["item"], r["text"]) for r in mine.collect()), key=lambda x: (str(x[0]), x[1])))


def benchmark_matches(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text: str = "text",
) -> DataFrame:
    """(doc_id, item_id, start_pos, end_pos, edits): a row per passage of an item in a document.

    Case and the kind of blank do not count. Positions are code points of the document, end
    exclusive; of overlapping places of one item the one with fewest edits is reported.
    Items of fewer than ``Q`` characters match exact copies, from the left, without overlaps. Null
    texts hold no match; repeated rows give repeated matches. A benchmark of more than
    ``MAX_ITEM_CHARS`` characters takes one scan of the documents for each block of it, whose
    matches are written before the next block is read.
    """
    rows = id_and_text(docs, id_col, text_col)
    kind = dict(rows.dtypes)["doc_id"]
    item_kind = dict(benchmark.dtypes)[item_col]
    names = ["doc_id", "item_id", "start_pos", "end_pos", "edits"]

    def run(batches: Iterator[pa.RecordBatch], items: tuple[tuple[object, str], ...]) -> Iterator[pa.RecordBatch]:
        index = _index(items)
        for batch in batches:
            found = index.matches(batch.column("text").to_pylist())
            flat = [(i, *m) for i, ms in enumerate(found) for m in ms]
            where = pa.array([f[0] for f in flat], pa.int64())
            item = pa.array([f[1] for f in flat], pa.from_numpy_dtype(np.int64) if item_kind in ("bigint", "int") else None)
            numbers = [pa.array([f[c] for f in flat], pa.int32()) for c in (2, 3, 4)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(where), item, *numbers], names)

    kinds = f"doc_id {kind}, item_id {'bigint' if item_kind == 'int' else item_kind}, start_pos int, end_pos int, edits int"
    blocks = item_blocks(benchmark, item_col, item_text)
    items, found = next(blocks), []
    while items is not None:
        part, items = rows.mapInArrow(functools.partial(run, items=items), kinds), next(blocks, None)
        found.append(stored(part, "passages") if found or items is not None else part)
    return functools.reduce(DataFrame.unionAll, found)


def drop_contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    text_col: str = "text",
    item_col: str = "item_id",
    item_text: str = "text",
) -> DataFrame:
    """``docs`` without the rows that hold a benchmark passage; columns stay as they are.

    Between the blocks of a large benchmark the rows are written, so that a task holds one index.
    """
    bounded_batches(docs.sparkSession)
    mark = fresh(docs, "passages")
    for turn, items in enumerate(item_blocks(benchmark, item_col, item_text)):
        hits = _hits(items)
        docs = stored(docs, "clean") if turn else docs
        docs = docs.withColumn(mark, hits(F.col(text_col))).where(F.col(mark) == 0).drop(mark)
    return docs


def _hits(items: tuple[tuple[object, str], ...]):
    @F.pandas_udf("int")
    def hits(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        index = _index(items)
        for texts in batches:
            yield pd.Series([len(m) for m in index.matches(texts.tolist())], dtype="int32")

    return hits
