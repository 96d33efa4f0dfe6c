"""Repeated token windows: rolling hashes counted over all documents, merged into intervals.

Every window of ``WINDOW`` words has a Rabin-Karp value, computed for a whole chunk of
documents at once. A window goes if the same window starts in a document with a smaller id.
The work is two exchanges:

1. Documents are dealt to chunks by a hash. A chunk sends each of its different windows once,
   with the smallest id that has it there, packed by bucket. A window in a third of all
   documents is thus one entry a chunk, not one a document.
2. A bucket finds the smallest id of each window and answers every chunk with one bit a
   window: is there a smaller id elsewhere? The chunk's documents meet the bits and cut.

The bucket comes from a second hash and the number of buckets grows with the input, so the
chance that a window meets an unequal one in its bucket is about ``BUCKET_WINDOWS / 2**64``
at every size.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from answerloom.llm.common import id_and_text

WINDOW = 13
CHUNK_DOCUMENTS = 512
CHUNK_BYTES = 8 << 20
BUCKET_WINDOWS = 2_000_000
#: Words remembered by one worker; the memory is emptied when it is full.
KNOWN_WORDS = 500_000
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_LAST = np.iinfo(np.int64).max


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= KNOWN_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


_HASHES = _Hashes()


class _Chunk:
    """Words and windows of the documents of one chunk, by ascending id."""

    def __init__(self, table: pa.Table, window: int):
        ids = table.column("doc_id").combine_chunks()
        # Rows without an id come last; equal ids share a rank and never remove each other.
        place = pc.fill_null(ids.cast(pa.int64()), int(_LAST)).to_numpy(zero_copy_only=False)
        self.rows = np.argsort(place, kind="stable")
        texts = table.column("text").cast(pa.binary()).to_pylist()
        self.words = [(texts[r] or b"").split() for r in self.rows]
        self.ids = place[self.rows]
        self.lengths = np.array([len(w) for w in self.words], dtype=np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)])
        total = int(self.starts[-1])
        codes = np.empty(total, dtype=np.uint64)
        for words, at in zip(self.words, self.starts.tolist(), strict=False):
            codes[at : at + len(words)] = np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words))
        n = max(0, total - window + 1)
        rolled = []
        for base in _BASES:
            value = np.zeros(n, dtype=np.uint64)
            for i in range(window):
                value *= np.uint64(base)
                value += codes[i : i + n]
            rolled.append(value)
        owner = np.repeat(np.arange(len(self.words)), self.lengths)
        left = self.starts[1:][owner] - np.arange(total)  # words from here to the text's end
        self.at = np.flatnonzero(left >= window)
        self.owner = owner[self.at]
        self.value, self.second = (r[self.at] for r in rolled)

    def distinct(self, buckets: int):
        """First occurrence of each different window by bucket, then id; and all windows' entry."""
        bucket = ((self.second >> np.uint64(20)) % np.uint64(buckets)).astype(np.int64)
        _, first, entry = np.unique(self.value, return_index=True, return_inverse=True)
        order = np.lexsort((first, bucket[first]))
        place = np.empty(len(order), dtype=np.int64)
        place[order] = np.arange(len(order))
        first = first[order]
        return first, bucket[first], place[entry]


def _messages(window: int, buckets: int):
    def send(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        chunk = _Chunk(table, window)
        first, bucket, _ = chunk.distinct(buckets)
        names, cuts = np.unique(bucket, return_index=True)
        rows = {"bucket": [], "chunk": [], "values": [], "ids": [], "counts": []}
        for b, start, stop in zip(names.tolist(), cuts.tolist(), [*cuts.tolist()[1:], len(first)], strict=True):
            mine = first[start:stop]
            ids, counts = np.unique(chunk.ids[chunk.owner[mine]], return_counts=True)
            rows["bucket"].append(b)
            rows["chunk"].append(key[0].as_py())
            rows["values"].append(chunk.value[mine].tobytes())
            rows["ids"].append(ids.tobytes())
            rows["counts"].append(counts.astype("<u4").tobytes())
        kinds = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
        return pa.table([pa.array(v, k) for v, k in zip(rows.values(), kinds, strict=True)], names=list(rows))

    return send


def _answers(table: pa.Table) -> pa.Table:
    """For each chunk's entries of one bucket, whether a smaller id has the window elsewhere."""
    values, owners, sizes = [], [], []
    for v, i, c in zip(*(table.column(n).to_pylist() for n in ("values", "ids", "counts")), strict=True):
        values.append(np.frombuffer(v, dtype=np.uint64))
        owners.append(np.repeat(np.frombuffer(i, dtype=np.int64), np.frombuffer(c, dtype="<u4")))
        sizes.append(len(values[-1]))
    value, owner = np.concatenate(values), np.concatenate(owners)
    order = np.argsort(value, kind="stable")
    value, sorted_owner = value[order], owner[order]
    starts = np.flatnonzero(np.concatenate([[True], value[1:] != value[:-1]]))
    least = np.minimum.reduceat(sorted_owner, starts)
    smaller = np.repeat(least, np.diff([*starts, len(value)])) < sorted_owner
    flags = np.empty(len(value), dtype=bool)
    flags[order] = smaller
    parts = np.split(flags, np.cumsum(sizes)[:-1])
    chunk, bucket = table.column("chunk").to_pylist(), table.column("bucket").to_pylist()
    rows = [(c, b, np.packbits(p).tobytes()) for c, b, p in zip(chunk, bucket, parts, strict=True) if p.any()]
    kinds = [("chunk", pa.int64()), ("bucket", pa.int64()), ("bits", pa.binary())]
    return pa.table([pa.array([r[i] for r in rows], k) for i, (_, k) in enumerate(kinds)], names=[n for n, _ in kinds])


def _cut(window: int, buckets: int):
    def cut(docs: pa.Table, answers: pa.Table) -> pa.Table:
        chunk = _Chunk(docs, window)
        first, bucket, entry = chunk.distinct(buckets)
        elsewhere = np.zeros(len(first), dtype=bool)
        names, cuts, counts = np.unique(bucket, return_index=True, return_counts=True)
        span = {b: (s, n) for b, s, n in zip(names.tolist(), cuts.tolist(), counts.tolist(), strict=True)}
        for b, bits in zip(answers.column("bucket").to_pylist(), answers.column("bits").to_pylist(), strict=True):
            start, n = span[b]
            elsewhere[start : start + n] = np.unpackbits(np.frombuffer(bits, np.uint8), count=n).astype(bool)
        here = chunk.ids[chunk.owner] > chunk.ids[chunk.owner[first[entry]]] if len(first) else np.zeros(0, bool)
        repeated = chunk.at[elsewhere[entry] | here] if len(first) else chunk.at
        edge = np.zeros(int(chunk.starts[-1]) + 1, dtype=np.int32)
        np.add.at(edge, repeated, 1)
        np.add.at(edge, repeated + window, -1)
        gone = np.cumsum(edge)[:-1] > 0
        intervals, kept = [], []
        for words, at in zip(chunk.words, chunk.starts.tolist(), strict=False):
            mine = gone[at : at + len(words)]
            if mine.any():
                turns = np.flatnonzero(np.diff(np.concatenate([[False], mine, [False]]).astype(np.int8)))
                intervals.append([{"first": int(a), "stop": int(b)} for a, b in turns.reshape(-1, 2)])
                words = compress(words, (~mine).tolist())
            else:
                intervals.append([])
            kept.append(b" ".join(words))
        span_kind = pa.list_(pa.struct([("first", pa.int32()), ("stop", pa.int32())]))
        return pa.table(
            [
                docs.column("doc_id").take(pa.array(chunk.rows)),
                pa.array(chunk.lengths),
                pa.array(intervals, span_kind),
                pa.array(kept, pa.binary()).cast(pa.string()),
            ],
            names=["doc_id", "n_words", "removed", "kept"],
        )

    return cut


def remove_repeated_windows(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW
) -> DataFrame:
    """(doc_id, n_words, removed, kept) for every row of ``docs``.

    ``removed`` lists the maximal intervals [first, stop) of words that lie in a window which
    also starts in a document with a smaller id; ``kept`` is the other words, one blank
    between. Windows are judged on the input. Repeats within one document stay. Null and
    short texts lose nothing. Rows with the same id never remove each other's words; rows
    without an id count as larger than all others and give way to every row with one. Ids
    are integers. An empty table gives no rows.
    """
    rows = id_and_text(docs, id_col, text_col)
    size = rows.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    # About six bytes a word, so as many windows at most; more only means smaller buckets.
    buckets = max(1, -(-size[1] // (6 * BUCKET_WINDOWS)))
    chunks = max(1, -(-size[0] // CHUNK_DOCUMENTS), -(-size[1] // CHUNK_BYTES))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    mark = F.pmod(F.xxhash64("doc_id", "text"), F.lit(chunks)).alias("chunk")
    # One exchange of the texts serves both the sending and the cutting.
    dealt = rows.select(F.col("doc_id").cast("long").alias("doc_id"), "text", mark).repartition(parts, "chunk")
    sent = dealt.groupBy("chunk").applyInArrow(
        _messages(window, buckets), "bucket long, chunk long, values binary, ids binary, counts binary"
    )
    answers = sent.groupBy("bucket").applyInArrow(_answers, "chunk long, bucket long, bits binary")
    result = dealt.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(
        _cut(window, buckets),
        "doc_id long, n_words long, removed array<struct<first:int,stop:int>>, kept string",
    )
    kind = dict(rows.dtypes)["doc_id"]
    return result.withColumn("doc_id", F.col("doc_id").cast(kind))
