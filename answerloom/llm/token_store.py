"""Token ids on disk as directly addressable codes.

An id is split into chunks of eight bits, lowest first. Level 0 holds the first chunk of
every id; a bitmap says which ids go on, and level 1 holds the second chunk of just those,
and so on. A rank directory over each bitmap counts the ones before every block of 512 bits,
so the place of any id's next chunk is one addition and one small count away: a token is
read without decoding its neighbours.

A token table is a set of Parquet files below one folder. A row is a segment: whole
documents in ascending order, with their ids, their token counts and one code block. Shards
are the files of the ordered write; a token's position counts from the first shard's start.
"""

from __future__ import annotations

import functools
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from answerloom.llm.common import id_and_text, slices

SEGMENT_TOKENS = 1 << 16
BATCH_BYTES = 6 << 20
RANK_BITS = 512
#: Pieces remembered by one worker; the memory is emptied when it is full.
KNOWN_PIECES = 400_000
_MAGIC = b"DAC1"
#: Blanks beside blanks, or that are not a space or a line feed: such texts are not split here.
_UNEVEN = [b"  ", b" \n", b"\n ", b"\t", b"\r", b"\x0b", b"\x0c", b"\x1c", b"\x1d", b"\x1e", b"\x1f"]
_WIDE_BLANK = re.compile("[\x85\xa0\u1680\u180e\u2000-\u200f\u2028-\u202f\u205f-\u2060\u3000\ufeff]")


def pack(ids: np.ndarray) -> bytes:
    """The code block of an array of ids."""
    rest = np.asarray(ids, dtype=np.uint32)
    levels = []
    while True:
        low, more = (rest & 0xFF).astype(np.uint8), rest >> 8
        goes_on = more > 0
        bits = np.packbits(goes_on, bitorder="little")
        blocks = np.add.reduceat(goes_on, np.arange(0, len(goes_on), RANK_BITS)) if len(goes_on) else []
        ranks = np.concatenate([[0], np.cumsum(blocks)])[:-1].astype("<u4")
        levels.append((low.tobytes(), bits.tobytes(), ranks.tobytes()))
        rest = more[goes_on]
        if not len(rest):
            break
    head = _MAGIC + struct.pack("<B", len(levels))
    sizes = b"".join(struct.pack("<III", *map(len, level)) for level in levels)
    return head + sizes + b"".join(part for level in levels for part in level)


class DirectCodes:
    """Reader of one code block."""

    def __init__(self, block: bytes):
        if block[:4] != _MAGIC:
            raise ValueError("not a code block")
        count = block[4]
        at = 5 + 12 * count
        self.levels = []
        for i in range(count):
            parts = []
            for size, kind in zip(struct.unpack_from("<III", block, 5 + 12 * i), (np.uint8, np.uint8, "<u4"), strict=True):
                parts.append(np.frombuffer(block, kind, size // np.dtype(kind).itemsize, at))
                at += size
            self.levels.append(parts)

    def __len__(self) -> int:
        return len(self.levels[0][0])

    def __getitem__(self, i: int) -> int:
        """One id by its place, touching one byte, one bit and one rank block a level."""
        value = 0
        for depth, (low, bits, ranks) in enumerate(self.levels):
            value |= int(low[i]) << (8 * depth)
            if not bits[i >> 3] >> (i & 7) & 1:
                break
            block = i // RANK_BITS
            inside = bits[block * RANK_BITS // 8 : i >> 3]
            partial = int(bits[i >> 3]) & ((1 << (i & 7)) - 1)
            i = int(ranks[block]) + int(np.bitwise_count(inside).sum()) + partial.bit_count()
        return value

    def all(self) -> np.ndarray:
        """Every id, as little-endian 32-bit integers."""
        value = np.zeros(0, dtype="<u4")
        for low, bits, _ in reversed(self.levels):
            here = low.astype("<u4")
            goes_on = np.unpackbits(bits, bitorder="little", count=len(low)).astype(bool)
            here[goes_on] |= value << 8
            value = here
        return value


class PieceEncoder:
    """Byte-level BPE ids of texts, word by word.

    A text is cut before every single space; the pattern of these files never takes a space
    and what stands before it into one part, so a piece has the same ids wherever it stands.
    Texts with other blanks beside blanks, or with the name of a special token, are encoded
    whole. Merging itself is the tokenizer library's.
    """

    def __init__(self, rank_file: str, special: tuple[tuple[str, int], ...]):
        import base64

        import tiktoken

        pattern = (
            r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        )
        with open(rank_file, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.library = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens=dict(special))
        self.names = [name.encode() for name, _ in special]
        self.known: dict[bytes, bytes] = {}

    def _direct(self, text: str) -> bytes:
        ids = self.library.encode(text, allowed_special="all")
        return np.array(ids, dtype="<u4").tobytes()

    def __call__(self, text: bytes | None) -> bytes:
        """The ids of a text as little-endian 32-bit integers; null is empty."""
        if not text:
            return b""
        whole = (
            text.endswith(b" ")
            or any(blank in text for blank in _UNEVEN)
            or any(name in text for name in self.names)
            or (not text.isascii() and _WIDE_BLANK.search(text.decode()) is not None)
        )
        if whole:
            return self._direct(text.decode())
        first, *others = text.split(b" ")
        out = [self._direct(first.decode())] if first else []
        known = self.known
        try:
            out += map(known.__getitem__, others)
        except KeyError:
            if len(known) > KNOWN_PIECES:
                known.clear()
            plain = self.library.encode_ordinary
            for piece in others:
                if piece not in known:
                    ids = plain(" " + piece.decode())
                    known[piece] = np.array(ids, dtype="<u4").tobytes()
            out = [self._direct(first.decode())] if first else []
            out += map(known.__getitem__, others)
        return b"".join(out)


@functools.lru_cache(maxsize=2)
def piece_encoder(rank_file: str, special: tuple[tuple[str, int], ...]) -> PieceEncoder:
    return PieceEncoder(rank_file, special)


def write_tokens(
    docs: DataFrame,
    path: str,
    rank_file: str,
    special: tuple[tuple[str, int], ...] = (),
    end_id: int | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> None:
    """Encode every document and write the token table to ``path``, in ascending id order.

    Null and empty texts have only the end id, if one is given. Rows without an id come
    first; rows with equal ids are ordered by a hash of the text, then the text. A document
    is never split between segments; a segment ends once it holds ``SEGMENT_TOKENS``.
    """
    rows = id_and_text(docs, id_col, text_col)
    kind = dict(rows.dtypes)["doc_id"]
    order = [F.col("doc_id"), F.xxhash64("text"), F.col("text")]
    ordered = rows.repartitionByRange(*order[:2]).sortWithinPartitions(*order)
    last = b"" if end_id is None else np.array([end_id], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = piece_encoder(rank_file, special)
        shard, segment, ahead = TaskContext.get().partitionId(), 0, 0
        ids, coded, held = [], [], 0

        def flush() -> pa.RecordBatch:
            counts = [len(c) // 4 for c in coded]
            block = pack(np.frombuffer(b"".join(coded), dtype="<u4"))
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([shard], pa.int32()), pa.array([segment], pa.int64()),
                    pa.array([ahead], pa.int64()), pa.array([sum(counts)], pa.int64()),
                    pa.ListArray.from_arrays(pa.array([0, len(counts)], pa.int32()), pa.concat_arrays(ids)),
                    pa.array([counts], pa.list_(pa.int64())), pa.array([block], pa.binary()),
                ],
                ["shard", "segment", "ahead", "n_tokens", "doc_ids", "doc_tokens", "codes"],
            )

        for batch in slices(batches, "text", BATCH_BYTES):
            keys = batch.column("doc_id")
            for i, text in enumerate(batch.column("text").cast(pa.binary()).to_pylist()):
                ids.append(keys.slice(i, 1))
                coded.append(encode(text) + last)
                held += len(coded[-1]) // 4
                if held >= SEGMENT_TOKENS:
                    yield flush()
                    segment, ahead = segment + 1, ahead + held
                    ids, coded, held = [], [], 0
        if coded:
            yield flush()

    out = ordered.mapInArrow(
        run,
        f"shard int, segment long, ahead long, n_tokens long, doc_ids array<{kind}>, doc_tokens array<long>, codes binary",
    )
    out.write.parquet(path)


def read_segments(spark: SparkSession, path: str) -> DataFrame:
    """Segments with ``start``, the number of tokens before each of them.

    A segment knows what is ahead of it in its shard. What only the whole table knows is the
    shards' sizes: one row for each file of the ordered write, summed in order and broadcast.
    """
    table = spark.read.parquet(path)
    shards = table.groupBy("shard").agg(F.sum("n_tokens").alias("held"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shards = shards.select("shard", F.coalesce(F.sum("held").over(before), F.lit(0)).alias("base"))
    return table.join(F.broadcast(shards), "shard").withColumn("start", F.col("base") + F.col("ahead"))


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids) per document; ids are little-endian 32-bit integers."""
    segments = read_segments(spark, path).select("start", "doc_ids", "doc_tokens", "codes")
    kind = dict(segments.dtypes)["doc_ids"].removeprefix("array<").removesuffix(">")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                start = batch.column("start")[i].as_py()
                counts = np.array(batch.column("doc_tokens")[i].as_py(), dtype=np.int64)
                ends = np.cumsum(counts)
                data = DirectCodes(batch.column("codes")[i].as_py()).all().tobytes()
                ids = [data[4 * (e - n) : 4 * e] for e, n in zip(ends.tolist(), counts.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_ids")[i].values, pa.array(start + ends - counts), pa.array(counts), pa.array(ids, pa.binary())],
                    ["doc_id", "start", "n_tokens", "ids"],
                )

    return segments.mapInArrow(run, f"doc_id {kind}, start long, n_tokens long, ids binary")


def read_positions(spark: SparkSession, path: str, positions: DataFrame, column: str = "position") -> DataFrame:
    """(position, token) for every different position inside the table.

    Positions are gathered by cells of ``SEGMENT_TOKENS``, so a list is never longer than
    that; each is then read through the rank directories of the segment that holds it.
    """
    cell = lambda c: F.floor(c / F.lit(SEGMENT_TOKENS))
    segments = read_segments(spark, path).where("n_tokens > 0").select("start", "n_tokens", "codes")
    last = F.col("start") + F.col("n_tokens") - 1
    segments = segments.withColumn("cell", F.explode(F.sequence(cell(F.col("start")), cell(last))))
    wanted = positions.select(F.col(column).cast("long").alias("position")).where("position IS NOT NULL").distinct()
    wanted = wanted.groupBy(cell(F.col("position")).alias("cell")).agg(F.collect_list("position").alias("positions"))
    met = wanted.join(segments, "cell").select("positions", "start", "codes")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                codes = DirectCodes(batch.column("codes")[row].as_py())
                start = batch.column("start")[row].as_py()
                asked = [p for p in batch.column("positions")[row].as_py() if 0 <= p - start < len(codes)]
                tokens = pa.array([codes[p - start] for p in asked], pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(asked, pa.int64()), tokens], ["position", "token"])

    return met.mapInArrow(run, "position long, token long")
