"""Near copies by word shingles: SimHash candidates, exact similarity, components.

Two texts are near copies if the sets of their word shingles have a Jaccard similarity of at
least ``SIMILARITY``. Texts with equal sets are one class from the first aggregation on. A class
whose ``SKETCH`` smallest shingles hardly occur in other sketches has no near copy and is done.

Every other class has several 64-bit SimHash fingerprints, each cut into four blocks of 16 bits:
as many as miss a pair at the threshold with a chance of ``MISSED``. Two rows of a block are
candidates if their first fingerprints differ in no more bits than a pair at the threshold does
with the same chance, and their sizes allow the similarity. Candidates that hang together, over
all blocks, are a band: a row has one, however many blocks it shares. The blocks of the first
``EARLY`` fingerprints are joined first; in the others only rows that are still apart give links.
Sets of few shingles, whose bits depend on each other's ties, meet by their smallest shingles
instead, as many as a similar pair cannot avoid.

Members of a band are not compared pair by pair at first. A shingle that only one member of
all bands has cannot be shared, which bounds the similarity a row can reach: rows that cannot
reach any other row of their band leave it. In every round a row is compared with at most
``PIVOTS`` others: the pivots of its bands that lie in other components, those first that it
shares most bands with. The first pivots are the rows that meet most others, the later ones
are drawn. Rounds go on while they join components; a band whose members are one component
is done. Of what is left, bands of at most ``PAIRED`` rows give all
pairs of different components. In larger ones a row is written as its difference from the
shingles that over half of the band holds: two sets differ where their differences do, so what
the copies of one text have in common takes no part. They are cut into groups of rows that
share one of the rarest shingles of their differences, as many as a similar pair cannot avoid
(prefix filter, which loses none). Before, all rows are compared with the one whose difference is
smallest; these groups take rounds of their own, if large, before their pairs are compared. Pairs whose parities of shingles differ too often are not (a bound, exact as well).
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from answerloom.llm.common import id_and_text, slices, stored
from answerloom.llm.components import connected_components

SHINGLE_WORDS = 5
SIMILARITY = 0.8
#: Chance that a pair at the threshold shares no block.
MISSED = 1e-6
BLOCK_BITS = 16
#: Fingerprints that travel with a block, for the distance of what meets there.
CHECKED = 4
#: Fingerprints whose blocks are joined before the others.
EARLY = 8
#: Smallest shingles of a set that say whether it shares any with others.
SKETCH = 16
#: Sets of at most so many shingles meet by shingles, not by fingerprints.
SHORT = 24
#: Rows of a block up to which distances are counted; a larger one is one band.
COUNTED = 4096
#: Rows of blocks for one task, and those that are worked on at once.
TASK_BLOCKS = 2_000_000
CHUNK = 200_000
PAIRED = 32
PIVOTS = 2
#: A round that finds fewer links than this share of its rows, or than this number, is the last one.
WORTHWHILE = 0.01
FEW = 512
#: Rows of a table that may be broadcast: 16 bytes each.
SENT_ROWS = 2_000_000
#: Classes of shingles, by hash, whose parities are compared before sets are: 64 in a word.
CLASSES = 2048
#: Counters of shingles, by hash, that the prefix order goes by.
COUNTERS = 1 << 18
BATCH_BYTES = 4 << 20
_PART = 255
_hash = functools.partial(xxhash.xxh64_intdigest, seed=7)


def shingle_set(text: bytes | None, width: int = SHINGLE_WORDS) -> np.ndarray:
    """Sorted 64-bit values of the different shingles; a shorter text is one shingle."""
    words = (text or b"").lower().split()  # bytes: only A-Z change, only ASCII blanks split
    if not words:
        return np.zeros(0, dtype=np.uint64)
    if len(words) < width:
        shingles = [b" ".join(words)]
    else:
        shingles = map(b" ".join, zip(*(words[i:] for i in range(width)), strict=False))
    return np.unique(np.fromiter(map(_hash, shingles), dtype=np.uint64))


def _differing(similarity: float) -> float:
    """Chance that a bit differs between two sets of this similarity; sets of one size differ most."""
    return math.acos(min(1.0, 2 * similarity / (1 + similarity))) / math.pi


def band_count(similarity: float) -> int:
    """Blocks that a pair of this similarity misses with a chance of ``MISSED``, in whole fingerprints."""
    same = (1 - _differing(min(similarity, 0.999))) ** BLOCK_BITS
    each = 64 // BLOCK_BITS
    return each * max(CHECKED, math.ceil(math.log(MISSED) / math.log1p(-same) / each))


def _at_most(n: int, p: float, k: int) -> float:
    """Chance of at most ``k`` successes in ``n``."""
    return sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))


def radius(similarity: float, prints: int = 2) -> int:
    """Differing bits in ``prints`` fingerprints that a similar pair exceeds with a quarter of ``MISSED``."""
    bits, p = 64 * prints, _differing(similarity)
    return next(k for k in range(bits + 1) if 1 - _at_most(bits, p, k) <= MISSED / 4)


def least_shared(similarity: float) -> int:
    """Sketch values in common that a similar pair falls short of with a quarter of ``MISSED`` at most."""
    short = [k for k in range(1, SKETCH + 1) if _at_most(SKETCH, similarity, k - 1) <= MISSED / 4]
    return max(short, default=1)


@functools.cache
def _factors(count: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20)
    drawn = rng.integers(0, 1 << 64, (count, 2), dtype=np.uint64).T
    return drawn[0] | np.uint64(1), drawn[1]


def fingerprints(shingles: np.ndarray, count: int) -> np.ndarray:
    """``count`` SimHash fingerprints of a set: a bit is 1 if set in over half of the values."""
    factor, shift = _factors(count)
    ones = np.zeros(64 * count, dtype=np.int64)
    for at in range(0, len(shingles), _PART):
        part = shingles[at : at + _PART, None] * factor + shift
        part ^= part >> np.uint64(32)
        part *= np.uint64(0x9E3779B97F4A7C15)
        part ^= part >> np.uint64(29)
        bits = np.unpackbits(part.astype("<u8", copy=False).view(np.uint8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.uint8)  # _PART rows fit a byte
    return np.packbits(ones * 2 > len(shingles), bitorder="little").view("<u8")


def _blocks(prints: np.ndarray) -> np.ndarray:
    values = prints.astype("<u8", copy=False).view("<u2").astype(np.int64)
    return values | (np.arange(len(values)) << BLOCK_BITS)


def band_values(shingles: np.ndarray, bands: int) -> list[int]:
    """Number and value of each fingerprint block of a set; none for an empty set."""
    if not len(shingles):
        return []
    return _blocks(fingerprints(shingles, bands * BLOCK_BITS // 64)).tolist()


def _sketches(rows: DataFrame, width: int) -> DataFrame:
    kind = dict(rows.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", BATCH_BYTES):
            sets = [shingle_set(t, width) for t in batch.column("text").cast(pa.binary()).to_pylist()]
            keys = np.array([xxhash.xxh64_intdigest(s.tobytes()) if len(s) else 0 for s in sets], dtype=np.uint64)
            columns = [
                *(batch.column(c) for c in ("row", "doc_id", "text_hash")),
                pa.array(keys.view(np.int64)),
                pa.array([len(s) for s in sets], pa.int64()),
                pa.array([s[:SKETCH].view(np.int64) for s in sets], pa.list_(pa.int64())),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["row", "doc_id", "text_hash", "key", "n", "low"])

    return rows.mapInArrow(run, f"row long, doc_id {kind}, text_hash long, key long, n long, low array<long>")


def _sharing(heads: DataFrame, similarity: float) -> DataFrame:
    """The rows whose sketch has as many values of other sketches as a similar pair has in common."""
    keyed = heads.select("row", F.explode("low").alias("value"))
    shared = keyed.groupBy("value").agg(F.count("*").alias("held")).where("held > 1").select("value")
    found = keyed.join(shared, "value").groupBy("row").agg(F.count("*").alias("common"))
    need = F.ceil(F.least("n", F.lit(SKETCH)) * (least_shared(similarity) / SKETCH) - 1e-9)
    return heads.select("row", "n").join(found, "row").where(F.col("common") >= need).select("row")


def _block_rows(sets: DataFrame, similarity: float, first: int, last: int) -> DataFrame:
    """(block, row, n, print_0, …): a row for each block of fingerprints ``first`` to ``last`` of each set that is not short."""
    each = 64 // BLOCK_BITS
    bands = each * (last - first)
    names = [f"print_{i}" for i in range(CHECKED)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "shingles", BATCH_BYTES):
            found = [np.frombuffer(s, np.uint64) for s in batch.column("shingles").to_pylist()]
            at = np.array([i for i, s in enumerate(found) if len(s) > SHORT], dtype=np.int64)
            if not len(at):
                continue
            prints = np.array([fingerprints(found[i], max(last, CHECKED)) for i in at])
            owner = pa.array(np.repeat(at, bands))
            columns = [
                pa.array(np.concatenate([_blocks(p[:last])[each * first :] for p in prints])),
                batch.column("row").take(owner),
                pa.array(np.repeat([len(found[i]) for i in at], bands)),
                *(pa.array(np.repeat(prints[:, i], bands).view(np.int64)) for i in range(CHECKED)),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["block", "row", "n", *names])

    schema = ", ".join(f"{c} long" for c in ("block", "row", "n", *names))
    return sets.select("row", "shingles").mapInArrow(run, schema)


def _mixed(values: np.ndarray) -> np.ndarray:
    """64-bit values whose sums tell sets of whole numbers apart."""
    found = values.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        found = (found ^ (found >> np.uint64(shift))) * np.uint64(factor)
    return (found ^ (found >> np.uint64(31))).view(np.int64)


def _hanging(data: np.ndarray, within: int, similarity: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
    """Indexes of the rows that are ``within`` of another one of their block, and the first row they hang on.

    ``data`` has the columns block, row, n and the fingerprints, and is ordered by block and row.
    Rows of one name are not compared.
    """
    block, name, size, prints = data[:, 0], data[:, 1], data[:, 2], data[:, 3:].view(np.uint64)
    left, right = [], []
    here = np.arange(len(data) - 1)
    step = 1
    while len(here := here[here + step < len(data)]):
        here = here[block[here] == block[here + step]]
        sizes = size[here], size[here + step]
        meets = np.minimum(*sizes) >= np.maximum(*sizes) * similarity - 1e-6
        met = here[meets & (name[here] != name[here + step])]
        apart = np.bitwise_count(prints[met] ^ prints[met + step]).sum(axis=1, dtype=np.int64)
        near = met[apart <= within]
        left.append(near)
        right.append(near + step)
        step += 1
    a, b = (np.concatenate([np.zeros(0, np.int64), *side]) for side in (left, right))
    label = np.arange(len(data))
    while True:
        least = np.minimum(label[a], label[b])
        if (least == label[a]).all() and (least == label[b]).all():
            break
        np.minimum.at(label, a, least)
        np.minimum.at(label, b, least)
        label = label[label]
    rows = np.unique(np.concatenate([a, b]))
    return rows, label[rows]


def _banded(
    parts: Iterator[np.ndarray], within: int, counted: int, similarity: float = 0.0
) -> Iterator[np.ndarray]:
    """(band, row, n) of the rows in bands, from rows ordered by block and row.

    A band is named after its rows, whatever its block. A block of more than ``counted`` rows is one
    band, named after the block: it goes on as it comes in and is never held whole.
    """

    def whole(rows: np.ndarray) -> np.ndarray:
        return np.column_stack([_mixed(~rows[:, 0]), rows[:, 1], rows[:, 2]])

    def told(rows: np.ndarray) -> Iterator[np.ndarray]:
        starts = np.flatnonzero(np.r_[True, rows[1:, 0] != rows[:-1, 0]])
        large = np.repeat(np.diff(np.r_[starts, len(rows)]) > counted, np.diff(np.r_[starts, len(rows)]))
        yield whole(rows[large])
        rest = rows[~large]
        at, first = _hanging(rest, within, similarity)
        names = np.zeros(len(rest), dtype=np.int64)
        np.add.at(names, first, _mixed(rest[at, 1]))
        yield np.column_stack([_mixed(names[first]), rest[at, 1], rest[at, 2]])

    held, count, passing = [], 0, None
    for part in parts:
        if passing is not None:
            same = part[:, 0] == passing
            yield whole(part[same])
            part = part[~same]
        held.append(part)
        count += len(part)
        if count < max(CHUNK, counted + 1):
            continue
        rows = np.concatenate(held)
        last = np.searchsorted(rows[:, 0], rows[-1, 0])
        if last:
            yield from told(rows[:last])
        rows = rows[last:]
        if len(rows) > counted:
            yield whole(rows)
            passing, rows = rows[0, 0], rows[:0]
        held, count = [rows], len(rows)
    if count:
        yield from told(np.concatenate(held))


def _links(bands: Iterator[np.ndarray]) -> Iterator[np.ndarray]:
    """(a, b): each row of a band with the band's first one, from what ``_banded`` gives."""
    passing, hub = None, 0
    for found in bands:
        if not len(found):
            continue
        names, first, inverse = np.unique(found[:, 0], return_index=True, return_inverse=True)
        hubs = found[first, 1]
        hubs[names == passing] = hub  # the band of a large block goes on
        passing, hub = found[-1, 0], hubs[inverse[-1]]
        links = np.column_stack([hubs[inverse], found[:, 1]])
        yield np.unique(links[links[:, 0] != links[:, 1]], axis=0)


def _block_links(sets: DataFrame, similarity: float, first: int, last: int, counted: int) -> DataFrame:
    """(a, b) links that join the candidates of the blocks of fingerprints ``first`` to ``last``."""
    blocks = _block_rows(sets, similarity, first, last)
    within = radius(similarity, CHECKED)
    tasks = math.ceil(sets.count() * (last - first) * (64 // BLOCK_BITS) / TASK_BLOCKS)
    tasks = max(tasks, int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = (np.column_stack([c.to_numpy() for c in b.columns]) for b in batches if b.num_rows)
        for found in _links(_banded(parts, within, counted, similarity)):
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in found.T], ["a", "b"])

    ordered = blocks.repartition(tasks, "block").sortWithinPartitions("block", "row")
    return ordered.mapInArrow(run, "a long, b long").distinct()


def _candidates(sets: DataFrame, similarity: float, counted: int = COUNTED) -> DataFrame:
    """(band, row, n) of the rows that have a candidate, by fingerprints or, if short, by shingles."""
    prints = band_count(similarity) * BLOCK_BITS // 64
    early = min(EARLY, prints)
    bands = connected_components(_block_links(sets, similarity, 0, early, counted), "a", "b")
    bands = checked(stored(bands.toDF("row", "band"), "bands"))
    # From here on a set goes by the name of its band.
    named = sets.join(bands, "row", "left").select("row", F.coalesce("band", "row").alias("band"), "shingles")
    rest = named.select(F.col("band").alias("row"), "shingles")
    joined = connected_components(_block_links(rest, similarity, early, prints, counted), "a", "b")
    joined = checked(stored(joined.toDF("band", "joined"), "bands"))
    size = F.expr("octet_length(shingles) div 8").alias("n")
    near = named.select("row", "band", size).join(joined, "band", "left")
    near = near.select(F.coalesce("joined", "band").alias("band"), "row", "n")

    def smallest(shingles: np.ndarray) -> np.ndarray:
        return shingles[: len(shingles) - math.ceil(len(shingles) * similarity - 1e-6) + 1]

    short = _exploded(sets.withColumn("n", size).where(F.col("n") <= int(SHORT / similarity)), smallest, ("row", "n"))
    near = near.unionAll(short.select(F.xxhash64("shingle").alias("band"), "row", "n"))
    met = near.groupBy("band").agg(F.count("*").alias("held")).where("held > 1").select("band")
    return near.join(met, "band", "left_semi")


def _sets(texts: DataFrame, width: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", BATCH_BYTES):
            sets = [shingle_set(t, width).tobytes() for t in batch.column("text").cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(sets, pa.binary())], ["row", "shingles"])

    return texts.select("row", "text").mapInArrow(run, "row long, shingles binary")


def _similar(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose sets are as similar as asked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("left").to_pylist(), batch.column("right").to_pylist(), strict=True):
                both = np.sort(np.concatenate([np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)]))
                common = int((both[1:] == both[:-1]).sum())
                keep.append(common / (len(both) - common) >= similarity)
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    pairs = checked(stored(pairs, "pairs"))
    meant = [sets.join(checked(stored(pairs.select(c).distinct(), "meant")).toDF("row"), "row", "left_semi") for c in "ab"]
    whole = pairs.join(meant[1].toDF("b", "right"), "b").join(meant[0].toDF("a", "left"), "a")
    return whole.select("a", "b", "left", "right").mapInArrow(run, "a long, b long")


def checked(df: DataFrame, rows: int = SENT_ROWS) -> DataFrame:
    """``df``, to be broadcast if it has at most so many rows; otherwise Spark decides."""
    return F.broadcast(df) if df.count() <= rows else df


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _with_order(members: DataFrame, turn: int) -> DataFrame:
    """``members`` with the order of pivots: who meets most rows comes first, later ones are drawn.

    Where differences are known, who has the smallest comes first.
    """
    drawn = F.xxhash64("row", F.lit(turn))
    if "e" in members.columns:
        return members.withColumn("order", F.struct("e", drawn.alias("drawn")))
    if turn:
        return members.withColumn("order", F.struct(F.lit(0).cast("long").alias("met"), drawn.alias("drawn")))
    met = members.groupBy("row").agg(F.sum("size").alias("met"))
    return members.join(met, "row").withColumn("order", F.struct((-F.col("met")).alias("met"), drawn.alias("drawn")))


def _pivot_pairs(members: DataFrame, turn: int) -> DataFrame:
    """Each row with at most ``PIVOTS`` pivots of its bands, of other components than its own.

    A band has the pivot that comes first in an order common to all bands, and the first one
    of another component than that; each member takes the one that is not of its own.
    """
    members = _with_order(members, turn)
    first = members.groupBy("band").agg(
        F.min_by("row", "order").alias("p"), F.min_by("component", "order").alias("of")
    )
    known = members.join(first, "band")
    other = known.where(F.col("component") != F.col("of")).groupBy("band").agg(F.min_by("row", "order").alias("q"))
    away = F.when(F.col("component") != F.col("of"), F.col("p")).otherwise(F.col("q"))
    pairs = known.join(other, "band").select(F.col("row").alias("a"), away.alias("b"))
    shared = pairs.groupBy("a", "b").agg(F.count("*").alias("bands"))
    best = Window.partitionBy("a").orderBy(F.desc("bands"), F.xxhash64("b", F.lit(turn)))
    ranked = shared.withColumn("place", F.row_number().over(best))
    return _ordered(ranked.where(F.col("place") <= PIVOTS))


def _sided(rows: DataFrame, shapes: DataFrame, similarity: float) -> DataFrame:
    """Pairs of ``rows`` that share a band, are of different components and may be similar.

    Two sets differ in all their lone shingles, and once at least in each class where one has
    an even number of others and one an odd number.
    """
    rows = rows.join(shapes, "row")
    left, right = (
        rows.select(
            "band", F.col("row").alias(r), *[F.col(c).alias(f"{c}_{r}") for c in ("n", "component", "reach", "lone", "shape")]
        )
        for r in ("a", "b")
    )
    close = F.least("n_a", "n_b") >= F.greatest("n_a", "n_b") * similarity - 1e-6
    close &= (F.col("n_b") <= F.col("reach_a")) & (F.col("n_a") <= F.col("reach_b"))
    odd = F.zip_with("shape_a", "shape_b", lambda x, y: F.bit_count(x.bitwiseXOR(y)))
    apart = F.aggregate(odd, F.col("lone_a") + F.col("lone_b"), lambda s, x: s + x)
    close &= apart <= _apart(F.col("n_a") + F.col("n_b"), similarity)
    different = (F.col("a") < F.col("b")) & (F.col("component_a") != F.col("component_b"))
    return left.join(right, "band").where(different & close).select("a", "b")


def _apart(sizes, similarity: float):
    """Shingles in which two similar sets of these sizes together may differ."""
    return sizes * ((1 - similarity) / (1 + similarity)) + 1e-6


def _exploded(rows: DataFrame, pick, names: tuple[str, ...], *given: str) -> DataFrame:
    """``names`` and shingle for the shingles that ``pick`` takes of each row's set and columns ``given``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "shingles", BATCH_BYTES):
            taken = zip(*(batch.column(c).to_pylist() for c in ("shingles", *given)), strict=True)
            sets = [pick(np.frombuffer(s, np.uint64), *more) for s, *more in taken]
            owner = pa.array(np.repeat(np.arange(len(sets)), [len(s) for s in sets]))
            columns = [batch.column(c).take(owner) for c in names]
            values = np.concatenate([np.zeros(0, np.uint64), *sets]).view(np.int64)
            yield pa.RecordBatch.from_arrays([*columns, pa.array(values)], [*names, "shingle"])

    schema = ", ".join(f"{c} long" for c in (*names, "shingle"))
    return rows.select(*dict.fromkeys((*names, *given)), "shingles").mapInArrow(run, schema)


def _shapes(sets: DataFrame) -> DataFrame:
    """(row, lone, shape): a row's shingles that no other row has, and the parity of the others by class."""
    held = _exploded(sets, lambda s: s, ("row",)).groupBy("shingle").agg(F.count("*").alias("held"), F.min("row").alias("row"))
    word = F.expr(f"pmod(shingle, {CLASSES}) div 64")
    bit = F.expr("shiftleft(1L, cast(pmod(shingle, 64) as int))")
    alone = held.where("held = 1").groupBy("row").agg(
        F.count("*").alias("lone"),
        F.array(*[F.bit_xor(F.when(word == k, bit).otherwise(F.lit(0).cast("long"))) for k in range(CLASSES // 64)]).alias("lone_shape"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            all_sets = [np.frombuffer(s, np.int64) % CLASSES for s in batch.column("shingles").to_pylist()]
            odd = [np.packbits(np.bincount(s, minlength=CLASSES) % 2 == 1, bitorder="little").view("<i8") for s in all_sets]
            columns = [batch.column("row"), pa.array(odd, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["row", "whole"])

    whole = sets.mapInArrow(run, "row long, whole array<long>").join(alone, "row", "left")
    others = F.zip_with("whole", "lone_shape", lambda x, y: x.bitwiseXOR(y))
    shape = F.when(F.col("lone").isNull(), F.col("whole")).otherwise(others)
    lone = F.coalesce("lone", F.lit(0).cast("long")).alias("lone")
    return stored(whole.select("row", lone, shape.alias("shape")), "shapes")


def _reaching(members: DataFrame, shapes: DataFrame, similarity: float) -> DataFrame:
    """Members that may be similar to another one of their band, with ``reach``.

    ``reach`` is the largest set that a row can be similar to: of its n shingles only those
    count that another row has too.
    """
    shared = F.col("n") - F.col("lone")
    reach = F.floor(shared * ((1 + similarity) / similarity) - F.col("n") + 1e-6).alias("reach")
    known = members.join(shapes.select("row", "lone"), "row")
    known = stored(known.select("band", "row", "n", reach), "reaching")
    while True:
        least = known.groupBy("band").agg(F.min("n").alias("least"), F.count("*").alias("held"))
        near = known.join(least, "band").where("reach >= least AND held > 1")
        near = stored(near.select("band", "row", "n", F.col("held").alias("size"), "reach"), "reaching")
        # A row that left may have been the smallest of its band.
        if near.count() >= 0.9 * known.count():
            return near
        known = near


def _differences(members: DataFrame, sets: DataFrame) -> DataFrame:
    """``members`` with e and shingles: in how many and which ones a row differs from what its band usually holds.

    Usual are the shingles of over half of the band's rows, at most twice as many as a row has
    on average.
    """
    names = ("band", "row", "component", "n", "reach", "size")
    wide = stored(members.select(*names).join(sets, "row"), "wide")
    usual = _exploded(wide, lambda s: s, ("band", "size")).groupBy("band", "size", "shingle").agg(F.count("*").alias("held"))
    usual = usual.where("2 * held > size").groupBy("band").agg(F.collect_list("shingle").alias("usual"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "shingles", BATCH_BYTES):
            found = zip(batch.column("shingles").to_pylist(), batch.column("usual").to_pylist(), strict=True)
            found = [np.setxor1d(np.frombuffer(s, np.int64), np.array(u or [], dtype=np.int64), True) for s, u in found]
            columns = [
                *(batch.column(c) for c in names),
                pa.array([len(x) for x in found], pa.int64()),
                pa.array([x.tobytes() for x in found], pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays(columns, [*names, "e", "shingles"])

    schema = ", ".join(f"{c} long" for c in (*names, "e")) + ", shingles binary"
    known = wide.join(usual, "band", "left").select(*names, "shingles", "usual")
    return stored(known.mapInArrow(run, schema), "differences")


def _needed(members: DataFrame, similarity: float) -> DataFrame:
    """``members`` with what a row's difference must share with that of a similar row of another component.

    Two sets whose differences have e and f shingles differ in e + f, less twice those that
    the differences share. Nothing need be shared where ``needed`` is less than one.
    """
    first = members.groupBy("band").agg(
        F.min_by("component", F.struct("e", "component")).alias("of"), F.min("e").alias("least"), F.max("n").alias("most")
    )
    known = members.join(first, "band")
    other = known.where(F.col("component") != F.col("of")).groupBy("band").agg(F.min("e").alias("other"))
    within = _apart(F.col("n") + F.least("most", F.col("n") / similarity), similarity)
    partner = F.when(F.col("component") == F.col("of"), F.col("other")).otherwise(F.col("least"))
    needed = (F.col("e") + F.greatest(partner, F.col("e") - within) - within) / 2
    return known.join(other, "band").withColumn("needed", F.ceil(needed - 1e-6))


def _prefix_members(members: DataFrame, differences: DataFrame, similarity: float) -> DataFrame:
    """Rows of ``members`` by the rarest shingles in their differences, as bands that every similar pair shares.

    Shingles are ordered by the count of their counter, then by value: the same order for all
    rows, which is all that the filter needs. There are ``COUNTERS`` counters at any size.
    Rows that may be similar without sharing any part of their differences share shingle 0.
    """
    names = ("band", "row", "component", "n", "reach")
    rows = _needed(members, similarity).select(*names, "needed")
    rows = stored(rows.join(differences.select("band", "row", "shingles"), ["band", "row"]), "wide")
    counter = F.pmod("shingle", F.lit(COUNTERS)).alias("counter")
    counted = _exploded(rows, lambda s: s, ("row",)).groupBy(counter).agg(F.count("*").alias("held")).collect()
    held = np.zeros(COUNTERS, dtype=np.int64)
    for r in counted:
        held[r.counter] = r.held

    def rarest(shingles: np.ndarray, needed: int) -> np.ndarray:
        count = held[shingles.view(np.int64) % COUNTERS]
        if (count > 1).sum() < needed:
            return shingles[:0]
        first = np.lexsort((shingles, count))[: len(shingles) - max(needed, 1) + 1]
        found = shingles[first[count[first] > 1]]
        return found if needed > 0 else np.append(found, np.uint64(0))

    rare = _exploded(rows, rarest, names, "needed").withColumn("band", F.xxhash64("band", "shingle")).drop("shingle")
    rare = stored(rare, "rare")
    shared = rare.groupBy("band").agg(
        F.count("*").alias("size"), F.min("component").alias("low"), F.max("component").alias("high"),
        F.bit_xor(F.xxhash64("row")).alias("rows"),
    )
    # Shingles that the same rows share are one band.
    shared = shared.where("low < high").groupBy("size", "low", "high", "rows").agg(F.min("band").alias("band"))
    shared = shared.select("band", "size")
    return stored(rare.join(shared, "band"), "prefixes")


def _open(members: DataFrame, links: DataFrame) -> DataFrame:
    """Members of the bands that hold several components after ``links`` between these."""
    known = connected_components(links, "a", "b").toDF("component", "found")
    named = members.join(known, "component", "left").withColumn("joined", F.coalesce("found", "component"))
    named = named.drop("component", "found").withColumnRenamed("joined", "component")
    several = named.groupBy("band").agg(F.min("component").alias("low"), F.max("component").alias("high"))
    several = several.where("low < high").select("band")
    return stored(named.join(several, "band", "left_semi"), "open")


def _rounds(members: DataFrame, sets: DataFrame, similarity: float, most: int | None = None):
    """The links that rounds of pivots find, ``most`` of them if given, and the members of the bands that stay open."""
    links, turn, left = [], 0, members
    while True:
        rows = left.select("row").distinct().count()
        if not rows:
            return links, left
        new = stored(_similar(_pivot_pairs(left, turn), sets, similarity), "similar")
        found = new.count()
        if found:
            links.append(new)
            names = left.select("row", "component").distinct()
            between = new.join(names.toDF("a", "x"), "a").join(names.toDF("b", "y"), "b")
            left = _open(left, between.select(F.col("x").alias("a"), F.col("y").alias("b")))
        turn += 1
        if turn == most or found < max(WORTHWHILE * rows, FEW):
            return links, left


def near_copy_links(
    members: DataFrame, sets: DataFrame, similarity: float = SIMILARITY, paired: int = PAIRED
) -> DataFrame:
    """(a, b) links of similar rows, enough for the components over all pairs that share a band.

    ``members`` is (band, row, n): a row for each band of a row, and the number of its
    shingles. ``sets`` is (row, shingles).
    """
    shapes = _shapes(sets)
    near = _reaching(members, shapes, similarity)
    links, left = _rounds(near.withColumn("component", F.col("row")), sets, similarity)
    small = left.where(F.col("size") <= paired)
    last = [_sided(small, shapes, similarity)]
    large = left.where(F.col("size") > paired)
    if not large.isEmpty():
        differences = _differences(large, sets)
        more, large = _rounds(differences.drop("shingles"), sets, similarity, 1)
        links += more
        rest = _prefix_members(large, differences, similarity)
        # Bands of so few rows on average make pairs in proportion to their rows.
        if (rest.agg(F.avg("size")).first()[0] or 0) > paired:
            more, rest = _rounds(rest, sets, similarity)
            links += more
        last.append(_sided(rest, shapes, similarity))
    links.append(stored(_similar(_ordered(functools.reduce(DataFrame.unionAll, last)), sets, similarity), "similar"))
    return functools.reduce(DataFrame.unionAll, links)


def near_copy_groups(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    width: int = SHINGLE_WORDS,
    similarity: float = SIMILARITY,
    paired: int = PAIRED,
) -> DataFrame:
    """(doc_id, text_hash, component_id) for every row of ``docs``; ``text_hash`` is xxhash64(text).

    ``component_id`` is the smallest id reachable over pairs of at least ``similarity``. Texts
    without words are one component. A row without an id still carries links; a component of
    such rows only has a null ``component_id``. An empty table gives no rows.
    """
    rows = id_and_text(docs, id_col, text_col).withColumn("row", F.monotonically_increasing_id())
    # Rows are named once, with their texts, so that names hold whatever is computed again.
    rows = stored(rows.withColumn("text_hash", F.xxhash64("text")), "rows")
    marked = stored(_sketches(rows, width), "sketches")
    classes = stored(marked.groupBy("key").agg(F.min("row").alias("row"), F.min("doc_id").alias("low")), "classes")
    heads = marked.select("row", "n", "low").join(classes.select("row"), "row", "left_semi")
    wanted = checked(stored(_sharing(heads, similarity), "wanted"))
    sets = stored(_sets(rows.select("row", "text").join(wanted, "row", "left_semi"), width), "sets")
    members = stored(_candidates(sets, similarity), "members")
    sets = sets.join(checked(stored(members.select("row").distinct(), "met")), "row", "left_semi")
    sets = stored(sets.select("row", "shingles"), "sets")
    known = connected_components(near_copy_links(members, sets, similarity, paired), "a", "b").toDF("row", "found")
    named = classes.join(known, "row", "left").select("key", "low", F.coalesce("found", "row").alias("root"))
    least = named.groupBy("root").agg(F.min("low").alias("component_id"))
    named = named.join(least, "root").select("key", "component_id")
    return marked.select("doc_id", "key", "text_hash").join(named, "key").select("doc_id", "text_hash", "component_id")
