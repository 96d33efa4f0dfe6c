"""Hard negatives by Four-Russians scoring: subset-sum tables, bit planes, shifts and adds.

Vectors are whole numbers. Every eight dimensions of an anchor give a table of the sums of all
256 subsets of their values. A candidate is its bit planes, one byte for each plane and eight
dimensions: bit ``k`` of its values, packed. A byte looks up the sum of the anchor's values at
the candidate's set bits; the sums of a plane are added, planes are shifted and added, and the
highest plane counts negative (two's complement). The result is the exact inner product.

Anchors and candidates are dealt to the cells of a grid, every anchor group meeting every
candidate group in one task. The first pass gives the best rows of an anchor's own label, the
second the best rows of other labels inside the window below each of them. A cell returns at
most ``n`` rows for an anchor, or for an anchor and positive; the last choice is a window over
those, limited again before its shuffle.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from answerloom.llm.common import stored

#: Rows of one side of a cell; groups are dealt by row, so they are about equal.
CELL_ROWS = 8192
_ANCHORS = 128
_CANDIDATES = 2048
_LARGEST = 1 << 31


def whole_vectors(
    vectors: DataFrame, id_col: str, vector_col: str, label: Column, scale: int = 256
) -> DataFrame:
    """(row, id, label, vector) with every component as floor(scale * x), ready for mining.

    Rows with a null label, a null vector, or a component that is null or not finite are left
    out. ``row`` names a row even if its id is missing or repeated.
    """
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))
    rows = vectors.select(
        F.col(id_col).cast("long").alias("id"),
        label.cast("long").alias("label"),
        F.col(vector_col).cast("array<double>").alias("vector"),
    )
    usable = F.col("label").isNotNull() & F.coalesce(F.forall("vector", finite), F.lit(False))
    floored = F.transform("vector", lambda x: F.floor(x * F.lit(float(scale))).cast("long"))
    rows = rows.where(usable).select("id", "label", floored.alias("vector"))
    return stored(rows.withColumn("row", F.monotonically_increasing_id()), "vectors")


def bit_planes(values: np.ndarray, planes: int) -> np.ndarray:
    """(rows, planes, groups) bytes of whole numbers below 2 ** (planes - 1) in size."""
    rows, width = values.shape
    padded = np.zeros((rows, -(-width // 8) * 8), dtype=np.int64)
    padded[:, :width] = values
    bits = (padded[:, None, :] >> np.arange(planes)[:, None]) & 1
    return np.packbits(bits.astype(np.uint8), axis=2, bitorder="little")


def subset_sums(anchors: np.ndarray, kind=np.int64) -> np.ndarray:
    """(groups, 256, anchors) sums of all subsets of each eight dimensions."""
    rows, width = anchors.shape
    groups = -(-width // 8)
    padded = np.zeros((rows, groups * 8), dtype=kind)
    padded[:, :width] = anchors
    tables = np.zeros((groups, 256, rows), dtype=kind)
    for bit in range(8):  # subsets with this bit highest: the lower ones, and its value
        value = padded[:, bit::8].T[:, None, :]
        tables[:, 1 << bit : 2 << bit] = tables[:, : 1 << bit] + value
    return tables


def scores(planes: np.ndarray, tables: np.ndarray, kind=np.int64) -> np.ndarray:
    """(candidates, anchors) exact inner products from packed planes and subset sums."""
    rows, count, groups = planes.shape
    total = np.zeros((rows, tables.shape[2]), dtype=kind)
    for plane in range(count - 1, -1, -1):
        one = np.zeros((rows, tables.shape[2]), dtype=tables.dtype)
        for group in range(groups):
            one += tables[group].take(planes[:, plane, group], axis=0)
        if plane == count - 1:  # the sign
            total -= one
        else:
            total += total
            total += one
    return total


def _kinds(values: np.ndarray, planes: int):
    """Smallest integer types that hold a plane's sums and the scores."""
    most = int(np.abs(values).sum(axis=1).max(initial=0))
    fitting = lambda n: next(k for k in (np.int16, np.int32, np.int64) if n <= np.iinfo(k).max)
    return fitting(most), fitting(max(most << planes, 1 << 17))


def _matrix(table: pa.Table, name: str, width: int, kind=np.int64) -> np.ndarray:
    flat = table.column(name).combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return flat.astype(kind, copy=False).reshape(table.num_rows, width)


def _best(score: np.ndarray, ids: np.ndarray, group: np.ndarray, n: int) -> np.ndarray:
    """Indices of the first ``n`` of each group, by score, then id."""
    order = np.lexsort((ids, -score, group))
    sorted_group = group[order]
    start = np.searchsorted(sorted_group, sorted_group)
    return order[np.arange(len(order)) - start < n]


def _planes_of(candidates: pa.Table, planes: int) -> np.ndarray:
    packed = candidates.column("planes").to_pylist()
    return np.frombuffer(b"".join(packed), np.uint8).reshape(candidates.num_rows, planes, -1)


def _pack(planes: int):
    def run(batches):
        for batch in batches:
            sizes = np.diff(batch.column("vector").offsets.to_numpy())
            packed: list = [b""] * batch.num_rows
            flat = batch.column("vector").flatten().to_numpy(zero_copy_only=False)
            ends = np.cumsum(sizes)
            for size in np.unique(sizes):
                mine = np.flatnonzero(sizes == size)
                values = flat[(ends[mine] - size)[:, None] + np.arange(size)]
                for i, row in zip(mine.tolist(), bit_planes(values, planes), strict=True):
                    packed[i] = row.tobytes()
            names = ["row", "id", "label", "size"]
            columns = [batch.column(c) for c in names]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(packed, pa.binary())], [*names, "planes"])

    return run


def _ids(table: pa.Table) -> np.ndarray:
    """Ids for tie-breaking; a row without one comes after all others."""
    return table.column("id").fill_null(np.iinfo(np.int64).max).to_numpy()


def _sorted_labels(labels: np.ndarray):
    order = np.argsort(labels, kind="stable")
    names, cuts = np.unique(labels[order], return_index=True)
    return zip(names.tolist(), np.split(order, cuts[1:]), strict=True)


def _blocks(rows: np.ndarray, size: int):
    return (rows[i : i + size] for i in range(0, len(rows), size))


def _own_label(planes: int, n: int):
    """The best ``n`` candidates of its own label for each anchor of a cell."""

    def run(key, candidates: pa.Table, anchors: pa.Table) -> pa.Table:
        found = [np.zeros((0, 3), dtype=np.int64)]
        if candidates.num_rows and anchors.num_rows:
            packed, values = _planes_of(candidates, planes), _matrix(anchors, "vector", key[2].as_py())
            ids, rows = _ids(candidates), candidates.column("row").to_numpy()
            anchor_rows = anchors.column("row").to_numpy()
            by_label = dict(_sorted_labels(candidates.column("label").to_numpy()))
            for label, mine in _sorted_labels(anchors.column("label").to_numpy()):
                for block in _blocks(mine, _ANCHORS):
                    sums, kind = _kinds(values[block], planes)
                    tables = subset_sums(values[block], sums)
                    held = np.zeros((0, 3), dtype=np.int64)  # anchor in block, candidate, score
                    for part in _blocks(by_label.get(label, mine[:0]), _CANDIDATES):
                        got = scores(packed[part], tables, kind).astype(np.int64)
                        other = rows[part][:, None] != anchor_rows[block]
                        if len(part) > 4 * n:  # only what can be among the first n
                            floor = np.partition(got, len(part) - n - 1, axis=0)[len(part) - n - 1]
                            other &= got >= floor
                        c, a = np.nonzero(other)
                        more = np.column_stack([a, part[c], got[c, a]])
                        held = np.concatenate([held, more])
                        held = held[_best(held[:, 2], ids[held[:, 1]], held[:, 0], n)]
                    found.append(np.column_stack([anchor_rows[block][held[:, 0]], held[:, 1], held[:, 2]]))
        out = np.concatenate(found)
        columns = [pa.array(out[:, 0]), candidates.column("id").combine_chunks().take(pa.array(out[:, 1])), pa.array(out[:, 2])]
        columns.append(pa.array(candidates.column("row").to_numpy()[out[:, 1]]))
        return pa.table(columns, names=["anchor_row", "id", "score", "row"])

    return run


def _other_labels(planes: int, n: int, low: int):
    """The best ``n`` candidates of other labels in the window below each positive's score."""

    def run(key, candidates: pa.Table, anchors: pa.Table) -> pa.Table:
        found = [np.zeros((0, 4), dtype=np.int64)]
        if candidates.num_rows and anchors.num_rows:
            packed, values = _planes_of(candidates, planes), _matrix(anchors, "vector", key[2].as_py())
            ids, labels = _ids(candidates), candidates.column("label").to_numpy()
            anchor_rows = anchors.column("row").to_numpy()
            anchor_labels = anchors.column("label").to_numpy()
            tops = anchors.column("tops").to_pylist()
            for block in _blocks(np.arange(anchors.num_rows), _ANCHORS):
                sums, kind = _kinds(values[block], planes)
                tables = subset_sums(values[block], sums)
                depth = max(len(tops[b]) for b in block)
                top = np.full((depth, len(block)), -1, dtype=np.int64)
                for i, b in enumerate(block):
                    top[: len(tops[b]), i] = tops[b]
                floor = np.where(top >= 0, -((-low * top) // 100), np.iinfo(np.int64).max)
                held = np.zeros((0, 4), dtype=np.int64)  # anchor in block, top, candidate, score
                for part in _blocks(np.arange(candidates.num_rows), _CANDIDATES):
                    got = scores(packed[part], tables, kind)
                    near = (got >= floor.min(axis=0)) & (got <= top.max(axis=0))
                    near &= labels[part][:, None] != anchor_labels[block]
                    c, a = np.nonzero(near)
                    score = got[c, a].astype(np.int64)
                    more = [held]
                    for t in range(depth):
                        inside = (score >= floor[t, a]) & (score <= top[t, a])
                        more.append(
                            np.column_stack([a[inside], np.full(inside.sum(), t), part[c[inside]], score[inside]])
                        )
                    held = np.concatenate(more)
                    held = held[_best(held[:, 3], ids[held[:, 2]], held[:, 0] * depth + held[:, 1], n)]
                found.append(np.column_stack([anchor_rows[block][held[:, 0]], held[:, 1:]]))
        out = np.concatenate(found)
        taken = candidates.column("id").combine_chunks().take(pa.array(out[:, 2]))
        columns = [pa.array(out[:, 0]), pa.array(out[:, 1]), taken, pa.array(out[:, 3])]
        return pa.table(columns, names=["anchor_row", "top", "id", "score"])

    return run


def _grid(candidates: DataFrame, anchors: DataFrame, across: int, down: int):
    """Both tables with the cells (x, y, size) their rows meet in."""
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    own = lambda n, salt: F.pmod(F.xxhash64("row", F.lit(salt)), F.lit(n)).cast("int")
    left = candidates.withColumn("x", own(across, 0)).withColumn("y", every(down))
    right = anchors.withColumn("y", own(down, 1)).withColumn("x", every(across))
    return left.groupBy("x", "y", "size"), right.groupBy("x", "y", "size")


def hard_negatives(
    rows: DataFrame,
    anchor: Column,
    n_positives: int = 5,
    n_negatives: int = 5,
    low: int = 80,
    cell_rows: int = CELL_ROWS,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of ``rows``.

    ``rows`` comes from ``whole_vectors``; ``anchor`` chooses the anchors by id. Scores are
    inner products; higher ones come first, ties by smaller id, rows without an id last. An
    anchor's positives are its first ``n_positives`` other rows of the same label. For each,
    the first ``n_negatives`` rows of another label are returned that score at least ``low``
    per cent of the positive and at most as much. Only vectors of one length are compared.
    Repeated rows are rows of their own: each is a candidate and, if chosen, an anchor. An
    empty table gives no rows. Scores beyond 64 bits raise an error.
    """
    size = F.size("vector").alias("size")
    largest, width, count, chosen = rows.agg(
        F.coalesce(F.max(F.array_max(F.transform("vector", lambda x: F.abs(x)))), F.lit(0)),
        F.coalesce(F.max(F.size("vector")), F.lit(0)),
        F.count("*"),
        F.count_if(F.coalesce(anchor, F.lit(False))),
    ).first()
    if largest >= _LARGEST or largest * largest * max(width, 1) >= 1 << 62:
        raise ValueError("components too large for scores of 64 bits")
    planes = int(largest).bit_length() + 1
    across, down = max(1, -(-count // cell_rows)), max(1, -(-chosen // cell_rows))
    packed = rows.select("row", "id", "label", size, "vector").mapInArrow(
        _pack(planes), "row long, id long, label long, size int, planes binary"
    )
    anchors = rows.where(F.coalesce(anchor, F.lit(False))).select("row", "id", "label", size, "vector")
    left, right = _grid(packed, anchors, across, down)
    near = left.cogroup(right).applyInArrow(
        _own_label(planes, n_positives), "anchor_row long, id long, score long, row long"
    )
    order = [F.desc("score"), F.asc_nulls_last("id"), F.asc("row")]
    ranked = near.withColumn("place", F.row_number().over(Window.partitionBy("anchor_row").orderBy(*order)))
    positives = stored(ranked.where(F.col("place") <= n_positives).drop("row"), "positives")
    # A place is at most n_positives, so these lists are short.
    tops = positives.groupBy("anchor_row").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("place", "score"))), lambda s: s["score"]).alias("tops")
    )
    searched = anchors.join(tops, F.col("row") == F.col("anchor_row")).drop("anchor_row")
    left, right = _grid(packed, searched, across, down)
    below = left.cogroup(right).applyInArrow(
        _other_labels(planes, n_negatives, low), "anchor_row long, top long, id long, score long"
    )
    order = [F.desc("score"), F.asc_nulls_last("id")]
    ranked = below.withColumn("rank", F.row_number().over(Window.partitionBy("anchor_row", "top").orderBy(*order)))
    ranked = ranked.where(F.col("rank") <= n_negatives).select(
        "anchor_row", (F.col("top") + 1).cast("int").alias("place"), "rank",
        F.col("id").alias("negative_id"), F.col("score").alias("negative_score"),
    )
    named = positives.join(anchors.select(F.col("row").alias("anchor_row"), F.col("id").alias("anchor_id")), "anchor_row")
    return named.join(ranked, ["anchor_row", "place"]).select(
        "anchor_id", F.col("id").alias("positive_id"), "rank", "negative_id",
        F.col("score").alias("positive_score"), "negative_score",
    )
