"""Repeated byte strings: suffixes ordered by radix passes, through a fixed depth only.

Every position with ``length`` bytes left is a suffix, cut off at ``length``. Suffixes are
ordered by digits of eight bytes, most significant first; one that is alone in its group after
some pass is dropped, and groups still together at the full depth are the repeated strings.
To order them on many machines, the suffixes are dealt first, so that equal ones meet:

1. The least fingerprint of the ``length // 2``-byte grams inside a string is its key. Equal
   strings have equal keys, and neighbouring suffixes mostly share one, so a text falls into
   pieces of some fifty suffixes. A chunk of documents sends its different keys once each,
   packed by bucket, and learns which keys occur elsewhere. The other suffixes are unique.
2. The chunk sends each different piece with a repeated key once. A bucket orders the
   suffixes of its pieces by the radix passes, on their real bytes, and answers one bit a
   suffix. A key with more than ``HOT`` pieces is too large a group for one task: its suffixes
   go on alone, under one digit as wide as their whole depth (a fingerprint of all bytes).
3. The chunk marks the bytes under repeated suffixes and cuts them.

Only fingerprints of 64 bits stand for bytes anywhere: a piece of a chunk, within its key's
group, and a suffix of a hot key, within its bucket.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from answerloom.llm.common import id_and_text

LENGTH = 200
CHUNK_BYTES = 8 << 20
#: Texts of so many bytes in all share one bucket of keys, and one bucket of pieces.
KEY_BUCKET_BYTES = 64 << 20
PIECE_BUCKET_BYTES = 16 << 20
#: Different pieces of one key that one task may order.
HOT = 4096
_BLOCK = 1 << 16
_PIECE = 128
_BASE = 0x9E3779B97F4A7C15
_BYTES = np.random.default_rng(11).integers(0, 1 << 64, 256, dtype=np.uint64)
_UNIQUE, _REPEATED, _TOO_MANY = 0, 1, 2


def _joined(left: np.ndarray, right: np.ndarray, n_left: int, n_right: int) -> np.ndarray:
    """Fingerprints of strings of n_left + n_right bytes from those of their two parts."""
    right = right[n_left:]
    return left[: len(right)] * np.uint64(pow(_BASE, n_right, 1 << 64)) + right


def _rolled(data: np.ndarray, n: int) -> np.ndarray:
    """Fingerprint of the ``n`` bytes from each position on."""
    power, size, out, done = _BYTES[data], 1, None, 0
    while True:
        if n & size:
            out = power if out is None else _joined(out, power, done, size)
            done += size
        if size * 2 > n:
            return out
        power = _joined(power, power, size, size)
        size *= 2


def _extreme(values: np.ndarray, width: int, pick) -> np.ndarray:
    """Least or greatest of each ``width`` neighbouring values."""
    size = 1
    while size * 2 <= width:
        values = pick(values[:-size], values[size:])
        size *= 2
    rest = width - size
    return pick(values[:-rest], values[rest:]) if rest else values


def _mixed(value: np.ndarray) -> np.ndarray:
    value = (value ^ (value >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return value ^ (value >> np.uint64(29))


def _expanded(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """start, start + 1, … of every start, one after the other."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)


class _Chunk:
    """Pieces of the documents of one chunk; the same ones each time it is built."""

    def __init__(self, texts: list[bytes], length: int):
        self.length = length
        sizes = np.array([len(t) for t in texts], dtype=np.int64)
        self.bounds = np.concatenate([[0], np.cumsum(sizes)])
        self.buffer = b"".join(texts)
        self.data = np.frombuffer(self.buffer, dtype=np.uint8)
        edge = np.zeros(len(self.data) + 1, dtype=np.int8)
        whole = sizes >= length
        edge[self.bounds[:-1][whole]] += 1
        edge[self.bounds[1:][whole] - (length - 1)] -= 1
        self.valid = np.cumsum(edge, dtype=np.int8)[:-1].astype(bool)
        found = [self._block(at) for at in range(0, len(self.data), _BLOCK)]
        kinds = (np.int64, np.int64, np.uint64, np.uint64, np.uint64)
        self.start, self.size, self.key, self.digest, chosen = (
            np.concatenate([np.zeros(0, kind), *(f[i] for f in found if f)]).astype(kind, copy=False)
            for i, kind in enumerate(kinds)
        )
        # Different pieces by key; every piece knows which of them it is.
        order = np.lexsort((self.digest, self.key))
        key, digest = self.key[order], self.digest[order]
        new = np.ones(len(order), dtype=bool)
        new[1:] = (key[1:] != key[:-1]) | (digest[1:] != digest[:-1])
        self.entry = np.empty(len(order), dtype=np.int64)
        self.entry[order] = np.cumsum(new) - 1
        self.first = order[new]  # one piece of each kind
        self.copies = np.bincount(self.entry, minlength=len(self.first))
        self.keys, self.n_pieces = np.unique(self.key[self.first], return_counts=True)
        self.key_of = np.searchsorted(self.keys, self.key[self.first])
        chosen, times = np.unique(chosen, return_counts=True)
        self.times = np.zeros(len(self.keys), dtype=np.int64)
        held = np.searchsorted(self.keys, chosen)
        self.times[held] = times

    def _block(self, at: int):
        length, gram = self.length, max(1, self.length // 2)
        valid = self.valid[at : at + _BLOCK]
        if not valid.any():
            return None
        data = self.data[at : at + _BLOCK + length - 1]
        grams = _rolled(data, gram)
        key = _extreme(grams, length - gram + 1, np.minimum)
        valid = valid[: len(key)]
        whole = _joined(grams, grams, gram, gram)
        if length > 2 * gram:
            whole = _joined(whole, _BYTES[data], 2 * gram, 1)
        turn = np.empty(len(key), dtype=bool)
        turn[0] = True
        turn[1:] = (key[1:] != key[:-1]) | (valid[1:] != valid[:-1])
        turns = np.flatnonzero(turn)
        sizes = np.diff(turns, append=len(key))
        mine = valid[turns]
        start, size = turns[mine], sizes[mine]
        most = min(_PIECE, length)
        if len(size) and size.max() > most:
            parts = -(-size // most)
            place = _expanded(np.zeros(len(size), np.int64), parts) * most
            start = np.repeat(start, parts) + place
            size = np.minimum(np.repeat(size, parts) - place, most)
        # First and last string cover all bytes of a piece.
        digest = _mixed(_mixed(whole[start]) + _mixed(whole[start + size - 1] ^ np.uint64(0x5DEECE66D)))
        digest ^= _mixed(size.astype(np.uint64))
        # Positions whose gram is the least of a string that covers it.
        width = length - gram
        padded = np.zeros(len(key) + 2 * width, dtype=np.uint64)
        padded[width : width + len(key)] = np.where(valid, key, 0)
        chosen = grams[_extreme(padded, width + 1, np.maximum) == grams]
        return start + at, size, key[start], digest, chosen[chosen > 0]

    def suffixes(self, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions of all suffixes of the pieces that ``entries`` (a mask) chooses, and the pieces."""
        pieces = np.flatnonzero(entries[self.entry])
        return _expanded(self.start[pieces], self.size[pieces]), pieces

    def fingerprints(self, at: np.ndarray) -> np.ndarray:
        """Whole-depth fingerprints at ascending or unordered positions ``at``."""
        out = np.empty(len(at), dtype=np.uint64)
        for b, mine in _groups(at // _BLOCK):
            values = _rolled(self.data[b * _BLOCK : (b + 1) * _BLOCK + self.length - 1], self.length)
            out[mine] = values[at[mine] - b * _BLOCK]
        return out


def _groups(bucket: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each bucket and the places that are in it."""
    if not len(bucket):
        return iter(())
    order = np.argsort(bucket, kind="stable")
    names, cuts = np.unique(bucket[order], return_index=True)
    return zip(names.tolist(), np.split(order, cuts[1:]), strict=True)


def _dealt(value: np.ndarray, buckets: int) -> np.ndarray:
    return ((_mixed(value) >> np.uint64(20)) % np.uint64(buckets)).astype(np.int64)


def _ordered(table: pa.Table) -> tuple[pa.Table, list[bytes]]:
    """The rows by text, and their texts: rows arrive in any order, pieces must not depend on it."""
    texts = [t or b"" for t in table.column("text").cast(pa.binary()).to_pylist()]
    order = sorted(range(len(texts)), key=texts.__getitem__)
    return table.take(pa.array(order, pa.int64())), [texts[i] for i in order]


def _table(kinds: dict[str, pa.DataType], rows: list[tuple]) -> pa.Table:
    columns = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds.values())]
    return pa.table(columns, names=list(kinds))


def _send_keys(length: int, buckets: int):
    kinds = {"bucket": pa.int64(), "chunk": pa.int64(), "keys": pa.binary(), "counts": pa.binary()}

    def send(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        chunk = _Chunk(_ordered(table)[1], length)
        count = np.minimum(chunk.n_pieces, 32767) * 2 + (chunk.times > 1)
        rows = [
            (b, key[0].as_py(), chunk.keys[mine].tobytes(), count[mine].astype("<u2").tobytes())
            for b, mine in _groups(_dealt(chunk.keys, buckets))
        ]
        return _table(kinds, rows)

    return send


def _judge_keys(hot: int):
    kinds = {"chunk": pa.int64(), "kind": pa.int64(), "bucket": pa.int64(), "bits": pa.binary(), "more": pa.binary()}

    def judge(table: pa.Table) -> pa.Table:
        keys = [np.frombuffer(k, np.uint64) for k in table.column("keys").to_pylist()]
        counts = np.concatenate([np.frombuffer(c, "<u2") for c in table.column("counts").to_pylist()]).astype(np.int64)
        _, entry = np.unique(np.concatenate(keys), return_inverse=True)
        chunks = np.bincount(entry)
        pieces = np.bincount(entry, counts >> 1)
        inside = np.bincount(entry, counts & 1)
        verdict = np.where(pieces > hot, _TOO_MANY, _REPEATED)
        verdict = np.where((chunks > 1) | (inside > 0), verdict, _UNIQUE).astype(np.uint8)[entry]
        parts = np.split(verdict, np.cumsum([len(k) for k in keys])[:-1])
        places = zip(table.column("chunk").to_pylist(), table.column("bucket").to_pylist(), parts, strict=True)
        return _table(kinds, [(c, 0, b, p.tobytes(), None) for c, b, p in places if p.any()])

    return judge


def _verdicts(chunk: _Chunk, answers: pa.Table, buckets: int) -> np.ndarray:
    """What the buckets said of each key of the chunk."""
    verdict = np.zeros(len(chunk.keys), dtype=np.uint8)
    said = dict(zip(answers.column("bucket").to_pylist(), answers.column("bits").to_pylist(), strict=True))
    for b, mine in _groups(_dealt(chunk.keys, buckets)):
        if b in said:
            verdict[mine] = np.frombuffer(said[b], np.uint8)
    return verdict[chunk.key_of]


def _hot_suffixes(chunk: _Chunk, verdict: np.ndarray):
    at, _ = chunk.suffixes(verdict == _TOO_MANY)
    values, entry, times = np.unique(chunk.fingerprints(at), return_inverse=True, return_counts=True)
    return at, values, entry, times


_PIECES = {
    "bucket": pa.int64(), "chunk": pa.int64(), "keys": pa.binary(), "digests": pa.binary(), "sizes": pa.binary(),
    "twice": pa.binary(), "bytes": pa.binary(), "alone": pa.binary(), "alone_twice": pa.binary(),
}


def _send_pieces(length: int, buckets: int, piece_buckets: int):
    def send(key: tuple[pa.Scalar, ...], docs: pa.Table, answers: pa.Table) -> pa.Table:
        if not answers.num_rows:
            return _table(_PIECES, [])
        chunk = _Chunk(_ordered(docs)[1], length)
        verdict = _verdicts(chunk, answers, buckets)
        rows = {}
        mine = np.flatnonzero(verdict == _REPEATED)
        for b, part in _groups(_dealt(chunk.key[chunk.first[mine]], piece_buckets)):
            entries = mine[part]
            pieces = chunk.first[entries]
            sizes = chunk.size[pieces]
            stop = (chunk.start[pieces] + sizes + length - 1).tolist()
            data = b"".join([chunk.buffer[a:z] for a, z in zip(chunk.start[pieces].tolist(), stop, strict=True)])
            twice = (chunk.copies[entries] > 1).astype(np.uint8)
            rows[b] = [x.tobytes() for x in (chunk.key[pieces], chunk.digest[pieces], sizes.astype("<u2"), twice)] + [data]
        _, values, _, times = _hot_suffixes(chunk, verdict)
        for b, part in _groups(_dealt(values, piece_buckets)):
            rows.setdefault(b, [b""] * 5)
            rows[b] += [values[part].tobytes(), (times[part] > 1).astype(np.uint8).tobytes()]
        empty = [b"", b""]
        return _table(_PIECES, [(b, key[0].as_py(), *(r if len(r) == 7 else r + empty)) for b, r in rows.items()])

    return send


def radix_repeats(data: np.ndarray, at: np.ndarray, group: np.ndarray, weight: np.ndarray, depth: int) -> np.ndarray:
    """Whether each suffix ``data[at : at + depth]`` has an equal one in its group.

    ``weight`` counts how often a suffix stands for itself. Digits of eight bytes are taken
    most significant first; suffixes that are alone in their group leave after each pass.
    """
    repeated = weight > 1
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    digits = np.ndarray(len(padded) - 7, dtype=">u8", buffer=padded, strides=(1,))
    left = np.arange(len(at))
    if len(left):
        left = left[np.argsort(group, kind="stable")]
        new = np.ones(len(left), dtype=bool)
        new[1:] = group[left][1:] != group[left][:-1]
        left, name = _together(left, new)
    for place in range(0, depth, 8):
        if not len(left):
            return repeated
        digit = digits[at[left] + place].astype(np.uint64)
        if depth - place < 8:  # the last digit ends with the depth
            digit >>= np.uint64(8 * (8 - (depth - place)))
        order = np.lexsort((digit, name))
        left, name, digit = left[order], name[order], digit[order]
        new = np.ones(len(left), dtype=bool)
        new[1:] = (name[1:] != name[:-1]) | (digit[1:] != digit[:-1])
        left, name = _together(left, new)
    repeated[left] = True
    return repeated


def _together(left: np.ndarray, new: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ordered suffixes that are not alone, and the number of each one's group."""
    name = np.cumsum(new) - 1
    several = np.bincount(name)[name] > 1
    return left[several], name[several]


def _order_pieces(length: int):
    kinds = {"chunk": pa.int64(), "kind": pa.int64(), "bucket": pa.int64(), "bits": pa.binary(), "more": pa.binary()}

    def read(table: pa.Table, name: str, kind) -> list[np.ndarray]:
        return [np.frombuffer(x, kind) for x in table.column(name).to_pylist()]

    def order(table: pa.Table) -> pa.Table:
        keys, values = read(table, "keys", np.uint64), read(table, "alone", np.uint64)
        key, digest = np.concatenate(keys), np.concatenate(read(table, "digests", np.uint64))
        size = np.concatenate(read(table, "sizes", "<u2")).astype(np.int64)
        twice = np.concatenate(read(table, "twice", np.uint8)).astype(np.int64)
        data = np.concatenate(read(table, "bytes", np.uint8))
        span = size + length - 1
        start = np.cumsum(span) - span
        # Equal pieces of several chunks are one, which counts as often.
        place = np.lexsort((digest, key))
        new = np.ones(len(place), dtype=bool)
        new[1:] = (key[place][1:] != key[place][:-1]) | (digest[place][1:] != digest[place][:-1])
        entry = np.empty(len(place), dtype=np.int64)
        entry[place] = np.cumsum(new) - 1
        first = place[new]
        weight = np.bincount(entry, 1 + twice, minlength=len(first)).astype(np.int64)
        at = _expanded(start[first], size[first])
        owner = np.repeat(np.arange(len(first)), size[first])
        same = radix_repeats(data, at, key[first][owner], weight[owner], length)
        flags = np.zeros((len(first), _PIECE), dtype=bool)
        flags[owner, _expanded(np.zeros(len(first), np.int64), size[first])] = same
        bits = np.packbits(flags, axis=1)[entry]
        value = np.concatenate(values)
        alone_twice = np.concatenate(read(table, "alone_twice", np.uint8)).astype(np.int64)
        _, which = np.unique(value, return_inverse=True)
        often = np.bincount(which, 1 + alone_twice)[which] > 1 if len(value) else np.zeros(0, bool)
        piece_cuts = np.cumsum([len(k) for k in keys])[:-1]
        value_cuts = np.cumsum([len(v) for v in values])[:-1]
        rows = zip(
            table.column("chunk").to_pylist(), table.column("bucket").to_pylist(),
            np.split(bits, piece_cuts), np.split(often, value_cuts), strict=True,
        )
        return _table(kinds, [(c, 1, b, p.tobytes(), np.packbits(o).tobytes()) for c, b, p, o in rows])

    return order


def _cut(length: int, buckets: int, piece_buckets: int):
    def repeated(chunk: _Chunk, answers: pa.Table) -> np.ndarray:
        """Mask of the positions whose suffix is repeated."""
        kind = answers.column("kind").to_numpy()
        verdict = _verdicts(chunk, answers.filter(pa.array(kind == 0)), buckets)
        said = answers.filter(pa.array(kind == 1))
        bits, more = (
            dict(zip(said.column("bucket").to_pylist(), said.column(c).to_pylist(), strict=True)) for c in ("bits", "more")
        )
        flags = np.zeros((len(chunk.first), _PIECE // 8), dtype=np.uint8)
        mine = np.flatnonzero(verdict == _REPEATED)
        for b, part in _groups(_dealt(chunk.key[chunk.first[mine]], piece_buckets)):
            flags[mine[part]] = np.frombuffer(bits[b], np.uint8).reshape(len(part), -1)
        marked = np.zeros(len(chunk.data) + 1, dtype=bool)
        at, pieces = chunk.suffixes(flags.any(axis=1))
        inside = _expanded(np.zeros(len(pieces), np.int64), chunk.size[pieces])
        row = np.repeat(chunk.entry[pieces], chunk.size[pieces])
        marked[at] = (flags[row, inside >> 3] >> (7 - (inside & 7)).astype(np.uint8)) & 1
        at, values, entry, _ = _hot_suffixes(chunk, verdict)
        often = np.zeros(len(values), dtype=bool)
        for b, part in _groups(_dealt(values, piece_buckets)):
            often[part] = np.unpackbits(np.frombuffer(more[b], np.uint8), count=len(part)).astype(bool)
        marked[at] = often[entry]
        return marked

    def cut(key: tuple[pa.Scalar, ...], docs: pa.Table, answers: pa.Table) -> pa.Table:
        docs, texts = _ordered(docs)
        removed: list[list] = [[] for _ in texts]
        kept = list(texts)
        if answers.num_rows:
            chunk = _Chunk(texts, length)
            starts = np.flatnonzero(repeated(chunk, answers))
            # Neighbouring strings that touch or overlap are one span; none crosses a document.
            new = np.ones(len(starts), dtype=bool)
            owner = np.searchsorted(chunk.bounds, starts, side="right") - 1
            new[1:] = (np.diff(starts) > length) | (owner[1:] != owner[:-1])
            first = starts[new]
            stop = starts[np.flatnonzero(np.append(new, True))[1:] - 1] + length if len(starts) else starts
            doc = owner[new]
            for d, group in _groups(doc):
                base = int(chunk.bounds[d])
                spans = [(int(first[g]) - base, int(stop[g]) - base) for g in np.sort(group)]
                removed[d] = [{"first": a, "stop": z} for a, z in spans]
                ends = [0, *(z for _, z in spans)]
                begins = [*(a for a, _ in spans), len(kept[d])]
                kept[d] = b"".join(kept[d][a:z] for a, z in zip(ends, begins, strict=True))
        kinds = pa.list_(pa.struct([("first", pa.int64()), ("stop", pa.int64())]))
        sizes = pa.array([len(t) for t in texts], pa.int64())
        columns = [docs.column("doc_id"), sizes, pa.array(removed, kinds), pa.array(kept, pa.binary())]
        return pa.table(columns, names=["doc_id", "n_bytes", "removed", "kept"])

    return cut


def remove_repeated_strings(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, hot: int = HOT
) -> DataFrame:
    """(doc_id, n_bytes, removed, kept) for every row of ``docs``.

    ``removed`` lists the maximal runs [first, stop) of bytes that lie in a string of
    ``length`` UTF-8 bytes which also starts anywhere else, in the same row or another one;
    strings never cross rows. ``kept`` is the other bytes, which need not be valid UTF-8.
    Strings are judged on the input: of two equal texts, both lose all. Repeated rows are
    copies like any other, ids play no part and may be null. Null, empty and short texts lose
    nothing; texts of any length are read whole. Other columns are not looked at, whatever
    their names. An empty table gives no rows. ``hot`` bounds the pieces of one key that one
    task orders; it changes the plan, never the rows.
    """
    if length < 2:
        raise ValueError("length must be two bytes or more")
    rows = id_and_text(docs, id_col, text_col)
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)), F.count("*")).first()
    chunks = max(1, -(-size[0] // CHUNK_BYTES), -(-size[1] // 10_000))
    buckets = max(1, -(-size[0] // KEY_BUCKET_BYTES))
    piece_buckets = max(1, -(-size[0] // PIECE_BUCKET_BYTES))
    # Dealt by row, not by content: copies of one text, and of one row, go to many chunks.
    mark = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(chunks)).alias("chunk")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # One exchange of the texts serves all three steps.
    dealt = rows.select("doc_id", "text", mark).repartition(parts, "chunk")
    keys = dealt.groupBy("chunk").applyInArrow(
        _send_keys(length, buckets), "bucket long, chunk long, keys binary, counts binary"
    )
    answer = "chunk long, kind long, bucket long, bits binary, more binary"
    verdicts = keys.groupBy("bucket").applyInArrow(_judge_keys(hot), answer)
    pieces = dealt.groupBy("chunk").cogroup(verdicts.groupBy("chunk")).applyInArrow(
        _send_pieces(length, buckets, piece_buckets),
        "bucket long, chunk long, keys binary, digests binary, sizes binary, twice binary, bytes binary, "
        "alone binary, alone_twice binary",
    )
    said = pieces.groupBy("bucket").applyInArrow(_order_pieces(length), answer)
    answers = verdicts.unionAll(said)
    kind = dict(rows.dtypes)["doc_id"]
    return dealt.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(
        _cut(length, buckets, piece_buckets),
        f"doc_id {kind}, n_bytes long, removed array<struct<first:long,stop:long>>, kept binary",
    )
