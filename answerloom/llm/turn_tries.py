"""Prefix tries of conversations: double arrays per prefix shard, shared nodes merged.

A node is a sequence of turns that some conversation starts with. It is named by the xor of
two 64-bit fingerprints of its turns, each salted with its place, so that names are running
aggregates and a conversation of any length is cut into pieces of ``PIECE`` turns. Pieces are
dealt to shards by their first ``SHARED`` turns; the pieces behind a start that very many
share are dealt on by conversation.

A shard numbers its different turns densely and packs its trie into two arrays: the child of
state ``s`` by turn ``c`` is ``BASE[s] + c`` if ``CHECK`` there is ``s``. Every piece walks the
arrays, one step a turn, and its figures are added at the states it passes. Upper nodes occur
in several shards; the shards' figures of a node are merged in Spark.

Two walks give all figures as sums over members. The first counts members and finds the
smallest, which owns the node: the nodes that a conversation owns are the end of its path.
A conversation then adds, at each of its nodes, one child where it owns the next node, one
leaf where it owns a leaf, and the words of the turns from here to its first own node, which
are the ones that an earlier conversation holds already.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from answerloom.llm.common import bounded_batches, stored
from answerloom.plans.skew import group_positions, running

#: Turns of one piece of a conversation.
PIECE = 512
#: Leading turns that decide a piece's shard.
SHARED = 4
#: Turns a shard holds, about; a common start of more is dealt by conversation.
SHARD_TURNS = 100_000
#: Ids in one piece of a long list that is hashed.
LISTED = 4096
_TRIES = 32
WORD = r"[^\x20\x09-\x0D]+"
_NODE = ["p1", "p2", "depth"]


class DoubleArray:
    """BASE and CHECK over edges (parent node, code, child node); node 0 is the root, codes are positive."""

    def __init__(self, parent: np.ndarray, code: np.ndarray, child: np.ndarray):
        order = np.lexsort((code, parent))
        parent, code, child = parent[order], code[order], child[order]
        nodes, first, fan = np.unique(parent, return_index=True, return_counts=True)
        n = len(child) + 1
        slot = np.zeros(n, dtype=np.int64)
        offset = np.zeros(n, dtype=np.int64)
        taken = np.zeros(2 * n + int(code.max(initial=0)) + 1, dtype=bool)
        taken[0] = True  # the root's own
        end, free = 1, 1
        # Wide nodes first, while there is room; the many nodes of one child fill all gaps.
        for i in np.argsort(-fan, kind="stable")[: int((fan > 1).sum())].tolist():
            codes = code[first[i] : first[i] + fan[i]]
            if end + codes[-1] - codes[0] + 1 > len(taken):
                taken = np.concatenate([taken, np.zeros(len(taken) + codes[-1], dtype=bool)])
            while taken[free]:
                free += 1
            gaps = free + np.flatnonzero(~taken[free : free + 4 * _TRIES])[:_TRIES]
            spread = codes - codes[0]
            fits = (int(g) for g in gaps if g + spread[-1] < len(taken) and not taken[g + spread].any())
            place = next(fits, end)
            taken[place + spread] = True
            end = max(end, place + int(spread[-1]) + 1)
            offset[nodes[i]] = place - codes[0]
            slot[child[first[i] : first[i] + fan[i]]] = place + spread
        single = np.flatnonzero(fan == 1)
        if len(single):
            gaps = np.flatnonzero(~taken)
            if len(gaps) < len(single):
                gaps = np.concatenate([gaps, np.arange(len(taken), len(taken) + len(single))])
            gaps = gaps[: len(single)]
            offset[nodes[single]] = gaps - code[first[single]]
            slot[child[first[single]]] = gaps
            end = max(end, int(gaps[-1]) + 1)
        self.base = np.zeros(end, dtype=np.int64)
        self.check = np.full(end, -1, dtype=np.int64)
        self.base[slot[nodes]] = offset[nodes]
        self.check[slot[child]] = slot[parent]

    def step(self, state: np.ndarray, code: np.ndarray) -> np.ndarray:
        """The states reached from ``state`` by ``code``; -1 where there is no such edge."""
        to = self.base[state] + code
        inside = (state >= 0) & (to > 0) & (to < len(self.check))
        to = np.where(inside, to, 0)
        return np.where(inside & (self.check[to] == state), to, -1)


def _numbered(*columns: np.ndarray) -> np.ndarray:
    """Dense numbers from 0 for the different rows of ``columns``."""
    order = np.lexsort(columns)
    new = np.zeros(len(order), dtype=np.int64)
    for c in columns:
        new[1:] |= c[order][1:] != c[order][:-1]
    out = np.empty(len(order), dtype=np.int64)
    out[order] = np.cumsum(new)
    return out


def _walked(table: pa.Table) -> np.ndarray:
    """The state that each row (a turn of a piece, in order of piece and depth) ends in."""
    get = lambda name: table.column(name).to_numpy()
    piece, depth = _numbered(get("conv"), get("piece")), get("depth")
    order = np.lexsort((depth, piece))
    start = np.flatnonzero(np.diff(piece[order], prepend=-1))
    length = np.diff(start, append=len(order))
    # Codes: turns, then the nodes where pieces start. The root is such a node and has a row.
    turn = _numbered(get("t1"), get("t2")) + 1
    above = [get("p1") ^ get("s1"), get("p2") ^ get("s2")]
    head = order[start]
    root = depth[head] == 0
    starts = _numbered(np.where(root, 0, above[0][head]), np.where(root, 0, above[1][head]), get("piece")[head])
    node = _numbered(get("p1"), get("p2"), depth) + 1
    started = node.max(initial=0) + 1 + starts
    top = np.where(root, node[head], started)
    code = turn.max(initial=0) + 1 + starts
    # Edges: from the trie's root to each piece's start, and from each row's node to the next.
    before = np.empty(len(order), dtype=np.int64)
    before[1:] = node[order][:-1]
    before[start] = np.where(root, 0, started)
    keep = np.ones(len(order), dtype=bool)
    keep[start[root]] = False
    edges = np.column_stack([before[keep], turn[order][keep], node[order][keep]])
    edges = np.concatenate([edges, np.column_stack([np.zeros(len(top), np.int64), code, top])])
    edges = np.unique(edges, axis=0)
    edges[:, [0, 2]] = _dense(edges[:, [0, 2]])
    trie = DoubleArray(edges[:, 0], edges[:, 1], edges[:, 2])
    state = np.empty(len(order), dtype=np.int64)
    by_length = np.argsort(-length, kind="stable")
    at, left, skip = start[by_length], length[by_length], root[by_length]
    now = trie.step(np.zeros(len(at), np.int64), code[by_length])
    for level in range(int(left.max(initial=0))):
        active = int(np.searchsorted(-left, -level, side="left"))
        rows = order[at[:active] + level]
        now = now[:active]
        stepped = trie.step(now, turn[rows])
        now = np.where(skip[:active], now, stepped) if level == 0 else stepped
        state[rows] = now
    if (state < 0).any():
        raise RuntimeError("a turn is missing from its shard's trie")
    return state


def _dense(values: np.ndarray) -> np.ndarray:
    """The same nodes numbered without gaps; 0 stays 0."""
    names = np.unique(np.concatenate([[0], values.ravel()]))
    return np.searchsorted(names, values)


def _shard_figures(kinds: dict[str, str], sums: list[str]):
    def figures(table: pa.Table) -> pa.Table:
        names, first, entry = np.unique(_walked(table), return_index=True, return_inverse=True)
        out = {}
        for name in kinds:
            values = table.column(name if name != "low" else "conv").to_numpy()
            if name in sums:
                out[name] = np.zeros(len(names), dtype=np.int64)
                np.add.at(out[name], entry, values)
            elif name == "low":
                out[name] = np.full(len(names), np.iinfo(np.int64).max)
                np.minimum.at(out[name], entry, values)
            else:
                out[name] = values[first]
        return pa.table({k: pa.array(v, pa.int64()) for k, v in out.items()})

    return figures


def _walk(walks: DataFrame, same: list[str], sums: list[str], smallest: bool) -> DataFrame:
    """Figures of every node: ``same`` columns, sums over members, and the smallest member."""
    kinds = {c: "long" for c in [*_NODE, *same, *sums, *(["low"] if smallest else [])]}
    schema = ", ".join(f"{c} {k}" for c, k in kinds.items())
    needed = ["shard", "conv", "piece", *_NODE, "t1", "t2", "s1", "s2", *same, *sums]
    part = walks.select(*dict.fromkeys(needed)).groupBy("shard").applyInArrow(_shard_figures(kinds, sums), schema)
    merged = [*(F.min(c).alias(c) for c in same), *(F.sum(c).alias(c) for c in sums)]
    if smallest:
        merged.append(F.min("low").alias("low"))
    return part.groupBy(*_NODE).agg(*merged)


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ids of one node, in order, joined in lists of bounded size."""
    names = [*_NODE, "first", "ids"]
    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in (*_NODE, "conv")]
        rows, node = [], None
        for *key, conv in zip(*columns, strict=True):
            if key != node or len(rows[-1][4]) >= LISTED:
                node = key
                rows.append([*key, conv, []])
            rows[-1][4].append(str(conv))
        kinds = [pa.int64()] * 4 + [pa.string()]
        values = [[*r[:4], ",".join(r[4])] for r in rows]
        yield pa.RecordBatch.from_arrays([pa.array([v[i] for v in values], k) for i, k in enumerate(kinds)], names)


def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each node's lists, which arrive in order; one hash is open at a time."""
    node, digest = None, None
    names = [*_NODE, "ends_sha256"]
    pack = lambda rows: pa.RecordBatch.from_arrays(
        [pa.array([r[i] for r in rows], pa.int64() if i < 3 else pa.string()) for i in range(4)], names
    )
    for batch in batches:
        rows = []
        for *key, ids in zip(*(batch.column(c).to_pylist() for c in (*_NODE, "ids")), strict=True):
            if key == node:
                digest.update(b",")
            else:
                if node is not None:
                    rows.append((*node, digest.hexdigest()))
                node, digest = key, hashlib.sha256()
            digest.update(ids.encode())
        yield pack(rows)
    if node is not None:
        yield pack([(*node, digest.hexdigest())])


def _end_digests(ends: DataFrame) -> DataFrame:
    """(node, ends_sha256): ids are listed in many tasks; only the lists of a node meet in one."""
    key = ", ".join(f"{c} long" for c in _NODE)
    ranged = ends.repartitionByRange(*_NODE, "conv").sortWithinPartitions(*_NODE, "conv")
    lists = ranged.mapInArrow(_listed, f"{key}, first long, ids string")
    met = lists.repartition(*_NODE).sortWithinPartitions(*_NODE, "first")
    return met.mapInArrow(_digested, f"{key}, ends_sha256 string")


def ordered_turns(
    turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text"
) -> DataFrame:
    """(conv, pos, t1, t2, words): turns as fingerprints, numbered from 0 in each conversation.

    Null turn numbers come first; equal ones are ordered by fingerprint. A null role or text
    is an empty one. Rows without a conversation id belong to none and are left out.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    rows = turns.where(F.col(conv_col).isNotNull()).select(
        F.col(conv_col).cast("long").alias("conv"),
        F.col(turn_col).alias("turn"),
        F.xxhash64(F.lit(1), role, text).alias("t1"),
        F.xxhash64(F.lit("turn"), text, role).alias("t2"),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("words"),
    )
    return group_positions(rows, ["conv"], [F.asc_nulls_first("turn"), F.asc("t1"), F.asc("t2")]).drop("turn")


def rebuilt_turns(ordered: DataFrame, block: int = 20) -> DataFrame:
    """(conv, depth, length, t1, t2, words) after every conversation took its block's start.

    Conversation c starts with the first h turns of c - c % block, h = crc32(c) % 4, followed
    by its own turns after its first h. Depth 0 is the root, a row of every conversation.
    """
    ordered = stored(ordered, "turns")
    head = F.pmod(F.crc32(F.col("conv").cast("string").cast("binary")), F.lit(4))
    sizes = ordered.groupBy("conv").agg(F.count("*").alias("n"))
    own = sizes.select("conv", "n", head.alias("h"), (F.col("conv") - F.col("conv") % block).alias("source"))
    given = sizes.select(F.col("conv").alias("source"), F.col("n").alias("held"))
    joined = own.join(given, "source", "left")
    taken = F.least("h", F.coalesce("held", F.lit(0))).alias("taken")
    convs = joined.select("conv", "source", "h", taken, F.greatest(F.col("n") - F.col("h"), F.lit(0)).alias("rest"))
    convs = convs.withColumn("length", F.col("taken") + F.col("rest"))
    columns = ["conv", "depth", "length", "t1", "t2", "words"]
    root = convs.select("conv", "length").withColumns({c: F.lit(0).cast("long") for c in ("depth", "t1", "t2", "words")})
    heads = ordered.where("pos < 3").withColumnRenamed("conv", "source")
    front = convs.join(heads, "source").where("pos < h").withColumn("depth", F.col("pos") + 1)
    tail = ordered.join(convs, "conv").where("pos >= h").withColumn("depth", F.col("taken") + F.col("pos") - F.col("h") + 1)
    return root.select(*columns).unionAll(front.select(*columns)).unionAll(tail.select(*columns))


def _with_shards(rows: DataFrame, piece: int, shard_turns: int) -> DataFrame:
    """Node names, words so far, pieces and shards of all rows of all conversations."""
    salted = rows.withColumns({
        "s1": F.when(F.col("depth") == 0, F.lit(0).cast("long")).otherwise(F.xxhash64("depth", "t1", "t2")),
        "s2": F.when(F.col("depth") == 0, F.lit(0).cast("long")).otherwise(F.xxhash64("t2", F.lit("at"), "t1", "depth")),
    })
    outputs = {"p1": ("xor", F.col("s1")), "p2": ("xor", F.col("s2")), "so_far": ("sum", F.col("words"))}
    named = running(salted, ["conv"], "depth", outputs, segment_rows=piece)
    before = F.greatest(F.col("depth") - 1, F.lit(0))
    named = named.withColumn("piece", F.floor(before / F.lit(piece)).cast("long"))
    local = F.col("depth") - F.col("piece") * piece
    leading = F.max_by("p1", F.when(local <= SHARED, F.col("depth")))
    named = named.withColumn("start", leading.over(W.partitionBy("conv", "piece")))
    named = stored(named, "paths")
    crowded = named.groupBy("start").agg(F.count("*").alias("held")).where(F.col("held") > shard_turns)
    parts = F.ceil(F.col("held") / F.lit(shard_turns))
    salt = F.coalesce(F.pmod(F.xxhash64("conv"), parts), F.lit(0))
    shards = max(1, -(-named.count() // shard_turns))
    shard = F.pmod(F.xxhash64("start", salt), F.lit(shards)).alias("shard")
    return named.join(crowded, "start", "left").select("*", shard).drop("start", "held")


def prefix_nodes(rebuilt: DataFrame, piece: int = PIECE, shard_turns: int = SHARD_TURNS) -> DataFrame:
    """One row for every different start of the conversations in ``rebuilt``.

    (conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256):
    a node is named by its smallest member and its depth. Conversations without turns are
    members of the root. Repeated conversations are members of the same nodes. An empty table
    gives no rows. ``piece`` and ``shard_turns`` change the plan, never the rows.
    """
    bounded_batches(rebuilt.sparkSession)
    walks = stored(_with_shards(rebuilt, piece, shard_turns), "walks")
    first = walks.withColumns({
        "n": F.lit(1).cast("long"),
        "ends": (F.col("depth") == F.col("length")).cast("long"),
        "q1": F.col("p1").bitwiseXOR(F.col("s1")),
        "q2": F.col("p2").bitwiseXOR(F.col("s2")),
    })
    nodes = stored(_walk(first, ["q1", "q2"], ["n", "ends"], smallest=True), "nodes")
    # What a conversation owns: its nodes from depth ``own`` on, and perhaps a leaf.
    owned = nodes.groupBy(F.col("low").alias("conv")).agg(
        F.min("depth").alias("own"), F.max((F.col("n") == F.col("ends")).cast("long")).alias("leaf")
    )
    shared = walks.join(owned, "conv", "left").withColumn("own", F.coalesce("own", F.col("length") + 1))
    shared = shared.withColumn("leaf", F.coalesce("leaf", F.lit(0).cast("long")))
    # Words up to the last turn that an earlier conversation holds.
    last = shared.where(F.col("depth") == F.col("own") - 1).select("conv", F.col("so_far").alias("held_words"))
    shared = shared.join(last, "conv", "left")
    second = shared.withColumns({
        "children": ((F.col("depth") < F.col("length")) & (F.col("own") <= F.col("depth") + 1)).cast("long"),
        "saved": F.when(
            F.col("depth") < F.col("own"), F.col("held_words") - F.col("so_far") + F.col("words")
        ).otherwise(F.lit(0).cast("long")),
    })
    sums = _walk(second, [], ["children", "leaf", "saved"], smallest=False)
    ends = _end_digests(walks.where(F.col("depth") == F.col("length")).select(*_NODE, "conv"))
    above = nodes.select(
        F.col("p1").alias("q1"), F.col("p2").alias("q2"), (F.col("depth") + 1).alias("depth"), F.col("low").alias("parent")
    )
    whole = nodes.where("depth > 0").join(above, ["q1", "q2", "depth"]).unionByName(
        nodes.where("depth = 0").withColumn("parent", F.lit(None).cast("long"))
    )
    whole = whole.join(sums, _NODE).join(ends, _NODE, "left")
    nothing = hashlib.sha256(b"").hexdigest()
    return whole.select(
        F.col("low").alias("conv_id"), "depth", F.col("parent").alias("parent_conv_id"), F.col("n").alias("n_convs"),
        F.col("children").alias("n_children"), F.col("leaf").alias("n_leaves"), F.col("saved").alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(nothing)).alias("ends_sha256"),
    )


def rebuilt_conversation_nodes(turns: DataFrame, **columns: str) -> DataFrame:
    """``prefix_nodes`` of the rebuilt conversations in a table of turns, whatever other columns it has."""
    return prefix_nodes(rebuilt_turns(ordered_turns(turns, **columns)))

