"""Large bands of the near-duplicate stage: differences from what a band usually holds."""

import numpy as np

from answerloom.llm import near_copies
from answerloom.llm.components import connected_components


def copies(rng, count, size=200):
    """Sets that are one set with some shingles replaced by ones that a few other sets have."""
    base, pool = rng.integers(1, 1 << 62, size), rng.integers(1, 1 << 62, 2000)
    for _ in range(count):
        gone = int(rng.integers(2, 18)) if rng.random() < 0.8 else int(rng.integers(24, 50))
        yield np.concatenate([rng.permutation(base)[gone:], rng.permutation(pool)[:gone]])


def generations(rng, count, size=120):
    """Sets made from any one before, so that some are similar to few others, and of different sizes."""
    sets = [rng.integers(1, 1 << 62, size)]
    while len(sets) < count:
        parent = rng.permutation(sets[int(rng.integers(0, min(len(sets), 12)))])
        gone, new = rng.integers(0, 16, 2)
        sets.append(np.concatenate([parent[gone:], rng.integers(1, 1 << 62, new)]))
    return sets


def tables(spark, sets):
    rows = [(i, np.sort(s.astype(np.uint64)).tobytes()) for i, s in enumerate(sets)]
    members = spark.createDataFrame([(7, i, len(s)) for i, s in enumerate(sets)], "band long, row long, n long")
    return members, spark.createDataFrame(rows, "row long, shingles binary")


def found(spark, sets):
    links = near_copies.near_copy_links(*tables(spark, sets))
    named = {r.node: r.component for r in connected_components(links, "a", "b").collect()}
    return [named.get(i, i) for i in range(len(sets))]


def brute(sets, similarity=0.8):
    values = {v: k for k, v in enumerate(np.unique(np.concatenate(sets)).tolist())}
    held = np.zeros((len(sets), len(values)), dtype=np.float32)
    for i, s in enumerate(sets):
        held[i, [values[v] for v in s.tolist()]] = 1
    common = held @ held.T
    sizes = held.sum(axis=1)
    near = common >= similarity * (sizes[:, None] + sizes[None, :] - common) - 1e-4
    label = np.arange(len(sets))
    while True:
        least = np.where(near, label[None, :], len(sets)).min(axis=1)
        if (least == label).all():
            return label.tolist()
        label = least


def test_pairs_of_a_large_band_do_not_grow_with_its_square(spark, monkeypatch):
    made = []
    sided = near_copies._sided

    def counted(*given):
        pairs = near_copies.stored(sided(*given), "counted")
        made.append(pairs.count())
        return pairs

    monkeypatch.setattr(near_copies, "_sided", counted)
    sets = list(copies(np.random.default_rng(11), 600))
    assert found(spark, sets) == brute(sets)
    assert sum(made) <= len(sets)


def test_a_large_band_of_many_generations(spark):
    for seed in (12, 13):
        sets = generations(np.random.default_rng(seed), 240)
        want = brute(sets)
        assert found(spark, sets) == want and 5 < len(set(want)) < 200


def test_similar_rows_share_a_prefix_of_their_differences(spark):
    sets = [s.astype(np.uint64) for s in generations(np.random.default_rng(14), 160)]
    members, rows = tables(spark, sets)
    members = members.selectExpr("band", "row", "n", "1000L AS reach", "row AS component", "160L AS size")
    bands = near_copies._prefix_members(
        near_copies._differences(members, rows).drop("shingles"), near_copies._differences(members, rows), 0.8
    )
    held = {}
    for r in bands.collect():
        held.setdefault(r.row, set()).add(r.band)
    similar = 0
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            common = len(np.intersect1d(a, b))
            if common >= 0.8 * (len(a) + len(b) - common):
                similar += 1
                assert held.get(i, set()) & held.get(j, set())
    assert similar > 100
