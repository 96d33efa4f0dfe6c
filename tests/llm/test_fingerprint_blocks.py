"""Candidates of the near-duplicate stage: SimHash fingerprints, their blocks, counted distances."""

import numpy as np
import pytest

from answerloom.llm import near_copies


def pair(rng, size, common):
    drawn = rng.integers(0, 1 << 64, 2 * size - common, dtype=np.uint64)
    return np.sort(drawn[:size]), np.sort(np.concatenate([drawn[:common], drawn[size:]]))


@pytest.mark.parametrize(("size", "common"), [(27, 24), (90, 80), (900, 800)])
def test_similar_sets_share_a_block_within_the_radius(size, common):
    rng = np.random.default_rng(3)
    bands, within = near_copies.band_count(0.8), near_copies.radius(0.8)
    shares = []
    for _ in range(300):
        prints = [near_copies.fingerprints(s, bands // 4) for s in pair(rng, size, common)]
        apart = np.bitwise_count(prints[0] ^ prints[1])
        shares.append(apart.sum() / (64 * len(apart)))
        rows = [
            np.column_stack([near_copies._blocks(p), np.full(bands, i), np.full(bands, size), *[np.full(bands, x.view(np.int64)) for x in p[:2]]])
            for i, p in enumerate(prints)
        ]
        both = np.concatenate(rows)
        both = both[np.lexsort((both[:, 1], both[:, 0]))]
        found = np.concatenate(list(near_copies._banded(iter([both]), within, 4096)))
        assert set(found[:, 1]) == {0, 1} and len(set(found[:, 0])) == 1
    assert abs(np.mean(shares) - np.arccos(8 / 9) / np.pi) < 0.01


def test_unlike_sets_do_not_meet():
    rng = np.random.default_rng(4)
    prints = np.array([near_copies.fingerprints(s, 2) for _ in range(200) for s in pair(rng, 90, 5)]).view(np.int64)
    one_block = np.column_stack([np.zeros(len(prints), np.int64), np.arange(len(prints)), np.full(len(prints), 90), prints])
    met = np.concatenate(list(near_copies._banded(iter([one_block]), near_copies.radius(0.8), 4096)))
    assert len(met) < 0.1 * len(prints)


def test_a_large_block_goes_on_whole_however_it_comes_in(monkeypatch):
    rng = np.random.default_rng(5)
    block = np.sort(np.concatenate([np.full(700, 50), rng.integers(0, 100, 900)]))
    prints = np.zeros((len(block), 2), dtype=np.int64)
    rows = np.column_stack([block, np.arange(len(block)), np.full(len(block), 30), prints])
    want = set(map(tuple, np.concatenate(list(near_copies._banded(iter([rows]), 42, 100))).tolist()))
    monkeypatch.setattr(near_copies, "CHUNK", 64)
    for cut in (1, 7, 333):
        parts = (rows[i : i + cut] for i in range(0, len(rows), cut))
        got = np.concatenate(list(near_copies._banded(parts, 42, 100)))
        assert set(map(tuple, got.tolist())) == want
        bands, sizes = np.unique(got[:, 0], return_counts=True)
        assert set(got[got[:, 0] == bands[sizes.argmax()]][:, 1]) == set(np.flatnonzero(block == 50))


def test_short_sets_meet_by_shingles(spark):
    rng = np.random.default_rng(6)
    rows = []
    for i in range(60):
        base = [f"w{k}" for k in rng.integers(0, 1 << 30, int(rng.integers(9, 29)))]
        rows += [(2 * i, " ".join(base)), (2 * i + 1, " ".join([*base, "more"]))]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in near_copies.near_copy_groups(table).collect()}
    assert got == {i: 2 * (i // 2) if len(rows[i - i % 2][1].split()) >= 8 else i for i, _ in rows}


def test_a_row_has_one_band_however_many_blocks_it_shares(spark):
    rng = np.random.default_rng(7)
    base = rng.integers(0, 1 << 63, 120)
    rows = []
    for i in range(200):
        own = np.concatenate([base[rng.random(120) < 0.95], rng.integers(0, 1 << 63, 4)])
        rows.append((i, np.sort(own.astype(np.uint64)).tobytes()))
    for i in range(200, 300):
        rows.append((i, np.sort(rng.integers(0, 1 << 63, 120).astype(np.uint64)).tobytes()))
    sets = spark.createDataFrame(rows, "row long, shingles binary")
    for counted in (4096, 20):  # a block that is not counted may bring in others
        got = near_copies._candidates(sets, 0.8, counted).collect()
        found = {r.row for r in got}
        assert found >= set(range(200)) and len(got) == len(found)
        assert found == set(range(200)) or counted == 20
        assert len({r.band for r in got}) == 1 and all(r.n == len(rows[r.row][1]) // 8 for r in got)


def test_links_of_a_block_that_comes_in_parts():
    parts = [np.array(x).reshape(-1, 3) for x in ([], [[5, 1, 9], [5, 2, 9]], [[5, 3, 9]], [[7, 2, 9], [8, 4, 9], [7, 6, 9]])]
    links = np.concatenate(list(near_copies._links(iter(parts))))
    assert links.tolist() == [[1, 2], [1, 3], [2, 6]]
