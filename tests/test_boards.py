import math

import pytest

from answerloom.operators import boards

# fixed values: 60 votes (winner, loser) in order; G = GPT-5, C = Claude-3, L4 = Llama-4, L3 = Llama-3
NAMES = {"G": "GPT-5", "C": "Claude-3", "L4": "Llama-4", "L3": "Llama-3"}
VOTES = """
G C, G L4, C L3, L4 L3, C L3, G L3, C G, L4 C, L3 L4, G C, C L4, G L4, C G, L4 C, G L3, C L3, L3 C, G L4,
C G, L4 G, L3 C, G C, C L4, L4 L3, G L3, C L3, G C, C L4, G C, L4 L3, C G, G L3, C L3, L3 L4, G C, C L4,
G L4, C G, L4 C, G L3, C L3, L3 C, G L4, C G, L4 G, L3 C, G C, C L4, L4 L3, G L3, C L3, G C, C L4, G C,
L4 L3, C G, G L3, C L3, L3 L4, C L3
"""


@pytest.fixture(scope="module")
def votes(spark):
    pairs = [p.split() for p in VOTES.replace("\n", " ").split(",")]
    rows = [("all", i, NAMES[w], NAMES[x]) for i, (w, x) in enumerate(pairs)]
    assert len(rows) == 60
    return spark.createDataFrame(rows, "arena string, seq long, winner string, loser string").repartition(3)


def ratings(df):
    return {r.model: r.rating for r in df.collect()}


ELO = {"GPT-5": 1095.9, "Claude-3": 1058.7, "Llama-4": 958.2, "Llama-3": 887.2}
BT = {"GPT-5": 1140.6, "Claude-3": 1058.7, "Llama-4": 950.3, "Llama-3": 850.4}


def test_elo_published_ratings(votes):
    got = ratings(boards.elo(votes))
    assert {m: round(r, 1) for m, r in got.items()} == ELO
    assert math.isclose(sum(got.values()), 4000.0)


def test_elo_segments_give_the_same(spark, votes):
    two = votes.union(votes.selectExpr("'other'", "100 - seq", "winner", "loser").where("seq % 2 = 0"))
    whole = {(r.arena, r.model): r.rating for r in boards.elo(two).collect()}
    cut = {(r.arena, r.model): r.rating for r in boards.elo(two, segment_votes=7).collect()}
    assert whole == cut


def test_elo_single_match_and_total(spark):
    one = spark.createDataFrame([("x", 0, "A", "B")], "arena string, seq long, winner string, loser string")
    assert ratings(boards.elo(one)) == pytest.approx({"A": 1016.0, "B": 984.0})
    three = spark.createDataFrame(
        [("x", 0, "A", "B"), ("x", 1, "B", "C"), ("x", 2, "A", "C")],
        "arena string, seq long, winner string, loser string",
    )
    assert sum(ratings(boards.elo(three)).values()) == pytest.approx(3000.0)


def test_bradley_terry_published_ratings(votes):
    got = ratings(boards.bradley_terry(votes))
    assert got == pytest.approx(BT, abs=0.1)


def test_bradley_terry_distributed_steps(votes):
    near = ratings(boards.bradley_terry(votes, steps=3))
    far = ratings(boards.bradley_terry(votes, max_pairs=1, steps=3))
    assert far == pytest.approx(near, abs=1e-9)
