"""Queries on token rows where a position has no mass, no value or a single zero."""

import datetime
import os

import duckdb
import pytest

from answerloom.catalog import load
from answerloom.operators import sequences
from oracle import ROOT, compare

QUERIES = [
    "a23_batch_mean", "g1_sequence_logprob", "g2_mean_answer_logprob", "g2_option_logprob",
    "g3_mean_step_entropy", "g8_token_level_loss", "w10_top_k_share", "w9_nucleus", "w11_softmax",
]
SCHEMA = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    base = tmp_path_factory.mktemp("zero")
    for name in os.listdir(f"{ROOT}/sf0.001"):
        if name != "events.parquet":
            os.symlink(f"{ROOT}/sf0.001/{name}", base / name)
    values = [
        (0, 6, "view", 0.0),  # all of the position's mass is zero
        (0, 7, "view", 0.0), (0, 7, "click", 0.0),
        (0, 8, "view", 3.5), (0, 8, "click", 0.0), (0, 8, "error", 1.25),
        (1, 29, "signup", 0.0), (1, 30, "signup", 2.0), (1, 2, "view", 1.0),
        (2, 28, "view", 4.0), (2, 28, "click", 2.0),
    ]
    rows = [
        (i, datetime.datetime(2024, 1, day, 1, 2, 3), user, kind, value, "{}")
        for i, (user, day, kind, value) in enumerate(values)
    ]
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(str(base / "events"))
    duckdb.sql(f"COPY (SELECT * FROM '{base}/events/*.parquet') TO '{base}/events.parquet'")
    return str(base)


@pytest.mark.parametrize("name", QUERIES)
def test_positions_without_mass(spark, folder, name):
    assert compare(spark, load()[name], folder) is None


def test_top_k_of_zeros(spark):
    rows = [("a", 1, 0.0), ("a", 2, 0.0), ("b", 1, 0.5), ("b", 2, 0.25), ("b", 3, 0.25)]
    got = sequences.top_k_share(spark.createDataFrame(rows, "r string, i int, p double"), ["r"], "i", "p", 2)
    found = {(r.r, r.i): r.share for r in got.collect()}
    assert found["b", 1] == pytest.approx(2 / 3) and found["b", 2] == pytest.approx(1 / 3)
    assert found["a", 1] != found["a", 1] and found["a", 2] != found["a", 2]
