"""Quantiles by narrowing ranges against a sorted list."""

import datetime
import math
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from answerloom.operators import profiles, selection

QS = [0.0, 0.01, 0.25, 0.5, 0.5, 0.77, 0.99, 1.0]
RNG = random.Random(9)
DAY = datetime.date(2024, 1, 1)

COLUMNS = {
    "ties": ("int", [RNG.choice([1, 1, 1, 1, 2, 7]) for _ in range(900)]),
    "two_values": ("int", [0] * 500 + [1] * 500),
    "same": ("double", [2.5] * 300),
    "spread": ("double", [RNG.choice([-1, 1]) * 10.0 ** RNG.uniform(-300, 300) for _ in range(900)]),
    "special": ("double", [math.inf, -math.inf, math.nan, math.nan, 0.0] * 20 + [RNG.random() for _ in range(400)]),
    "close_longs": ("bigint", [2**62 + RNG.randrange(60) for _ in range(700)]),
    "decimals": ("decimal(30,4)", [Decimal(RNG.randrange(10**28)).scaleb(-4) for _ in range(500)]),
    "dates": ("date", [DAY + datetime.timedelta(days=RNG.randrange(4000)) for _ in range(600)]),
    "texts": ("string", [RNG.choice("abcdefgh") * RNG.randrange(5) for _ in range(300)]),
    "one": ("int", [4]),
    "empty": ("int", []),
}


def _sorted(values):
    return sorted(values, key=lambda v: (True, 0.0) if isinstance(v, float) and math.isnan(v) else (False, v))


@pytest.mark.parametrize("name", COLUMNS)
def test_quantiles_of_any_kind(spark, name):
    kind, values = COLUMNS[name]
    df = spark.createDataFrame([(v,) for v in values] + [(None,)] * 3, f"x {kind}").repartition(4)
    order = _sorted(values)
    want = [(q, order[int(q * len(order))] if int(q * len(order)) < len(order) else None) for q in QS]
    found = [profiles.nearest_rank_quantiles(df, "x", QS)]
    if kind != "string":
        found.append(selection.values_at_ranks(df, "x", QS, small=5, accuracy=10))
    for got in found:
        assert got.columns == ["q", "value"]
        assert got.schema["value"].dataType == df.schema["x"].dataType
        assert sorted(map(str, (tuple(r) for r in got.collect()))) == sorted(map(str, want))


def test_scans_are_few_and_ranges_small(spark):
    values = spark.range(400_000).select((F.pow(F.lit(1.0001), F.col("id") % 90_000) * (F.hash("id") % 7)).alias("v"))
    ranks = [0, 4000, 200_000, 399_999]
    ranges, scans = selection.rank_ranges(values, ranks, 400_000, 1000, 1000)
    assert scans <= 4 and all(r.done or r.inside <= 1000 for r in ranges)
    for r in ranges:
        if not r.done:
            assert values.where(r.holds()).count() == r.inside
