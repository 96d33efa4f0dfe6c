"""Run a registered query and its SQL twin and compare the rows."""

from __future__ import annotations

import math
import os

import duckdb

from answerloom.catalog.registry import TABLE_NAMES

ROOT = os.environ.get("TESTDATA", "/root/testdata")


def connect(folder: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in TABLE_NAMES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def _cell(value):
    if isinstance(value, float):
        if math.isnan(value):
            return "NaN"
        return repr(value)
    return str(value)


def _table(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(_cell(r[i]) for i in order) for r in rows)


def compare(spark, entry, folder: str) -> str | None:
    """None when equal, otherwise a short description of the first difference."""
    df = entry.run(spark, folder)
    got_names = df.columns
    got = [tuple(r) for r in df.collect()]
    cur = connect(folder).execute(entry.sql)
    want_names = [d[0] for d in cur.description]
    want = cur.fetchall()
    if sorted(got_names) != sorted(want_names):
        return f"columns {sorted(got_names)} != {sorted(want_names)}"
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}; {got[:2]} / {want[:2]}"
    a, b = _table(got_names, got), _table(want_names, want)
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    if bad:
        return f"{len(bad)} of {len(a)} rows differ, columns {sorted(got_names)}: {bad[:2]}"[:900]
    return "EMPTY" if not got else None
