"""Large files cut by several tasks give the rows that a whole-file read gives."""

import json
import random

import pytest
from pyspark.sql import functions as F

from answerloom.sources import readers, splits

WHOLE = 1 << 60


@pytest.fixture
def small_ranges(spark):
    names = ["spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"]
    old = [spark.conf.get(n) for n in names]
    for name, value in zip(names, ("256", "0")):
        spark.conf.set(name, value)
    yield
    for name, value in zip(names, old):
        spark.conf.set(name, value)


def _text(rng):
    signs = ['"', "\\", "{", "}", "[", "]", ",", "é", "\n", "a", " ", "", ":"]
    return "".join(rng.choice(signs) for _ in range(rng.randrange(30)))


def _objects(n, seed):
    rng = random.Random(seed)
    return [{"a": _text(rng), "b": {"c": [i, {"d": _text(rng)}]}, "k}": i} for i in range(n)]


def _records(spark, path, split_bytes):
    rows = readers.read_records(spark, str(path), quarantine=True, split_bytes=split_bytes)
    return sorted((r.line_no, r.record, r.bad) for r in rows.collect())


ODD = [
    "[]", " [ ] \n", "[1]}", '[{"a":1},]', '[,{"a":1}]', '[{"a":1} {"b":2}]', '[{"a":1}', '[{"a":1}], [{"b":2}]',
    '[{"a":1}, 3], [{"b":2}, 4]', '[1, "x}", {"a":"]"}, [2, {"b":[]}], null, "]"]', '["a", "b]', '[{"a":1}] {"x":1}',
    '[1]\n[2, {"a":1}]\n\n[{"b":2}]', '{"a":1}', '{"a":1}\n', '{"a":1}\n{"b":"}\\""}\r\n\n{"c":3} oops\n{"d":4}',
    '{"records": [{"a":1}, {"b":2}]}', '{"a":1} oops', '{"a":1', "42", "words", "  ", '{"a":1}{"b":2}',
]


def test_odd_roots_are_read_alike(spark, tmp_path):
    for i, text in enumerate(ODD):
        (tmp_path / f"{i:02d}.json").write_text(text)
    whole, cut = (
        sorted(map(tuple, readers.read_records(spark, str(tmp_path), quarantine=True, split_bytes=s).collect()))
        for s in (WHOLE, 0)
    )
    assert cut == whole


def test_large_files_are_not_read_whole(spark, tmp_path):
    for name, size in (("small", 10), ("large", 5000)):
        (tmp_path / f"{name}.txt").write_text("x" * size)
    small = readers._whole_files(spark, str(tmp_path), readers._size_at_most(100))
    assert len(small.collect()) == 1
    scan = small._jdf.queryExecution().executedPlan().collectLeaves().apply(0)
    assert scan.metrics().apply("filesSize").value() == 10


@pytest.mark.parametrize("indent", [None, 1])
def test_array_over_several_tasks(spark, tmp_path, small_ranges, indent):
    items = _objects(80, 1)
    mixed = [7, "t}", [1, {"z": "]"}], *items[:40], None, *items[40:], {"last": 1}, "end]", [2]]
    path = tmp_path / "one.json"
    for rows in (items, mixed):
        path.write_text(json.dumps(rows, indent=indent, ensure_ascii=False), encoding="utf-8")
        assert splits.scan_pieces(spark, str(path), "}", 0).rdd.getNumPartitions() > 8
        got = _records(spark, path, 0)
        assert got == _records(spark, path, WHOLE)
        assert [n for n, _, _ in got] == list(range(1, len(rows) + 1))
    path.write_text(json.dumps(items))
    table = readers.read_json_table(spark, str(path), split_bytes=0)
    whole = readers.read_json_table(spark, str(path))
    assert table.columns == whole.columns
    assert sorted(map(str, table.collect())) == sorted(map(str, whole.collect()))


def test_buckets_of_records(spark, tmp_path, small_ranges, monkeypatch):
    monkeypatch.setattr(splits, "BUCKET_RECORDS", 3)
    path = tmp_path / "one.json"
    path.write_text(json.dumps([1, 2, *_objects(20, 2), 3, *_objects(5, 3)]))
    assert _records(spark, path, 0) == _records(spark, path, WHOLE)


def test_bad_line_of_a_split_file(spark, tmp_path, small_ranges):
    path = tmp_path / "many.jsonl"
    lines = [json.dumps(r) for r in _objects(60, 4)]
    path.write_text("\n".join([*lines[:41], "", '{"a": 2} oops', *lines[41:]]) + "\n")
    assert _records(spark, path, 0) == _records(spark, path, WHOLE)
    with pytest.raises(Exception, match="invalid JSON on line 43"):
        readers.read_records(spark, str(path), split_bytes=0).collect()


def test_raw_rows_of_large_files(spark, tmp_path):
    for name, text in {"a.json": '{"a": 1}', "b.json": "[1, {}]", "c.json": '[{"x": 1}]', "d.json": "[{]"}.items():
        (tmp_path / name).write_text(text)
    got = readers.read_json_table(spark, str(tmp_path), split_bytes=0)
    want = readers.read_json_table(spark, str(tmp_path))
    assert got.columns == want.columns == ["x", "RawJSON"]
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    mixed = readers.read_json_table(spark, str(tmp_path), split_bytes=8)
    assert sorted(map(str, mixed.collect())) == sorted(map(str, want.collect()))


@pytest.mark.parametrize("drop", [False, True])
@pytest.mark.parametrize("end", ["", "\n", "\n\n", "\r\n"])
def test_line_numbers_over_splits(spark, tmp_path, small_ranges, drop, end):
    rng = random.Random(5)
    path = tmp_path / "notes.txt"
    path.write_text("\n".join(" " * rng.randrange(3) + "é" * rng.randrange(40) for _ in range(300)) + "\r\nx" + end)
    got = readers.read_lines(spark, str(path), drop, split_bytes=0)
    assert got.rdd.getNumPartitions() > 8
    want = readers.read_lines(spark, str(path), drop, split_bytes=WHOLE)
    assert sorted(got.collect()) == sorted(want.collect())


@pytest.mark.parametrize("brk", ["\n", "\r\n"])
def test_csv_with_breaks_over_splits(spark, tmp_path, small_ranges, brk):
    rng = random.Random(6)
    signs = ['""', "\n", ",", "é", "b", " ", "{", "\\"]
    cells = [["".join(rng.choice(signs) for _ in range(rng.randrange(1, 25))) for _ in range(3)] for _ in range(150)]
    rows = ['x,"y ""z""",w', *[",".join(f'"{c}"' for c in row) for row in cells], "", "plain,2,", "short", ",,"]
    path = tmp_path / "one.csv"
    path.write_bytes((brk.join(r.replace("\n", brk) for r in rows) + brk).encode())
    got = readers.read_csv(spark, str(path), split_bytes=0)
    want = readers.read_csv(spark, str(path), split_bytes=WHOLE)
    assert got.columns == want.columns
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert splits.scan_pieces(spark, str(path), "\n", 0).rdd.getNumPartitions() > 8
    blocks = [readers.read_csv_blocks(spark, str(path), True, size).agg(F.count("*")).first()[0] for size in (0, WHOLE)]
    assert blocks[0] == blocks[1]
