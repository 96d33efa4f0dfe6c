import json
import threading

import pytest
from pyspark.sql import functions as F

from answerloom.functions.grading import grade
from answerloom.operators import filters, joins, profiles
from answerloom.operators.evaluate import accuracy, graded, match_predictions, score_histogram
from answerloom.sources import readers, store


def test_records_four_shapes(spark, tmp_path):
    rows = [{"a": 1}, {"a": 2, "b": "é"}]
    shapes = {
        "array.json": json.dumps(rows, indent=2),
        "records.json": json.dumps({"records": rows}),
        "single.json": json.dumps(rows[1], indent=1),
        "lines.jsonl": "\n".join(json.dumps(r) for r in rows) + "\n\n",
    }
    for name, text in shapes.items():
        path = tmp_path / name
        path.write_text(text, encoding="utf-8")
        got = [json.loads(r.record) for r in readers.read_records(spark, str(path)).collect()]
        assert got == ([rows[1]] if name == "single.json" else rows), name
    fast = readers.read_records(spark, str(tmp_path / "lines.jsonl"), json_lines=True)
    assert [json.loads(r.record) for r in fast.collect()] == rows


def test_bad_line_names_its_number(spark, tmp_path):
    path = tmp_path / "bad.jsonl"
    path.write_text('{"a": 1}\n\n{"a": 2} oops\n{"a": 3}\n')
    bad = readers.read_records(spark, str(path), quarantine=True).where("bad").collect()
    assert [(r.line_no, r.record) for r in bad] == [(3, '{"a": 2} oops')]
    with pytest.raises(Exception, match="invalid JSON on line 3"):
        readers.read_records(spark, str(path)).collect()
    scalar = tmp_path / "scalar.json"
    scalar.write_text("42")
    with pytest.raises(Exception, match="invalid JSON"):
        readers.read_records(spark, str(scalar)).collect()


@pytest.mark.parametrize("gt,gen", [("gtruth_answer", "generated_text"), ("answer_key", "model_output")])
def test_evaluation_files(spark, tmp_path, gt, gen):
    rows = [{gt: "2", gen: "so \\boxed{2}"}, {gt: "3", gen: "so \\boxed{4}"}]
    path = tmp_path / "run.json"
    path.write_text(json.dumps(rows))
    fields = readers.record_fields(readers.read_records(spark, str(path)), [gt, gen])
    out = accuracy(graded(fields.withColumn("s", F.lit("all")), gen, gt), "s").where("s IS NULL").first()
    assert (out.correct, out.total, out.accuracy) == (1, 2, 0.5)
    with pytest.raises(Exception, match="missing key"):
        readers.record_fields(readers.read_records(spark, str(path)), ["nope"]).collect()


def test_unmatched_predictions_fail(spark):
    truth = spark.createDataFrame([(1, "a"), (2, "b")], "index int, g string")
    pred = spark.createDataFrame([(1, "a")], "index int, p string")
    with pytest.raises(Exception, match="unmatched record 2"):
        match_predictions(truth, pred, "index").collect()


def test_csv_and_unknown_extension(spark, tmp_path):
    csv = tmp_path / "people.csv"
    csv.write_bytes('Name,Age,Note\nAda,36,"a, ""b""\nc"\nBob,,x\xff\n'.encode("latin-1"))
    rows = readers.read_any(spark, str(csv)).collect()
    assert [tuple(r) for r in rows] == [("Ada", "36", 'a, "b"\nc'), ("Bob", None, "x")]
    odd = tmp_path / "notes.xyz"
    odd.write_text("line\nline")
    assert [tuple(r) for r in readers.read_any(spark, str(odd)).collect()] == [("line\nline",)]
    obj = tmp_path / "obj.json"
    obj.write_text('{"a": 1}')
    assert readers.read_any(spark, str(obj)).columns == ["RawJSON"]
    arr = tmp_path / "arr.json"
    arr.write_text('[{"b": 1, "a": "x"}, {"a": "y", "z": 3}]')
    assert sorted(readers.read_any(spark, str(arr)).select("a", "b").collect()) == [("x", "1"), ("y", "")]


def test_header_detection(spark):
    lines = [["Report", "", ""], ["", "", ""], ["", "Name", ""], ["", "Name", "Age"], ["", "Ada", "36"],
             ["", "", ""], ["", "Bob"]]
    df = spark.createDataFrame([("f", i + 1, c) for i, c in enumerate(lines)],
                               "file string, line_no int, cells array<string>")
    rows = {r.line_no: r.row for r in readers.rows_below_header(df).collect()}
    assert rows == {5: {"Name": "Ada", "Age": "36"}, 7: {"Name": "Bob", "Age": ""}}


def test_numbered_lines(spark):
    df = spark.createDataFrame([("f", "a\r\n\n b \n")], "file string, text string")
    every = [(r.line_no, r.line) for r in readers.numbered_lines(df, "file", "text").collect()]
    assert every == [(1, "a"), (2, ""), (3, " b ")]
    kept = [(r.line_no, r.line) for r in readers.numbered_lines(df, "file", "text", True).collect()]
    assert kept == [(1, "a"), (3, "b")]


def test_metric_log_header_once_and_headerless(spark, tmp_path):
    path = str(tmp_path / "log")
    schema = "epoch int, total_steps int, train_loss double, val_loss double"
    for row in [(1, 10, 1.23, 0.91), (2, 20, 0.98, 0.77)]:
        store.append_metrics(spark.createDataFrame([row], schema).coalesce(1), path)
    texts = sorted(p.read_text() for p in (tmp_path / "log").glob("*.csv") if p.stat().st_size)
    head = "epoch,total_steps,train_loss,val_loss\n"
    assert texts == [head + "1,10,1.230000,0.910000\n", head + "2,20,0.980000,0.770000\n"]
    bare = tmp_path / "bare.csv"
    bare.write_text("1,0.5,\n2,0.4,0.9\n")
    out = readers.read_metric_log(spark, str(bare), "step int, loss double, eval_acc double")
    assert [tuple(r) for r in out.collect()] == [(1, 0.5, None), (2, 0.4, 0.9)]
    named = tmp_path / "named.csv"
    named.write_text("step,reward,loss\n1,9,0.5\n")
    out = readers.read_metric_log(spark, str(named), "step int, loss double, eval_acc double")
    assert [tuple(r) for r in out.collect()] == [(1, 0.5, None)]


def test_delete_drops_rows_and_vectors(spark, tmp_path):
    rows = spark.range(1200).withColumn("name", F.concat(F.lit("n"), "id"))
    paths = [str(tmp_path / "store"), str(tmp_path / "vectors")]
    for path in paths:
        for name in ("a.csv", "b.csv"):
            store.append_chunks(store.file_chunks(rows, "t", name, [F.col("id")]), path)
        store.append_chunks(store.file_chunks(rows, "other", "a.csv", [F.col("id")]), path)
    store.delete_file(spark, paths, "t", "a.csv")
    for path in paths:
        left = {(r.thread_id, r.file_name, r.row_count) for r in store.stored_files(spark, path).collect()}
        assert left == {("t", "b.csv", 1200), ("other", "a.csv", 1200)}
    store.delete_file(spark, paths, "t", "b.csv")
    assert {r.thread_id for r in store.stored_files(spark, paths[0]).collect()} == {"other"}
    assert store.read_store(spark, paths[0]).agg(F.max("n_rows")).first()[0] == 500
    back = store.rows_as_columns(store.read_file(spark, paths[0], "other", "a.csv"), ["id", "name"])
    assert back.where("name = 'n' || id").count() == 1200


def test_deleted_file_can_come_back(spark, tmp_path):
    path = str(tmp_path / "store")
    rows = spark.range(700).withColumn("name", F.concat(F.lit("n"), "id"))
    for thread in ("a b/1", "t2", "7"):
        store.append_chunks(store.file_chunks(rows, thread, "x.csv", [F.col("id")]), path)
    store.delete_file(spark, [path], "a b/1", "x.csv")
    store.delete_file(spark, [path], "absent", "x.csv")
    again = store.file_chunks(rows.limit(3), "a b/1", "x.csv", [F.col("id")])
    more = store.file_chunks(rows.limit(5), "t2", "y.csv", [F.col("id")])
    store.append_chunks(again.unionByName(more), path)
    want = {("a b/1", "x.csv", 3), ("t2", "x.csv", 700), ("t2", "y.csv", 5), ("7", "x.csv", 700)}
    for _ in range(2):
        found = store.stored_files(spark, path).collect()
        assert {(r.thread_id, r.file_name, r.row_count) for r in found} == want
        store.drop_deleted(spark, path)
    assert store.read_file(spark, path, "a b/1", "x.csv").count() == 3


def test_reader_never_misses_a_replaced_table(spark, tmp_path):
    path = str(tmp_path / "table")
    store.replace_table(spark.range(100).withColumn("v", F.lit(0)), path)
    stop, seen, faults = threading.Event(), [], []

    def read():
        while not stop.is_set():
            try:
                seen.append(tuple(store.read_table(spark, path).agg(F.count("*"), F.min("v"), F.max("v")).first()))
            except Exception as fault:  # noqa: BLE001
                faults.append(fault)

    reader = threading.Thread(target=read)
    reader.start()
    for i in range(1, 11):
        assert store.replace_table(spark.range(100).withColumn("v", F.lit(i)), path) == i + 1
    stop.set()
    reader.join()
    assert not faults and len(seen) > 3
    assert all(n == 100 and low == high for n, low, high in seen) and seen == sorted(seen)
    store.drop_old_versions(spark, path, keep=1)
    assert len(list((tmp_path / "table").glob("_version-*"))) == 1
    assert store.read_table(spark, path).agg(F.max("v")).first()[0] == 10


def test_unpublished_version_stays_unseen(spark, tmp_path):
    path = str(tmp_path / "table")
    spark.range(5).write.parquet(path)
    assert store.read_table(spark, path).count() == 5
    spark.range(9).write.parquet(f"{path}/_version-000000000001")
    assert store.read_table(spark, path).count() == 5
    assert store.replace_table(spark.range(7), path) == 2
    assert store.read_table(spark, path).count() == 7


def test_roles_and_compat(spark):
    data = [(str(i), f"2024-01-{i % 28 + 1:02d}", "x", None) for i in range(100)]
    df = spark.createDataFrame(data, "n string, d string, c string, e string")
    roles = {r["column"]: r.role for r in profiles.column_roles(df).collect()}
    assert roles == {"n": "numeric", "d": "date", "c": "categorical"}
    old = {r["column"]: r.role for r in profiles.column_roles(df, [F.col("n")], compat=True).collect()}
    assert old == {"n": "categorical", "d": "categorical", "c": "categorical"}


def test_profile_ignores_money_text(spark):
    df = spark.createDataFrame([("$50", "1"), ("7", " 2.5 "), ("nan", "1d")], "a string, b string")
    out = {r["column"]: (r["count"], r["sum"]) for r in profiles.numeric_profile(df).collect()}
    assert out == {"a": (1, 7.0), "b": (2, 3.5)}


def test_conditions_fold_left_to_right(spark):
    people = spark.createDataFrame([("Ann", 30, "dev"), ("Bob", 45, "ops"), ("Cy", 50, "dev")],
                                   "Name string, Age int, Role string")
    rule = [("Role", ["dev"], "==", "AND"), ("Name", ["bob"], "==", "OR"), ("Age", 40, ">", "AND")]
    assert {r.Name for r in people.where(filters.fold_conditions(rule)).collect()} == {"Bob", "Cy"}
    assert people.where(filters.fold_conditions([])).count() == 3
    assert people.where(filters.numeric_condition("Age", 1, "!=")).count() == 0


def test_headers_of_three_files(spark):
    rows = [("f1", 0, "Dept"), ("f1", 1, "Sales"), ("f1", 2, "Start Date"), ("f2", 0, "Department"),
            ("f2", 1, "Revenue"), ("f2", 2, "Begin"), ("f3", 0, "column0"), ("f3", 1, "Équipe"),
            ("f3", 2, "Amount")]
    df = spark.createDataFrame(rows, "file string, pos int, header string")
    got = {(r.file, r.target): r.header for r in joins.resolve_headers(df).collect()}
    assert got[("f1", "department")] == "Dept" and got[("f2", "department")] == "Department"
    assert got[("f1", "start")] == "Start Date" and got[("f2", "start")] == "Begin"
    assert got[("f2", "progress")] == "Revenue" and got[("f3", "progress")] == "Amount"
    best = {r.file: r.header for r in joins.best_header_per_file(df, "show department totals").collect()}
    assert best == {"f1": "Dept", "f2": "Department", "f3": "column0"}


def test_score_histogram_published_counts(spark):
    df = spark.createDataFrame([(s,) for s in [1] * 2 + [3] * 2 + [5] * 6], "score int")
    rows = score_histogram(df, "score").orderBy("score").collect()
    assert [(r.score, r.n) for r in rows] == [(1, 2), (2, 0), (3, 2), (4, 0), (5, 6)]
    assert rows[0].mean_score == pytest.approx(3.8)


def test_grade_keeps_columns(spark):
    df = spark.createDataFrame([(1, "1/2", "0.5")], "id int, p string, g string")
    assert grade(df, "p", "g").columns == ["id", "p", "g", "verdict"]
