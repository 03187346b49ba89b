"""Runs with their own schemas, records that do not fit their header, contracts with arrays and objects."""

import csv
import gzip
import io
import random

import pytest
from pyspark.sql import functions as F

from freightlake.operators import contracts
from freightlake.sources import files, runs


def rows_of(df, *columns):
    return sorted((tuple(r) for r in (df.select(*columns) if columns else df).collect()), key=repr)


# runs


def test_a_run_keeps_its_own_schema(spark, tmp_path):
    root = str(tmp_path)
    path = files.write_raw(spark.createDataFrame([(1, "x")], "a int, b string"), root, "zz")
    files.write_raw(spark.createDataFrame([("p",)], "a string"), root, "aa")
    got = files.read_stage(spark, path, "zz")
    assert got.columns == ["a", "b", "run_id"] and rows_of(got) == [(1, "x", "zz")]
    assert rows_of(files.read_stage(spark, path, "aa")) == [("p", "aa")]
    assert files.read_stage(spark, path, "none").count() == 0
    both = runs.read_runs(spark, path)
    assert both.columns == ["a", "b", "run_id"] and rows_of(both) == [("1", "x", "zz"), ("p", None, "aa")]


def test_versions_and_readers_during_a_write(spark, tmp_path):
    path, one = str(tmp_path / "t"), spark.createDataFrame([(1,), (2,)], "x int")
    assert runs.write_run(one, path, "r") == 1
    before = runs.read_run(spark, path, "r")
    # files without an entry in the log, as a write that has not ended or was lost leaves them
    one.write.parquet(f"{path}/data/unfinished")
    assert rows_of(runs.read_run(spark, path, "r")) == [(1, "r"), (2, "r")]
    assert runs.write_run(spark.createDataFrame([(2.5, None)], "x double, run_id string"), path, "r") == 2
    assert rows_of(before) == [(1, "r"), (2, "r")]  # planned before the second write
    assert rows_of(runs.read_run(spark, path, "r")) == [(2.5, "r")] and rows_of(runs.read_run(spark, path, "r", version=1)) == [(1, "r"), (2, "r")]
    assert rows_of(runs.stage_log(spark, path), "version", "rows", "columns", "latest") == [(1, 2, ["x:integer"], False), (2, 1, ["x:double"], True)]
    assert runs.vacuum(spark, path) == 1
    assert rows_of(runs.read_run(spark, path, "r")) == [(2.5, "r")]


def test_damage_of_a_run_is_found(spark, tmp_path):
    path = str(tmp_path / "t")
    runs.write_run(spark.range(10).repartition(2), path, "r")
    file = next(f for f in (tmp_path / "t/data").rglob("*.parquet"))
    file.unlink()
    with pytest.raises(runs.DamagedRun):
        runs.read_run(spark, path, "r")


def test_runs_of_nothing_and_of_nested_types(spark, tmp_path):
    path = str(tmp_path / "t")
    runs.write_run(spark.createDataFrame([], "a int, b array<struct<c:string>>"), path, "empty")
    got = runs.read_run(spark, path, "empty")
    assert got.dtypes == [("a", "int"), ("b", "array<struct<c:string>>"), ("run_id", "string")] and got.count() == 0
    runs.write_run(spark.createDataFrame([(7,)], "a bigint"), path, "wide")
    assert dict(runs.read_runs(spark, path).dtypes)["a"] == "bigint"


# CSV records


def test_records_of_any_shape(spark, tmp_path):
    (tmp_path / "a.csv").write_text('﻿id,note,x\n1,"two\nlines, and ""more""",c\n2\n3,c,d,EXTRA,"q, ""r""",""\n4,,\n"5",e,"f\n\ng"\n')
    (tmp_path / "b.csv").write_text('x,"a ""b"", c",id\n9,8,7,6\n')
    (tmp_path / "c.csv").write_text('\n\n"head\nin two",id\nv,1\n')
    got = rows_of(files.csv_scan(spark, f"{tmp_path}/*.csv"), "id", "note", "x", "record_shape", "overflow_fields")
    assert got == sorted([
        ("1", 'two\nlines, and "more"', "c", None, None), ("2", None, None, "short", None), ("3", "c", "d", "long", ["EXTRA", 'q, "r"', ""]), ("4", None, None, None, None),
        ("5", "e", "f\n\ng", None, None), ("7", None, "9", "long", ["6"]), ("1", None, None, None, None),
    ], key=repr)
    scan = files.csv_scan(spark, f"{tmp_path}/a.csv")
    assert rows_of(scan, "record_shape", "id") == sorted([(None, "1"), ("short", "2"), ("long", "3"), (None, "4"), (None, "5")], key=repr)  # whatever columns are read
    assert scan.groupBy("record_shape").count().count() == 3
    heads = {r["source_file"][-5:]: r["headers"] for r in files.csv_headers(spark, f"{tmp_path}/*.csv").collect()}
    assert heads == {"a.csv": ["id", "note", "x"], "b.csv": ["x", 'a "b", c', "id"], "c.csv": ["head\nin two", "id"]}


def test_names_that_clash_and_packed_files(spark, tmp_path):
    with gzip.open(tmp_path / "a.csv.gz", "wt") as f:
        f.write("Record_Shape,source_file,raw_record\n1,2,3,4\n")
    scan = files.csv_scan(spark, f"{tmp_path}/*")
    assert scan.columns == ["Record_Shape", "source_file", "raw_record", "record_shape_", "overflow_fields", "source_file_"]
    assert rows_of(scan, "Record_Shape", "source_file", "raw_record", "record_shape_") == [("1", "2", "3", "long")]


def test_records_as_python_reads_them(spark, tmp_path):
    rng, want = random.Random(6), []
    text = lambda: "".join(rng.choice(["a", "é", " ", ",", '"', "\n", ";", "\\"]) for _ in range(rng.randrange(8)))
    for k in range(5):
        out = io.StringIO()
        w = csv.writer(out, lineterminator="\n", quoting=csv.QUOTE_ALL)
        w.writerow(["k", "a", "b"])
        for i in range(60):
            row = [f"{k}-{i}", *[text() for _ in range(rng.choice([0, 1, 2, 2, 2, 3, 4]))]]
            w.writerow(row)
            want.append((row[0], "short" if len(row) < 3 else "long" if len(row) > 3 else None, row[3:] if len(row) > 3 else None))
        (tmp_path / f"{k}.csv").write_text(out.getvalue())
    assert rows_of(files.csv_scan(spark, f"{tmp_path}/*.csv"), "k", "record_shape", "overflow_fields") == sorted(want, key=repr)


def test_stores_that_only_spark_opens(spark, tmp_path, monkeypatch):
    (tmp_path / "a.csv").write_text("id,x\n1,2\n")
    (tmp_path / "b.csv").write_text("x,id\n3,4\n")

    def refuse(uri):
        raise OSError(uri)

    monkeypatch.setattr(files, "pafs", type("None", (), {"FileSystem": type("F", (), {"from_uri": staticmethod(refuse)})}))
    assert rows_of(files.csv_scan(spark, f"{tmp_path}/*.csv"), "id", "x") == [("1", "2"), ("4", "3")]


# contracts

SCHEMA = {
    "title": "t", "required": ["id", "items"], "properties": {
        "id": {"type": "integer", "minimum": 1, "exclusiveMaximum": 9},
        "items": {"type": "array", "minItems": 1, "items": {"type": "object", "required": ["sku", "price"], "properties": {
            "sku": {"type": "string", "pattern": "^[A-Z]"}, "price": {"type": "number", "minimum": 0}, "tags": {"type": "array", "items": {"type": "string", "enum": ["a", "b"]}}}}},
        "to": {"type": "object", "required": ["city"], "properties": {"city": {"type": "string"}, "zip code": {"type": ["integer", "null"]}}},
        "s": {"type": ["string", "null"], "enum": ["x", "y", None]},
    },
}
NESTED = [
    ("1", '[{"sku":"A","price":"1.5","tags":["a","c"]},{"sku":"b","price":-2},{"price":"x"}]', '{"city":"B","zip code":"1x"}', "x"), ("0", "[]", '{"zip code":5}', "z"),
    ("3", "not json", "[1]", None), ("4", None, "5", "y"), ("9", '[{"sku":"A","price":1,"tags":7},null,[2]]', "", ""), ("8", ' [{"sku":"Ab","price":0.5,"more":1}]', '{"city":"c"}', "y"),
]
FOUND = {
    ("1", "items[0].tags[1]", "enum", "c"), ("1", "items[1].sku", "pattern", "b"), ("1", "items[1].price", "minimum", "-2"), ("1", "items[2].sku", "required", None), ("1", "items[2].price", "cast", "x"), ("1", "to.zip code", "cast", "1x"),
    ("0", "id", "minimum", "0"), ("0", "items", "minItems", "0"), ("0", "to.city", "required", None), ("0", "s", "enum", "z"), ("3", "items", "cast", "not json"), ("3", "to", "cast", "[1]"), ("4", "items", "required", None), ("4", "to", "cast", "5"),
    ("9", "id", "exclusiveMaximum", "9"), ("9", "items[0].tags", "cast", "7"), ("9", "items[1]", "required", None), ("9", "items[2]", "cast", "[2]"),
}


def test_nested_contracts_by_path(spark):
    c = contracts.Contract.from_json_schema(SCHEMA)
    df = spark.createDataFrame(NESTED, "id string, items string, to string, s string")
    got = contracts.contract_violations(df, c, "id").collect()
    assert {tuple(r) for r in got} == FOUND and len(got) == len(FOUND)
    typed = contracts.conform(df, c)
    assert typed.dtypes == [("id", "bigint"), ("items", "array<struct<sku:string,price:double,tags:array<string>>>"), ("to", "struct<city:string,zip code:bigint>"), ("s", "string")]
    first = typed.where("id = 1").first()
    assert [tuple(x) for x in first["items"]] == [("A", 1.5, ["a", "c"]), ("b", -2.0, None), (None, None, None)] and tuple(first["to"]) == ("B", None)
    assert rows_of(typed.where("items is null"), "id") == [(3,), (4,)]
    good, bad = contracts.quarantine(df, c)
    assert rows_of(good, "id") == [("8",)] and bad.count() == 5
    again = {(r["key"], r["column"]) for r in contracts.contract_violations(typed, c, "id").collect()}  # of columns that hold arrays and structs
    assert ("1", "items[1].sku") in again and ("9", "items[1]") in again


def test_records_of_odd_shape_are_rejected(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,reasons\n1,mine\n2\n3,a,b\nx,c\n")
    c = contracts.Contract.from_json_schema({"required": ["id"], "properties": {"id": {"type": "integer"}, "reasons": {"type": "string"}}})
    good, bad = contracts.quarantine(files.csv_scan(spark, str(tmp_path)), c, shape=files.SHAPE)
    assert rows_of(good, "id", "reasons") == [("1", "mine")]
    assert rows_of(bad, "id", "reasons", "reasons_") == [("2", None, ["record:shape"]), ("3", "a", ["record:shape"]), ("x", "c", ["id:cast"])]


def test_the_plainest_contract(spark):
    c = contracts.Contract.from_json_schema({"title": "Orders", "type": "object", "properties": {"order_id": {"type": "string"}, "created_at": {"type": "string"}}})
    df = spark.createDataFrame([("1", None), (None, "")], "order_id string, created_at string")
    assert contracts.contract_violations(df, c, "order_id").count() == 0 and contracts.conform(df, c).count() == 2
    assert contracts.quarantine(df.limit(0), c)[0].withColumn("n", F.lit(1)).count() == 0
