"""What a review of plans and of larger tables found."""

import json

from pyspark.sql import functions as F

from freightlake.operators import contracts, features
from freightlake.plans import catalog


def parses(df):
    return df._jdf.queryExecution().analyzed().toString().count("from_json")


def test_nested_json_is_not_parsed_once_for_each_rule(spark):
    df = spark.createDataFrame([("1", '[{"part":1,"flags":["A"]}]', '{"rank":2}')], "order_id string, lines string, priority string")
    # lines at one go, or level by level (three levels), and the priority
    assert parses(contracts.contract_violations(df, catalog.NESTED, "order_id")) <= 5
    assert parses(contracts.conform(df, catalog.NESTED)) <= 5


def test_json_that_is_parsed_level_by_level_gives_the_same(spark):
    """An item that is no object, or flags that are text, keep the whole value from being parsed at one go."""
    good, odd = {"part": "p", "quantity": 46, "flags": ["A", "x"]}, ["text", None, {"part": 1, "flags": '["Q"]'}, {"part": [1]}]
    df = spark.createDataFrame([(k, json.dumps(v)) for k, v in (("1", [good]), ("2", [good, *odd]), ("3", "[]"))], "order_id string, lines string")
    found = {}
    for r in contracts.contract_violations(df, catalog.NESTED, "order_id").collect():
        found.setdefault(r["key"], set()).add((r["column"], r["reason"], r["value"]))
    first = {("lines[0].part", "cast", "p"), ("lines[0].quantity", "maximum", "46"), ("lines[0].flags[1]", "enum", "x")}
    assert found["1"] == first and found["3"] == {("lines", "cast", '"[]"')}
    assert found["2"] == first | {("lines[1]", "cast", "text"), ("lines[2]", "required", None), ("lines[3].flags[0]", "enum", "Q"), ("lines[4].part", "cast", "[1]")}
    rows = {r["order_id"]: r["n"] for r in contracts.conform(df, catalog.NESTED).select("order_id", F.transform("lines", lambda x: x["flags"]).alias("n")).collect()}
    assert rows == {1: [["A", "x"]], 2: [["A", "x"], None, None, ["Q"], None], 3: None}


def test_rows_of_large_groups_are_not_shuffled_for_their_scale(spark, monkeypatch):
    df = spark.createDataFrame([(k, g, float(k * k % 17)) for k in range(60) for g in ([None, "a"][k % 2 :: 2] if k < 50 else [f"g{k // 2}"])], "k int, g string, x double")
    want = {r["k"]: r["z"] for r in features.scale_features(df, "x", "g").collect()}
    assert "Exchange hashpartitioning" not in features.scale_features(df, "x", "g")._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(features, "FEW_GROUPS", 2)
    monkeypatch.setattr(features, "LARGE_GROUP", 10)
    got = features.scale_features(df, "x", "g").collect()
    assert len(got) == 60 and {r["k"]: r["z"] for r in got} == want


def test_tags_of_a_report_are_made_by_compiled_code(spark):
    plan = catalog.QUERIES["one_scan_report"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "lambda" not in plan and "to_json" not in plan  # both run row by row, and whole numbers need no text


def test_keys_of_a_report_of_any_type(spark):
    from freightlake.operators import quality

    df = spark.createDataFrame([(1, 1, 1, "a"), (1, 1, 1, "a"), (1, 1, None, "a"), (1, None, 1, "a"), (None, 1, 1, "a"), (1, 1, 2, "a"), (1, 1, 1, None), (None, 1, 1, "a")], "a int, b long, c short, s string")
    other = spark.createDataFrame([("1",), ("x",), (None,)], "s string")
    rules = [quality.Unique("t", ("a", "b", "c", "s")), quality.Unique("t", ("c", "b")), quality.Known("t", "a", "o", "s"), quality.Known("o", "s", "t", "b")]
    got = {(r["rule"], r["column"]): (r["checked"], r["failed"]) for r in quality.compiled_report({"t": df, "o": other}, rules).collect()}
    assert got == {("unique", "a,b,c,s"): (8, 2), ("unique", "c,b"): (8, 4), ("foreign_key", "a"): (6, 0), ("foreign_key", "s"): (2, 1)}


def test_difference_of_runs_sees_microseconds_and_hashes_by_compiled_code(spark, tmp_path):
    from freightlake.operators import digests

    old = spark.sql("SELECT id AS k, timestamp'2024-01-01 00:00:00.000001' AS at, CAST(id AS INT) AS n, CAST(id AS STRING) AS s, array(id) AS a FROM range(6)")
    new = old.selectExpr("k", "CASE WHEN k = 1 THEN at + INTERVAL '0.000001' SECOND ELSE at END AS at", "CAST(n AS LONG) AS n", "CASE WHEN k = 2 THEN 'x' ELSE s END AS s", "CASE WHEN k = 3 THEN array(0L) ELSE a END AS a")
    digests.write_digested(old, str(tmp_path), "old", "k")
    digests.write_digested(new, str(tmp_path), "new", "k")
    got = digests.run_difference(spark, str(tmp_path), "old", "new", "k")
    assert sorted(map(tuple, got.collect())) == [(1, "changed", ["at"]), (2, "changed", ["s"]), (3, "changed", ["a"])]
    plan = catalog.QUERIES["run_difference"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "to_json" not in plan
