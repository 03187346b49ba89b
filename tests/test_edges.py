"""What the driver's tables don't hold: odd files, bad values, nulls, ties and empty tables."""

import random

import pytest
from pyspark.sql import functions as F

from freightlake.functions import scalars
from freightlake.operators import contracts, features, finance, headers, kpi, lineage, profile, quality, standardize
from freightlake.operators.quantiles import exact_quantiles
from freightlake.operators.ranking import global_prefix, ntile
from freightlake.sources import files

NAMES = headers.NameMap({"order_id": ("order id",), "created_at": ("created",)}, critical=("order_id", "created_at"))


def test_swapped_columns_and_provenance(spark, tmp_path):
    (tmp_path / "a.csv").write_text("order_id,created_at\n007,1.50\n")
    (tmp_path / "b.csv").write_text("created_at,order_id,extra\n2024-01-01,8,x\n")
    got = {tuple(r) for r in files.csv_scan(spark, f"{tmp_path}/*.csv").select("order_id", "created_at", "extra", F.element_at(F.split("source_file", "/"), -1)).collect()}
    assert got == {("007", "1.50", None, "a.csv"), ("8", "2024-01-01", "x", "b.csv")}


def test_no_file(spark, tmp_path):
    (tmp_path / "x.txt").write_text("")
    with pytest.raises(Exception):
        files.csv_scan(spark, f"{tmp_path}/*.csv")


def test_headers_of_many_spellings(spark):
    df = spark.createDataFrame([("", "5", "x"), ("3", "4", None)], ["﻿Order ID", "order_id", "other"])
    assert [r["order_id"] for r in headers.map_headers(df, NAMES).collect()] == ["5", "3"]
    assert headers.map_headers(df, NAMES).columns == ["order_id", "created_at"]
    report = {r["column"]: (r["present"], r["filled"]) for r in headers.critical_column_report(df.withColumn("f", F.lit("f")), NAMES, "f").collect()}
    assert report == {"order_id": (True, 2), "created_at": (False, 0)}
    assert [tuple(r) for r in headers.unmapped_header_report(df, NAMES).collect()] == [("other", 2, 1, "x", "x")]
    assert headers.unmapped_header_report(df.drop("other"), NAMES).count() == 0


def test_contract_types():
    c = contracts.Contract.from_json_schema({"title": "t", "properties": {"a": {"type": ["integer", "null"]}, "b": {"type": "array", "items": {"type": "number"}}, "c": {"type": "object", "properties": {"d": {"type": "boolean"}}}, "e": {"type": "string", "format": "date-time"}}})
    assert c.types == {"a": "bigint", "b": "array<double>", "c": "struct<d:boolean>", "e": "timestamp"}


def test_contract_rows(spark):
    c = contracts.Contract("t", {"id": "bigint", "day": "date", "note": "string"}, ("id",))
    df = spark.createDataFrame([("1", "2024-02-30"), (None, "x"), ("y", None), ("4", "2024-02-29")], "id string, day string")
    assert [tuple(map(str, r)) for r in contracts.conform(df, c).collect()] == [("1", "None", "None"), ("None", "None", "None"), ("None", "None", "None"), ("4", "2024-02-29", "None")]
    good, bad = contracts.quarantine(df, c)
    assert good.count() == 1 and sorted(r["reasons"] for r in bad.collect()) == [["day:cast"], ["day:cast", "id:required"], ["id:cast"]]
    assert contracts.contract_violations(df, c, "id").count() == 4


def test_runs_are_text_and_replace_only_themselves(spark, tmp_path):
    root, df = str(tmp_path), spark.createDataFrame([(1,), (2,)], "x int")
    path = files.write_raw(df, root, "007")
    files.write_raw(df, root, "7")
    files.write_raw(df.where("x = 1"), root, "007")
    assert [tuple(r) for r in files.read_stage(spark, path, "007").collect()] == [(1, "007")]
    assert files.read_stage(spark, path, "7").count() == 2


def test_times_and_numbers(spark):
    formats = ["yyyy-MM-dd HH:mm:ss", "dd/MM/yyyy"]
    texts = [("2024-01-02 03:04:05",), ("31/12/2023",), ("02/03/2024",), ("2024-02-30",), (None,)]
    got = [str(r[0]) for r in spark.createDataFrame(texts, "t string").select(scalars.parse_timestamp(F.col("t"), formats)).collect()]
    assert got == ["2024-01-02 03:04:05", "2023-12-31 00:00:00", "2024-03-02 00:00:00", "None", "None"]
    numbers = [("1,234.50",), (" 7 ",), ("",), ("x",), ("١٢",)]
    got = [r[0] and float(r[0]) for r in spark.createDataFrame(numbers, "t string").select(scalars.parse_number(F.col("t"))).collect()]
    assert got == [1234.5, 7.0, None, None, 12.0]
    assert spark.createDataFrame([("  A \n B ",)], "t string").select(scalars.normalize_text(F.col("t"))).first()[0] == "a b"


def test_rules_on_nulls_and_nothing(spark):
    df = spark.createDataFrame([(None, 1.0), ("a", None), ("b", 5.0)], "s string, x double")
    rules = [quality.not_null("s"), quality.accepted_values("s", ["a"]), quality.in_range("x", 0, 2), quality.pattern("s", "^a")]
    assert [(r["checked"], r["failed"]) for r in quality.evaluate_policy(df, rules).collect()] == [(3, 1), (2, 1), (2, 1), (2, 1)]
    none = quality.evaluate_policy(df.limit(0), rules).collect()
    assert all(r["checked"] == 0 and r["pass_rate"] == 1.0 and r["status"] == "pass" for r in none)
    assert quality.unique_key(df.limit(0), ["s"]).first()["checked"] == 0
    assert quality.foreign_key(df, df.limit(0), "s", "s").first()["failed"] == 2


def test_codes_and_latest_rows(spark):
    lookup = spark.createDataFrame([("F", "full")], "c string, n string")
    df = spark.createDataFrame([("F", 1), ("Z", 2), (None, 3)], "s string, x int")
    assert sorted(r["o"] for r in standardize.map_codes(df, "s", lookup, "c", "n", "o").collect()) == ["UNKNOWN", "UNKNOWN", "full"]
    lookup = spark.createDataFrame([("F", "full"), ("F", "final"), ("F", "found")], "c string, n string")
    assert sorted(r["o"] for r in standardize.map_codes(df, "s", lookup, "c", "n", "o").collect()) == ["UNKNOWN", "UNKNOWN", "final"]
    ties = spark.createDataFrame([(1, 5, "b"), (1, 5, "a"), (2, 1, "c")], "k int, t int, v string")
    assert sorted(tuple(r) for r in standardize.deduplicate(ties, ["k"], [F.desc("t"), F.asc("v")]).collect()) == [(1, 5, "a"), (2, 1, "c")]


def test_equal_values_have_no_spread(spark):
    df = spark.createDataFrame([("a", 2.0), ("a", 2.0), ("b", 1.0)], "g string, x double")
    assert {r["z"] for r in features.scale_features(df, "x", "g").collect()} == {0.0}


def test_changes_over_a_gap(spark):
    df = spark.sql("SELECT date'2020-01-01' AS period, 'r' AS measure, 0D AS value UNION ALL SELECT date'2021-01-01', 'r', 4D UNION ALL SELECT date'2021-03-01', 'r', 2D")
    got = {str(r["period"]): (r["prior"], r["relative_change"]) for r in kpi.kpi_period_change(df, ["measure"]).collect()}
    assert got == {"2020-01-01": (None, None), "2021-01-01": (0.0, None), "2021-03-01": (None, None)}


def test_histories_as_one_window_has_them(spark):
    """An entity with most rows, others with few, null entities, times and amounts, ties in time."""
    rng = random.Random(4)
    day = lambda: None if rng.random() < 0.05 else f"20{rng.randrange(19, 23)}-{rng.randrange(1, 13):02}-{rng.randrange(1, 29):02} {rng.randrange(24):02}:00:00"
    rows = [(k, rng.choice(["hot"] * 6 + ["a", "b", None]), day(), None if rng.random() < 0.1 else rng.randrange(1, 10_000) / 100) for k in range(800)]
    df = spark.createDataFrame(rows, "k int, e string, t string, x double").withColumn("t", F.to_timestamp("t")).repartition(5)
    df.createOrReplaceTempView("history")
    want = spark.sql("""SELECT k, row_number() OVER w AS sequence, datediff(to_date(t), to_date(lag(t) OVER w)) AS days_since,
        CAST(sum(CAST(x AS DECIMAL(18,2))) OVER (PARTITION BY e ORDER BY t, k ROWS UNBOUNDED PRECEDING) AS DOUBLE) AS running_total,
        CAST(sum(CAST(x AS DECIMAL(18,2))) OVER (PARTITION BY e, year(t) ORDER BY t, k ROWS UNBOUNDED PRECEDING) AS DOUBLE) AS year_to_date,
        count(1) OVER r AS rolling_count, CAST(sum(CAST(x AS DECIMAL(18,2))) OVER r AS DOUBLE) AS rolling_sum
        FROM history WINDOW w AS (PARTITION BY e ORDER BY t, k), r AS (PARTITION BY e ORDER BY datediff(to_date(t), date'1970-01-01') RANGE BETWEEN 30 PRECEDING AND CURRENT ROW)""").collect()
    for got in (features.gap_features(df, "e", "t", "k"), finance.running_balance(df, "e", "t", "k", "x"), features.rolling_features(df, "e", "t", "x")):
        new = [c for c in got.columns if c not in df.columns]
        assert len(new) == 2 and set(got.columns) == {*df.columns, *new}
        assert {r["k"]: tuple(r[c] for c in new) for r in got.collect()} == {r["k"]: tuple(r[c] for c in new) for r in want}


def test_null_keys_meet(spark):
    left = spark.createDataFrame([("a", 1.0), (None, 2.0), (None, 3.0)], "k string, x double")
    right = spark.createDataFrame([(None, 5.5), ("b", 1.0)], "k string, y double")
    got = {r["k"]: (r["left_total"], r["right_total"], r["status"]) for r in finance.reconcile(left, right, "k", "x", "y").collect()}
    assert got == {"a": (1.0, None, "missing_right"), "b": (None, 1.0, "missing_left"), None: (5.0, 5.5, "match")}
    kpis = spark.sql("SELECT date'2020-01-01' AS period, CAST(NULL AS STRING) AS region, 2D AS value UNION ALL SELECT date'2021-01-01', NULL, 3D")
    assert {r["prior"] for r in kpi.kpi_period_change(kpis, ["region"]).collect()} == {None, 2.0}


def test_ranks_over_many_buckets(spark):
    df = spark.range(5000).select(F.col("id").alias("k"), (F.col("id") * 7919 % 1000).alias("v"))
    got = global_prefix(df, "v", "k", weight="v", rows_together=100).withColumn("t", ntile(F.col("row"), F.col("total_rows"), 7))
    df.createOrReplaceTempView("ranked")
    want = spark.sql("SELECT k, row_number() OVER w AS row, coalesce(sum(v) OVER (ORDER BY v, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, ntile(7) OVER w AS t FROM ranked WINDOW w AS (ORDER BY v, k)")
    assert sorted(map(tuple, got.select("k", "row", "before", "t").collect())) == sorted(map(tuple, want.collect()))


def test_profiles_of_nulls(spark):
    df = spark.createDataFrame([(None,), (1.0,)], "x double")
    row = profile.profile_numeric(df, ["x"]).first()
    assert (row["rows"], row["nulls"], row["distinct"]) == (2, 1, 1)


def test_differences_of_nulls(spark):
    a = spark.createDataFrame([(1, None, "x"), (2, "y", None)], "k int, p string, q string")
    b = spark.createDataFrame([(1, "x", None), (2, "y", None), (3, None, None)], "k int, p string, q string")
    assert sorted(map(tuple, lineage.artifact_diff(a, b, "k").collect())) == [(1, "changed"), (2, "same"), (3, "added")]


def test_ranks_of_one_value_in_most_rows(spark):
    df = spark.range(5000).select(F.col("id").alias("k"), F.when(F.col("id") % 10 > 0, 7).when(F.col("id") % 20 == 0, F.col("id")).alias("v"))
    df.createOrReplaceTempView("tied")
    for down in (False, True):
        got = global_prefix(df, "v", "k", weight="k", descending=down, rows_together=100)
        order = f"v {'DESC' if down else 'ASC'} NULLS LAST, k"
        want = spark.sql(f"SELECT k, row_number() OVER (ORDER BY {order}) AS row, coalesce(sum(k) OVER (ORDER BY {order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM tied")
        assert sorted(map(tuple, got.select("k", "row", "before").collect())) == sorted(map(tuple, want.collect()))


def test_quantiles_by_bracket(spark):
    df = spark.range(30_000).select((F.col("id") % 3).alias("g"), F.when(F.col("id") % 3 == 2, 5.0).otherwise((F.col("id") * 7919 % 10007).cast("double")).alias("v"))
    df = df.unionByName(spark.createDataFrame([(None, 1.0), (None, 2.0), (9, None), (8, 4.0)], "g long, v double"))
    probs = [0.0, 0.25, 0.5, 0.9, 1.0]
    want = {r["g"]: r["q"] for r in df.groupBy("g").agg(F.percentile("v", F.array(*map(F.lit, probs))).alias("q")).collect() if r["q"]}
    for most in (20, 300, 10_000):  # with passes and without
        got = {r["g"]: list(r)[2:] for r in exact_quantiles(df, "v", "g", probs, most).collect()}
        assert got.keys() == want.keys() and all(got[g] == pytest.approx(want[g]) for g in want)
    assert exact_quantiles(df.limit(0), "v", "g", probs).count() == 0


def test_differences_of_schemas_and_repeated_keys(spark):
    a = spark.createDataFrame([(1, "x", "o"), (None, "n", None), (2, "r", None), (2, "s", None), (4, "t", None)], "k int, p string, gone string")
    b = spark.createDataFrame([(1, "x", None), (None, "n", None), (2, "s", None), (2, "r", None), (4, "t", 5)], "k int, p string, new int")
    got = {r["k"]: r["change"] for r in lineage.artifact_diff(a, b, "k").collect()}
    assert got == {1: "changed", None: "same", 2: "same", 4: "changed"}
    assert {r["change"] for r in lineage.artifact_diff(a, b.limit(0), "k").collect()} == {"removed"}


def test_presence_by_file(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Order ID,created\n1,2024-01-01\n2,\n")
    (tmp_path / "b.csv").write_text("\norder_id\n3\n")
    (tmp_path / "c.csv").write_text("created,order-id\n")
    (tmp_path / "empty.csv").write_text("")
    paths = f"{tmp_path}/*.csv"
    raw = files.csv_scan(spark, paths)
    assert raw.count() == 3
    report = headers.critical_column_report(raw, NAMES, files.SOURCE_FILE, files.csv_headers(spark, paths)).collect()
    got = {(r["source_file"][-5:], r["column"]): (r["present"], r["rows"], r["filled"], r["fill_rate"]) for r in report}
    assert got == {
        ("a.csv", "order_id"): (True, 2, 2, 1.0), ("a.csv", "created_at"): (True, 2, 1, 0.5), ("b.csv", "order_id"): (True, 1, 1, 1.0),
        ("b.csv", "created_at"): (False, 1, 0, 0.0), ("c.csv", "order_id"): (True, 0, 0, None), ("c.csv", "created_at"): (True, 0, 0, None),
    }


def test_scaled_values_of_no_group(spark):
    df = spark.createDataFrame([(None, 1.0), (None, 3.0), ("a", 2.0)], "g string, x double")
    assert sorted(r["z"] for r in features.scale_features(df, "x", "g").collect()) == [-0.707107, 0.0, 0.707107]
