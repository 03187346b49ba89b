"""Null groups, names that clash, and heavy keys, over the operators of tables."""

import random

import pytest
from pyspark.sql import Column
from pyspark.sql import functions as F

from freightlake.operators import commercial, features, finance, kpi, marts, profile, quality, standardize
from freightlake.operators.quantiles import exact_quantiles
from freightlake.operators.ranking import global_prefix, prefix_sums

#: Names that operators might use for columns of their own.
ODD = ["rank", "__rank", "month", "__month", "entity_of", "month_of", "n", "last", "number", "previous", "before", "day", "on", "total", "mid", "part", "row", "start", "weight", "spread", "group_of", "mean", "sd", "code_of", "name_of", "then", "key_of", "g", "v", "i", "e", "t", "s"]


@pytest.fixture(scope="module")
def table(spark):
    rng = random.Random(8)
    rows = [(k, rng.choice(["hot"] * 5 + ["b", None]), f"2020-0{rng.randrange(1, 5)}-1{rng.randrange(9)} 0{rng.randrange(9)}:30:00" if rng.random() > 0.05 else None, None if rng.random() < 0.1 else rng.randrange(100, 9000) / 100) for k in range(300)]
    df = spark.createDataFrame(rows, "k int, who string, ts string, amount double").withColumn("ts", F.to_timestamp("ts"))
    return df.select("*", *[F.concat(F.lit(f"{name}-"), F.col("k")).alias(name) for name in ODD]).repartition(4).cache()


CASES = {
    "gap_features": lambda df: features.gap_features(df, "who", "ts", "k"),
    "rolling_features": lambda df: features.rolling_features(df, "who", "ts", "amount"),
    "rolling_range": lambda df: features.rolling_range(df, "who", "ts", "amount", 7200),
    "scale_features": lambda df: features.scale_features(df, "amount", "who"),
    "running_balance": lambda df: finance.running_balance(df, "who", "ts", "k", "amount"),
    "deduplicate": lambda df: standardize.deduplicate(df, ["k"], [F.asc("ts")]),
    "map_codes": lambda df: standardize.map_codes(df, "who", df.sparkSession.createDataFrame([("b", "B")], "code string, name string"), "code", "name", "found"),
    "global_prefix": lambda df: global_prefix(df.drop("row", "before", "total"), "amount", "k", weight="amount"),
}


@pytest.mark.parametrize("name", CASES)
def test_rows_and_columns_stay(table, name):
    got = CASES[name](table)
    kept = [c for c in table.columns if c in got.columns and c not in ("row", "before", "total")]
    assert len(kept) >= len(table.columns) - 3 and len({c.lower() for c in got.columns}) == len(got.columns)
    assert sorted(map(repr, got.select(*kept).collect())) == sorted(map(repr, table.select(*kept).collect()))


@pytest.mark.parametrize("name", [n for n in CASES if n != "map_codes"])
def test_nothing_gives_nothing(table, name):
    assert CASES[name](table.limit(0)).count() == 0


def test_null_groups_are_checked(spark):
    df = spark.createDataFrame([(None, float(x)) for x in (1, 2, 3, 4, 1000)] + [("a", float(x)) for x in (1, 2, 3, 4, 5)], "q1 string, high double")
    row = quality.iqr_outlier(df, "high", "q1").first()
    assert (row["checked"], row["failed"]) == (10, 1)


def test_sums_of_null_dimensions_and_months(spark):
    df = spark.createDataFrame([("2020-01-05", "a", 3.0), ("2020-03-05", None, 7.0), (None, "a", 2.0)], "d string, month string, x double").withColumn("d", F.to_timestamp("d"))
    got = {(str(r[0]), r[1]): r[2] for r in marts.summary_mart(df.withColumnRenamed("month", "kind"), "d", "kind", {"sum": F.sum("x")}).collect()}
    assert got == {("2020-01-01", "a"): 3, ("2020-02-01", "a"): 0, ("2020-03-01", "a"): 0, ("2020-01-01", None): 0, ("2020-02-01", None): 0, ("2020-03-01", None): 7, ("None", "a"): 2}
    assert marts.summary_mart(df.withColumnRenamed("month", "kind").limit(0), "d", "kind", {"sum": F.sum("x")}).count() == 0


def test_null_customers_are_one(spark):
    df = spark.createDataFrame([(None, "2020-01-05"), (None, "2020-02-05"), ("a", "2020-02-01")], "m string, d string").withColumn("d", F.to_timestamp("d"))
    assert {tuple(r) for r in commercial.cohort_retention(df, "m", "d").collect()} == {(24241, 0, 1), (24241, 1, 1), (24242, 0, 1)}


def test_changes_of_odd_dimensions(spark):
    df = spark.sql("SELECT date'2020-01-01' AS period, 'x' AS then, 1 AS month_index, 2D AS value UNION ALL SELECT date'2021-01-01', 'x', 1, 3D")
    got = kpi.kpi_period_change(df, ["then", "month_index"])
    assert got.columns == ["period", "then", "month_index", "value", "prior", "change", "relative_change"] and {r["prior"] for r in got.collect()} == {None, 2.0}


def test_ties_of_text_are_cut(spark):
    """One value in 90 % of the rows, ties of text, rows that are equal in all: no part holds many rows."""
    df = spark.range(6000).select(F.when(F.col("id") % 10 > 0, 7).otherwise(F.col("id")).alias("v"), F.when(F.col("id") % 3 == 0, "same").otherwise(F.concat(F.lit("t"), F.col("id"))).alias("t"), F.lit(2).alias("w"))
    got = global_prefix(df, "v", "t", weight="w", rows_together=200)
    df.createOrReplaceTempView("tied_texts")
    want = spark.sql("SELECT v, t, row_number() OVER (ORDER BY v, t) AS row, coalesce(sum(w) OVER (ORDER BY v, t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM tied_texts")
    assert sorted(map(tuple, got.select("v", "t", "row", "before").collect())) == sorted(map(tuple, want.collect()))
    placed = prefix_sums(df, [(F.col("v"), Column.asc)], rows_together=200)
    assert placed.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0] <= 1500


def test_ranges_of_time_as_a_window_has_them(spark):
    """An entity with most rows, most of them within one range; equal times, null times and amounts; microseconds."""
    rng = random.Random(9)
    rows = [(k, rng.choice(["hot"] * 6 + ["a", None]), None if rng.random() < 0.05 else rng.choice([1_600_000_000.0, 1_600_000_000 + rng.randrange(9) / 1e6, 1_600_000_000 + rng.random() * 30_000]), None if rng.random() < 0.2 else rng.randrange(1, 9999) / 100) for k in range(900)]
    df = spark.createDataFrame(rows, "k int, who string, ts double, x double").withColumn("ts", F.timestamp_micros(F.round(F.col("ts") * 1_000_000).cast("long"))).repartition(5)
    df.createOrReplaceTempView("moments")
    want = spark.sql("SELECT k, count(1) OVER r, CAST(sum(CAST(x AS DECIMAL(18,2))) OVER r AS DOUBLE) FROM moments WINDOW r AS (PARTITION BY who ORDER BY ts RANGE BETWEEN INTERVAL 2500 SECONDS PRECEDING AND CURRENT ROW)")
    got = features.rolling_range(df, "who", "ts", "x", 2500).select("k", "rolling_count", "rolling_sum")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_quantiles_of_any_spread(spark):
    """Values over hundreds of magnitudes, equal ones, negative ones and a group of one: brackets narrow down for all."""
    v = F.when(F.col("id") % 4 == 0, F.pow(F.lit(1.13), F.col("id") % 5000)).when(F.col("id") % 4 == 1, -F.pow(F.lit(0.9), F.col("id") % 4000)).when(F.col("id") % 4 == 2, F.lit(1.0)).otherwise(F.col("id").cast("double"))
    df = spark.range(40_000).select(F.when(F.col("id") % 3 > 0, "big").when(F.col("id") == 0, "one").otherwise(None).alias("g"), v.alias("v"))
    probs = [0.0, 0.001, 0.25, 0.5, 0.75, 0.999, 1.0]
    want = {r["g"]: r["q"] for r in df.groupBy("g").agg(F.percentile("v", F.array(*map(F.lit, probs))).alias("q")).collect()}
    got = {r["g"]: list(r)[2:] for r in exact_quantiles(df, "v", "g", probs, 10).collect()}
    assert got.keys() == want.keys() and all(got[g] == pytest.approx(want[g], rel=1e-12) for g in want)


def test_sketches_of_parts_make_the_whole(spark):
    df = spark.range(20_000).select((F.col("id") * 7919 % 10_007).cast("double").alias("x"), F.when(F.col("id") % 4 > 0, F.col("id") % 50).alias("a b"), F.lit(None).cast("double").alias("none"))
    parts = [profile.profile_sketch(df.where(f"x % 3 = {i}"), df.columns) for i in range(3)] + [profile.profile_sketch(df.limit(0), df.columns)]
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    twice = profile.merge_sketches(profile.merge_sketches(whole))
    got = {r["column"]: r for r in profile.profile_of_sketches(twice).collect()}
    want = {c: profile.profile_numeric(df.select(F.col(f"`{c}`").alias("c")), ["c"]).first() for c in df.columns}
    for c in df.columns:
        for f in ("rows", "nulls", "least", "largest", "mean"):
            assert got[c][f] == want[c][f], (c, f)
        if c != "none":
            assert got[c]["sd"] == pytest.approx(want[c]["sd"], rel=1e-6) and abs(got[c]["distinct"] / want[c]["distinct"] - 1) < 0.04
            for q, p in (("q1", 0.25), ("median", 0.5), ("q3", 0.75)):
                low, high = df.agg(F.avg((F.col(f"`{c}`") < got[c][q]).cast("double")), F.avg((F.col(f"`{c}`") <= got[c][q]).cast("double"))).first()
                assert low <= p + 0.01 and high >= p - 0.01
    assert got["none"]["median"] is None and got["none"]["distinct"] == 0
