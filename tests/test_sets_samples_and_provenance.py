"""Retention by bitmaps, samples and proposals of columns, decisions of rows."""

import hashlib
import random
from collections import Counter
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from freightlake.operators import commercial, contracts, headers, provenance, retention, samples


@pytest.fixture(scope="module")
def orders(spark):
    """Customers of many ranges of numbers, null customers and null times, many orders a day."""
    rng = random.Random(16)
    rows = [(rng.choice([None, *range(40)]), (date(2020, 1, 1) + timedelta(rng.randrange(500))).isoformat() if rng.random() > 0.03 else None) for _ in range(900)]
    return spark.createDataFrame(rows, "who int, ts string").withColumn("ts", F.to_timestamp("ts")).withColumnRenamed("who", "number").repartition(4).cache()


def test_months_as_pairs_of_sets(orders):
    want = {tuple(r) for r in commercial.cohort_retention(orders.where("ts is not null"), "number", "ts").collect()}
    assert {tuple(r) for r in retention.month_retention(orders, "number", "ts").collect()} == want
    assert retention.month_retention(orders.limit(0), "number", "ts").count() == 0


def test_windows_of_days(orders):
    rows = [(r["number"], r["ts"].date()) for r in orders.collect() if r["ts"]]
    day, last, want = min(d for _, d in rows), max(d for _, d in rows), []
    while day <= last:
        before = {c for c, d in rows if day - timedelta(44) < d <= day}
        after = {c for c, d in rows if day < d <= day + timedelta(44)}
        want.append((day, len(before), len(after), len(before & after)))
        day += timedelta(17)
    got = retention.rolling_retention(orders, "number", "ts", days=44, step=17)
    assert sorted(map(tuple, got.collect())) == want
    assert retention.rolling_retention(orders.where("ts is null"), "number", "ts").count() == 0


def test_sets_beyond_one_bitmap(spark):
    rows = spark.range(1, 70_001).select((F.col("id") % 2).alias("period"), F.col("id").alias("number"))
    sets = retention.numbered_sets(rows)
    assert sets.count() == 6 and {tuple(r) for r in retention.sizes(sets).collect()} == {(0, 35_000), (1, 35_000)}
    windows = spark.createDataFrame([(9, 0), (9, 1)], "window long, period long")
    whole = retention.window_sets(sets, windows)
    assert {tuple(r) for r in retention.sizes(whole).collect()} == {(9, 70_000)}
    pairs = spark.createDataFrame([(9, 1)], "a long, b long")
    assert [tuple(r) for r in retention.both(whole, sets, pairs).collect()] == [(9, 1, 35_000)]


def smallest(values, k):
    return sorted({v.strip() for v in values if v and v.strip()}, key=lambda v: (hashlib.md5(("s" + v).encode()).hexdigest(), v))[:k]


def test_samples_are_the_same_however_they_are_cut(spark):
    rng = random.Random(17)
    rows = [(rng.choice(["x"] * 9 + [f"v{rng.randrange(200)}", "é", " x ", "", None]), rng.choice([None, 3, 4])) for _ in range(500)]
    df = spark.createDataFrame(rows, "`a b` string, n int")
    want = {("a b", v) for v in smallest([r[0] for r in rows], 8)} | {("n", "3"), ("n", "4")}
    whole = samples.sample_columns(df, ["a b", "n"], 8)
    parts = [samples.sample_columns(df.where(c), ["a b", "n"], 8) for c in ("n = 3", "n = 4", "n is null")]
    merged = samples.merge_samples(samples.merge_samples(parts[0].unionByName(parts[1]), 8).unionByName(parts[2]), 8)
    for got in (whole, samples.sample_columns(df.repartition(7), ["a b", "n"], 8), merged):
        assert {(r["header"], r["value"]) for r in got.collect()} == want
    assert samples.sample_columns(df.limit(0), ["n"]).count() == 0 and samples.sample_columns(df, []).count() == 0


def test_overlaps_of_samples(spark):
    of = lambda h, values: samples.sample_columns(spark.createDataFrame([(str(v),) for v in values], f"`{h}` string"), [h], 16)
    a, b = range(0, 300), range(100, 300)
    got = {(r["a"], r["b"]): r["overlap"] for r in samples.overlaps(of("a", a), of("b", b).unionByName(of("c", range(900, 950))), 16).collect()}
    union = smallest(map(str, {*a, *b}), 16)
    mine, theirs = smallest(map(str, a), 16), smallest(map(str, b), 16)
    assert got == {("a", "b"): sum(v in mine and v in theirs for v in union) / 16}


def test_proposals(spark):
    known = headers.NameMap({"order_id": ("order id",), "city": ("town",)})
    df = spark.createDataFrame([("1", "Bonn", "z"), ("2", "Köln", "z")], "`Order-No` string, place string, other string")
    mapped = spark.createDataFrame([("1", "Bonn"), ("2", "Köln"), ("3", "Ulm")], "order_id string, town string")
    got = {(r["header"], r["proposal"]): (r["name_likeness"], r["value_overlap"]) for r in samples.alias_proposals(df, known, mapped, least=0.2).collect()}
    assert got.keys() == {("Order-No", "order_id"), ("place", "city")} and got[("place", "city")] == (0.0, 0.666667)
    assert samples.name_likeness("Order ID", "order_id") == 1 and samples.name_likeness("a", "b") < 0.5
    assert samples.alias_proposals(df.select("other"), known, mapped, ignore=("other",)).count() == 0


def test_every_row_has_one_decision(spark, tmp_path):
    rng = random.Random(18)
    rows = [(rng.choice([None, "1", "2", "x", "3", "3", "3"]), rng.choice(["a", "b", None]), rng.randrange(4), "mine") for _ in range(200)] + [("3", "a", 1, "mine")] * 3
    spark.createDataFrame(rows, "id string, kind string, at int, reasons string").repartition(3).write.parquet(str(tmp_path / "t"))
    raw = provenance.with_row_id(spark.read.parquet(str(tmp_path / "t")))
    contract = contracts.Contract.from_json_schema({"required": [], "properties": {"id": {"type": "integer"}, "kind": {"type": "string"}, "at": {"type": "integer"}, "reasons": {"type": "string"}}})
    result, decisions = provenance.decided(raw, contract, ["id", "kind"], [F.desc("at")])
    found, ids = decisions.collect(), [r["row_id"] for r in raw.collect()]
    assert Counter(r["row_id"] for r in found) == Counter(ids) and len(ids) == len(set(ids)) == len(rows)
    told = Counter(r["decision"] for r in found)
    good = [r for r in rows if r[0] != "x"]
    assert told == {"rejected": len(rows) - len(good), "kept": len({r[:2] for r in good}), "duplicate": len(good) - len({r[:2] for r in good})}
    assert all((r["reasons"] == ["id:cast"]) == (r["decision"] == "rejected") for r in found)
    best = {}
    for r in good:
        best[r[:2]] = max(best.get(r[:2], -1), r[2])
    assert {(r["id"], r["kind"]): r["at"] for r in result.collect()} == best and "reasons" in result.columns
    back = provenance.traced(result.where("id = '3' and kind = 'a'"), decisions, raw)
    assert back.count() == sum(r[:2] == ("3", "a") for r in rows) and back.where("decision = 'kept'").count() == 1
    none, nothing = provenance.decided(raw.limit(0), contract, ["id"], [F.desc("at")])
    assert none.count() == 0 and nothing.count() == 0
