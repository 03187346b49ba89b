"""Differences that read only what differs, reports in one scan."""

import random
import re
import shutil
from pathlib import Path

from pyspark.sql import functions as F

from freightlake.operators import digests, lineage, quality
from freightlake.sources import runs


def two_runs(spark, n=600):
    rng = random.Random(14)
    rows = [(k, rng.choice(["a", "b", None]), rng.randrange(50)) for k in range(n)] + [(None, "x", 1), (7, "again", 2)]
    old = spark.createDataFrame(rows, "k int, p string, q int")
    edited = [r if r[0] not in (5, 250) else (r[0], "edited", r[2]) for r in rows if r[0] != 9] + [(10_000, None, 3)]
    new = spark.createDataFrame([(*r, "note" if r[0] == 250 else None) for r in edited], "k int, p string, q int, note string")
    return old, new


def test_only_unlike_buckets_are_read(spark, tmp_path):
    path, (old, new) = str(tmp_path / "t"), two_runs(spark)
    digests.write_digested(old, path, "old", "k", levels=(3, 4))
    digests.write_digested(new, path, "new", "k", levels=(3, 4))
    unlike = digests.unlike_buckets(spark, path, "old", "new", levels=(3, 4))
    assert 1 <= len(unlike) <= 4  # of 128, for four keys
    for folder in Path(f"{path}/rows/data").glob("*/key_bucket=*"):  # what is equal can be gone
        if int(folder.name.split("=")[1]) not in unlike:
            shutil.rmtree(folder)
    got = {r["k"]: (r["change"], r["columns"]) for r in digests.run_difference(spark, path, "old", "new", "k", levels=(3, 4)).collect()}
    assert got == {5: ("changed", ["p"]), 250: ("changed", ["note", "p"]), 9: ("removed", got[9][1]), 10_000: ("added", ["q"])} and "q" in got[9][1]


def test_differences_are_those_of_all_rows(spark, tmp_path):
    path, (old, new) = str(tmp_path / "t"), two_runs(spark, 80)
    for run, df in (("old", old), ("new", new), ("same", old.repartition(3)), ("none", old.limit(0)), ("repeated", old.unionByName(old.where("k = 3")))):
        digests.write_digested(df, path, run, "k", levels=(2,))
    for a, b, x, y in (("old", "new", old, new), ("new", "old", new, old), ("old", "none", old, old.limit(0)), ("none", "none", old.limit(0), old.limit(0)), ("old", "repeated", old, old.unionByName(old.where("k = 3")))):
        got = {(r["k"], r["change"]) for r in digests.run_difference(spark, path, a, b, "k", levels=(2,)).collect()}
        assert got == {(r["k"], r["change"]) for r in lineage.artifact_diff(x, y, "k").where("change <> 'same'").collect()}
    assert digests.run_difference(spark, path, "old", "same", "k", levels=(2,)).count() == 0
    assert digests.unlike_buckets(spark, path, "old", "same", levels=(2,)) == []


def test_partitioned_runs_are_checked(spark, tmp_path):
    path = str(tmp_path / "t")
    runs.write_run(spark.range(50).withColumn("p", F.col("id") % 5), path, "r", ("p",))
    got = runs.read_run(spark, path, "r")
    assert got.columns == ["id", "p", "run_id"] and got.where("p = 2").count() == 10


def scans(df, table):
    df._jdf.queryExecution().executedPlan()
    plan = df._jdf.queryExecution().toString().split("== Physical Plan ==")[1]
    return len(re.findall(rf"FileScan parquet[^\n]*{table}", plan))


def test_each_table_is_scanned_once(spark):
    from freightlake.plans import catalog

    report = catalog.QUERIES["one_scan_report"](spark, "/root/testdata/sf0.001")
    assert (scans(report, "orders.parquet"), scans(report, "lineitem.parquet")) == (1, 1)


def test_compiled_rules_are_the_single_ones(spark):
    rng = random.Random(15)
    parents = spark.createDataFrame([(k, f"2020-01-{1 + k % 28:02}") for k in range(40)] + [(None, "2020-01-01"), (41, None)], "k int, d string").withColumn("d", F.to_date("d"))
    rows = [(rng.choice([None, 1, 2, 3, 44, rng.randrange(60)]), f"2020-01-{rng.randrange(1, 28):02}" if rng.random() > 0.1 else None, rng.choice(["a", "b", "", None])) for _ in range(500)]
    child = spark.createDataFrame(rows, "k int, e string, s string").withColumn("e", F.to_timestamp("e"))
    tables = {"p": parents, "c": child, "none": child.limit(0)}
    rules = [
        quality.OfTable("c", quality.not_null("s")), quality.OfTable("c", quality.accepted_values("s", ["a"])), quality.Unique("c", ("k", "e")), quality.Known("c", "k", "p", "k"), quality.Known("p", "k", "c", "k"),
        quality.Ordered("c", "e", "k", "p", "d", "k"), quality.OfTable("none", quality.not_null("s")), quality.Unique("none", ("k",)), quality.Known("none", "k", "p", "k"), quality.Known("c", "s", "none", "s"),
    ]
    got = sorted((tuple(r) for r in quality.compiled_report(tables, rules).collect()), key=repr)
    met = child.join(parents, "k")
    one = [
        quality.evaluate_policy(child, [rules[0].rule, rules[1].rule]), quality.unique_key(child, ["k", "e"]), quality.foreign_key(child, parents, "k", "k"), quality.foreign_key(parents, child, "k", "k"),
        quality.evaluate_policy(met, [quality.ordering("d", "e")]), quality.evaluate_policy(child.limit(0), [rules[6].rule]), quality.unique_key(child.limit(0), ["k"]), quality.foreign_key(child.limit(0), parents, "k", "k"), quality.foreign_key(child, child.limit(0), "s", "s"),
    ]
    assert got == sorted((tuple(r) for part in one for r in part.collect()), key=repr)
