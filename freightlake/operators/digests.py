"""Differences of runs by a tree of digests, so that what is equal is not read.

A run is written in buckets of its keys. A digest of rows is a sum of their hashes, so that of a node is the sum of its
children's, whatever the order of rows. Two runs are compared from the root down: only the children of unlike nodes
are looked at, and only the files of unlike buckets are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DateType, NumericType, StringType, TimestampNTZType, TimestampType

from ..functions.names import named, private
from ..sources.runs import RUN, read_run, write_run

#: Bits of a bucket's number at each level of the tree, from the root's children down.
LEVELS = (4, 4)
BUCKET = "key_bucket"
DIGEST = "decimal(38,0)"


def _bucket(key: str, bits: int) -> Column:
    return F.shiftrightunsigned(F.xxhash64(F.lit(7), named(key).cast("string")), 64 - bits).cast("int")


def _hashes(rows: DataFrame, *columns: str) -> list[Column]:
    """Two numbers of a row's columns; a null and a column that is not there are alike.

    A value counts as its text and whether that is a number, so that runs may hold it in other types; times to the microsecond.
    """
    parts = []
    for c in columns:
        kind, value = rows.schema[c].dataType, named(c)
        plain = isinstance(kind, (BooleanType, DateType, NumericType, StringType, TimestampNTZType, TimestampType))
        mark = "number" if isinstance(kind, NumericType) else "boolean" if isinstance(kind, BooleanType) else "text" if plain else "json"
        text = value.cast("string") if plain else F.when(value.isNotNull(), F.to_json(F.struct(value.alias("v"))))
        parts += [F.when(value.isNotNull(), F.lit(f"{c}:{mark}")), text]  # hashes pass over nulls
    return [F.xxhash64(F.lit(seed), *parts) for seed in (1, 2)]


def _sums(name: str, hashes: list[Column]) -> list[Column]:
    """Sums of hashes; their halves are added up as longs, which is far cheaper than decimals."""
    high, low = (lambda h: F.sum(F.shiftright(h, 32)).cast(DIGEST)), (lambda h: F.sum(h.bitwiseAND(F.lit(0xFFFFFFFF))).cast(DIGEST))
    return [(high(h) * F.lit(1 << 32) + low(h)).cast(DIGEST).alias(f"{name}{i}") for i, h in enumerate(hashes)]


def write_digested(df: DataFrame, path: str, run_id: str, key: str, levels: tuple[int, ...] = LEVELS) -> int:
    """Write a run in buckets of its key with the tree of its digests; returns the run's version.

    16 bits of levels at most, 65,536 buckets. A column key_bucket of df is replaced.
    """
    if not 0 < sum(levels) <= 16:
        raise ValueError("levels must have 1 to 16 bits together")
    body = df.drop(RUN, BUCKET)
    columns = sorted(c for c in body.columns if c != key)
    version = write_run(body.withColumn(BUCKET, _bucket(key, sum(levels))).repartition(BUCKET), f"{path}/rows", run_id, (BUCKET,))
    rows = read_run(df.sparkSession, f"{path}/rows", run_id, version, check=False)
    leaves = rows.groupBy(F.col(BUCKET).alias("node")).agg(F.count(F.lit(1)).alias("n"), *_sums("h", _hashes(rows, key, *columns))).withColumn("level", F.lit(len(levels)))
    tree, now, left = leaves, leaves, list(levels)
    while left:  # sums of sums: few rows each
        now = now.groupBy(F.shiftright("node", left.pop()).alias("node")).agg(F.sum("n").alias("n"), F.sum("h0").cast(DIGEST).alias("h0"), F.sum("h1").cast(DIGEST).alias("h1")).withColumn("level", F.lit(len(left)))
        tree = tree.unionByName(now)
    write_run(tree.withColumn("version", F.lit(version)), f"{path}/digests", run_id, ("level",))
    return version


def unlike_buckets(spark: SparkSession, path: str, old: str, new: str, levels: tuple[int, ...] = LEVELS) -> list[int]:
    """The buckets in which two runs differ, found from the root down."""
    trees = [read_run(spark, f"{path}/digests", run).select("level", "node", *[F.col(c).alias(f"{c}_{k}") for c in ("n", "h0", "h1")]) for k, run in enumerate((old, new))]
    nodes = [0]
    for level in range(len(levels) + 1):
        if level:
            nodes = [(x << levels[level - 1]) + i for x in nodes for i in range(1 << levels[level - 1])]
        a, b = (t.where((F.col("level") == level) & F.col("node").isin(nodes)).drop("level") for t in trees)
        same = F.lit(True)
        for c in ("n", "h0", "h1"):
            same &= F.col(f"{c}_0").eqNullSafe(F.col(f"{c}_1"))
        nodes = sorted(r["node"] for r in a.join(b, "node", "full").where(~same).select("node").collect())
        if not nodes:
            break
    return nodes


def run_difference(spark: SparkSession, path: str, old: str, new: str, key: str, levels: tuple[int, ...] = LEVELS) -> DataFrame:
    """L3: (key, change, columns) of every key that was added, removed or changed between two digested runs.

    columns: those that changed, in order; all that hold something for an added or removed key. A key that repeats is one
    row, changed if its rows are not the same ones; null is a key as any other. A column that one run lacks is null there.
    Only the files of unlike buckets are read.
    """
    sides = [read_run(spark, f"{path}/rows", run, check=False).drop(RUN) for run in (old, new)]
    kind = next((s.schema[key].dataType.simpleString() for s in sides if key in s.columns), "string")
    buckets = unlike_buckets(spark, path, old, new, levels)
    columns = sorted({c for s in sides for c in s.columns} - {key, BUCKET})
    if not buckets or any(key not in s.columns for s in sides):
        missing = [s for s in sides if key in s.columns]
        if not buckets or not missing:
            return spark.createDataFrame([], "change string, columns array<string>").select(F.lit(None).cast(kind).alias(key), "change", "columns")
    old_key, new_key, one, two = private([key, *columns], "old_key", "new_key", "old_row", "new_row")

    def of(side: DataFrame, k: str, row: str) -> DataFrame:
        rows = side.where(F.col(BUCKET).isin(buckets)) if BUCKET in side.columns else side
        own = named(key) if key in side.columns else F.lit(None).cast(kind)
        held = lambda c: F.struct(*_sums("h", _hashes(side, *([c] if c in side.columns else []))), (F.count(named(c)) if c in side.columns else F.lit(0).cast("long")).alias("held"))
        whole = _sums("row", _hashes(side, *[c for c in columns if c in side.columns]))
        return rows.groupBy(own.alias(k)).agg(F.struct(F.count(F.lit(1)).alias("n"), *whole, *[held(c).alias(f"c{i}") for i, c in enumerate(columns)]).alias(row))

    both = of(sides[0], old_key, one).join(of(sides[1], new_key, two), F.col(old_key).eqNullSafe(F.col(new_key)), "full")
    a, b = F.col(one), F.col(two)
    unlike = [F.when(F.when(a.isNull(), b[f"c{i}"]["held"] > 0).when(b.isNull(), a[f"c{i}"]["held"] > 0).otherwise((a[f"c{i}"]["h0"] != b[f"c{i}"]["h0"]) | (a[f"c{i}"]["h1"] != b[f"c{i}"]["h1"])), F.lit(c)) for i, c in enumerate(columns)]
    moved = (a["n"] != b["n"]) | (a["row0"] != b["row0"]) | (a["row1"] != b["row1"])
    change = F.when(a.isNull(), "added").when(b.isNull(), "removed").when(moved, "changed")
    names = F.array_compact(F.array(*unlike)) if unlike else F.array().cast("array<string>")
    return both.select(F.when(a.isNull(), F.col(new_key)).otherwise(F.col(old_key)).alias(key), change.alias("change"), names.alias("columns")).where("change is not null")
