"""What runs and stages made, and how two runs differ."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST = "run_id string, stage string, rows_in long, rows_out long, rows_rejected long"


def append_manifest(spark: SparkSession, path: str, run_id: str, stage: str, rows_in: int, rows_out: int, rows_rejected: int) -> None:
    """L2: note the rows of a stage, as counted by an ``Observation`` on its write."""
    spark.createDataFrame([(run_id, stage, rows_in, rows_out, rows_rejected)], MANIFEST).write.mode("append").parquet(path)


def stage_lineage(manifest: DataFrame) -> DataFrame:
    """L2: rows in, out and rejected by run and stage, and rows neither kept nor rejected."""
    sums = manifest.groupBy("run_id", "stage").agg(*[F.sum(c).alias(c) for c in ("rows_in", "rows_out", "rows_rejected")])
    return sums.withColumn("rows_lost", F.col("rows_in") - F.col("rows_out") - F.col("rows_rejected"))


def phase_status(manifest: DataFrame, stages: list[str]) -> DataFrame:
    """L1: rows out by run, a column for each stage; null where a run has none."""
    return manifest.groupBy("run_id").agg(*[F.sum(F.when(F.col("stage") == s, F.col("rows_out"))).alias(s) for s in stages])


def artifact_diff(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """L3: (key, change): keys added, removed, changed and same between two runs, by hashes of their rows.

    A key that repeats is one row of the result, the same if all its rows are. Null is a key as any other. A
    column that one run lacks is null there, so a new column is a change where it holds something.
    """
    columns = sorted({*old.columns, *new.columns} - {key})

    def of(df: DataFrame, name: str) -> DataFrame:
        # JSON leaves out what is null, so a null value and a column that is not there are alike
        row = F.to_json(F.struct(*[F.col(c) for c in columns if c in df.columns])) if len(df.columns) > 1 else F.lit("{}")
        parts = [F.sum(F.xxhash64(F.lit(seed), row).cast("decimal(20,0)")) for seed in (1, 2)]  # in any order of rows
        return df.groupBy(F.col(key).alias(f"{name}_key")).agg(F.struct(F.count(F.lit(1)).alias("n"), *[p.alias(f"h{i}") for i, p in enumerate(parts)]).alias(name))

    a, b = of(old, "old"), of(new, "new")
    both = a.join(b, F.col("old_key").eqNullSafe(F.col("new_key")), "full")
    change = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").when(F.col("old") != F.col("new"), "changed").otherwise("same")
    return both.select(F.when(F.col("old").isNull(), F.col("new_key")).otherwise(F.col("old_key")).alias(key), change.alias("change"))
