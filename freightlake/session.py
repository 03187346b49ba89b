"""The session that tests, the bench and local runs use."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | str = 8, shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session with the settings that the results rely on: UTC, ANSI and AQE."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("freightlake")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def scratch_dir(spark: SparkSession) -> str:
    """A folder that driver and executors share: under spark.checkpoint.dir, or, where that is unset, a temporary one of a local master."""
    place = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not place and not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return f"{(place or f'file://{tempfile.gettempdir()}').rstrip('/')}/freightlake-{uuid.uuid4().hex}"


def saved(df: DataFrame) -> DataFrame:
    """df, written to the shared folder and read back, so that it is not computed again."""
    path = scratch_dir(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
