"""Op 4, sharding: a two-pass external shuffle, with DataFrame functions only.

Pass one scatters the records, whole, into buckets that fit in memory, by a seeded hash of where each record
is stored. Pass two shuffles each bucket (Spark's ``shuffle`` is a seeded Fisher-Yates shuffle of an array) and
writes the buckets one after the other, so each record moves once. Shards are equal stretches of that order.
"""

from __future__ import annotations

import math
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, named, shared_dir, table

#: A bucket's share of the records' bytes, and that of the buckets that one task shuffles and writes.
BUCKET_BYTES, TASK_BYTES = 2 << 20, 32 << 20
#: Beyond so many tasks each gets more buckets instead.
MOST_TASKS = 20_000
#: Buckets whose counts one prefix sum adds up.
BUCKETS_TOGETHER = 1024


def stored_address() -> list[Column]:
    """Where a row of a table of files is stored: the same in every attempt of a task."""
    return [F.col("_metadata.file_path"), F.col("_metadata.row_index")]


def _begins(counts: DataFrame) -> DataFrame:
    """(bucket, begin): how many rows the buckets before hold, by prefix sums inside parts of buckets and over the parts."""
    counts = counts.withColumn("part", F.floor(F.col("bucket") / BUCKETS_TOGETHER))
    inside = Window.partitionBy("part").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    over = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = counts.groupBy("part").agg(F.sum("count").alias("total")).select("part", F.coalesce(F.sum("total").over(over), F.lit(0)).alias("before"))
    return counts.withColumn("inside", F.coalesce(F.sum("count").over(inside), F.lit(0))).join(parts, "part").select("bucket", (F.col("inside") + F.col("before")).alias("begin"))


def shuffle_into_shards(records: DataFrame, n_shards: int, size: str = "size", seed: int = 20, address: list[Column] | None = None, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """All rows of ``records`` in a random order, cut into ``n_shards``: its columns, ``shard`` and ``slot``.

    ``size`` names the column with a row's bytes. ``address`` tells rows apart, in every attempt alike; without
    it the records are written to the shared folder first and are told apart by their place there. Equal rows
    have different addresses, so no row that repeats often fills one bucket. Shards hold counts at most one
    apart and slots are gapless from 0. Nulls are values as any other; an empty table gives no rows. Columns
    named shard or slot are replaced. Columns of map type can't be sorted and are refused by Spark.
    """
    cols = [c for c in records.columns if c.lower() not in ("shard", "slot")]
    if address is None:
        records, address = cut(records, "records"), stored_address()
    sums = records.agg(F.sum(named(size)[0]).alias("b"), F.count(F.lit(1)).alias("n")).first()
    total, n = sums["b"] or 0, sums["n"]
    n_buckets = max(1, math.ceil(total / bucket_bytes))
    together = max(1, round(max(TASK_BYTES, total / MOST_TASKS) / bucket_bytes))
    key = F.xxhash64(F.lit(seed), *address)
    place = F.struct(key.alias("key"), *[a.alias(f"a{i}") for i, a in enumerate(address)])
    packed = records.select(place.alias("place"), F.struct(*named(*cols)).alias("row")).withColumn("bucket", F.pmod("place.key", F.lit(n_buckets)))
    scattered = packed.select("bucket", F.lit(None).cast("long").alias("begin"), F.struct("place", "row").alias("item"))
    begins = _begins(packed.groupBy("bucket").count())  # reads no column of the records
    both = scattered.unionByName(begins.withColumn("item", F.lit(None).cast(scattered.schema["item"].dataType)))
    # neighbouring buckets go to one task, each with a row that tells where it begins
    dealt = both.withColumn("task", F.floor(F.col("bucket") / together)).repartition(math.ceil(n_buckets / together), "task")
    buckets = dealt.groupBy("task", "bucket").agg(F.max("begin").alias("begin"), F.array_sort(F.collect_list("item")).alias("items"))
    shuffled = buckets.sortWithinPartitions("task", "bucket").select("begin", F.posexplode(F.shuffle("items", F.lit(seed))).alias("pos", "item"))
    at, (least, more) = F.col("begin") + F.col("pos"), divmod(n, n_shards)
    long_rows = more * (least + 1)  # in the shards with one row more
    shard = F.when(at < long_rows, F.floor(at / (least + 1))).otherwise(more + F.floor((at - long_rows) / max(least, 1)))
    slot = F.when(at < long_rows, F.pmod(at, F.lit(least + 1))).otherwise(F.pmod(at - long_rows, F.lit(max(least, 1))))
    return shuffled.select("item.row.*", shard.cast("int").alias("shard"), slot.cast("long").alias("slot"))


def write_shards(sharded: DataFrame, path: str) -> None:
    """Write each shard as a folder of files that hold stretches of its slots in order; rows stay in the tasks that they are in."""
    sharded.sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, whole, written in 40 shards under the law ``rows``; returned is what the written shards hold.

    A null text has no bytes (size 16) and the checksum of nothing, 0.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    size = (F.octet_length(text) + 16).cast("long")
    records = table(spark, sf_dir, "documents").withColumns({"doc_id": F.col("doc_id").cast("long"), "size": size})
    sharded = shuffle_into_shards(records, n_shards=40, address=stored_address())
    path = f"{shared_dir(spark)}/shards-{uuid.uuid4().hex}"
    write_shards(sharded, path)
    return spark.read.schema(sharded.schema).parquet(path).select(
        "doc_id", size.alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
