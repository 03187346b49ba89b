"""Tables by run with a commit log.

A write puts its files in a folder of its own and then adds one entry to the log: the run, the version, the schema and
where its files are listed. Only an entry makes files count, so a reader sees a run whole, in the schema that it was
written in, as it was before or after a write; what a lost or repeated write leaves behind is never read.
"""

from __future__ import annotations

import json
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, DoubleType, IntegralType, LongType, NumericType, StringType, StructType

from ..functions.names import named

RUN = "run_id"
LOG = "run_id string, version long, commit_id string, schema string, rows long, files long, bytes long"


class DamagedRun(Exception):
    """Files of a run are missing, added or changed since it was written."""


def _folder(path: str, commit: str) -> str:
    return f"{path}/data/{commit}"


def _listing(spark: SparkSession, folder: str) -> DataFrame:
    """(file, bytes) below a folder; no content is read."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", True).load(folder).select(F.substring_index("path", f"/{folder.rsplit('/', 1)[1]}/", -1).alias("file"), F.col("length").alias("bytes"))


def stage_log(spark: SparkSession, path: str) -> DataFrame:
    """Every entry of a table's log, with ``columns`` (name:type, in order) and whether it is its run's ``latest``.

    Of two writes of a run at a time both are kept as one version, and that of the larger commit id is the latest.
    """
    log = spark.read.schema(LOG).json(f"{path}/log")
    last = Window.partitionBy(RUN).orderBy(F.desc("version"), F.desc("commit_id"))
    fields = F.from_json(F.get_json_object("schema", "$.fields"), "array<struct<name:string,type:string>>")
    return log.withColumn("columns", F.transform(fields, lambda f: F.concat_ws(":", f["name"], f["type"]))).withColumn("latest", F.row_number().over(last) == 1)


def write_run(df: DataFrame, path: str, run_id: str, partition_by: tuple[str, ...] = ()) -> int:
    """Write a run, in place of what it held; other runs stay as they are. Returns its version, from 1.

    A column run_id of df is replaced by the run's. A table without rows is a run too. Columns of partition_by, which
    filters on them prune, come last when the run is read.
    """
    spark, commit = df.sparkSession, uuid.uuid4().hex
    body = df.drop(RUN)
    body = body.select(*[named(c) for c in body.columns if c not in partition_by], *map(named, partition_by))
    body.write.partitionBy(*partition_by).parquet(_folder(path, commit))
    files = _listing(spark, _folder(path, commit))
    files.write.parquet(f"{path}/files/{commit}")
    told = spark.read.parquet(f"{path}/files/{commit}").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("b")).first()
    rows = spark.read.schema(body.schema).parquet(_folder(path, commit)).count()  # from the files' footers
    version = 1 + (_entries(spark, path, run_id).agg(F.max("version")).first()[0] or 0)
    entry = spark.createDataFrame([(run_id, version, commit, body.schema.json(), rows, told["n"], told["b"])], LOG)
    entry.coalesce(1).write.mode("append").json(f"{path}/log")  # the write counts from here on
    return version


def _entries(spark: SparkSession, path: str, run_id: str | None = None) -> DataFrame:
    try:
        log = stage_log(spark, path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        log = spark.createDataFrame([], f"{LOG}, columns array<string>, latest boolean")
    return log if run_id is None else log.where(F.col(RUN) == run_id)


def read_run(spark: SparkSession, path: str, run_id: str, version: int | None = None, check: bool = True) -> DataFrame:
    """The rows of a run in its own schema, with run_id last; the latest version unless one is named.

    A run that was never written has neither rows nor other columns. check: raise DamagedRun unless the files are
    those that were written, by name and size.
    """
    entries = _entries(spark, path, run_id)
    entry = (entries.where("latest") if version is None else entries.where(F.col("version") == version)).orderBy(F.desc("commit_id")).first()
    if entry is None:
        return spark.createDataFrame([], f"{RUN} string")
    if check:
        there = _listing(spark, _folder(path, entry["commit_id"])).select(F.col("file").alias("of"), F.col("bytes").alias("now"))
        known = spark.read.schema("file string, bytes long").parquet(f"{path}/files/{entry['commit_id']}")
        odd = known.join(there, F.col("file") == F.col("of"), "full").where(~F.col("bytes").eqNullSafe(F.col("now"))).limit(5).collect()
        if odd:
            raise DamagedRun(f"run {run_id}, version {entry['version']}: {[r['file'] or r['of'] for r in odd]} are not as they were written")
    schema = StructType.fromJson(json.loads(entry["schema"]))
    return spark.read.schema(schema).parquet(_folder(path, entry["commit_id"])).withColumn(RUN, F.lit(run_id))


def _common(kinds: list[DataType]) -> DataType:
    """The type that columns of several runs are read in: equal types stay, numbers meet as long or double, others as text."""
    if all(k == kinds[0] for k in kinds):
        return kinds[0]
    if all(isinstance(k, IntegralType) for k in kinds):
        return LongType()
    return DoubleType() if all(isinstance(k, NumericType) for k in kinds) else StringType()


def read_runs(spark: SparkSession, path: str, run_ids: list[str] | None = None) -> DataFrame:
    """Several runs (all, unless named) as one table: a column that a run lacks is null there, unlike types meet as ``_common`` says."""
    runs = sorted(r[RUN] for r in _entries(spark, path).where("latest").select(RUN).collect()) if run_ids is None else run_ids
    parts = [read_run(spark, path, r) for r in runs] or [spark.createDataFrame([], f"{RUN} string")]
    kinds: dict[str, list[DataType]] = {}
    for part in parts:
        for f in part.schema.fields:
            kinds.setdefault(f.name, []).append(f.dataType)
    one = {name: _common(found) for name, found in kinds.items()}
    parts = [p.select(*[named(f.name).cast(one[f.name]).alias(f.name) for f in p.schema.fields]) for p in parts]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out.select(*[named(c) for c in out.columns if c != RUN], RUN)


def vacuum(spark: SparkSession, path: str) -> int:
    """Remove the files of versions that are no longer a run's latest; returns how many versions went. Readers of them end."""
    gone = 0
    for entry in _entries(spark, path).where("not latest").select("commit_id").toLocalIterator():
        place = spark._jvm.org.apache.hadoop.fs.Path(_folder(path, entry["commit_id"]))
        gone += bool(place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True))
    return gone
