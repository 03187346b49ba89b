"""Files in and out: CSV of mixed headers and odd records, Parquet by run, JSON reports."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..functions.names import named, private
from .runs import RUN, read_run, write_run  # noqa: F401

SOURCE_FILE = "source_file"
#: Columns that tell how a record fits the header of its file.
SHAPE, OVERFLOW = "record_shape", "overflow_fields"
#: Files whose beginnings one task reads, and tasks at most.
FILES_TOGETHER, MOST_TASKS = 64, 10_000


def csv_scan(spark: SparkSession, paths: str | Sequence[str], sep: str = ",", multiline: bool = True) -> DataFrame:
    """CSV files as one table of strings, with the file that each row came from and how its record fits the header.

    Spark applies one file's header to all files of a read, by position. So files are grouped by their own
    header, each group is read on its own, and the groups are united by name; columns that a file lacks are
    null. Headers that differ only in case stay apart, with Spark's index appended. Files without a line are left out.

    Records are read by their quotes: a quoted field may hold separators, line breaks and doubled quotes. A record
    with too few fields is ``short`` in ``record_shape`` and null in what it lacks; one with too many is ``long``, and
    ``overflow_fields`` holds the rest in order; one whose quotes can't be matched is ``unclear``. Others are null in
    both. multiline=False takes every line for a record, so that a large file is read by many tasks. The added columns
    get other names, with _ appended, where a file has a column of the same name.
    """
    groups = _by_header(spark, paths)
    if not groups:
        raise FileNotFoundError(f"no file with a header matches {paths}")
    options = {"header": True, "sep": sep, "escape": '"', "multiLine": multiline, "columnPruning": False}
    heads = [spark.read.options(**options).csv(group[0]).columns for group in groups]
    shape, overflow, place, raw = private({c for head in heads for c in head}, SHAPE, OVERFLOW, SOURCE_FILE, "raw_record")
    parts = []
    for group, head in zip(groups, heads, strict=True):
        schema = StructType([StructField(c, StringType()) for c in [*head, raw]])  # raw: only of records that don't fit
        rows = spark.read.schema(schema).options(**options, columnNameOfCorruptRecord=raw).csv(group)
        # Spark reads raw records only together with another column: none of the first one's text goes behind them
        record = F.concat(F.col(raw), F.substring(F.coalesce(named(head[0]), F.lit("")), F.lit(1), F.lit(0)))
        fields, n = record_fields(record, sep), len(head)
        fit = F.when(F.size(fields) < n, "short").when(F.size(fields) > n, "long").otherwise("unclear")
        rest = F.when(F.size(fields) > n, F.slice(fields, n + 1, F.greatest(F.size(fields) - n, F.lit(0))))
        parts.append(rows.select(*map(named, head), F.when(record.isNotNull(), fit).alias(shape), F.when(record.isNotNull(), rest).alias(overflow), F.col("_metadata.file_path").alias(place)))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out.select(*[named(c) for c in out.columns if c not in (shape, overflow, place)], shape, overflow, place)


def record_fields(record: Column, sep: str = ",") -> Column:
    """The fields of a CSV record as an array. Quotes cut it into stretches, and every second one is inside quotes."""
    mark = F.lit("\x1f\x01")
    outside = F.transform(F.split(record, '"', -1), lambda part, i: F.when(i % 2 == 0, F.replace(part, F.lit(sep), mark)).otherwise(part))
    fields = F.split(F.array_join(outside, '"'), "\x1f\x01", -1)
    plain = lambda f: F.when(f.startswith('"') & f.endswith('"') & (F.length(f) > 1), F.replace(F.substring(f, F.lit(2), F.length(f) - 2), F.lit('""'), F.lit('"'))).otherwise(f)
    return F.transform(fields, plain)


def _by_header(spark: SparkSession, paths: str | Sequence[str]) -> list[list[str]]:
    """The files of each header. Executors read the beginnings of the listed files; the driver gets a list of files for each header."""
    listed = spark.read.format("binaryFile").load([paths] if isinstance(paths, str) else list(paths)).where("length > 0").select("path", F.col("_metadata.file_path").alias("uri"))
    some = listed.first()
    if some is None:
        return []
    try:
        pafs.FileSystem.from_uri(some["uri"])
    except (pa.ArrowException, OSError, ValueError):  # a store that only Spark opens: its first lines are found by a pass over the text
        return _grouped(_first_lines(spark, paths))

    def heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [first_record(uri) for uri in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_pydict({"path": batch.column(0), "header": pa.array(found, pa.string())})

    def first_record(uri: str) -> str | None:
        """The first record that is not empty; its quoted fields may hold line breaks."""
        system, place = pafs.FileSystem.from_uri(uri)
        with system.open_input_stream(place) as source:
            text, at, more = b"", 0, True
            while more:
                more = source.read(1 << 16)
                text += more
                end = text.find(b"\n", at)
                while end >= 0 or (not more and at < len(text)):
                    record = text[:end] if end >= 0 else text
                    if not record.strip(b"\r\n\xef\xbb\xbf"):
                        text, at = text[len(record) + 1 :], 0
                    elif record.count(b'"') % 2 == 0 or end < 0:
                        return record.decode("utf-8-sig", "replace").strip("\r\n")
                    else:
                        at = end + 1
                    end = text.find(b"\n", at)
            return None

    to_read = listed.repartition(max(1, min(MOST_TASKS, -(-listed.count() // FILES_TOGETHER))))
    return _grouped(to_read.mapInArrow(heads, "path string, header string").where("header is not null"))


def _first_lines(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    lines = spark.read.text([paths] if isinstance(paths, str) else list(paths))
    place = F.struct(F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("row"))
    return lines.where(F.trim("value") != "").select(F.col("_metadata.file_path").alias("path"), place.alias("place"), "value").groupBy("path").agg(F.min_by("value", "place").alias("header"))


def _grouped(heads: DataFrame) -> list[list[str]]:
    return [r["paths"] for r in heads.groupBy("header").agg(F.sort_array(F.collect_list("path")).alias("paths")).orderBy(F.element_at("paths", 1)).collect()]


def csv_headers(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """(source_file, headers): the columns that each CSV file has itself."""
    out = None
    for group in _by_header(spark, paths):
        columns = spark.read.options(header=True, escape='"', multiLine=True).csv(group[0]).columns
        part = spark.read.format("binaryFile").load(group).select(F.col("_metadata.file_path").alias(SOURCE_FILE), F.array(*map(F.lit, columns)).alias("headers"))
        out = part if out is None else out.unionByName(part)
    return spark.createDataFrame([], f"{SOURCE_FILE} string, headers array<string>") if out is None else out


def write_raw(df: DataFrame, root: str, run_id: str) -> str:
    """Save the ingested table of a run; other runs stay as they are. Returns the table's path."""
    write_run(df, path := f"{root}/stage_01_ingestion/raw.parquet", run_id)
    return path


def write_clean(df: DataFrame, root: str, run_id: str) -> str:
    """Save the standardised table of a run."""
    write_run(df, path := f"{root}/stage_06_standardize/clean.parquet", run_id)
    return path


def read_stage(spark: SparkSession, path: str, run_id: str, version: int | None = None) -> DataFrame:
    """S3: a run's rows of a stage's table, in the schema that the run was written in. The run id is text, whatever it looks like."""
    return read_run(spark, path, run_id, version)


def write_report(report: DataFrame, path: str) -> str:
    """Save a small report as JSON lines."""
    report.coalesce(1).write.mode("overwrite").json(path)
    return path
