"""What became of every row of a stage, and where a row of its result came from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.names import named, private
from .contracts import Contract, quarantine
from .standardize import deduplicate

#: The column that tells where a row is stored: the file and its place there.
ROW_ID = "row_id"


def with_row_id(df: DataFrame) -> DataFrame:
    """A table of Parquet files with ``row_id``, the same in every run; rows that are equal differ in it. Replaces a column of that name."""
    place = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    return df.select(*[named(c) for c in df.columns if c.lower() != ROW_ID], place.alias(ROW_ID))


def decided(rows: DataFrame, contract: Contract, keys: list[str], order: list[Column], shape: str | None = None) -> tuple[DataFrame, DataFrame]:
    """L2: (result, decisions) of rows with a row_id: quarantine by the contract, then the first row of each key.

    result: the kept rows with their row_id. decisions: (row_id, decision, reasons, kept_as), exactly one for every row:
    ``rejected`` with the reasons, ``duplicate`` with the row_id that stands for it, or ``kept``. ``order`` should be total;
    ties are broken by where rows are stored. Null keys are keys as any other.
    """
    good, bad = quarantine(rows, contract, shape)
    (reasons,) = [c for c in bad.columns if c not in good.columns]
    result = deduplicate(good, keys, [*order, F.asc(ROW_ID)])
    kept, *of = private(rows.columns, "kept_as", *[f"{k}_of" for k in keys])
    names = result.select(F.col(ROW_ID).alias(kept), *[named(k).alias(o) for k, o in zip(keys, of, strict=True)])
    same = F.lit(True)
    for k, o in zip(keys, of, strict=True):
        same &= named(k).eqNullSafe(F.col(o))
    met = good.join(names, same).select(ROW_ID, F.col(kept).alias("kept_as"))
    none = F.lit(None).cast("array<string>")
    stayed = met.select(ROW_ID, F.when(F.col(ROW_ID) == F.col("kept_as"), "kept").otherwise("duplicate").alias("decision"), none.alias("reasons"), "kept_as")
    fell = bad.select(ROW_ID, F.lit("rejected").alias("decision"), named(reasons).alias("reasons"), F.lit(None).cast(rows.schema[ROW_ID].dataType).alias("kept_as"))
    return result, stayed.unionByName(fell)


def traced(result: DataFrame, decisions: DataFrame, raw: DataFrame) -> DataFrame:
    """The rows of ``raw`` (with row_id) that each row of the result stands for: its own and its duplicates, with ``kept_as`` and ``decision``."""
    (at,) = private(raw.columns, "decided_row")
    of = decisions.where("kept_as is not null").join(result.select(F.col(ROW_ID).alias("kept_as")), "kept_as", "left_semi").select(F.col(ROW_ID).alias(at), "kept_as", "decision")
    return raw.join(of, F.col(ROW_ID) == F.col(at)).drop(at)
