"""Standardisation of tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import named, private


def map_codes(df: DataFrame, column: str, lookup: DataFrame, code: str, name: str, out: str, unknown: str = "UNKNOWN") -> DataFrame:
    """T4: code values by name through a lookup table; codes that it lacks stay visible as ``unknown``.

    Of several names for a code the least counts.
    """
    known, label = private([*df.columns, out], "code_of", "name_of")
    names = lookup.groupBy(named(code).alias(known)).agg(F.min(named(name)).alias(label))
    joined = df.join(names, named(column) == F.col(known), "left")
    return joined.withColumn(out, F.coalesce(label, F.lit(unknown))).drop(known, label)


def deduplicate(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """T5: the first row of each key in the given order, which should be total.

    The limit of one row runs before the shuffle too, so a frequent key sends one row from each task.
    """
    (rank,) = private(df.columns, "rank")
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(rank) == 1).drop(rank)
