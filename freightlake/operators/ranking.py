"""Ranks and running sums over a whole table, without a window over all of it."""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import named, private
from ..session import saved

#: Rows of a part of the order.
ROWS_TOGETHER = 50_000


def prefix_sums(df: DataFrame, order: list[tuple[Column, Callable[[Column], Column]]], sums: Mapping[str, str] | None = None, rows_together: int = ROWS_TOGETHER) -> DataFrame:
    """df with ``row`` (from 1), ``total_rows`` and, for each (name, column) of sums, ``before_<name>`` and ``total_<name>``.

    order: expressions with their directions, such as ``Column.desc_nulls_last``. A sample sort: the rows are cut into parts by ranges of the whole order, ties of any type included, and rows equal
    in all of it by where they are stored. The number of parts grows with the rows, so none holds many, however
    often a value comes. Rows are numbered as they lie in their part; sums run inside parts; the parts' totals, one
    row for each, give where a part begins. A column of df is replaced if it has the name of a new one.
    """
    sums = dict(sums or {})
    new = {"row", "total_rows", *[f"{kind}_{name}".lower() for name in sums for kind in ("before", "total")]}
    mid, part, place, first, start, own, tie = private([*df.columns, *new], "mid", "part", "part_of", "first_mid", "rows_before", "weight", "spread")
    kept = [c for c in df.columns if c.lower() not in new]
    rows = saved(df.select(*map(named, kept), *[named(c).alias(f"{own}_{i}") for i, c in enumerate(sums.values())], *[c.alias(f"{tie}_{i}") for i, (c, _) in enumerate(order)]))
    spread = F.xxhash64(F.col("_metadata.file_path"), F.col("_metadata.row_index"))
    parts = max(1, math.ceil(rows.count() / rows_together))
    keys = [*[direction(F.col(f"{tie}_{i}")) for i, (_, direction) in enumerate(order)], F.col(tie)]
    rows = rows.withColumn(tie, spread).repartitionByRange(parts, *keys).sortWithinPartitions(*keys).drop(tie, *[f"{tie}_{i}" for i in range(len(order))])
    rows = saved(rows.withColumn(mid, F.monotonically_increasing_id())).withColumn(part, F.shiftrightunsigned(mid, 33))
    ends = rows.groupBy(F.col(part).alias(place)).agg(F.count(F.lit(1)).alias("n"), F.min(mid).alias(first), *[F.sum(f"{own}_{i}").alias(f"{place}_{i}") for i in range(len(sums))])
    earlier, every = Window.orderBy(place).rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    zero = lambda c, over: F.coalesce(F.sum(c).over(over), F.lit(0))
    begins = ends.select(place, first, zero("n", earlier).alias(start), F.sum("n").over(every).alias("total_rows"), *[f(f"{place}_{i}").alias(name) for i in range(len(sums)) for f, name in ((lambda c: zero(c, earlier), f"{start}_{i}"), (lambda c: F.sum(c).over(every), f"{first}_{i}"))])
    inside = Window.partitionBy(part).orderBy(mid).rowsBetween(Window.unboundedPreceding, -1)
    for i in range(len(sums)):
        rows = rows.withColumn(f"{mid}_{i}", zero(F.col(f"{own}_{i}"), inside))
    out = rows.join(begins, F.col(part) == F.col(place))
    return out.select(
        *map(named, kept), (F.col(start) + F.col(mid) - F.col(first) + 1).alias("row"), "total_rows",
        *[x for i, name in enumerate(sums) for x in ((F.col(f"{start}_{i}") + F.col(f"{mid}_{i}")).alias(f"before_{name}"), F.col(f"{first}_{i}").alias(f"total_{name}"))],
    )


def global_prefix(df: DataFrame, value: str, tie: str, weight: str | None = None, descending: bool = False, rows_together: int = ROWS_TOGETHER) -> DataFrame:
    """df with ``row`` (from 1), ``total_rows`` and, for a weight, ``before`` and ``total`` (its sums), in order of value, then tie.

    Null values come last. A column of df is replaced if it has the name of a new one.
    """
    order = [(named(value), Column.desc_nulls_last if descending else Column.asc_nulls_last), (named(tie), Column.asc_nulls_first)]
    out = prefix_sums(df, order, {} if weight is None else {"weight": weight}, rows_together)
    if weight is None:
        return out
    return out.drop(*[c for c in out.columns if c.lower() in ("before", "total")]).withColumnsRenamed({"before_weight": "before", "total_weight": "total"})


def ntile(row: Column, total: Column, tiles: int) -> Column:
    """SQL's ntile of a row (from 1) among total rows."""
    small, extra = F.floor(total / tiles), total % tiles
    return F.when(row <= extra * (small + 1), F.floor((row - 1) / (small + 1)) + 1).otherwise(extra + F.floor((row - 1 - extra * (small + 1)) / F.greatest(small, F.lit(1))) + 1).cast("int")
