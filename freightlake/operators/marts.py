"""Tables for reporting."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.names import named, private
from ..session import saved


def build_fact(fact: DataFrame, dimensions: list[tuple[DataFrame, str, str, str]]) -> DataFrame:
    """B1: a fact joined to (dimension, fact key, dimension key, kind of join) in turn. Spark broadcasts what is small."""
    return reduce(lambda df, d: df.join(d[0], df[d[1]] == d[0][d[2]], d[3]), dimensions, fact)


def date_dimension(df: DataFrame, ts: str) -> DataFrame:
    """B2: every day from the first to the last, with its calendar."""
    span = df.agg(F.min(F.to_date(ts)).alias("lo"), F.max(F.to_date(ts)).alias("hi")).where("lo is not null")
    days = span.select(F.explode(F.sequence("lo", "hi")).alias("day"))
    return days.select("day", F.year("day").alias("year"), F.quarter("day").alias("quarter"), F.month("day").alias("month"), F.weekofyear("day").alias("iso_week"), (F.dayofweek("day") - 1).alias("weekday"))


def summary_mart(df: DataFrame, ts: str, dimension: str, measures: dict[str, Column]) -> DataFrame:
    """Measures by month and value of a small dimension, with 0 where nothing happened.

    The months and the dimension's values are the two sides of the spine; neither grows with the rows. Null is a value
    of the dimension, and rows without a time are summed under a null month.
    """
    month, value = private([dimension, *measures], "month_of", "value_of")
    sums = df.groupBy(F.to_date(F.date_trunc("month", ts)).alias(month), named(dimension).alias(value)).agg(*[c.alias(n) for n, c in measures.items()])
    sums = saved(sums)  # as many rows as months and values
    span = sums.agg(F.min(month).alias("lo"), F.max(month).alias("hi")).first()
    months = F.sequence(F.lit(span["lo"]).cast("date"), F.lit(span["hi"]).cast("date"), F.expr("interval 1 month"))
    spine = sums.select(F.col(value).alias(dimension)).distinct().select(F.explode(months).alias("month"), named(dimension))
    met = spine.join(sums, (spine["month"] == F.col(month)) & spine[dimension].eqNullSafe(F.col(value)), "left").select(spine["month"], spine[dimension], *map(named, measures))
    timeless = sums.where(F.col(month).isNull()).select(F.col(month).alias("month"), F.col(value).alias(dimension), *map(named, measures))
    return met.unionByName(timeless).select("month", named(dimension), *[F.coalesce(named(n), F.lit(0)).cast("double").alias(n) for n in measures])
