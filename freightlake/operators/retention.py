"""Retention by sets of customers as bitmaps.

Customers get dense numbers. A set of them is a bitmap for each range of numbers (a bucket of Spark's bitmap functions),
so the sets of days or months are built once, and any window's set is an OR of them, and who is in two an AND.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.names import named
from ..session import saved
from .ranking import prefix_sums


def customer_numbers(orders: DataFrame, customer: str) -> DataFrame:
    """(who, number): every customer, null included, with a number from 1 without gaps, in order."""
    who = orders.select(named(customer).alias("who")).distinct()
    return prefix_sums(who, [(F.col("who"), Column.asc_nulls_first)]).select("who", F.col("row").alias("number"))


def period_sets(orders: DataFrame, customer: str, numbers: DataFrame, period: Column) -> DataFrame:
    """(period, bucket, bits): the customers of each period. Rows of a null period are left out."""
    rows = orders.select(named(customer).alias("of"), period.alias("period")).where(F.col("period").isNotNull()).distinct()
    return numbered_sets(rows.join(numbers, F.col("of").eqNullSafe(F.col("who"))).select("period", "number"))


def numbered_sets(rows: DataFrame) -> DataFrame:
    """(period, bucket, bits) of (period, number)."""
    return rows.groupBy("period", F.bitmap_bucket_number("number").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("number")).alias("bits"))


def window_sets(sets: DataFrame, windows: DataFrame) -> DataFrame:
    """(period, bucket, bits) of windows (window, period: one row for each period in it): who was there in any of its periods."""
    within = windows.select("window", F.col("period").alias("inside"))
    return sets.join(within, F.col("period") == F.col("inside")).groupBy(F.col("window").alias("period"), "bucket").agg(F.bitmap_or_agg("bits").alias("bits"))


def sizes(sets: DataFrame) -> DataFrame:
    """(period, customers)."""
    return sets.groupBy("period").agg(F.sum(F.bitmap_count("bits")).alias("customers"))


def both(first: DataFrame, second: DataFrame, pairs: DataFrame) -> DataFrame:
    """(a, b, customers): how many are in set a of the first and set b of the second, for the pairs (a, b) in which anyone is.

    A pair's two bitmaps of a bucket meet in one group of two rows.
    """
    one = first.select(F.col("period").alias("p"), F.col("bucket").alias("of_bucket"), F.col("bits").alias("x")).join(pairs, F.col("p") == F.col("a"))
    two = second.select(F.col("period").alias("q"), F.col("bucket").alias("at"), F.col("bits").alias("y"))
    met = one.join(two, (F.col("of_bucket") == F.col("at")) & (F.col("b") == F.col("q")))
    each = met.select("a", "b", "at", F.explode(F.array("x", "y")).alias("bits")).groupBy("a", "b", "at").agg(F.bitmap_and_agg("bits").alias("bits"))
    return each.groupBy("a", "b").agg(F.sum(F.bitmap_count("bits")).alias("customers")).where("customers > 0")


def month_retention(orders: DataFrame, customer: str, ts: str) -> DataFrame:
    """M2: (cohort, age, customers) as ``cohort_retention`` has it, of orders with a time, from one set for each month and cohort."""
    month = F.year(named(ts)) * 12 + F.month(named(ts))
    numbers = saved(customer_numbers(orders, customer))
    active = saved(period_sets(orders, customer, numbers, month))
    first = orders.where(named(ts).isNotNull()).groupBy(named(customer).alias("of")).agg(F.min(month).alias("period"))
    cohorts = numbered_sets(first.join(numbers, F.col("of").eqNullSafe(F.col("who"))).select("period", "number"))
    months = active.select("period").distinct()
    later = months.select(F.col("period").alias("a")).join(months.select(F.col("period").alias("b")), F.col("a") <= F.col("b"))  # pairs of months
    return both(cohorts, active, later).select(F.col("a").alias("cohort"), (F.col("b") - F.col("a")).alias("age"), "customers")


def rolling_retention(orders: DataFrame, customer: str, ts: str, days: int = 90, step: int = 30) -> DataFrame:
    """M2: (day, before, after, retained): customers of the ``days`` up to each day, of as many after it, and of both.

    Days come every ``step`` days from the first order's; every day's customers are one set, whatever the windows are.
    """
    day = F.datediff(F.to_date(named(ts)), F.lit("1970-01-01").cast("date"))
    numbers = saved(customer_numbers(orders, customer))
    active = saved(period_sets(orders, customer, numbers, day))
    span = active.agg(F.min("period").alias("lo"), F.max("period").alias("hi")).where("lo is not null")
    points = span.select(F.explode(F.sequence("lo", "hi", F.lit(step))).alias("window"))  # a row for each point of time
    before = window_sets(active, points.select("window", F.explode(F.sequence(F.col("window") - days + 1, F.col("window"))).alias("period")))
    after = window_sets(active, points.select("window", F.explode(F.sequence(F.col("window") + 1, F.col("window") + days)).alias("period")))
    before, after = saved(before), saved(after)
    kept = both(before, after, points.select(F.col("window").alias("a"), F.col("window").alias("b")))
    out = points.join(sizes(before).toDF("w1", "before"), F.col("window") == F.col("w1"), "left").join(sizes(after).toDF("w2", "after"), F.col("window") == F.col("w2"), "left").join(kept, F.col("window") == F.col("a"), "left")
    count = lambda c, name: F.coalesce(c, F.lit(0)).cast("long").alias(name)
    return out.select(F.date_add(F.lit("1970-01-01").cast("date"), F.col("window")).alias("day"), count("before", "before"), count("after", "after"), count("customers", "retained"))
