"""Customers, products and lanes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.names import named
from ..session import saved
from .ranking import global_prefix, ntile

MONEY = "decimal(18,2)"


def rfm_segments(orders: DataFrame, customer: str, ts: str, amount: str, tiles: int = 5) -> DataFrame:
    """M1: recency, frequency and monetary quintiles of each customer; ties by customer."""
    day = F.datediff(F.to_date(ts), F.lit("1970-01-01").cast("date"))
    out = orders.groupBy(customer).agg(F.max(day).cast("long").alias("__last"), F.count(F.lit(1)).alias("frequency"), F.sum(F.col(amount).cast(MONEY)).alias("monetary"))
    out = saved(out)  # a row for each customer, read for every rank
    for value, name in (("__last", "r"), ("frequency", "f"), ("monetary", "m")):
        ranked = global_prefix(out, value, customer)
        out = saved(ranked.withColumn(name, ntile(F.col("row"), F.col("total_rows"), tiles)).drop("row", "total_rows"))
    return out.select(customer, F.date_add(F.lit("1970-01-01").cast("date"), F.col("__last").cast("int")).alias("last_day"), "frequency", F.col("monetary").cast("double").alias("monetary"), "r", "f", "m", (F.col("r") * 100 + F.col("f") * 10 + F.col("m")).alias("segment"))


def cohort_retention(orders: DataFrame, customer: str, ts: str) -> DataFrame:
    """M2: active customers by the month of their first order (year * 12 + month) and months since.

    Null is a customer as any other; orders without a time count under a null age.
    """
    months = orders.select(named(customer).alias("who"), (F.year(ts) * 12 + F.month(ts)).alias("m")).distinct()
    first = months.groupBy(F.col("who").alias("of")).agg(F.min("m").alias("cohort"))
    return months.join(first, F.col("who").eqNullSafe(F.col("of"))).groupBy("cohort", (F.col("m") - F.col("cohort")).alias("age")).agg(F.count(F.lit(1)).alias("customers"))


def abc_classes(lines: DataFrame, item: str, amount: str, a: float = 0.8, b: float = 0.95) -> DataFrame:
    """M3: class by the share of revenue before an item, largest first: under a is A, under b is B, else C."""
    revenue = lines.groupBy(item).agg(F.sum(F.col(amount).cast(MONEY)).alias("revenue"))
    ranked = global_prefix(revenue, "revenue", item, weight="revenue", descending=True)
    share = F.col("before").cast("double") / F.col("total").cast("double")
    return ranked.select(item, F.col("revenue").cast("double").alias("revenue"), F.col("row").cast("long").alias("rank"), F.round(share, 9).alias("share_before"), F.when(share < a, "A").when(share < b, "B").otherwise("C").alias("class"))


def fulfilment_lead_time(shipments: DataFrame, lane: list[str], ordered: str, shipped: str, late_after: int = 30, exact: bool = True) -> DataFrame:
    """M4: days from order to shipment by lane, of shipments not before their order: mean, quartiles, share late."""
    days = F.datediff(F.to_date(shipped), F.to_date(ordered))
    q = (lambda p: F.percentile("days", F.lit(p))) if exact else (lambda p: F.percentile_approx("days", F.lit(p)).cast("double"))
    rows = shipments.withColumn("days", days).where(F.col("days") >= 0)
    return rows.groupBy(*lane).agg(F.count(F.lit(1)).alias("shipments"), (F.sum("days") / F.count(F.lit(1))).alias("mean_days"), F.round(q(0.25), 4).alias("q1"), F.round(q(0.5), 4).alias("median"), F.round(q(0.75), 4).alias("q3"), (F.count_if(F.col("days") > late_after) / F.count(F.lit(1))).alias("late_share"))
