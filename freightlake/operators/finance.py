"""Financial alignment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import named, private
from .history import join_months, month_of

MONEY = "decimal(18,2)"


def reconcile(left: DataFrame, right: DataFrame, key: str, left_amount: str, right_amount: str, tolerance: float = 1.0) -> DataFrame:
    """(key, left_total, right_total, difference, status) of two sources, each summed by key before the join; null keys match each other."""
    mine, theirs = private([key, "left_total", "right_total", "difference", "status"], "left_key", "right_key")
    total = lambda df, c, name, k: df.groupBy(named(key).alias(k)).agg(F.sum(named(c).cast(MONEY)).alias(name))
    both = total(left, left_amount, "left_total", mine).join(total(right, right_amount, "right_total", theirs), F.col(mine).eqNullSafe(F.col(theirs)), "full")
    both = both.withColumn(key, F.coalesce(mine, theirs))
    diff = F.col("left_total") - F.col("right_total")
    status = F.when(F.col("left_total").isNull(), "missing_left").when(F.col("right_total").isNull(), "missing_right").when(F.abs(diff) <= tolerance, "match").otherwise("variance")
    return both.select(key, F.col("left_total").cast("double").alias("left_total"), F.col("right_total").cast("double").alias("right_total"), diff.cast("double").alias("difference"), status.alias("status"))


def net_revenue(lines: DataFrame, by: dict[str, Column], price: str, discount: str, tax: str) -> DataFrame:
    """Gross, discount, tax and net by period and dimensions, summed as decimals."""
    p, d, t = F.col(price).cast(MONEY), F.col(discount).cast("decimal(6,4)"), F.col(tax).cast("decimal(6,4)")
    total = lambda c, name: F.sum(c).cast("double").alias(name)
    return lines.groupBy(*[c.alias(name) for name, c in by.items()]).agg(total(p, "gross"), total(p * d, "discount"), total(p * (1 - d), "net"), total(p * (1 - d) * t, "tax"))


def running_balance(rows: DataFrame, account: str, ts: str, key: str, amount: str) -> DataFrame:
    """Running total and year-to-date total of each account; its order is by time, then key.

    Rows are added up inside each month of an account; the totals of its earlier months are joined on.
    """
    names = private([*rows.columns, "running_total", "year_to_date"], "month", "entity_of", "month_of", "total", "before", "this_year", "so_far")
    month, of, in_month, total, earlier, this_year, so_far = names
    rows = rows.withColumn(month, month_of(ts))
    money = F.sum(named(amount).cast(MONEY))
    months = rows.groupBy(named(account).alias(of), F.col(month).alias(in_month)).agg(money.alias(total))
    before = lambda *by: F.sum(total).over(Window.partitionBy(of, *by).orderBy(in_month).rowsBetween(Window.unboundedPreceding, -1))
    months = months.select(of, in_month, before().alias(earlier), before(F.year(in_month)).alias(this_year))
    inside = Window.partitionBy(named(account), month).orderBy(ts, key).rowsBetween(Window.unboundedPreceding, 0)
    rows = join_months(rows.withColumn(so_far, money.over(inside)), months, account, month, of, in_month)
    plus = lambda c: F.coalesce(F.col(c) + F.col(so_far), c, so_far).cast("double")
    return rows.withColumns({"running_total": plus(earlier), "year_to_date": plus(this_year)}).drop(so_far, earlier, this_year, month)
