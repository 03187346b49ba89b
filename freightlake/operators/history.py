"""An entity's whole history, month by month: no task needs all rows of one entity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.names import named


def month_of(ts: str) -> Column:
    """First day of the month; null times make a month of their own, before all others."""
    return F.trunc(F.to_date(ts), "month")


def join_months(rows: DataFrame, months: DataFrame, entity: str, month: str, of: str, month_of_: str) -> DataFrame:
    """``rows`` with the columns of ``months``, one row for each ``of`` and ``month_of_``; nulls match nulls, and the two go."""
    return rows.join(months, named(entity).eqNullSafe(F.col(of)) & F.col(month).eqNullSafe(F.col(month_of_))).drop(of, month_of_)
