"""KPIs: measures by dimensions and time."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import named, private


def kpi_evaluate(df: DataFrame, ts: str, grain: str, dimensions: list[str], measures: dict[str, str]) -> DataFrame:
    """K1: (period, dimensions, measure, value) for SQL measures such as ``sum(x)``, in one aggregate."""
    wide = df.groupBy(F.to_date(F.date_trunc(grain, ts)).alias("period"), *dimensions).agg(*[F.expr(m).cast("double").alias(name) for name, m in measures.items()])
    return wide.unpivot(["period", *dimensions], list(measures), "measure", "value")


def kpi_period_change(kpis: DataFrame, dimensions: list[str], months: int = 12) -> DataFrame:
    """K2: each value with that of so many months before, the change and the relative change (null if the prior is 0 or absent); null dimensions match each other."""
    index = lambda c: F.year(c) * 12 + F.month(c)
    i, then, *was = private([*kpis.columns, "prior", "change", "relative_change"], "month_index", "then", *[f"{d}_of" for d in dimensions])
    now = kpis.drop("prior", "change", "relative_change").withColumn(i, index("period"))
    before = now.select(*[named(d).alias(w) for d, w in zip(dimensions, was, strict=True)], (F.col(i) + months).alias(then), F.col("value").alias("prior"))
    same = F.col(i).eqNullSafe(F.col(then))
    for d, w in zip(dimensions, was, strict=True):
        same &= named(d).eqNullSafe(F.col(w))
    out = now.join(before, same, "left").drop(i, then, *was).withColumn("change", F.col("value") - F.col("prior"))
    return out.withColumn("relative_change", F.when(F.col("prior") != 0, F.col("change") / F.col("prior")))


def kpi_top_k(kpis: DataFrame, period: list[str], member: str, value: str, k: int, best: bool = True) -> DataFrame:
    """K3: the k best or worst members of each period; ties by member."""
    rank = F.row_number().over(Window.partitionBy(*period).orderBy(F.desc(value) if best else F.asc(value), member))
    return kpis.withColumn("rank", rank).where(F.col("rank") <= k)


def kpi_rollup(df: DataFrame, dimensions: list[str], measures: dict[str, str]) -> DataFrame:
    """K4: measures for every subset of the dimensions; ``level`` has a bit for each one summed over."""
    return df.cube(*dimensions).agg(F.grouping_id().alias("level"), *[F.expr(m).alias(name) for name, m in measures.items()])
