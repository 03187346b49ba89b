"""Features of orders and entities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import named, private
from ..session import saved
from .history import join_months, month_of
from .ranking import prefix_sums

MONEY = "decimal(18,2)"
#: Groups that are broadcast whole, and rows of a group that is broadcast whatever their number.
FEW_GROUPS, LARGE_GROUP = 100_000, 1_000_000


def calendar_features(df: DataFrame, ts: str) -> DataFrame:
    """year, quarter, month, ISO week, weekday (Sunday is 0) and whether it is a month's last day."""
    day = F.to_date(ts)
    return df.withColumns({"year": F.year(day), "quarter": F.quarter(day), "month": F.month(day), "iso_week": F.weekofyear(day), "weekday": F.dayofweek(day) - 1, "is_month_end": day == F.last_day(day)})


def entity_aggregates(df: DataFrame, entity: str, ts: str, amount: str) -> DataFrame:
    """orders, spend, mean, first and last day and days between, of each entity."""
    day = F.to_date(ts)
    out = df.groupBy(entity).agg(F.count(F.lit(1)).alias("orders"), F.sum(F.col(amount).cast(MONEY)).cast("double").alias("spend"), F.min(day).alias("first_day"), F.max(day).alias("last_day"))
    return out.withColumns({"mean_order": F.col("spend") / F.col("orders"), "tenure_days": F.datediff("last_day", "first_day")})


def gap_features(df: DataFrame, entity: str, ts: str, key: str) -> DataFrame:
    """number of an order in its entity's sequence, and days since the one before.

    Rows are numbered inside each month of an entity; what its earlier months hold is joined on. Columns named
    sequence or days_since are replaced.
    """
    month, of, in_month, n, last, number, previous, before = private([*df.columns, "sequence", "days_since"], "month", "entity_of", "month_of", "n", "last", "number", "previous", "before")
    rows = df.withColumn(month, month_of(ts))
    months = rows.groupBy(named(entity).alias(of), F.col(month).alias(in_month)).agg(F.count(F.lit(1)).alias(n), F.max(ts).alias(last))
    w = Window.partitionBy(of).orderBy(in_month)
    earlier = F.coalesce(F.sum(n).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    months = months.select(of, in_month, earlier.alias(before), F.lag(last).over(w).alias(last))
    inside = Window.partitionBy(named(entity), month).orderBy(ts, key)
    rows = join_months(rows.withColumns({number: F.row_number().over(inside), previous: F.lag(ts).over(inside)}), months, entity, month, of, in_month)
    since = F.datediff(F.to_date(ts), F.to_date(F.coalesce(previous, last)))
    return rows.withColumns({"sequence": (F.col(before) + F.col(number)).cast("int"), "days_since": since}).drop(number, previous, before, last, month)


def rolling_features(df: DataFrame, entity: str, ts: str, amount: str, days: int = 30) -> DataFrame:
    """rows and sum of the days up to each row's day, that day whole, of its entity.

    Days are summed before the window, so it holds one row for each of an entity's days. Columns named
    rolling_count or rolling_sum are replaced.
    """
    day, of, on, n, total = private([*df.columns, "rolling_count", "rolling_sum"], "day", "entity_of", "on", "n", "total")
    rows = df.drop("rolling_count", "rolling_sum").withColumn(day, F.datediff(F.to_date(ts), F.lit("1970-01-01").cast("date")))
    daily = rows.groupBy(named(entity).alias(of), F.col(day).alias(on)).agg(F.count(F.lit(1)).alias(n), F.sum(named(amount).cast(MONEY)).alias(total))
    w = Window.partitionBy(of).orderBy(on).rangeBetween(-days, 0)
    daily = daily.select(of, on, F.sum(n).over(w).alias("rolling_count"), F.sum(total).over(w).cast("double").alias("rolling_sum"))
    return rows.join(daily, named(entity).eqNullSafe(F.col(of)) & F.col(day).eqNullSafe(F.col(on))).drop(day, of, on)


def rolling_range(df: DataFrame, entity: str, ts: str, amount: str, seconds: float) -> DataFrame:
    """F4 at full precision: rows and sum of amounts of the entity from ``seconds`` before each row's time up to it, both included.

    Rows of one time are summed first. Then each time has two places in the order of all entities' times: its own, and
    that where its range begins. The difference of the running sums there is the range's sum, so an entity with
    most of the rows, or of the rows of one range, is spread over as many parts as it needs. Rows without a time
    are a range of their own. Columns named rolling_count or rolling_sum are replaced.
    """
    of, on = private([*df.columns, "rolling_count", "rolling_sum"], "entity_of", "on")
    rows = df.drop("rolling_count", "rolling_sum")
    moment = lambda c: F.unix_micros(c.cast("timestamp"))
    times = saved(rows.groupBy(named(entity).alias("e"), moment(named(ts)).alias("t")).agg(F.count(F.lit(1)).alias("n"), F.sum(named(amount).cast(MONEY)).alias("s"), F.count(named(amount)).alias("with_amount")))
    ends = times.select("e", "t", F.col("t").alias("at"), F.lit(1).alias("kind"), "n", F.coalesce("s", F.lit(0)).alias("s"), "with_amount")
    begins = times.where("t is not null").select("e", "t", (F.col("t") - round(seconds * 1e6)).alias("at"), F.lit(0).alias("kind"), *[F.lit(0).cast(times.schema[c].dataType).alias(c) for c in ("n", "s", "with_amount")])
    order = [(F.col(c), Column.asc_nulls_first) for c in ("e", "at", "kind")]
    placed = prefix_sums(ends.unionByName(begins), order, {"n": "n", "s": "s", "k": "with_amount"})
    reach = lambda name, own: F.sum(F.when(F.col("kind") == 1, F.col(f"before_{name}") + F.col(own)).otherwise(-F.col(f"before_{name}")))
    alone = lambda own: F.max(F.when(F.col("t").isNull(), F.col(own)))
    told = placed.groupBy(F.col("e").alias(of), F.col("t").alias(on)).agg(*[F.coalesce(alone(own), reach(name, own)).alias(name) for name, own in (("n", "n"), ("s", "s"), ("k", "with_amount"))])
    told = told.select(of, on, F.col("n").alias("rolling_count"), F.when(F.col("k") > 0, F.col("s")).cast("double").alias("rolling_sum"))
    return rows.join(told, named(entity).eqNullSafe(F.col(of)) & moment(named(ts)).eqNullSafe(F.col(on))).drop(of, on)


def category_counts(df: DataFrame, entity: str, category: str, values: list[str]) -> DataFrame:
    """a column with the count of each listed value, of each entity; 0 where it has none."""
    return df.groupBy(entity).agg(*[F.count_if(F.col(category) == v).alias(f"n_{v}") for v in values])


def scale_features(df: DataFrame, value: str, group: str, digits: int = 6) -> DataFrame:
    """z-scores by group; 0 where a group's values do not differ.

    Groups go to their rows by broadcast if they are few; else those that hold many rows do, and only the rows of
    small groups are shuffled. So no task gets a large group whole.
    """
    of, mean, sd, n = private([*df.columns, "z"], "group_of", "mean", "sd", "n")
    counts = [F.count(F.lit(1)).alias(n), F.avg(named(value)).alias(mean), F.stddev_samp(named(value)).alias(sd)]
    stats = saved(df.groupBy(named(group).alias(of)).agg(*counts))
    z = F.when(F.coalesce(sd, F.lit(0.0)) == 0, F.lit(0.0)).otherwise((named(value) - F.col(mean)) / F.col(sd))
    own = named(group).eqNullSafe(F.col(of))
    scaled = lambda rows: rows.withColumn("z", F.round(z, digits)).drop(of, mean, sd, n)
    if stats.limit(FEW_GROUPS + 1).count() <= FEW_GROUPS:
        return scaled(df.join(F.broadcast(stats), own))
    large = F.broadcast(stats.where(F.col(n) >= LARGE_GROUP))  # one for LARGE_GROUP rows at most
    small = stats.where(F.col(n) < LARGE_GROUP)
    return scaled(df.join(large, own)).unionByName(scaled(df.join(large, own, "left_anti").join(small, own)))
