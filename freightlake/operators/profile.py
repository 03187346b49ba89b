"""Column profiles."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import named
from .quantiles import exact_quantiles


def profile_numeric(df: DataFrame, columns: list[str], exact: bool = True) -> DataFrame:
    """Count, nulls, distinct, least, largest, mean, deviation and quartiles of each column.

    Distinct counts and quartiles come from the counts of values of all columns at once, or are sketches.
    """
    def stats(c: str):
        q = lambda p: F.lit(None).cast("double") if exact else F.percentile_approx(c, F.lit(p), F.lit(10_000)).cast("double")
        return F.struct(
            F.lit(c).alias("column"), F.count(F.lit(1)).alias("rows"), F.count_if(F.col(c).isNull()).alias("nulls"), (F.lit(0).cast("long") if exact else F.approx_count_distinct(c)).alias("distinct"),
            F.min(c).cast("double").alias("least"), F.max(c).cast("double").alias("largest"),
            F.round(F.sum(F.col(c).cast("decimal(28,6)")).cast("double") / F.count(c), 6).alias("mean"), F.round(F.stddev_samp(c), 6).alias("sd"),
            F.round(q(0.25), 4).alias("q1"), F.round(q(0.5), 4).alias("median"), F.round(q(0.75), 4).alias("q3"),
        )

    sums = df.agg(F.array(*map(stats, columns)).alias("s")).select(F.inline("s"))
    if not exact:
        return sums
    long = df.select(*[F.col(c).cast("double").alias(c) for c in columns]).unpivot([], columns, "column", "value")
    q = exact_quantiles(long, "value", "column", [0.25, 0.5, 0.75])
    own = {"distinct": F.coalesce(q["distinct"], F.lit(0))} | {name: F.round(q[f"q{i}"], 4) for i, name in enumerate(("q1", "median", "q3"))}
    return sums.join(q, "column", "left").select(*[own[c].alias(c) if c in own else sums[c] for c in sums.columns])


def profile_categorical(df: DataFrame, columns: list[str], k: int = 5) -> DataFrame:
    """The k most frequent values of each column with their share; ties by value."""
    long = df.select(*[F.col(c).cast("string").alias(c) for c in columns]).unpivot([], columns, "column", "value")
    counts = long.groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    totals = counts.groupBy("column").agg(F.sum("n").alias("total"))
    rank = F.row_number().over(Window.partitionBy("column").orderBy(F.desc("n"), "value"))
    top = counts.withColumn("rank", rank).where(F.col("rank") <= k)
    return top.join(F.broadcast(totals), "column").select("column", "rank", "value", "n", (F.col("n") / F.col("total")).alias("share"))  # totals: a row for each column


def histogram(df: DataFrame, column: str, low: float, high: float, bins: int) -> DataFrame:
    """Rows in each of equal bins; 0 holds what is below, bins + 1 what is above."""
    return df.where(F.col(column).isNotNull()).groupBy(F.expr(f"width_bucket(cast(`{column}` as double), {low}D, {high}D, {bins})").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def correlation(df: DataFrame, columns: list[str]) -> DataFrame:
    """Pearson's correlation of each pair of columns, in one aggregate."""
    pairs = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.round(F.corr(a, b), 9).alias("r")) for a, b in combinations(columns, 2)]
    return df.agg(F.array(*pairs).alias("s")).select(F.inline("s"))


#: Sizes of the stored sketches: quantiles are off by 0.3 % of the rows and distinct counts by 1 %, nearly always by less.
KLL_K, HLL_BITS = 1000, 14


def profile_sketch(df: DataFrame, columns: list[str]) -> DataFrame:
    """What profiles are merged from, a row for each column, in one pass: counts, extremes, moments, and sketches as binary columns.

    ``total`` is exact to 6 digits; ``spread`` is the sum of squared distances from the mean. Null values are counted only.
    """

    def of(c: str):
        x = named(c).cast("double")
        name = "cast(`" + c.replace("`", "``") + "` as {})"
        return F.struct(
            F.lit(c).alias("column"), F.count(F.lit(1)).alias("rows"), F.count_if(x.isNull()).alias("nulls"), F.min(x).alias("least"), F.max(x).alias("largest"),
            F.sum(named(c).cast("decimal(28,6)")).alias("total"), F.coalesce(F.var_pop(x) * F.count(x), F.lit(0.0)).alias("spread"),
            F.expr(f"hll_sketch_agg({name.format('string')}, {HLL_BITS})").alias("distinct_sketch"), F.expr(f"kll_sketch_agg_double({name.format('double')}, {KLL_K})").alias("quantile_sketch"),
        )

    return df.agg(F.array(*map(of, columns)).alias("s")).select(F.inline("s"))


def merge_sketches(sketches: DataFrame) -> DataFrame:
    """One row of ``profile_sketch`` for each column, from those of any number of runs or parts; merges can be merged."""
    n = F.col("rows") - F.col("nulls")
    mean = lambda by: F.try_divide(F.sum(F.col("total").cast("double")).over(by), F.sum(n).over(by))
    by = Window.partitionBy("column")  # a row for each run
    own = F.try_divide(F.col("total").cast("double"), n)
    moved = F.coalesce(n * (own - mean(by)) * (own - mean(by)), F.lit(0.0))
    return sketches.withColumn("spread", F.col("spread") + moved).groupBy("column").agg(
        F.sum("rows").alias("rows"), F.sum("nulls").alias("nulls"), F.min("least").alias("least"), F.max("largest").alias("largest"), F.sum("total").cast("decimal(38,6)").alias("total"), F.sum("spread").alias("spread"),
        F.expr("hll_union_agg(distinct_sketch)").alias("distinct_sketch"), F.expr("kll_merge_agg_double(quantile_sketch)").alias("quantile_sketch"),
    )


def profile_of_sketches(sketches: DataFrame) -> DataFrame:
    """The columns of ``profile_numeric`` from merged sketches; distinct counts and quartiles are estimates. No row of the tables is read."""
    n = F.col("rows") - F.col("nulls")
    q = lambda p: F.when(n > 0, F.expr(f"kll_sketch_get_quantile_double(quantile_sketch, {p}D)"))
    return sketches.select(
        "column", "rows", "nulls", F.expr("hll_sketch_estimate(distinct_sketch)").alias("distinct"), "least", "largest", F.round(F.try_divide(F.col("total").cast("double"), n), 6).alias("mean"),
        F.when(n > 1, F.round(F.sqrt(F.col("spread") / (n - 1)), 6)).alias("sd"), F.round(q(0.25), 4).alias("q1"), F.round(q(0.5), 4).alias("median"), F.round(q(0.75), 4).alias("q3"),
    )
