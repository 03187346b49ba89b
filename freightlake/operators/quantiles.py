"""Exact quantiles of groups of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import named
from ..session import saved

#: Distinct values that a bracket may hold when they are sorted in one place.
MOST_INSIDE = 10_000
#: Cells into which one pass cuts a bracket, a square; a cell's bounds are looked up in two steps of its root.
ROOT = 16
CELLS = ROOT * ROOT


def _inside(counts: DataFrame, brackets: DataFrame) -> DataFrame:
    """The values (v, c) that lie in each bracket, after ``low`` and up to ``high``; null bounds are open."""
    fits = (F.col("low").isNull() | (F.col("v") > F.col("low"))) & (F.col("high").isNull() | (F.col("v") <= F.col("high")))
    return counts.join(brackets, F.col("g").eqNullSafe(F.col("of")) & fits)


def _narrowed(counts: DataFrame, brackets: DataFrame) -> DataFrame:
    """Each bracket cut down to the cells in which its two ranks lie. Cells hold about as many distinct values each."""
    inside = _inside(counts, brackets)
    bounds = F.array_distinct(F.sort_array(F.percentile_approx("v", [k / CELLS for k in range(1, CELLS)], 10 * CELLS)))
    cuts = inside.groupBy(F.col("g").alias("cut_g"), F.col("i").alias("cut_i")).agg(bounds.alias("cuts"))
    cuts = saved(cuts.withColumn("coarse", F.filter("cuts", lambda _, k: k % ROOT == 0)))  # a row for each bracket
    below = lambda xs: F.size(F.filter(xs, lambda x: x < F.col("v")))
    met = inside.join(cuts, F.col("g").eqNullSafe(F.col("cut_g")) & (F.col("i") == F.col("cut_i"))).withColumn("after", below(F.col("coarse")))
    start = (F.col("after") - 1) * ROOT
    cell = F.when(F.col("after") == 0, F.lit(0)).otherwise(start + below(F.slice("cuts", F.greatest(start, F.lit(0)) + 1, F.lit(ROOT))))
    cells = met.withColumn("cell", cell).groupBy("g", "i", "cell").agg(F.sum("c").alias("s"), F.count(F.lit(1)).alias("d"))
    every = Window.partitionBy("of", "i")  # CELLS rows at most
    rows = brackets.join(cells.select(F.col("g").alias("cell_g"), F.col("i").alias("cell_i"), "cell", "s", "d"), F.col("of").eqNullSafe(F.col("cell_g")) & (F.col("i") == F.col("cell_i")))
    rows = rows.withColumn("upto", F.col("below") + F.sum("s").over(every.orderBy("cell").rowsBetween(Window.unboundedPreceding, 0)))
    reached = lambda rank: F.min(F.when(F.col("upto") > rank, F.col("cell"))).over(every)
    rows = rows.withColumns({"a": reached(F.floor("place")), "b": reached(F.ceil("place"))}).where((F.col("cell") >= F.col("a")) & (F.col("cell") <= F.col("b")))
    kept = rows.groupBy("of", "i", "place", "low", "high", "a", "b").agg(F.min(F.col("upto") - F.col("s")).alias("below"), F.sum("d").alias("held"))
    there = cuts.select("cut_g", "cut_i", "cuts")
    kept = kept.join(there, F.col("of").eqNullSafe(F.col("cut_g")) & (F.col("i") == F.col("cut_i")))
    bound = lambda at, old: F.when((F.col(at[0]) + at[1] >= 0) & (F.col(at[0]) + at[1] < F.size("cuts")), F.get("cuts", F.col(at[0]) + at[1])).otherwise(F.col(old))
    return kept.select("of", "i", "place", "below", "held", bound(("a", -1), "low").alias("low"), bound(("b", 0), "high").alias("high"))


def exact_quantiles(df: DataFrame, value: str, group: str, probs: list[float], most: int = MOST_INSIDE) -> DataFrame:
    """(group, distinct, q0, q1, ...) of each group's values that are not null, linear between neighbours. Null is a group too.

    Equal values are counted first. Then every quantile of every group has a bracket of values around its rank,
    which passes over the counts narrow down until it holds ``most`` distinct values or fewer; only these are sorted in
    one place. A pass cuts a bracket into about CELLS parts of as many distinct values each, so three passes are
    enough for 10**11 of them, however they are spread.
    """
    counts = saved(df.where(named(value).isNotNull()).select(named(group).alias("g"), named(value).cast("double").alias("v")).groupBy("g", "v").agg(F.count(F.lit(1)).alias("c")))
    own = saved(counts.groupBy(F.col("g").alias("of")).agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("distinct")))
    null = F.lit(None).cast("double")
    now = own.select("of", F.posexplode(F.array(*[F.lit(float(p)) for p in probs])).alias("i", "p"), "n", "distinct")
    now = now.select("of", "i", (F.col("p") * (F.col("n") - 1)).alias("place"), F.lit(0).cast("long").alias("below"), F.col("distinct").alias("held"), null.alias("low"), null.alias("high"))
    while not (wide := now.where(F.col("held") > most)).isEmpty():
        now = saved(now.where(F.col("held") <= most).unionByName(_narrowed(counts, wide)))
    found = _inside(counts, now).groupBy("of", "i", "place", "below").agg(F.sort_array(F.collect_list(F.struct("v", "c"))).alias("inside"))
    start = F.struct(F.col("below").alias("seen"), null.alias("a"), null.alias("b"))

    def pass_by(s: Column, e: Column) -> Column:
        seen = s["seen"] + e["c"]
        first = lambda was, rank: F.when(was.isNull() & (seen > rank), e["v"]).otherwise(was)
        return F.struct(seen.alias("seen"), first(s["a"], F.floor("place")).alias("a"), first(s["b"], F.ceil("place")).alias("b"))

    ends = lambda s: F.when(s["a"] == s["b"], s["a"]).otherwise((F.ceil("place") - F.col("place")) * s["a"] + (F.col("place") - F.floor("place")) * s["b"])
    each = found.select("of", "i", F.aggregate("inside", start, pass_by, ends).alias("q"))
    wide = each.groupBy(F.col("of").alias("group_of")).agg(*[F.max(F.when(F.col("i") == k, F.col("q"))).alias(f"q{k}") for k in range(len(probs))])
    return own.join(wide, F.col("of").eqNullSafe(F.col("group_of"))).select(F.col("of").alias(group), "distinct", *[f"q{k}" for k in range(len(probs))])
