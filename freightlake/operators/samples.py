"""Samples of columns that no alias covers, and what they may be aliases of."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import named
from .headers import NameMap, map_headers, plain

SAMPLE = 32


def _smallest(rows: DataFrame, k: int) -> DataFrame:
    """The k rows of least hash of each header; the limit runs before the shuffle too."""
    least = Window.partitionBy("header").orderBy("hash", "value")
    return rows.withColumn("rank", F.row_number().over(least)).where(F.col("rank") <= k).select("header", "value", "hash")


def sample_columns(df: DataFrame, columns: list[str], k: int = SAMPLE, seed: str = "s") -> DataFrame:
    """(header, value, hash): the k distinct values of least hash of each column, the same in every run. Null and blank values are none."""
    if not columns:
        return df.sparkSession.createDataFrame([], "header string, value string, hash string")
    each = df.select(F.inline(F.array(*[F.struct(F.lit(c).alias("header"), F.trim(named(c).cast("string")).alias("value")) for c in columns])))
    values = each.where("value <> ''").distinct()
    return _smallest(values.withColumn("hash", F.md5(F.concat(F.lit(seed), "value").cast("binary"))), k)


def merge_samples(samples: DataFrame, k: int = SAMPLE) -> DataFrame:
    """One sample of each header from those of any number of files or runs, as if they had been sampled together."""
    return _smallest(samples.distinct(), k)


def name_likeness(a: str, b: str, n: int = 3) -> float:
    """Share of common n-grams of two names, written plainly, with a space before and behind; 1 for equal ones."""
    grams = lambda x: {f" {plain(x)} "[i : i + n] for i in range(max(1, len(plain(x)) + 3 - n))}
    one, two = grams(a), grams(b)
    return len(one & two) / len(one | two)


def overlaps(left: DataFrame, right: DataFrame, k: int = SAMPLE) -> DataFrame:
    """(a, b, overlap): of the k values of least hash of both headers' samples together, the share that both hold.

    It estimates the share of common values among all, and is exact where there are k at most. Pairs without a common value have no row.
    """
    # only pairs that share a value of their samples are looked at
    pairs = left.select(F.col("header").alias("a"), "value").join(right.select(F.col("header").alias("b"), "value"), "value").select("a", "b").distinct()
    one = pairs.join(left.withColumnRenamed("header", "a"), "a").select("a", "b", "value", "hash", F.lit(1).alias("side"))
    two = pairs.join(right.withColumnRenamed("header", "b"), "b").select("a", "b", "value", "hash", F.lit(2).alias("side"))
    union = one.unionByName(two).groupBy("a", "b", "hash", "value").agg((F.count_distinct("side") == 2).alias("shared"))
    first = union.withColumn("rank", F.row_number().over(Window.partitionBy("a", "b").orderBy("hash", "value"))).where(F.col("rank") <= k)
    return first.groupBy("a", "b").agg(F.avg(F.col("shared").cast("double")).alias("overlap")).where("overlap > 0")


def alias_proposals(df: DataFrame, names: NameMap, known: DataFrame, ignore: tuple[str, ...] = (), k: int = SAMPLE, least: float = 0.1) -> DataFrame:
    """H3: (header, proposal, name_likeness, value_overlap, score) for each column that no alias covers.

    Likeness is the best of the canonical name's and its aliases'; overlap is that of the values with those of the
    canonical column in ``known``, a table that is mapped already. The score is their mean; proposals of ``least`` or more stay.
    """
    used = {plain(x) for name, aliases in names.aliases.items() for x in (name, *aliases)}
    rest = [c for c in df.columns if plain(c) not in used and c not in ignore]
    canonical = list(names.aliases)
    spark = df.sparkSession
    likeness = [(h, c, max(name_likeness(h, x) for x in (c, *names.aliases[c]))) for h in rest for c in canonical]  # names only
    table = spark.createDataFrame(likeness, "header string, proposal string, name_likeness double")
    met = overlaps(sample_columns(df, rest, k), sample_columns(map_headers(known, names), canonical, k), k)
    both = table.join(met, (F.col("header") == F.col("a")) & (F.col("proposal") == F.col("b")), "left").withColumn("value_overlap", F.coalesce("overlap", F.lit(0.0)))
    scored = both.select("header", "proposal", F.round("name_likeness", 6).alias("name_likeness"), F.round("value_overlap", 6).alias("value_overlap"), F.round((F.col("name_likeness") + F.col("value_overlap")) / 2, 6).alias("score"))
    return scored.where(F.col("score") >= least)
