"""Data quality rules and their report."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, IntegralType, TimestampNTZType, TimestampType

from ..functions.names import named
from .quantiles import exact_quantiles

REPORT = "rule string, column string, checked long, failed long, pass_rate double, severity string, status string"
#: Columns of a tag's key.
KEY = ("one", "two", "text")


@dataclass(frozen=True)
class Rule:
    """A rule of one row: ``applies`` tells which rows are checked, ``fails`` which of them fail."""

    name: str
    column: str
    applies: Column
    fails: Column
    severity: str = "error"
    threshold: float = 1.0


def not_null(column: str, **kw) -> Rule:
    """Q2: null or blank fails."""
    c = F.col(column)
    return Rule("not_null", column, F.lit(True), c.isNull() | (F.trim(c.cast("string")) == ""), **kw)


def accepted_values(column: str, values: list, **kw) -> Rule:
    """Q4: a value outside a short list fails; null is not checked."""
    return Rule("accepted_values", column, F.col(column).isNotNull(), ~F.col(column).isin(values), **kw)


def in_range(column: str, low, high, **kw) -> Rule:
    """Q5: a value outside [low, high] fails."""
    return Rule("range", column, F.col(column).isNotNull(), ~F.col(column).between(low, high), **kw)


def pattern(column: str, regex: str, **kw) -> Rule:
    """Q6: text without a match fails."""
    return Rule("pattern", column, F.col(column).isNotNull(), ~F.col(column).rlike(regex), **kw)


def ordering(earlier: str, later: str, **kw) -> Rule:
    """Q7: a later column before the earlier one fails; columns of two tables are joined first."""
    return Rule("ordering", f"{earlier}<={later}", F.col(earlier).isNotNull() & F.col(later).isNotNull(), F.col(later) < F.col(earlier), **kw)


def evaluate_policy(df: DataFrame, rules: list[Rule]) -> DataFrame:
    """Q1: all row rules in one pass over the table, a report row for each."""
    found = F.array(*[
        F.struct(
            F.lit(r.name).alias("rule"), F.lit(r.column).alias("column"), F.count_if(r.applies).alias("checked"),
            F.count_if(r.applies & r.fails).alias("failed"), F.lit(r.severity).alias("severity"), F.lit(r.threshold).alias("threshold"),
        )
        for r in rules
    ])
    return _judged(df.agg(found.alias("r")).select(F.inline("r")))


def _judged(counts: DataFrame) -> DataFrame:
    rate = F.when(F.col("checked") > 0, 1 - F.col("failed") / F.col("checked")).otherwise(F.lit(1.0))
    return counts.withColumn("pass_rate", rate).select("rule", "column", "checked", "failed", "pass_rate", "severity", F.when(F.col("pass_rate") < F.col("threshold"), "fail").otherwise("pass").alias("status"))


def _one(counts: DataFrame, rule: str, column: str, severity: str, threshold: float) -> DataFrame:
    return _judged(counts.select(F.lit(rule).alias("rule"), F.lit(column).alias("column"), F.coalesce("checked", F.lit(0)).cast("long").alias("checked"), F.coalesce("failed", F.lit(0)).cast("long").alias("failed"), F.lit(severity).alias("severity"), F.lit(threshold).alias("threshold")))


def unique_key(df: DataFrame, keys: list[str], severity: str = "error", threshold: float = 1.0) -> DataFrame:
    """Q3: rows of a key beyond its first fail. Counts are combined before the shuffle, so a frequent key is one row of each task."""
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).agg(F.sum("n").alias("checked"), F.sum(F.col("n") - 1).alias("failed"))
    return _one(counts, "unique", ",".join(keys), severity, threshold)


def foreign_key(child: DataFrame, parent: DataFrame, column: str, parent_column: str, severity: str = "error", threshold: float = 1.0) -> DataFrame:
    """Q8: rows whose value has no parent fail; null is not checked. Values are counted before they are joined."""
    values = child.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("v")).agg(F.count(F.lit(1)).alias("n"))
    known = parent.select(F.col(parent_column).alias("v")).distinct().withColumn("there", F.lit(True))
    counts = values.join(known, "v", "left").agg(F.sum("n").alias("checked"), F.sum(F.when(F.col("there").isNull(), F.col("n")).otherwise(0)).alias("failed"))
    return _one(counts, "foreign_key", column, severity, threshold)


def iqr_bounds(df: DataFrame, value: str, group: str, digits: int = 4, exact: bool = True) -> DataFrame:
    """(group, q1, q3, low, high) of each group, quartiles rounded first; approximate ones are read off a sketch."""
    sketch = lambda p: F.percentile_approx(value, F.lit(p), F.lit(100_000))
    q = exact_quantiles(df, value, group, [0.25, 0.75]) if exact else df.groupBy(group).agg(sketch(0.25).alias("q0"), sketch(0.75).alias("q1"))
    q = q.select(group, F.round("q0", digits).alias("q1"), F.round("q1", digits).alias("q3"))
    width = 1.5 * (F.col("q3") - F.col("q1"))
    return q.withColumns({"low": F.col("q1") - width, "high": F.col("q3") + width})


def iqr_outlier(df: DataFrame, value: str, group: str, severity: str = "warn", threshold: float = 0.9, exact: bool = True) -> DataFrame:
    """Q9: values outside a group's quartiles by over 1.5 times their distance fail."""
    rows = df.where(named(value).isNotNull()).select(named(value).alias("v"), named(group).alias("g"))
    bounds = iqr_bounds(rows, "v", "g", exact=exact).select(F.col("g").alias("of"), "low", "high")
    joined = rows.join(bounds, F.col("g").eqNullSafe(F.col("of")))  # null is a group too
    counts = joined.agg(F.count(F.lit(1)).alias("checked"), F.count_if((F.col("v") < F.col("low")) | (F.col("v") > F.col("high"))).alias("failed"))
    return _one(counts, "iqr_outlier", value, severity, threshold)


@dataclass(frozen=True)
class OfTable:
    """A row rule of a named table."""

    table: str
    rule: Rule


@dataclass(frozen=True)
class Unique:
    """Q3 as part of a compiled report."""

    table: str
    keys: tuple[str, ...]
    severity: str = "error"
    threshold: float = 1.0
    name: str = "unique"


@dataclass(frozen=True)
class Known:
    """Q8, and Q4 for values that a table lists (``name="accepted_values"``): values of a column that the other table lacks fail."""

    table: str
    column: str
    parent: str
    parent_column: str
    severity: str = "error"
    threshold: float = 1.0
    name: str = "foreign_key"


@dataclass(frozen=True)
class Ordered:
    """Q7 across tables: a row whose ``later`` is before the ``earlier`` of the parent of its key fails; of several parents the latest counts."""

    table: str
    later: str
    key: str
    parent: str
    earlier: str
    parent_key: str
    severity: str = "error"
    threshold: float = 1.0
    name: str = "ordering"


def compiled_report(tables: dict[str, DataFrame], rules: list[OfTable | Unique | Known | Ordered]) -> DataFrame:
    """Q10: a report row for each rule, in one scan of each table and for all rules together.

    A scan tags every row with the rules that it takes part in and its key there. Equal tags are counted before the
    shuffle, so row rules send a row from each task, and a frequent key too. Where the tags of a key meet, each rule
    counts what fails. Keys of whole numbers are compared as such, others as text or JSON, times to the microsecond and numbers as doubles.
    """
    own: dict[str, list[Column]] = {name: [] for name in tables}
    none = F.lit(None)

    def kept(table: str, column: str) -> bool:
        return isinstance(tables[table].schema[column].dataType, IntegralType)

    def tag(k: int, side: int, keys: list[Column], when: Column, value: tuple[Column, Column] | None = None, failed: Column | None = None) -> Column:
        t, x = value or (none, none)
        cells = {"k": F.lit(k), "side": F.lit(side), **dict(zip(KEY, keys or [none] * 3, strict=True)), "t": t.cast("long"), "x": x.cast("double"), "failed": (F.lit(0) if failed is None else failed).cast("long")}
        return F.when(when, F.struct(*[c.cast({"one": "long", "two": "long", "text": "string"}.get(name, "int")).alias(name) if name in ("k", "side", *KEY) else c.alias(name) for name, c in cells.items()]))

    def together(table: str, columns: tuple[str, ...]) -> list[Column]:
        """A row's key: its first two whole numbers as they are, the rest as JSON."""
        whole = [c for c in columns if kept(table, c)][:2]
        rest = [named(c) for c in columns if c not in whole]
        return [*[named(c) for c in whole], *[none] * (2 - len(whole)), F.to_json(F.struct(*rest)) if rest else none]

    def single(table: str, column: str, other: str, other_column: str) -> list[Column]:
        """A key that two tables share: a whole number in both, or text."""
        both = kept(table, column) and kept(other, other_column)
        return [named(column), none, none] if both else [none, none, named(column)]

    def comparable(table: str, column: str) -> tuple[Column, Column]:
        time = isinstance(tables[table].schema[column].dataType, (DateType, TimestampType, TimestampNTZType))
        c = named(column)
        return (F.unix_micros(c.cast("timestamp")), none) if time else (none, c.cast("double"))

    for k, r in enumerate(rules):
        if isinstance(r, OfTable):
            own[r.table].append(tag(k, 0, [], r.rule.applies, failed=F.coalesce(r.rule.fails, F.lit(False)).cast("int")))
        elif isinstance(r, Unique):
            own[r.table].append(tag(k, 0, together(r.table, r.keys), F.lit(True)))
        elif isinstance(r, Known):
            own[r.table].append(tag(k, 0, single(r.table, r.column, r.parent, r.parent_column), named(r.column).isNotNull()))
            own[r.parent].append(tag(k, 1, single(r.parent, r.parent_column, r.table, r.column), named(r.parent_column).isNotNull()))
        else:
            own[r.table].append(tag(k, 0, single(r.table, r.key, r.parent, r.parent_key), named(r.key).isNotNull() & named(r.later).isNotNull(), comparable(r.table, r.later)))
            own[r.parent].append(tag(k, 1, single(r.parent, r.parent_key, r.table, r.key), named(r.parent_key).isNotNull() & named(r.earlier).isNotNull(), comparable(r.parent, r.earlier)))
    tagged = [tables[name].select(F.inline(F.array(*tags))).where("k is not null") for name, tags in own.items() if tags]  # no lambda: they are not compiled
    counts = reduce(lambda a, b: a.unionByName(b), tagged).groupBy("k", "side", *KEY, "t", "x").agg(F.count(F.lit(1)).alias("n"), F.sum("failed").alias("failed"))
    counts = counts.withColumn("value", F.struct("t", "x"))
    of_key = Window.partitionBy(*KEY, "k")  # sorts compare keys first, which differ; a row for each value of an ordering, else one for each side
    met = counts.withColumn("parent", F.max(F.when(F.col("side") == 1, F.col("value"))).over(of_key)).where("side = 0")
    kinds = {kind: [k for k, r in enumerate(rules) if isinstance(r, kind)] for kind in (OfTable, Unique, Known, Ordered)}
    of = lambda kind: F.col("k").isin(kinds[kind])
    fails = F.when(of(OfTable), F.col("failed")).when(of(Unique), F.col("n") - 1).when(of(Known) & F.col("parent").isNull(), F.col("n")).when(of(Ordered) & (F.col("value") < F.col("parent")), F.col("n")).otherwise(0)
    checked = F.when(of(Ordered) & F.col("parent").isNull(), 0).otherwise(F.col("n"))
    sums = met.groupBy("k").agg(F.sum(checked).alias("checked"), F.sum(fails).alias("failed"))
    told = []
    for k, r in enumerate(rules):
        rule = r.rule if isinstance(r, OfTable) else r
        column = {OfTable: lambda r: r.rule.column, Unique: lambda r: ",".join(r.keys), Known: lambda r: r.column, Ordered: lambda r: f"{r.earlier}<={r.later}"}[type(r)](r)
        told.append((k, rule.name, column, rule.severity, float(rule.threshold)))
    names = next(iter(tables.values())).sparkSession.createDataFrame(told, "number int, rule string, column string, severity string, threshold double")
    every = names.join(sums, F.col("number") == F.col("k"), "left").withColumns({c: F.coalesce(c, F.lit(0)).cast("long") for c in ("checked", "failed")})
    return _judged(every)


def quality_report(parts: list[DataFrame]) -> DataFrame:
    """Q10: the rule results as one report."""
    return reduce(lambda a, b: a.unionByName(b), parts)
