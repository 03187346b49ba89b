"""Header mapping: source columns to canonical names by a profile of aliases."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class NameMap:
    """Aliases of each canonical column, best first, and which columns are critical."""

    aliases: dict[str, tuple[str, ...]]
    critical: tuple[str, ...] = field(default=())

    def found(self, header: str) -> str | None:
        return next((name for name, known in self.aliases.items() if plain(header) in {plain(x) for x in (name, *known)}), None)


def plain(header: str) -> str:
    """A header without case, punctuation, byte order mark and repeated spaces."""
    return re.sub(r"[\s_\-.]+", " ", header.lstrip("﻿")).strip().lower()


def _sources(df: DataFrame, names: NameMap) -> dict[str, list[str]]:
    out = {}
    for name, known in names.aliases.items():
        wanted = [plain(x) for x in (*known, name)]
        out[name] = sorted((c for c in df.columns if plain(c) in wanted), key=lambda c: (wanted.index(plain(c)), df.columns.index(c)))
    return out


def map_headers(df: DataFrame, names: NameMap, keep: tuple[str, ...] = ()) -> DataFrame:
    """H1: the canonical columns. Where several columns map to one, the first that is not blank wins; none: null."""
    blank = lambda c: F.when(F.trim(F.col(f"`{c}`").cast("string")) != "", F.col(f"`{c}`"))
    sources = _sources(df, names)
    one = lambda cs: F.col(f"`{cs[0]}`") if len(cs) == 1 else F.coalesce(*map(blank, cs)) if cs else F.lit(None).cast("string")
    return df.select(*[one(cs).alias(name) for name, cs in sources.items()], *[F.col(f"`{c}`") for c in keep])


def critical_column_report(df: DataFrame, names: NameMap, source: str, headers: DataFrame | None = None) -> DataFrame:
    """H2: per source file and critical column: is it there, rows, filled rows, share filled.

    With headers (source_file and each file's own headers, as ``csv_headers`` has them), a column is there if the
    file has it, with or without rows; without, if the table has it.
    """
    mapped = map_headers(df, names, keep=(source,))
    there = _sources(df, names)
    filled = [F.count_if(F.trim(F.col(c).cast("string")) != "").alias(c) for c in names.critical]
    counts = mapped.groupBy(source).agg(F.count(F.lit(1)).alias("rows"), *filled)
    long = counts.unpivot([source, "rows"], list(names.critical), "column", "filled").withColumnRenamed(source, "source_file")
    if headers is None:
        present = F.create_map(*[x for c in names.critical for x in (F.lit(c), F.lit(bool(there.get(c))))])[F.col("column")]
    else:
        known = {c: {plain(x) for x in (c, *names.aliases[c])} for c in names.critical}
        spelled = F.transform("headers", lambda h: F.lower(F.trim(F.regexp_replace(F.ltrim(h, F.lit("\ufeff")), r"[\s_\-.]+", " "))))
        has = [F.struct(F.lit(c).alias("column"), F.arrays_overlap(spelled, F.array(*map(F.lit, sorted(known[c])))).alias("present")) for c in names.critical]
        own = headers.select("source_file", F.inline(F.array(*has)))
        long = own.join(long, ["source_file", "column"], "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("rows", "filled")})
        present = F.col("present")
    return long.select("source_file", "column", present.alias("present"), "rows", "filled", F.try_divide("filled", "rows").alias("fill_rate"))


def unmapped_header_report(df: DataFrame, names: NameMap, ignore: tuple[str, ...] = ()) -> DataFrame:
    """H3: columns that no alias covers, with rows, non-null rows and the least and largest value as text."""
    used = {c for cs in _sources(df, names).values() for c in cs}
    rest = [c for c in df.columns if c not in used and c not in ignore]
    if not rest:
        return df.sparkSession.createDataFrame([], "header string, rows long, non_null long, least string, largest string")
    text = df.select(*[F.col(f"`{c}`").cast("string").alias(c) for c in rest])
    # one aggregate row for the whole table, then a row for each column: the table itself is not multiplied
    stats = F.array(*[F.struct(F.lit(c).alias("header"), F.count(F.lit(1)).alias("rows"), F.count(f"`{c}`").alias("non_null"), F.min(f"`{c}`").alias("least"), F.max(f"`{c}`").alias("largest")) for c in rest])
    return text.agg(stats.alias("s")).select(F.inline("s"))
