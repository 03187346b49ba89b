"""Column functions that standardise values; all are stateless and take streaming frames too."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Arabic-Indic and Persian digits, and the digits that they stand for.
DIGITS = ("٠١٢٣٤٥٦٧٨٩۰۱۲۳۴۵۶۷۸۹", "01234567890123456789")


def normalize_text(c: Column, lower: bool = True) -> Column:
    """Trimmed, runs of white space as one space, digits as ASCII, in lower case if asked."""
    c = F.trim(F.regexp_replace(F.translate(c, *DIGITS), r"\s+", " "))
    return F.lower(c) if lower else c


def parse_timestamp(c: Column, formats: list[str]) -> Column:
    """The first format, in the given order, that reads the text; null if none does."""
    return F.coalesce(*[F.try_to_timestamp(F.trim(c), F.lit(f)) for f in formats])


def parse_number(c: Column, kind: str = "decimal(18,2)") -> Column:
    """Text with thousands separators as a number; null if it is none."""
    return F.trim(F.regexp_replace(F.translate(c, *DIGITS), ",", "")).try_cast(kind)
