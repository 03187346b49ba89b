"""Schema contracts: conforming a table, listing violations, splitting off rejected rows."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StructType, VariantType

from ..functions.names import named, private

VIOLATION = "struct<column:string,reason:string,value:string>"


@dataclass(frozen=True)
class Contract:
    """The table-valued part of a JSON Schema: properties in order, the required ones, and each one's own schema."""

    title: str
    types: dict[str, str]
    required: tuple[str, ...] = ()
    specs: dict[str, dict] = field(default_factory=dict)

    @staticmethod
    def from_json_schema(schema: dict) -> Contract:
        """From ``type``, ``format``, ``items``, ``properties``, ``required``, ``x-scale``, and the rules that ``_rules`` names."""
        return Contract(schema.get("title", ""), {k: spark_type(v) for k, v in schema["properties"].items()}, tuple(schema.get("required", ())), dict(schema["properties"]))

    def spec(self, column: str) -> dict:
        return self.specs.get(column, {})


def _kind(spec: dict) -> str:
    kind = spec.get("type", "string")
    return next((k for k in kind if k != "null"), "string") if isinstance(kind, list) else kind


def spark_type(spec: dict) -> str:
    """The Spark type of a JSON Schema, arrays and objects included."""
    return _type(spec, lambda s: {"date": "date", "date-time": "timestamp"}.get(s.get("format", ""), "string") if _kind(s) == "string" else f"decimal(18,{s['x-scale']})" if "x-scale" in s and _kind(s) == "number" else {"number": "double", "integer": "bigint", "boolean": "boolean"}[_kind(s)])


def _quoted(name: str) -> str:
    return name if re.fullmatch("[A-Za-z][A-Za-z0-9_]*", name) else "`" + name.replace("`", "``") + "`"


def _type(spec: dict, scalar) -> str:
    if _kind(spec) == "array":
        return f"array<{_type(spec.get('items', {}), scalar)}>"
    if _kind(spec) == "object":
        return "struct<" + ",".join(f"{_quoted(k)}:{_type(v, scalar)}" for k, v in spec.get("properties", {}).items()) + ">"
    return scalar(spec)


def _is_nested(spec: dict) -> bool:
    return _kind(spec) in ("array", "object")


def _as_text(df: DataFrame, name: str) -> Column:
    """A column as a file would have it: arrays, objects and variants as JSON."""
    kind = df.schema[name].dataType
    return F.to_json(named(name)) if isinstance(kind, (ArrayType, StructType, MapType, VariantType)) else named(name)


def _held(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once however often it is used: Spark does not share what repeats inside lambdas."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _parsed(text: Column, spec: dict) -> Column:
    """One level of JSON text, what is in it as text; null if it is not JSON of that kind."""
    kind = "array<string>" if _kind(spec) == "array" else "struct<" + ",".join(f"{_quoted(k)}:string" for k in spec.get("properties", {})) + ">"
    return F.when(_fits(text, spec), F.from_json(text, kind))


def _fits(text: Column, spec: dict) -> Column:
    return F.try_parse_json(text).isNotNull() & F.ltrim(text).startswith("[" if _kind(spec) == "array" else "{")


def _gap(value: Column, spec: dict) -> Column | None:
    """Whether an array or object inside a value that was parsed whole is null; None if it can hold none."""

    def inner(x: Column, s: dict) -> Column:
        deeper = _gap(x, s)
        return x.isNull() if deeper is None else x.isNull() | deeper

    if _kind(spec) == "array":
        item = spec.get("items", {})
        return F.exists(value, lambda x: inner(x, item)) if _is_nested(item) else None
    gaps = [inner(value[k], s) for k, s in spec.get("properties", {}).items() if _is_nested(s)]
    return reduce(lambda a, b: a | b, gaps) if gaps else None


def _read(text: Column, spec: dict, use: Callable[[Column, bool], Column]) -> Column:
    """use(value, True) of JSON text that is parsed at one go where all that is in it has its kind, else use(text, False), to parse it level by level."""
    if _gap(text, spec) is None:
        return use(text, False)
    kind = _type(spec, lambda _: "string")
    return _held(F.when(_fits(text, spec), F.from_json(text, kind)), lambda value: F.when(value.isNotNull() & ~_gap(value, spec), use(value, True)).otherwise(use(text, False)))


def _opened(text: Column, spec: dict, whole: bool, use: Callable[[Column], Column]) -> Column:
    """use of a level's value, which is there already if its JSON was parsed whole."""
    return use(text) if whole else _held(_parsed(text, spec), use)


def _typed(text: Column, spec: dict, whole: bool = False) -> Column:
    """Text in the contract's types, level by level; what can't be read or cast is null where it stands."""
    if _kind(spec) == "array":
        return F.transform(text if whole else _parsed(text, spec), lambda x: _typed(x, spec.get("items", {}), whole))
    if _kind(spec) == "object":
        parts = spec.get("properties", {}).items()
        return _opened(text, spec, whole, lambda value: F.when(value.isNotNull(), F.struct(*[_typed(value[k], s, whole).alias(k) for k, s in parts])))
    return text.try_cast(spark_type(spec))


def conform(df: DataFrame, contract: Contract) -> DataFrame:
    """The contract's columns in its types; failed casts and absent columns are null, other columns go.

    Arrays and objects are read from JSON text, or from columns of such types; inside them, what fails is null alone.
    """

    def one(c: str, kind: str) -> Column:
        if c not in df.columns:
            return F.lit(None).cast(kind)
        spec = contract.spec(c)
        return _held(_as_text(df, c), lambda text: _read(text, spec, lambda x, whole: _typed(x, spec, whole))).cast(kind) if _is_nested(spec) else named(c).try_cast(kind)

    return df.select(*[one(c, kind).alias(c) for c, kind in contract.types.items()])


def _rules(spec: dict, text: Column, typed: Column) -> list[tuple[str, Column]]:
    """(rule, whether it fails) for the rules of a scalar; none fails on null."""
    out = []
    if "enum" in spec:
        out.append(("enum", ~text.isin([str(x).lower() if isinstance(x, bool) else str(x) for x in spec["enum"] if x is not None])))
    if "const" in spec:
        out.append(("const", text != F.lit(str(spec["const"]))))
    if "pattern" in spec:
        out.append(("pattern", ~text.rlike(spec["pattern"])))
    for name, fails in (("minLength", F.char_length(text) < F.lit(spec.get("minLength"))), ("maxLength", F.char_length(text) > F.lit(spec.get("maxLength")))):
        if name in spec:
            out.append((name, fails))
    for name, fails in (("minimum", lambda b: typed < b), ("maximum", lambda b: typed > b), ("exclusiveMinimum", lambda b: typed <= b), ("exclusiveMaximum", lambda b: typed >= b)):
        if name in spec:
            out.append((name, fails(F.lit(spec[name]))))
    return out


def _row(path: Column, why: str, value: Column) -> Column:
    return F.struct(path.alias("column"), F.lit(why).alias("reason"), value.cast("string").alias("value"))


def _none() -> Column:
    return F.array().cast(f"array<{VIOLATION}>")


def _scalar(spec: dict, kind: str, raw: Column, path: Column, required: bool) -> tuple[Column, list[Column]] | None:
    """Whether a scalar as it came violates anything, and its rows (column, reason, value), null where they do not hold; None if nothing can."""
    text = raw.cast("string")
    missing, typed = raw.isNull() | (F.trim(text) == ""), raw.try_cast(kind)
    fails = [("cast", typed.isNull())] if kind != "string" else []
    fails += _rules(spec, F.trim(text) if kind != "string" else text, typed)
    rows = [F.when(missing, _row(path, "required", raw))] if required else []
    rows += [F.when(~missing & bad, _row(path, name, raw)) for name, bad in fails]
    return (F.when(missing, F.lit(required)).otherwise(reduce(lambda a, b: a | b, [bad for _, bad in fails], F.lit(False))), rows) if rows else None


def _scalars(found: list[tuple[Column, list[Column]] | None]) -> list[Column]:
    """The rows of several scalars as one array, at most; most values violate nothing, and for them no row is made."""
    found = [f for f in found if f is not None]
    return [F.when(reduce(lambda a, b: a | b, [bad for bad, _ in found]), F.array(*[r for _, rows in found for r in rows])).otherwise(_none())] if found else []


def _together(parts: list[Column]) -> Column:
    return F.flatten(F.array(*parts)) if len(parts) > 1 else parts[0] if parts else _none()


def _parts(values: list[tuple[dict, Column, Column, bool]], whole: bool) -> Column:
    """All that values violate, each of (schema, text, path, whether it is required): scalars together, JSON one by one."""
    plain = [_scalar(spec, spark_type(spec), text, path, required) for spec, text, path, required in values if not _is_nested(spec)]
    return _together(_scalars(plain) + [_violations(*v, whole) for v in values if _is_nested(v[0])])


def _violations(spec: dict, text: Column, path: Column, required: bool, whole: bool) -> Column:
    """All that JSON text, or its value where it was parsed whole, violates; its parts have paths of their own, such as ``items[3].price``."""

    def inside(value: Column) -> Column:
        if _kind(spec) == "object":
            return unless_unread(value, _parts([(s, value[k], F.concat(path, F.lit(f".{k}")), k in spec.get("required", ())) for k, s in spec.get("properties", {}).items()], whole))
        item, size = spec.get("items", {}), F.size(value)
        needs = "null" not in (item.get("type") or [])
        each = F.flatten(F.transform(value, lambda x, i: _parts([(item, x, F.concat(path, F.lit("["), i.cast("string"), F.lit("]")), needs)], whole)))
        sizes = [(name, fails) for name, fails in (("minItems", size < F.lit(spec.get("minItems"))), ("maxItems", size > F.lit(spec.get("maxItems")))) if name in spec]
        return unless_unread(value, _together([F.array(F.when(fails, _row(path, name, size))) for name, fails in sizes] + [each]))

    def unless_unread(value: Column, found: Column) -> Column:
        if whole:
            return found
        missing = text.isNull() | (F.trim(text) == "")
        unread = F.array(F.when(~missing, _row(path, "cast", text)), *([F.when(missing, _row(path, "required", text))] if required else []))
        return F.when(value.isNull(), unread).otherwise(found)

    return _opened(text, spec, whole, inside)


def _reasons(df: DataFrame, contract: Contract, shape: str | None = None) -> Column:
    """An array of (column, reason, value) for each row."""
    plain, found = [], []
    for c, kind in contract.types.items():
        spec, path, required = contract.spec(c), F.lit(c), c in contract.required
        if c not in df.columns:
            if required:
                found.append(F.array(_row(path, "required", F.lit(None))))
        elif _is_nested(spec):
            found.append(_held(_as_text(df, c), lambda text: _read(text, spec, lambda x, whole: _violations(spec, x, path, required, whole))))  # noqa: B023 - called at once
        else:
            plain.append(_scalar(spec, kind, named(c), path, required))
    if shape is not None and shape in df.columns:
        found.append(F.array(F.when(named(shape).isNotNull(), _row(F.lit("record"), "shape", named(shape)))))
    return F.array_compact(_together(_scalars(plain) + found))


def contract_violations(df: DataFrame, contract: Contract, key: str, shape: str | None = None) -> DataFrame:
    """A row (key, column, reason, value) for each violation, and one per extra column (null key).

    Reasons: ``required``, ``cast``, ``extra``, the rules of JSON Schema (``enum``, ``const``, ``pattern``, ``minimum``,
    ``maximum``, their exclusive forms, lengths and numbers of items), and ``shape`` for records that don't fit their header, where
    ``shape`` names the column that tells so. Violations inside arrays and objects name their path.
    """
    each = df.select(named(key).cast("string").alias("key"), F.inline(_reasons(df, contract, shape)))
    extra = [c for c in df.columns if c not in contract.types and c != shape]
    if not extra:
        return each
    rows = [(None, c, "extra", None) for c in extra]
    return each.unionByName(df.sparkSession.createDataFrame(rows, "key string, column string, reason string, value string"))


def quarantine(df: DataFrame, contract: Contract, shape: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected) rows as they came; rejected ones with ``reasons``, the sorted ``column:reason``, each once.

    A column of that name stays as it is, and the added one gets another name, with _ appended.
    """
    (out,) = private(df.columns, "reasons")
    reasons = F.array_sort(F.array_distinct(F.transform(_reasons(df, contract, shape), lambda r: F.concat_ws(":", r["column"], r["reason"]))))
    marked = df.withColumn(out, reasons)
    return marked.where(F.size(out) == 0).drop(out), marked.where(F.size(out) > 0)
