"""Graph-query scalar functions as column expressions, where Spark's own differ in null, type or bound handling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def truthy(value: Column, kind: T.DataType) -> Column:
    """Booleans as they are, null false, all else true."""
    return F.coalesce(value, F.lit(False)) if isinstance(kind, T.BooleanType) else value.isNotNull()


def to_integer(value: Column) -> Column:
    """Fractions are cut off; a string that isn't a number is an error under ANSI mode."""
    return value.cast("bigint")


def to_float(value: Column) -> Column:
    return value.cast("double")


def to_string(value: Column) -> Column:
    return value.cast("string")


def to_boolean(value: Column) -> Column:
    low = F.lower(value.cast("string"))
    return F.when(low == "true", True).when(low == "false", False)


def head(items: Column) -> Column:
    return F.try_element_at(items, F.lit(1))


def last(items: Column) -> Column:
    return F.try_element_at(items, F.lit(-1))


def tail(items: Column) -> Column:
    return F.slice(items, F.lit(2), F.greatest(F.size(items) - 1, F.lit(0)))


def span(first: Column, end: Column, step: Column | None = None) -> Column:
    """first … end, both included; a step of 0 or away from the end gives an empty list."""
    step = F.lit(1).cast("bigint") if step is None else step.cast("bigint")
    ok = ((step > 0) & (first <= end)) | ((step < 0) & (first >= end))
    safe = F.when(ok, step).otherwise(F.lit(1).cast("bigint"))
    low = F.when(ok, first.cast("bigint")).otherwise(F.lit(0).cast("bigint"))
    high = F.when(ok, end.cast("bigint")).otherwise(F.lit(0).cast("bigint"))
    return F.when(ok, F.sequence(low, high, safe)).otherwise(F.array().cast("array<bigint>"))


def member(value: Column, items: Column) -> Column:
    """x IN list: null if either is null; nulls within the list match nothing."""
    return F.when(value.isNull() | items.isNull(), F.lit(None).cast("boolean")).otherwise(F.exists(items, lambda e: e.eqNullSafe(value)))


def whole_match(text: Column, pattern: str) -> Column:
    """The pattern has to match the whole text."""
    return text.rlike(f"\\A(?:{pattern})\\z")


def int_divide(a: Column, b: Column) -> Column:
    """Whole-number division cut towards zero; dividing by zero is an error under ANSI mode."""
    return F.call_function("div", a.cast("bigint"), b.cast("bigint"))


def xor(a: Column, b: Column) -> Column:
    return a != b


def simple_case(subject: Column, pairs: list[tuple[Column, Column]], otherwise: Column | None = None) -> Column:
    """CASE subject WHEN …: null matches null."""
    out = None
    for value, result in pairs:
        test = subject.eqNullSafe(value)
        out = F.when(test, result) if out is None else out.when(test, result)
    return out if otherwise is None else out.otherwise(otherwise)


def keys_of(df: DataFrame, var: str) -> Column:
    """The names of a bound variable's non-null properties, in order."""
    names = sorted(c.split("__", 1)[1] for c in df.columns if c.startswith(f"{var}__"))
    names = [n for n in names if n not in ("id", "label", "labels", "src", "dst", "type", "ends")]
    return F.array_compact(F.array(*(F.when(F.col(f"{var}__{n}").isNotNull(), n) for n in names)))


def properties_of(df: DataFrame, var: str) -> Column:
    names = sorted(c.split("__", 1)[1] for c in df.columns if c.startswith(f"{var}__"))
    names = [n for n in names if n not in ("id", "label", "labels", "src", "dst", "type", "ends")]
    return F.struct(*(F.col(f"{var}__{n}").alias(n) for n in names))


def length(text: Column) -> Column:
    """Characters of a string."""
    return F.char_length(text)


def add(a: Column, b: Column, kind: T.DataType) -> Column:
    """+ by kind: strings and lists are put together, numbers summed."""
    return F.concat(a, b) if isinstance(kind, (T.StringType, T.ArrayType)) else a + b


def unwind(value: Column, kind: T.DataType) -> Column:
    """UNWIND: a row for each item of a list; none for null or an empty list, one for any other value."""
    return F.explode(value if isinstance(kind, T.ArrayType) else F.array_compact(F.array(value)))


def sum_or_zero(value: Column) -> Column:
    return F.coalesce(F.sum(value), F.lit(0))


def collect_sorted(value: Column, *order: Column) -> Column:
    """Non-null values as a list, in the order given."""
    rows = F.sort_array(F.collect_list(F.when(value.isNotNull(), F.struct(*(o.alias(f"k{i}") for i, o in enumerate(order)), value.alias("v")))))
    return F.transform(rows, lambda r: r["v"])


def ascending(value: Column) -> Column:
    """Nulls last."""
    return value.asc_nulls_last()


def descending(value: Column) -> Column:
    """Nulls first."""
    return value.desc_nulls_first()
