"""Zero-or-one values as nullable columns: nothing in, nothing out."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F


def some(x: Column) -> Column:
    """The value; a null raises."""
    return F.when(x.isNotNull(), x).otherwise(F.raise_error(F.lit("a value is required")))


def of(x: Column) -> Column:
    return x


def none(kind: str) -> Column:
    return F.lit(None).cast(kind)


def map_(x: Column, f: Callable[[Column], Column]) -> Column:
    """f of the value; never calls f on nothing, whatever f makes of null."""
    return F.when(x.isNotNull(), f(x))


flat_map = map_


def map_strict(x: Column, f: Callable[[Column], Column]) -> Column:
    """f of the value; a value that f makes nothing of raises."""
    return F.when(x.isNotNull(), some(f(x)))


def if_present(rows: DataFrame, x: Column) -> DataFrame:
    """The rows that have a value."""
    return rows.where(x.isNotNull())


def is_present(x: Column) -> Column:
    return x.isNotNull()


def get(x: Column) -> Column:
    """The value; nothing raises."""
    return F.when(x.isNotNull(), x).otherwise(F.raise_error(F.lit("no value is present")))


def or_else(x: Column, default) -> Column:
    return F.coalesce(x, default if isinstance(default, Column) else F.lit(default))
