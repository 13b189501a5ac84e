"""The plan's operators as plain DataFrame functions, usable without SQL.

Each declares what it computes and leaves the strategy to Catalyst: filters and columns reach the scans, joins are
broadcast, hashed or sorted by size, aggregates are partial before they shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import DuplicateColumn, InvalidOperation

HOW = {"inner": "inner", "left": "left", "right": "right", "full": "full", "cross": "cross"}


def scan(frame: DataFrame, alias: str) -> DataFrame:
    """A table under an alias: column c becomes ``alias.c``, so that names of several tables cannot clash."""
    return frame.select([F.col(f"`{c}`").alias(f"{alias}.{c}") for c in frame.columns])


def keep_where(frame: DataFrame, condition: Column) -> DataFrame:
    """Rows whose condition is true; null drops."""
    return frame.where(condition)


def join(left: DataFrame, right: DataFrame, how: str, condition: Column | None) -> DataFrame:
    """Null keys never match; a cross join's WHERE is pushed into it, so a comma list with equal keys is an equi-join."""
    if how not in HOW:
        raise InvalidOperation(f"join {how}")
    return left.crossJoin(right) if condition is None else left.join(right, condition, HOW[how])


def aggregate(frame: DataFrame, keys: Sequence[Column], measures: Sequence[Column]) -> DataFrame:
    """One row per group; without keys one row for all, even for no rows. Null is a key like any other."""
    if not keys:
        return frame.agg(*(measures or [F.count(F.lit(1)).alias("__rows")]))
    return frame.groupBy(*keys).agg(*measures) if measures else frame.select(*keys).distinct()


def project(frame: DataFrame, outputs: Sequence[tuple[str, Column]]) -> DataFrame:
    """Named outputs; two of one name (in any case) are an error."""
    seen: set[str] = set()
    for name, _ in outputs:
        if name.lower() in seen:
            raise DuplicateColumn(name)
        seen.add(name.lower())
    return frame.select([c.alias(n) for n, c in outputs])


def sort(frame: DataFrame, keys: Sequence[tuple[Column, bool]]) -> DataFrame:
    """By (column, descending); nulls come first ascending and last descending."""
    return frame.orderBy([c.desc_nulls_last() if down else c.asc_nulls_first() for c, down in keys])


def top(frame: DataFrame, n: int) -> DataFrame:
    """The first n rows; after a sort, a top-k that keeps n rows a partition."""
    return frame.limit(n)


def find(frame: DataFrame, column: str, key: object) -> DataFrame:
    """Index lookup: rows with the key; Parquet's statistics leave out files and row groups without it."""
    return frame.where(F.col(column) == F.lit(key))


def find_range(frame: DataFrame, column: str, low: object, high: object) -> DataFrame:
    """Index range scan, both ends included; no rows if low is above high."""
    return frame.where(F.col(column).between(F.lit(low), F.lit(high)))


def count_keys(frame: DataFrame, column: str) -> DataFrame:
    """Index count: the number of keys that are not null."""
    return frame.agg(F.count(F.col(column)).alias("count"))
