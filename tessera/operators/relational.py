"""The relational operators as thin DataFrame compositions; Catalyst picks the physical plan.

Scan, filter, project, inner equi-join on one or more keys, grouped and global aggregates, sort with offset and
fetch. SQL semantics throughout: null keys do not join, a null predicate drops the row, a grouped aggregate of no
rows has no rows, a global one has one row, nulls sort last unless asked otherwise.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.store import cut, small


def where(df: DataFrame, condition: Column | str) -> DataFrame:
    return df.where(condition)


def project(df: DataFrame, *columns: Column | str) -> DataFrame:
    return df.select(*columns)


def join(left: DataFrame, right: DataFrame, keys: Sequence[tuple[str, str]], broadcast_bytes: int = 0) -> DataFrame:
    """Inner equi-join on (left, right) key pairs. ``broadcast_bytes`` over 0 measures the right side first and broadcasts it
    only up to that size; otherwise the statistics and AQE decide."""
    if broadcast_bytes:
        right = small(right, broadcast_bytes)
    condition = None
    for a, b in keys:
        term = left[a] == right[b]
        condition = term if condition is None else condition & term
    return left.join(right, condition, "inner")


def aggregate(df: DataFrame, group: Sequence[str], *aggregates: Column) -> DataFrame:
    """Partial and final hash aggregation; an empty ``group`` is the global aggregate."""
    return df.groupBy(*group).agg(*aggregates) if group else df.agg(*aggregates)


def order(keys: Sequence[tuple[str, str]]) -> list[Column]:
    """('column', 'asc' or 'desc') with nulls last in both directions."""
    return [F.col(c).asc_nulls_last() if way == "asc" else F.col(c).desc_nulls_last() for c, way in keys]


def sort(df: DataFrame, keys: Sequence[tuple[str, str]], offset: int = 0, fetch: int | None = None) -> DataFrame:
    """ORDER BY with OFFSET and FETCH; with a fetch the plan is a top-k per partition, not a total sort."""
    out = df.orderBy(*order(keys)) if keys else df
    out = out.offset(offset) if offset else out
    return out if fetch is None else out.limit(fetch)


def numbered(df: DataFrame, keys: Sequence[Column], name: str) -> DataFrame:
    """Adds each row's place in the order of ``keys``, from 0; equal rows get theirs in any order.

    The sort deals ranges to partitions. Sorted rows are written with their place in their partition, and shifted by the
    counts of the partitions before: no partition holds more than its range.
    """
    place = "__place"
    rows = cut(df.orderBy(*keys).withColumn(place, F.monotonically_increasing_id()), "sorted")  # partition in the upper bits, row in the lower 33
    part, own = F.shiftright(place, 33), F.col(place).bitwiseAND(F.lit((1 << 33) - 1))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    shift = rows.groupBy(part.alias("__part")).agg(F.count(F.lit(1)).alias("__n")).select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__shift"))
    return rows.join(F.broadcast(shift), part == F.col("__part")).select(*df.columns, (own + F.col("__shift")).cast("long").alias(name))
