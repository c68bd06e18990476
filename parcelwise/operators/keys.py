"""Duplicate, orphan and unmatched keys of several tables from one grouping.

All tables that share a key are stacked as (key, side) rows and grouped once, so one
shuffle answers every question about that key and no join is run. Rows are counted
before the shuffle, so a hot key sends one row per map task.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class KeySide:
    """One table's part in a key profile: its name, rows and key columns."""

    name: str
    df: DataFrame
    columns: tuple[str, ...]


def _rows(side: str) -> Column:
    return F.col(f"rows_{side}")


def key_profile(sides: Sequence[KeySide]) -> DataFrame:
    """One row per distinct key, with ``has_null`` and a row count for each side."""
    width = len(sides[0].columns)
    if any(len(side.columns) != width for side in sides):
        raise ValueError("all sides of a key profile need equally many key columns")
    keys = [f"key_{i}" for i in range(width)]
    stacked = reduce(
        DataFrame.unionAll,
        (
            side.df.select(*(F.col(c).alias(k) for c, k in zip(side.columns, keys)), F.lit(i).alias("side"))
            for i, side in enumerate(sides)
        ),
    )
    counts = [F.count_if(F.col("side") == i).alias(f"rows_{side.name}") for i, side in enumerate(sides)]
    has_null = reduce(Column.__or__, (F.col(k).isNull() for k in keys))
    return stacked.groupBy(*keys).agg(*counts).withColumn("has_null", has_null)


def duplicate_keys(side: str) -> Column:
    """Aggregate over a profile: keys held by more than one row of ``side``."""
    return F.count_if(_rows(side) > 1)


def orphan_rows(child: str, parent: str) -> Column:
    """Aggregate over a profile: ``child`` rows without a ``parent`` row, NULL keys included."""
    orphan = F.col("has_null") | (_rows(parent) == 0)
    return F.coalesce(F.sum(F.when(orphan, _rows(child))), F.lit(0))


def unmatched_keys(child: str, parent: str) -> Column:
    """Aggregate over a profile: distinct non-NULL ``child`` keys without a ``parent`` row."""
    return F.count_if(~F.col("has_null") & (_rows(child) > 0) & (_rows(parent) == 0))
