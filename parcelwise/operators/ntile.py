"""NTILE over a whole table without one all-holding partition, and without storing it.

``ntile() OVER (ORDER BY …)`` without PARTITION BY moves every row to one task. Here the key space is cut into ranges by
bounds that are literals of the plan, each row is numbered within its range, and the rows of the ranges before
it are literals too. A task that is run again after a lost executor so gives the same numbers, and nothing is written.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

SAMPLED = 24  # keys for each range, from which the bounds are taken
MOST_RANGES = 1024  # each is a literal bound of the plan


@dataclass(frozen=True)
class SortKey:
    """A column to sort by. NULLs come last unless said otherwise."""

    column: str
    ascending: bool = True
    nulls_last: bool = True

    def order(self) -> Column:
        c = F.col(f"`{self.column}`")
        if self.ascending:
            return c.asc_nulls_last() if self.nulls_last else c.asc_nulls_first()
        return c.desc_nulls_last() if self.nulls_last else c.desc_nulls_first()

    def before(self, bound) -> Column:
        """Whether a row's value comes before ``bound``, never NULL."""
        c = F.col(f"`{self.column}`")
        if bound is None:
            return c.isNotNull() if self.nulls_last else F.lit(False)
        less = c < _literal(bound) if self.ascending else c > _literal(bound)
        return F.coalesce(less, F.lit(not self.nulls_last))


def _literal(value) -> Column:
    return F.lit(value.isoformat(sep=" ")).cast("timestamp_ntz") if isinstance(value, datetime) else F.lit(value)


def _before(keys: Sequence[SortKey], bound: Row) -> Column:
    """Whether a row comes before a bound in the order of all keys."""
    parts = list(zip(keys, bound, strict=True))

    def same(key: SortKey, value) -> Column:
        return F.col(f"`{key.column}`").eqNullSafe(F.lit(None) if value is None else _literal(value))

    return reduce(
        lambda later, part: part[0].before(part[1]) | (same(*part) & later), reversed(parts[:-1]), parts[-1][0].before(parts[-1][1])
    )


def _range_of(keys: Sequence[SortKey], bounds: Sequence[Row], low: int = 0) -> Column:
    """The number of bounds at or before a row, by a tree of comparisons as deep as the logarithm of their number."""
    if not bounds:
        return F.lit(low)
    middle = len(bounds) // 2
    return F.when(_before(keys, bounds[middle]), _range_of(keys, bounds[:middle], low)).otherwise(
        _range_of(keys, bounds[middle + 1 :], low + middle + 1)
    )


def range_bounds(df: DataFrame, keys: Sequence[SortKey], ranges: int) -> list[Row]:
    """Keys that cut ``df`` into about equal ranges, the same ones whenever the rows are the same.

    They are quantiles of the keys with the least hashes, ``SAMPLED`` for each range: a sample that depends on the rows alone. At
    most that many short rows reach the driver, whatever the size of ``df``.
    """
    names = [f"`{k.column}`" for k in keys]
    sample = df.select(*names).orderBy(F.xxhash64(*names), *(k.order() for k in keys)).limit(SAMPLED * ranges)
    rows = sample.orderBy(*(k.order() for k in keys)).collect()
    if len(rows) < SAMPLED * ranges:  # all rows are here: a range of its own for each part of them
        ranges = max(1, len(rows) // (SAMPLED * 40))
    bounds = [rows[len(rows) * k // ranges] for k in range(1, ranges)]
    return [b for k, b in enumerate(bounds) if k == 0 or b != bounds[k - 1]]


def distributed_ntile(
    df: DataFrame, n: int, order_by: Sequence[SortKey], alias: str, keep: Sequence[str] | None = None
) -> DataFrame:
    """Adds ``alias``: 1..n in the order given; the first ``rows % n`` groups get one row more.

    ``order_by`` should end in a unique column, so that equal rows are split the same way on every run. When called, it runs two
    short jobs over the key columns: one finds the bounds of the ranges, the other counts each range; both results have a
    row for each range. Rows with equal leading keys, also a third of all rows, are cut by the later ones. ``keep``
    names the columns to return, all by default.
    """
    if n < 1:
        raise ValueError("NTILE needs at least one group")
    kept = df.columns if keep is None else list(keep)
    ranges = min(MOST_RANGES, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    bounds = range_bounds(df, order_by, ranges)
    ranged = df.withColumn("_range", _range_of(order_by, bounds))
    sizes = {r["_range"]: r["count"] for r in ranged.groupBy("_range").count().collect()}
    total = sum(sizes.values())
    before, so_far = [], 0
    for k in range(len(bounds) + 1):
        before.append(so_far)
        so_far += sizes.get(k, 0)

    within = Window.partitionBy("_range").orderBy(*(k.order() for k in order_by))
    offset = F.element_at(F.array(*(F.lit(x).cast("long") for x in before)), F.col("_range") + 1)
    rank = F.row_number().over(within) - 1 + offset
    base, larger = divmod(total, n)
    in_larger = larger * (base + 1)
    tile = F.when(
        F.col("_rank") < in_larger, F.call_function("div", F.col("_rank"), F.lit(base + 1))
    ).otherwise(larger + F.call_function("div", F.col("_rank") - in_larger, F.lit(max(base, 1))))
    return ranged.withColumn("_rank", rank).withColumn(alias, (tile + 1).cast("int")).select(*kept, alias)
