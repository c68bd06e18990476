"""Share of a total over already grouped rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parcelwise.functions.numeric import pct


def share_of_total(groups: DataFrame, measure: str, alias: str, within: tuple[str, ...] = ()) -> DataFrame:
    """Adds ``measure`` as a percentage of its sum over all rows, or over ``within``.

    ``groups`` is the output of an aggregation on a few labels: the window sees one
    row per group, never the rows that were grouped.
    """
    whole = F.sum(measure).over(Window.partitionBy(*within))
    return groups.withColumn(alias, pct(F.col(measure), whole))
