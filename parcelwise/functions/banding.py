"""Range bands: a number to the label of the interval it falls in."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Bands:
    """``len(edges) + 1`` labels; the last also takes NULL.

    A value equal to an edge goes to the band above it, or below when ``inclusive``.
    """

    edges: tuple[float, ...]
    labels: tuple[str, ...]
    inclusive: bool = False

    def __post_init__(self) -> None:
        if len(self.labels) != len(self.edges) + 1:
            raise ValueError("bands need exactly one label more than edges")
        if list(self.edges) != sorted(set(self.edges)):
            raise ValueError("band edges must strictly increase")


def band(value: Column, bands: Bands) -> Column:
    chain = F
    for edge, label in zip(bands.edges, bands.labels):
        below = value <= edge if bands.inclusive else value < edge
        chain = chain.when(below, label)
    return chain.otherwise(bands.labels[-1])


def position(value: Column, ordered: Sequence[str]) -> Column:
    """Place of ``value`` in ``ordered`` (from 1), unlisted values last; a sort key."""
    chain = F
    for place, item in enumerate(ordered, start=1):
        chain = chain.when(value == item, place)
    return chain.otherwise(len(ordered) + 1)
