"""Business labels. A missing estimate counts as Late; a missing score has no bucket."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Labels that results must carry exactly.
ON_TIME = "On Time"
LATE = "Late"
SATISFIED = "Satisfied"
NEUTRAL = "Neutral"
DISSATISFIED = "Dissatisfied"
UNKNOWN_CATEGORY = "unknown"
DELIVERED = "delivered"

# Report order of the statuses, and score limits of the buckets.
STATUS_ORDER = (LATE, ON_TIME)
POSITIVE_SCORE = 4
NEGATIVE_SCORE = 2


def delivery_status(delivered: Column, estimated: Column) -> Column:
    return F.when(delivered <= estimated, ON_TIME).otherwise(LATE)


def satisfaction_bucket(score: Column) -> Column:
    return (
        F.when(score >= POSITIVE_SCORE, SATISFIED)
        .when(score <= NEGATIVE_SCORE, DISSATISFIED)
        .when(score.isNotNull(), NEUTRAL)
    )


def category_name(translated: Column, original: Column) -> Column:
    return F.coalesce(translated, original, F.lit(UNKNOWN_CATEGORY))
