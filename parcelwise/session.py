"""Session settings the package is tuned for. Results do not depend on them."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.timestampType": "TIMESTAMP_NTZ",
    # Re-plan at run time: broadcast by measured size, split hot partitions, merge small ones.
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.ui.enabled": "false",
}


def tuned(builder: SparkSession.Builder) -> SparkSession.Builder:
    """Adds the package's settings.

    On a cluster also set ``spark.checkpoint.dir`` to a shared folder, and
    ``spark.sql.shuffle.partitions`` to about the largest shuffle's bytes / 64 MB; small
    shuffles are merged at run time.
    """
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    return builder
