"""Intermediate results that must outlive executors: written tables in shared storage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch_folder(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Without one, a local session gets a temporary folder of its own; a cluster session must
    name one, since a temporary folder of one machine is not shared.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if named:
        return named
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="parcelwise-"))
    return context.getCheckpointDir()


def store(df: DataFrame, label: str, **options: str) -> DataFrame:
    """Writes ``df`` as Parquet under this application's scratch folder and reads it back; ``options`` of the writer."""
    spark = df.sparkSession
    application = spark.sparkContext.applicationId
    path = f"{scratch_folder(spark)}/{application}/{label}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)
