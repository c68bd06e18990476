"""Reading the corpus tables and keeping intermediate results."""

from __future__ import annotations

import gc

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parcelwise.sources import store

WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"
ARROW_ROWS = 512


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table of the corpus. Arrow batches are kept short, since texts may be long."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    return spark.read.parquet(f"{folder}/{name}.parquet")


def kept(df: DataFrame, label: str, **options: str) -> DataFrame:
    """``df`` written to the shared folder and read back, which also cuts its lineage.

    Spark frees shuffle files once the driver collects the plans that made them, so it is asked to before
    each step: a job of many steps would otherwise hold the shuffles of all its steps on disk.
    """
    gc.collect()
    df.sparkSession._jvm.System.gc()
    return store(df, label, **options)


def dropped(*tables: DataFrame) -> None:
    """Removes written tables that nothing reads any more, so that a job of many steps holds the last ones only."""
    for df in tables:
        jvm, files = df.sparkSession._jvm, df.inputFiles()
        if files:
            path = jvm.org.apache.hadoop.fs.Path(files[0]).getParent()
            path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def by_shuffle(df: DataFrame) -> DataFrame:
    """``df`` as a side of a join by sorted shuffles: for aggregates of the other side, which is shuffled before their size is known.

    Else those that turn out small are gathered on the driver, in a job and a broadcast of their own, and no shuffle is saved.
    """
    return df.hint("merge")


def word_count(text):
    """Number of words of a text column, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def crc_mod(doc_id, n: int):
    """crc32 of the id written as text, modulo ``n``; null ids count as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n
