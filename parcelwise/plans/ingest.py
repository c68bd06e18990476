"""Full reload of the raw tables from CSV."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import SparkSession

from parcelwise.plans.quality import require_constraints
from parcelwise.sources.csv_files import csv_path, located, read_csv_tables, require_closed_quotes
from parcelwise.sources.schema import TABLE_SPECS
from parcelwise.sources.tables import Tables, each_at_once, load_tables
from parcelwise.sources.versions import VersionedFolder


def ingest(
    spark: SparkSession,
    raw_dir: str,
    out_dir: str,
    paths: Mapping[str, str] | None = None,
    strict: bool = True,
) -> Tables:
    """CSV to one Parquet folder per table, a new version in place of what was there.

    Malformed input stops the load with the places of the first bad records. ``strict`` also raises when a loaded table
    breaks a declared key, NOT NULL, length or score rule; the views rely on those keys. Without it
    the same violations can be read with ``quality.constraint_violations``. A few tables are loaded at a time.

    The new tables are written and checked as a version of their own, which one small file makes the newest: a reader sees
    all nine tables of one load, also while another is running or after it died. A refused load leaves nothing. The version before
    stays for readers still at work; ``VersionedFolder(spark, out_dir).vacuum()`` removes older ones.

    Written with zstd: a key with too many values for a dictionary takes half as much again with Spark's usual codec.
    """
    raw = read_csv_tables(spark, raw_dir, paths)
    folder = VersionedFolder(spark, out_dir)
    id_ = folder.new_id()

    def load(name: str) -> None:
        df, path = raw[name], csv_path(spark, name, raw_dir, paths)
        require_closed_quotes(spark, name, path)
        try:
            df.write.option("compression", "zstd").parquet(f"{folder.staging(id_)}/{name}")
        except Exception as error:
            raise located(spark, name, path, error) from error

    try:
        each_at_once(spark, load)
        if strict:
            require_constraints(load_tables(spark, folder.staging(id_)))
    except Exception:
        folder.discard(id_)
        raise
    folder.accept(id_, TABLE_SPECS)
    return load_tables(spark, out_dir)
