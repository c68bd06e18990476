"""One database of the session catalog for the raw tables and the views.

Each saved set of frames is a version below the database's location. Every folder of it is an external table of the catalog, named
after its version, and the plain name is a persistent view on that table. So any session reads ``database.orders`` or
``database.vw_…`` by name, and saving again switches each name in one step, never leaving it absent or half written.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from parcelwise.sources.versions import Version, VersionedFolder


def _quoted(*parts: str) -> str:
    return ".".join("`" + p.replace("`", "``") + "`" for p in parts)


def create_database(spark: SparkSession, database: str, location: str | None = None) -> str:
    """Creates the database if it is absent, at ``location`` if given, and returns where it lies."""
    place = "" if location is None else " LOCATION '" + location.replace("\\", "\\\\").replace("'", "\\'") + "'"
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {_quoted(database)}{place}")
    return spark.catalog.getDatabase(_quoted(database)).locationUri


def _table(name: str, version: Version) -> str:
    return f"{name}__{version.id}"


def _define(spark: SparkSession, database: str, version: Version, schemas: dict[str, T.StructType]) -> None:
    """External tables over a version, then the names that point to them, then the tables before are dropped (not their data)."""
    for name, schema in schemas.items():
        path = version.paths[name].replace("\\", "\\\\").replace("'", "\\'")
        spark.sql(
            f"CREATE TABLE {_quoted(database, _table(name, version))} ({schema.toDDL()}) USING parquet LOCATION '{path}'"
        )
    for name in schemas:
        spark.sql(
            f"CREATE OR REPLACE VIEW {_quoted(database, name)} AS SELECT * FROM {_quoted(database, _table(name, version))}"
        )
    current = {_table(name, version) for name in schemas}
    for table in spark.catalog.listTables(_quoted(database)):
        name, _, id_ = table.name.rpartition("__")
        if name in schemas and len(id_) == len(version.id) and table.name not in current and not table.isTemporary:
            spark.sql(f"DROP TABLE IF EXISTS {_quoted(database, table.name)}")


def save(
    spark: SparkSession,
    database: str,
    group: str,
    names: Iterable[str],
    frame: Callable[[str, dict[str, DataFrame]], DataFrame],
) -> dict[str, DataFrame]:
    """Writes the frames as one version of ``group``, names them in the database and returns them as read from there.

    ``frame`` gives the frame of a name from those written before it. If one fails, no name changes and nothing of the
    version is left. The version before stays on disk until ``saved(…).vacuum()``.
    """
    folder = saved(spark, database, group)
    id_ = folder.new_id()
    written: dict[str, DataFrame] = {}
    schemas: dict[str, T.StructType] = {}
    try:
        for name in names:
            df = frame(name, written)
            schemas[name] = df.schema
            df.write.parquet(f"{folder.staging(id_)}/{name}")
            written[name] = spark.read.schema(df.schema).parquet(f"{folder.staging(id_)}/{name}")
    except Exception:
        folder.discard(id_)
        raise
    version = folder.accept(id_, schemas)
    _define(spark, database, version, schemas)
    return {name: spark.table(_quoted(database, _table(name, version))) for name in schemas}


def saved(spark: SparkSession, database: str, group: str) -> VersionedFolder:
    """The versions of a group of frames of a database, which is created if it is absent."""
    return VersionedFolder(spark, f"{create_database(spark, database).rstrip('/')}/{group}")


def open_saved(spark: SparkSession, database: str, group: str) -> dict[str, DataFrame]:
    """The newest version of a group, all its names from that one version whatever is saved meanwhile."""
    version = saved(spark, database, group).latest()
    if version is None:
        raise ValueError(f"nothing was saved as {group} in {database}")
    return {name: spark.read.schema(spark.table(_quoted(database, name)).schema).parquet(path) for name, path in version.paths.items()}
