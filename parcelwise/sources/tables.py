"""The nine raw tables as one value, and the places they are read from and written to."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Mapping
from concurrent.futures import FIRST_EXCEPTION, ThreadPoolExecutor, wait
from functools import partial

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession

from parcelwise.sources import catalog
from parcelwise.sources.schema import TABLE_SPECS, struct_type
from parcelwise.sources.versions import VersionedFolder


class Tables:
    """The nine raw tables by name, as attributes or items.

    Each is given as a frame, or as a function that makes it on first use: opening a large
    table lists its files, and most queries need few of the nine.
    """

    def __init__(self, **sources: DataFrame | Callable[[], DataFrame]) -> None:
        if sources.keys() != TABLE_SPECS.keys():
            raise ValueError(f"expected the tables {sorted(TABLE_SPECS)}, got {sorted(sources)}")
        self._sources = sources

    def __getitem__(self, name: str) -> DataFrame:
        source = self._sources[name]
        if not isinstance(source, DataFrame):
            source = self._sources[name] = source()
        return source

    def __getattr__(self, name: str) -> DataFrame:
        if name not in TABLE_SPECS:
            raise AttributeError(name)
        return self[name]

    def items(self) -> Iterator[tuple[str, DataFrame]]:
        return ((name, self[name]) for name in TABLE_SPECS)


def each_at_once(spark: SparkSession, work: Callable[[str], None], most: int = 4) -> None:
    """``work`` of the name of every table, up to ``most`` at a time, so that a table of few files leaves no core idle.

    After an error no further table is begun and those at work are waited for; of several errors the one of the first table in
    declared order is raised, which is the one that table after table would end with.
    """
    inherits = inheritable_thread_target(spark)  # the session itself where threads are not pinned
    run = work if inherits is spark else inherits(work)
    pool = ThreadPoolExecutor(most)
    try:
        tasks = [pool.submit(run, name) for name in TABLE_SPECS]
        wait(tasks, return_when=FIRST_EXCEPTION)
    finally:
        pool.shutdown(cancel_futures=True)
    for task in tasks:
        if not task.cancelled():
            task.result()


def load_tables(spark: SparkSession, folder: str) -> Tables:
    """Parquet scan of all nine tables with their declared schemas.

    Where ``folder`` holds versions, the newest one is looked up once, here: the tables of one value are always of one
    load, whatever is loaded meanwhile. Otherwise each table is a folder of its own below ``folder``.
    """
    version = VersionedFolder(spark, folder).latest()
    paths = version.paths if version else {name: f"{folder}/{name}" for name in TABLE_SPECS}
    return Tables(
        **{name: partial(spark.read.schema(struct_type(name)).parquet, paths[name]) for name in TABLE_SPECS}
    )


def write_tables(tables: Tables, folder: str) -> None:
    """Replaces each table's Parquet folder; running it again gives the same tables."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{folder}/{name}")


def _path(spark: SparkSession, folder: str):
    """A folder and the file system it is on."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def remove_folder(spark: SparkSession, folder: str) -> None:
    path, files = _path(spark, folder)
    files.delete(path, True)


def replace_folders(spark: SparkSession, source: str, target: str, names: Iterable[str]) -> None:
    """Moves the named folders of ``source`` to ``target``, in place of those there.

    An old folder is moved aside first and removed at the end; if a move fails, those already made are undone.
    """
    path = lambda folder, name: _path(spark, f"{folder.rstrip('/')}/{name}")[0]
    base, files = _path(spark, target)
    files.mkdirs(base)
    moved: list[tuple] = []

    def move(a, b) -> None:
        if not files.rename(a, b):
            raise OSError(f"cannot move {a} to {b}")
        moved.append((a, b))

    aside = f"{source.rstrip('/')}-old"
    files.mkdirs(_path(spark, aside)[0])
    try:
        for name in names:
            if files.exists(path(target, name)):
                move(path(target, name), path(aside, name))
            move(path(source, name), path(target, name))
    except Exception:
        for a, b in reversed(moved):
            files.rename(b, a)
        raise
    remove_folder(spark, aside)
    remove_folder(spark, source)
    for name in names:
        spark.catalog.refreshByPath(f"{target.rstrip('/')}/{name}")


def save_tables(tables: Tables, database: str) -> Tables:
    """Replaces the tables in a catalog database, as one version, and returns them as read from it."""
    spark = tables.orders.sparkSession
    return Tables(**catalog.save(spark, database, "tables", TABLE_SPECS, lambda name, _: tables[name]))


def open_tables(spark: SparkSession, database: str) -> Tables:
    """The tables of the newest version saved in a catalog database."""
    return Tables(**catalog.open_saved(spark, database, "tables"))


def register(frames: Mapping[str, DataFrame]) -> None:
    """Creates or replaces one temporary SQL view per frame."""
    for name, df in frames.items():
        df.createOrReplaceTempView(name)


def publish(frames: Mapping[str, DataFrame], folder: str) -> None:
    """Writes each frame to its own Parquet folder for readers outside Spark."""
    for name, df in frames.items():
        df.write.mode("overwrite").parquet(f"{folder}/{name}")
