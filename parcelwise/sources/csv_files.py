"""CSV scans: declared types, no inference, and an error that names the place of bad input.

Any quoted field may hold line breaks, so all files are read with ``multiLine``, which splits the work by file: a large
delivery comes as a folder of many files. A table known to have no such breaks can be read with ``multiline=False``, which splits
files too. In a file whose lines end in CRLF a CRLF inside quotes is read as LF; elsewhere breaks stay as they are.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parcelwise.sources.schema import TABLE_SPECS, struct_type
from parcelwise.sources.tables import Tables

# An unquoted empty field is NULL and a quoted one is an empty string. Spark maps both
# to its null marker when that is empty, so the marker is a character no text may hold.
_OPTIONS = {
    "header": "true",
    "enforceSchema": "true",
    "encoding": "UTF-8",
    "quote": '"',
    "escape": '"',
    "nullValue": "\u0000",
}
_BAD = "_malformed"
PLACES = 5  # bad records that an error names
SHOWN = 120  # characters of each


def read_csv_table(spark: SparkSession, name: str, path: str, multiline: bool = True) -> DataFrame:
    """Lazy scan of one table's CSV file, folder or glob."""
    options = {**_OPTIONS, "mode": "FAILFAST", "multiLine": str(multiline).lower()}
    return spark.read.schema(struct_type(name)).options(**options).csv(path)


def csv_path(
    spark: SparkSession, name: str, raw_dir: str, paths: Mapping[str, str] | None = None
) -> str:
    """Where a table's CSV lies: as named in ``paths``, or the one file or folder with its ending.

    Several that fit are refused, since reading all of them would repeat a table.
    """
    if paths and name in paths:
        return paths[name]
    pattern = spark._jvm.org.apache.hadoop.fs.Path(f"{raw_dir}/*{TABLE_SPECS[name].csv_suffix}")
    found = pattern.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(pattern) or []
    fits = sorted(status.getPath().toString() for status in found)
    if len(fits) != 1:
        raise ValueError(f"{name}: {len(fits)} files in {raw_dir} end in {TABLE_SPECS[name].csv_suffix}: {fits}")
    return fits[0]


def read_csv_tables(
    spark: SparkSession, raw_dir: str, paths: Mapping[str, str] | None = None
) -> Tables:
    """All nine tables; each is found in ``raw_dir`` by the end of its file name."""

    def scan(name: str) -> DataFrame:
        return read_csv_table(spark, name, csv_path(spark, name, raw_dir, paths))

    return Tables(**{name: partial(scan, name) for name in TABLE_SPECS})


def bad_records(spark: SparkSession, name: str, path: str) -> DataFrame:
    """``file``, ``record`` (from 1, below the header), ``fields`` that do not fit their type, and the ``text`` of each bad record.

    ``fields`` is empty where the number of fields is wrong. A record is numbered within its file, which one task reads.
    """
    schema = struct_type(name)
    texts = T.StructType([T.StructField(f.name, T.StringType()) for f in schema.fields])
    options = {**_OPTIONS, "mode": "PERMISSIVE", "multiLine": "true", "columnNameOfCorruptRecord": _BAD}
    rows = spark.read.schema(T.StructType([*schema.fields, T.StructField(_BAD, T.StringType())])).options(**options).csv(path)
    parsed = F.from_csv(_BAD, texts.toDDL(), {**_OPTIONS, "header": "false", "mode": "PERMISSIVE", "multiLine": "true"})
    misfits = [
        F.when(F.col(f"parts.{name}").isNotNull() & F.col(f"read.{name}").isNull(), F.lit(name)) for name in schema.names
    ]
    numbered = rows.select(
        F.col("_metadata.file_path").alias("file"),
        F.monotonically_increasing_id().alias("at"),
        F.struct(*schema.names).alias("read"),
        F.col(_BAD),
    )
    first = numbered.groupBy("file").agg(F.min("at").alias("first"))
    bad = numbered.where(F.col(_BAD).isNotNull()).join(first, "file").withColumn("parts", parsed)
    return bad.select(
        "file",
        (F.col("at") - F.col("first") + 1).alias("record"),
        F.array_compact(F.array(*misfits)).alias("fields"),
        F.col(_BAD).alias("text"),
    )


def unclosed_quotes(spark: SparkSession, path: str) -> list[str]:
    """Files with an odd number of quotes, whose last quoted field takes in the rest of the file. One short row a file.

    Quotes are counted as bytes, and only lines that hold one are taken apart: a count by characters was a quarter of a load's time.
    """
    quote = F.lit('"')
    lines = spark.read.option("lineSep", "\n").text(path).where(F.contains("value", quote))
    quotes = F.octet_length("value") - F.octet_length(F.replace("value", quote, F.lit("")))
    odd = lines.groupBy(F.col("_metadata.file_path").alias("file")).agg((F.sum(quotes) % 2).alias("odd")).where("odd = 1")
    return sorted(r.file for r in odd.limit(PLACES).collect())


def require_closed_quotes(spark: SparkSession, name: str, path: str) -> None:
    if files := unclosed_quotes(spark, path):
        raise ValueError(f"malformed {name}: quoted field never closed in {', '.join(files)}")


def located(spark: SparkSession, name: str, path: str, error: Exception) -> Exception:
    """``error`` of a load with the places of the first bad records; itself if there are none."""
    found = bad_records(spark, name, path).orderBy("file", "record").limit(PLACES + 1).collect()
    if not found:
        return error
    places = [
        f"{r.file}, record {r.record}, " + (f"field {', '.join(r.fields)}" if r.fields else "number of fields or quotes") + f": {r.text[:SHOWN]!r}"
        for r in found[:PLACES]
    ]
    more = " and more" if len(found) > PLACES else ""
    return ValueError(f"malformed {name}: " + "; ".join(places) + more)
