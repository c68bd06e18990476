"""Where tables come from and go to."""

from parcelwise.sources.csv_files import read_csv_table, read_csv_tables
from parcelwise.sources.schema import TABLE_SPECS, Field, TableSpec, struct_type
from parcelwise.sources.scratch import scratch_folder, store
from parcelwise.sources.tables import Tables, load_tables, open_tables, publish, register, save_tables, write_tables
from parcelwise.sources.versions import VersionedFolder

__all__ = [
    "TABLE_SPECS",
    "Field",
    "TableSpec",
    "Tables",
    "VersionedFolder",
    "load_tables",
    "open_tables",
    "publish",
    "read_csv_table",
    "read_csv_tables",
    "register",
    "save_tables",
    "scratch_folder",
    "store",
    "struct_type",
    "write_tables",
]
