"""Where rows come from, and where snapshots are kept."""

from cairn.sources.loaders import csv, jdbc, json, orc, parquet, table
from cairn.sources.store import JsonRows, ParquetRows, SnapshotStore, StoredSnapshot, from_json_rows, to_json_rows

__all__ = ["JsonRows", "ParquetRows", "SnapshotStore", "StoredSnapshot", "csv", "from_json_rows", "jdbc", "json", "orc", "parquet", "table", "to_json_rows"]
