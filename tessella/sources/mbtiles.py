"""Archives in SQLite as a Spark source, and a sink for them.

The source is split by ranges of zoom and column, so that a large archive is read by many tasks; each
task opens the file by itself, so its path must be on a file system that every executor mounts. Rows
come in Arrow batches. Keys have a table of their own, read without the data. Where the session has
spark.sql.python.filterPushdown.enabled, filters on zoom, column and row are put into each task's SQL.
"""

from __future__ import annotations

import sqlite3
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import (
    DataSource,
    DataSourceReader,
    EqualTo,
    Filter,
    GreaterThan,
    GreaterThanOrEqual,
    In,
    InputPartition,
    IsNotNull,
    LessThan,
    LessThanOrEqual,
)

from tessella.operators.tileset import Tileset, detect_layout

_TYPES = {"zoom_level": "int", "tile_column": "bigint", "tile_row": "bigint", "tile_data": "binary", "tile_data_id": "bigint", "fetched": "bigint", "expires": "bigint"}
_NAMES = {"zoom_level": "z", "tile_column": "x", "tile_row": "y"}
_TABLES = {
    "normalized": {"map": ["zoom_level", "tile_column", "tile_row", "tile_id"], "images": ["tile_id", "tile_data"]},
    "dedup_id": {"tiles_shallow": ["zoom_level", "tile_column", "tile_row", "tile_data_id"], "tiles_data": ["tile_data_id", "tile_data"]},
    "flat_with_hash": {"tiles_with_hash": ["zoom_level", "tile_column", "tile_row", "tile_data", "tile_hash"]},
    "flat": {"tiles": ["zoom_level", "tile_column", "tile_row", "tile_data"]},
    "cache": {"tile_cache": ["zoom_level", "tile_column", "tile_row", "fetched", "expires", "etag", "tile_data"]},
}


def _open(path: str) -> sqlite3.Connection:
    return sqlite3.connect(f"file:{path.removeprefix('file://')}?mode=ro", uri=True)


_ARROW = {"int": pa.int32(), "bigint": pa.int64(), "binary": pa.binary()}
_SIGNS = {EqualTo: "=", GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<="}
BATCH_ROWS = 1000


class _Rows(InputPartition):
    def __init__(self, low: int, high: int):
        self.low, self.high = low, high


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.table, self.columns = options["path"], options["table"], options["columns"].split(",")
        self.parts = int(options.get("partitions", 8))
        self.tests: list[tuple[str, list]] = []

    def partitions(self) -> list[InputPartition]:
        with _open(self.path) as db:
            low, high = db.execute(f'SELECT min(rowid), max(rowid) FROM "{self.table}"').fetchone()
        if low is None:
            return [_Rows(0, 0)]
        step = max(1, -(-(high - low + 1) // self.parts))
        return [_Rows(k, min(k + step, high + 1)) for k in range(low, high + 1, step)]

    def read(self, partition: _Rows) -> Iterator[pa.RecordBatch]:
        names = ", ".join(f'"{c}"' for c in self.columns)
        kinds = [_ARROW.get(_TYPES.get(c, "string"), pa.string()) for c in self.columns]
        tests = " AND ".join(["rowid >= ?", "rowid < ?", *[test for test, _ in self.tests]])
        values = [partition.low, partition.high, *[v for _, given in self.tests for v in given]]
        with _open(self.path) as db:
            cursor = db.execute(f'SELECT {names} FROM "{self.table}" WHERE {tests}', values)
            while rows := cursor.fetchmany(BATCH_ROWS):
                columns = [pa.array(map(_FIT.get(kind, _same), c), kind) for c, kind in zip(zip(*rows, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays(columns, names=[_NAMES.get(c, c) for c in self.columns])


def _same(v):
    return v


#: SQLite keeps a value's own type, whatever its column's is.
_FIT = {pa.string(): lambda v: v if v is None or isinstance(v, str) else str(v), pa.binary(): lambda v: v.encode() if isinstance(v, str) else v}


class _FilteringReader(_Reader):
    """Takes comparisons of key columns with values; all other filters are left to Spark."""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        back = {v: k for k, v in _NAMES.items()}
        for f in filters:
            name = back.get(f.attribute[0]) if len(getattr(f, "attribute", ())) == 1 else None
            if name in self.columns and type(f) in _SIGNS:
                self.tests.append((f'"{name}" {_SIGNS[type(f)]} ?', [f.value]))
            elif name in self.columns and isinstance(f, In):
                self.tests.append((f'"{name}" IN ({", ".join("?" * len(f.value))})', list(f.value)))
            elif name in self.columns and isinstance(f, IsNotNull):
                self.tests.append((f'"{name}" IS NOT NULL', []))
            else:
                yield f


class SqliteTable(DataSource):
    """Options: path, table, columns (comma-joined, those that are read) and partitions."""

    @classmethod
    def name(cls) -> str:
        return "sqlite_table"

    def schema(self) -> str:
        return ", ".join(f"`{_NAMES.get(c, c)}` {_TYPES.get(c, 'string')}" for c in self.options["columns"].split(","))

    def reader(self, schema) -> DataSourceReader:
        options = dict(self.options)
        return _FilteringReader(options) if options.get("pushdown") == "true" else _Reader(options)


def read(spark: SparkSession, path: str, partitions: int = 8) -> Tileset:
    """The archive at ``path`` in the layout that it has."""
    with _open(path) as db:
        tables = [r[0] for r in db.execute("SELECT name FROM sqlite_master WHERE type = 'table'")]
        schemas = {t: [c[1] for c in db.execute(f'PRAGMA table_info("{t}")')] for t in tables}
        counted = "metadata" in tables
    layout = detect_layout(schemas)
    spark.dataSource.register(SqliteTable)
    pushdown = spark.conf.get("spark.sql.python.filterPushdown.enabled", "false").lower()  # a reader that pushes fails without it
    load = lambda t, c: spark.read.format("sqlite_table").options(path=path, table=t, columns=",".join(c), partitions=partitions, pushdown=pushdown).load()
    found = {t: load(t, c) for t, c in _TABLES[layout].items()}
    keyed = next(t for t, c in _TABLES[layout].items() if "zoom_level" in c)
    return Tileset(layout, found, load("metadata", ["name", "value"]) if counted else None, load(keyed, list(_NAMES)))


def write(tileset: Tileset, path: str) -> None:
    """``tileset`` as a new archive. An archive is one file with one writer, so rows stream through the driver, a partition at a time."""
    db = sqlite3.connect(path)
    kinds = {"int": "INTEGER", "bigint": "INTEGER", "binary": "BLOB"}
    back = {v: k for k, v in _NAMES.items()}
    try:
        for table, df in tileset.tables.items():
            columns = [back.get(c, c) for c in df.columns]
            key = [c for c in columns if c in _NAMES] or columns[:1]
            spec = ", ".join(f'"{c}" {kinds.get(_TYPES.get(c, "string"), "TEXT")}' for c in columns)
            db.execute(f'CREATE TABLE "{table}" ({spec}, PRIMARY KEY ({", ".join(key)}))')
            marks = ", ".join("?" * len(columns))
            db.executemany(f'INSERT INTO "{table}" VALUES ({marks})', (tuple(bytes(v) if isinstance(v, bytearray) else v for v in r) for r in df.toLocalIterator()))
        if tileset.layout == "normalized":
            db.execute("CREATE VIEW tiles AS SELECT zoom_level, tile_column, tile_row, tile_data FROM map JOIN images USING (tile_id)")
        elif tileset.layout == "flat_with_hash":
            db.execute("CREATE VIEW tiles AS SELECT zoom_level, tile_column, tile_row, tile_data FROM tiles_with_hash")
        db.execute("CREATE TABLE metadata (name TEXT PRIMARY KEY, value TEXT)")
        if tileset.metadata is not None:
            db.executemany("INSERT INTO metadata VALUES (?, ?)", (tuple(r) for r in tileset.metadata.select("name", "value").toLocalIterator()))
        db.commit()
    finally:
        db.close()
