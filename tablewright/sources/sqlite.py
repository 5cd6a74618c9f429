"""SQLite tables as a Spark data source: one partition per range of row ids.

The file must lie where every executor can open it, such as a shared mount.
"""

import os
import re
import sqlite3

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

_NAME = re.compile(r"^[A-Za-z_一-鿿][A-Za-z0-9_一-鿿]*$")


def _quoted(name):
    if not _NAME.match(name or ""):
        raise ValueError(f"not a table name: {name!r}")
    return f'"{name}"'


def _open(path):
    if not os.path.exists(path):
        raise FileNotFoundError(f"no SQLite file: {path}")
    return sqlite3.connect(f"file:{path}?mode=ro", uri=True)


def _spark_type(declared):
    """Type by SQLite's own affinity rules."""
    upper = (declared or "").upper()
    if "INT" in upper:
        return T.LongType()
    if any(w in upper for w in ("CHAR", "CLOB", "TEXT")):
        return T.StringType()
    if "BLOB" in upper:
        return T.BinaryType()
    if any(w in upper for w in ("REAL", "FLOA", "DOUB", "DEC", "NUM")):
        return T.DoubleType()
    return T.StringType()


class RowIdRange(InputPartition):
    def __init__(self, first, last):
        super().__init__(None)
        self.first, self.last = first, last


class SqliteSource(DataSource):
    @classmethod
    def name(cls):
        return "sqlite_table"

    def schema(self):
        con = _open(self.options["path"])
        try:
            columns = con.execute(f"PRAGMA table_info({_quoted(self.options.get('table'))})").fetchall()
        finally:
            con.close()
        if not columns:
            raise ValueError(f"no table {self.options.get('table')!r} in {self.options['path']}")
        return T.StructType([T.StructField(c[1], _spark_type(c[2]), not c[3]) for c in columns])

    def reader(self, schema):
        return SqliteReader(self.options, schema)


class SqliteReader(DataSourceReader):
    def __init__(self, options, schema):
        self.path, self.table = options["path"], options["table"]
        self.parts = int(options.get("partitions", "8"))
        self.names = [f.name for f in schema]
        self.casts = [
            {T.LongType(): int, T.DoubleType(): float, T.StringType(): str, T.BinaryType(): bytes}[f.dataType]
            for f in schema
        ]

    def partitions(self):
        con = _open(self.path)
        try:
            low, high = con.execute(f"SELECT min(rowid), max(rowid) FROM {_quoted(self.table)}").fetchone()
        except sqlite3.OperationalError:  # a view or a table without row ids
            return [RowIdRange(None, None)]
        finally:
            con.close()
        if low is None:
            return [RowIdRange(None, None)]
        step = (high - low) // self.parts + 1
        return [RowIdRange(a, min(a + step - 1, high)) for a in range(low, high + 1, step)]

    def read(self, partition):
        names = ", ".join('"' + n.replace('"', '""') + '"' for n in self.names)
        text, args = f"SELECT {names} FROM {_quoted(self.table)}", ()
        if partition.first is not None:
            text, args = text + " WHERE rowid BETWEEN ? AND ?", (partition.first, partition.last)
        con = _open(self.path)
        try:
            for row in con.execute(text, args):
                yield tuple(v if v is None else cast(v) for v, cast in zip(row, self.casts))
        finally:
            con.close()


def read_sqlite(spark: SparkSession, path: str, table: str, partitions: int = 8) -> DataFrame:
    spark.dataSource.register(SqliteSource)
    return (
        spark.read.format("sqlite_table").option("path", path).option("table", table).option("partitions", partitions).load()
    )
