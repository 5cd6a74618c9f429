"""Readers for files, ad-hoc SQL over one source, pages of a table, descriptions."""

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.functions import hints
from tablewright.operators.frames import to_long
from tablewright.operators.profile import row_counts
from tablewright.session import checkpointed, sql_over
from tablewright.sources import json_array, quoted_csv


def reader_for(path: str) -> str:
    """csv, json, parquet, excel, sqlite or web, by scheme and extension; csv when unknown."""
    if re.match(r"https?://", path):
        return "web"
    stem, dot, ext = path.lower().rpartition(".")
    return hints.READERS.get(ext, "csv") if dot else "csv"


SEPARATORS = (",", ";", "\t", "|")
CORRUPT = "_corrupt_record"


def sniff_separator(spark: SparkSession, path: str) -> str:
    """The separator that cuts the first lines into the same number of cells, more than one; else ','."""
    lines = [re.sub(r'"[^"]*"', "", r[0]) for r in spark.read.text(path).where("value != ''").take(10)]
    counts = {s: {line.count(s) for line in lines} for s in SEPARATORS}
    steady = [s for s in SEPARATORS if len(counts[s]) == 1 and counts[s] != {0}]
    header = [s for s in SEPARATORS if lines and lines[0].count(s)]
    return max(steady or header or [","], key=lambda s: lines[0].count(s) if lines else 0)


def read_csv(
    spark: SparkSession, path: str, schema=None, sep: str | None = None, multi_line: bool | None = None, surplus: bool | None = None
) -> DataFrame:
    """CSV with a header. What is not given is found out.

    ``sep`` comes from the name (.tsv) or the first lines, ``multi_line`` (cells that hold line
    ends) from the quotes of all lines, the schema from all values. Rows whose cells do not fit the
    columns are kept: with ``surplus``, or where the file holds any, their text is in the column
    ``_corrupt_record``. Files with such cells are read by many tasks too (``quoted_csv``).
    """
    sep = sep or ("\t" if path.lower().endswith(".tsv") else sniff_separator(spark, path))
    if multi_line is None:
        of_ranges = checkpointed(quoted_csv.ranges(spark, path))
        if not of_ranges.where("odd > 0").isEmpty():
            return quoted_csv.read(spark, path, sep, schema, surplus, CORRUPT, of_ranges)
    elif multi_line:
        return quoted_csv.read(spark, path, sep, schema, surplus, CORRUPT)

    def reader():
        options = {"header": True, "sep": sep, "quote": '"', "escape": '"', "enforceSchema": True}
        return spark.read.options(**options)

    if schema is None:
        schema = reader().option("inferSchema", True).csv(path).schema
    plain = reader().schema(schema).csv(path)
    if surplus is False or CORRUPT in plain.columns:
        return plain
    wide = T.StructType([*plain.schema.fields, T.StructField(CORRUPT, T.StringType())])
    kept = reader().option("columnPruning", False).option("columnNameOfCorruptRecord", CORRUPT).schema(wide).csv(path)
    if surplus or kept.where(F.col(CORRUPT).isNotNull()).take(1):
        return kept
    return plain


def read_json(spark: SparkSession, path: str, schema=None, lines: bool | None = None) -> DataFrame:
    """JSON lines, or files that hold one array or object each (``lines=False``). Arrays are read by many tasks a file."""
    first = _first_sign(spark, path) if lines is None or not lines else ""
    if lines is None:
        lines = path.lower().endswith((".jsonl", ".ndjson")) or first == ""
    if not lines and first == "[":
        return json_array.read(spark, path, schema, CORRUPT)
    reader = spark.read.option("multiLine", not lines)
    return reader.schema(schema).json(path) if schema else reader.json(path)


def _first_sign(spark, path):
    """"[" where the first line opens an array, "{" where it opens an object that it does not close, else ""."""
    first = spark.read.text(path).where("trim(value) != ''").limit(1).select(F.left(F.trim("value"), F.lit(1)).alias("sign"), F.right(F.trim("value"), F.lit(1)).alias("last")).collect()
    if not first or first[0].sign not in ("[", "{"):
        return ""
    return "" if (first[0].sign, first[0].last) == ("{", "}") else first[0].sign


def read_parquet(spark: SparkSession, path: str, row_key: str | None = None) -> DataFrame:
    """Parquet files; ``row_key`` names a text column to add that tells all rows apart: file and place in it.

    The key costs no pass and is the same on every read, so it can follow rows through joins.
    """
    df = spark.read.parquet(path)
    if row_key is None:
        return df
    if row_key.lower() in (c.lower() for c in df.columns):
        raise ValueError(f"the files have a column {row_key!r}")
    place = F.col("_metadata.row_index").cast("string")
    return df.withColumn(row_key, F.concat(F.col("_metadata.file_path"), F.lit("#"), place))


def read_source(spark: SparkSession, path: str, kind: str | None = None, schema=None, table: str | None = None):
    """Read a path with the reader its name asks for."""
    kind = kind or reader_for(path)
    if kind == "csv":
        return read_csv(spark, path, schema)
    if kind == "json":
        return read_json(spark, path, schema)
    if kind == "parquet":
        return read_parquet(spark, path)
    if kind == "sqlite":
        from tablewright.sources.sqlite import read_sqlite

        return read_sqlite(spark, path, table)
    raise ValueError(f"no reader for {kind!r}: {path}")


def query(df: DataFrame, sql: str) -> DataFrame:
    """Any SELECT over one source, which the text calls ``_src``."""
    return sql_over(df.sparkSession, sql, {"_src": df})


def page(
    df: DataFrame, order_by: list[Column | str], limit: int = 1000, offset: int = 0, after: dict | None = None
) -> DataFrame:
    """Rows ``offset`` to ``offset + limit`` in the given order, or the ``limit`` rows ``after`` a key.

    ``after`` holds the last row's values of ``order_by`` (names, ascending): what comes before is
    filtered out in the scan and only ``limit`` rows are ever brought together. An ``offset`` is
    for the first pages, as limit plus offset rows meet in one task.
    """
    for name, value in (("limit", limit), ("offset", offset)):
        if not isinstance(value, int) or value < 0:
            raise ValueError(f"{name} must be a non-negative integer")
    if not order_by:
        raise ValueError("a page needs an order")
    if after is not None:
        if offset or list(after) != list(order_by):
            raise ValueError("after needs a value for each column of the order, and no offset")
        later, same = F.lit(False), F.lit(True)
        for name, value in after.items():
            later = later | (same & (F.col(name) > F.lit(value)))
            same = same & (F.col(name) == F.lit(value))
        df = df.where(later)
    ordered = df.orderBy(*order_by)
    return (ordered.offset(offset) if offset else ordered).limit(limit)


def describe(df: DataFrame) -> DataFrame:
    """(column, type, nullable, rows) of a source."""
    return to_long(
        row_counts(df).select("rows"),
        [
            {
                "column": F.lit(f.name),
                "type": F.lit(f.dataType.simpleString()),
                "nullable": F.lit(f.nullable),
                "rows": F.col("rows"),
            }
            for f in df.schema
        ],
    )
