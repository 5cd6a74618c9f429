"""CSV whose cells hold line ends, read by many tasks a file.

Where a record begins depends on all quotes before it. Tasks count the quotes of the byte ranges that
Spark cuts a file into; the parity of their running sum tells each range whether it starts inside a cell.
"""

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.session import checkpointed
from tablewright.sources.byte_ranges import joined_records, segments


def ranges(spark: SparkSession, path: str) -> DataFrame:
    """(file, start, ordinal, open, torn, odd): of each byte range its place in the file, whether it starts inside a cell, whether it starts or ends there, and its lines with an odd number of quotes."""
    line = F.col("value")
    of_line = segments(spark, path, "\n").withColumn("quotes", F.length(line) - F.length(F.replace(line, F.lit('"'), F.lit(""))))
    sums = of_line.groupBy("file", "start").agg(F.sum("quotes").alias("quotes"), F.sum(F.col("quotes") % 2).alias("odd"))
    until = Window.partitionBy("file").orderBy("start")
    running = F.sum("quotes").over(until)
    before = (running - F.col("quotes")) % 2 == 1
    return sums.select(
        "file", "start", (F.row_number().over(until) - 1).cast("long").alias("ordinal"), before.alias("open"), (before | (running % 2 == 1)).alias("torn"), "odd"
    )


def _scan(lines: pa.Array, state: tuple) -> tuple[np.ndarray, tuple]:
    inside = (np.cumsum(pc.count_substring(lines, '"').to_numpy()) + state[0]) % 2 == 1
    return ~inside, (bool(inside[-1]),)


def records(spark: SparkSession, path: str, of_ranges: DataFrame) -> DataFrame:
    """(record): the records of all files but their headers, from a checkpointed ``ranges``."""
    every = joined_records(segments(spark, path, "\n"), of_ranges, ["open"], "\n", _scan, lambda state: state[0])
    return every.where("ordinal >= 0").select("record")


_INT, _NUMBER = r"^[+-]?\d+$", r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
_DAY, _MOMENT = r"^\d{4}-\d{2}-\d{2}$", r"^\d{4}-\d{2}-\d{2}[ T]\d{2}:\d{2}"
_KINDS = ("int", "bigint", "decimal", "double", "date", "timestamp", "boolean")


def _fits(c: Column, kind: str) -> Column:
    if kind == "decimal":
        return c.rlike(_INT) & (F.length(c) <= 38)
    if kind == "boolean":
        return F.lower(c).isin("true", "false")
    shape = {"int": c.rlike(_INT), "bigint": c.rlike(_INT), "double": c.rlike(_NUMBER), "date": c.rlike(_DAY), "timestamp": c.rlike(_DAY) | c.rlike(_MOMENT)}
    return shape[kind] & c.try_cast(kind).isNotNull()


def infer(cells: DataFrame, corrupt: str) -> tuple[T.StructType, bool]:
    """The narrowest type of each column of texts, and whether any row is corrupt; one aggregate over all rows.

    Whole numbers beyond a long are decimals, columns without values are texts.
    """
    names = [n for n in cells.columns if n != corrupt]
    measures = [F.max(F.col(corrupt).isNotNull()).alias("corrupt")]
    for i, n in enumerate(names):
        c = F.col(f"`{n}`")
        measures += [F.min(F.when(c.isNotNull(), _fits(c, k))).alias(f"{k}_{i}") for k in _KINDS]
        measures.append(F.max(F.length(c)).alias(f"digits_{i}"))
    found = cells.agg(*measures).first()
    fields = []
    for i, n in enumerate(names):
        kind = next((k for k in _KINDS if found[f"{k}_{i}"]), "string")
        kind = f"decimal({min(38, found[f'digits_{i}'])},0)" if kind == "decimal" else kind
        fields.append(T.StructField(n, T._parse_datatype_string(kind)))
    return T.StructType(fields), bool(found["corrupt"])


def _ddl(shape: T.StructType) -> str:
    return ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in shape.fields)


def read(
    spark: SparkSession, path: str, sep: str, schema=None, surplus: bool | None = None, corrupt: str = "_corrupt_record", of_ranges: DataFrame | None = None
) -> DataFrame:
    """CSV with a header in each file and quoted cells that may hold line ends, several tasks a file.

    The rows are those of Spark's own reading of whole files, in no set order (a cell whose quote is never
    closed ends before the file's last line end). Before them come one pass
    over the quotes and, without a ``schema``, one that finds all types and corrupt rows.
    """
    of_ranges = checkpointed(ranges(spark, path)) if of_ranges is None else of_ranges
    every = records(spark, path, of_ranges).select(F.replace(F.regexp_replace("record", r"\r$", ""), F.lit("\r\n"), F.lit("\n")).alias("record"))
    every = every.where("record != ''")
    if schema is None:
        head = spark.read.options(header=True, sep=sep, quote='"', escape='"', multiLine=True)
        plain = T.StructType([T.StructField(n, T.StringType()) for n in head.csv(path).columns])
    else:
        plain = schema if isinstance(schema, T.StructType) else T._parse_datatype_string(schema)
        surplus = True if corrupt in plain.names else surplus
        plain = T.StructType([f for f in plain.fields if f.name != corrupt])

    def parsed(shape: T.StructType) -> DataFrame:
        wide = T.StructType([*shape.fields, T.StructField(corrupt, T.StringType())])
        options = {"sep": sep, "quote": '"', "escape": '"', "columnNameOfCorruptRecord": corrupt}
        return every.select(F.from_csv("record", _ddl(wide), options).alias("_row")).select("_row.*")

    if schema is None:
        plain, broken = infer(parsed(plain), corrupt)
        surplus = broken if surplus is None else surplus
    out = parsed(plain)
    if surplus is None:
        surplus = not out.where(F.col(corrupt).isNotNull()).isEmpty()
    return out if surplus else out.drop(corrupt)
