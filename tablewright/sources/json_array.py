"""JSON files that hold one array of objects, read by many tasks a file.

Every object of the array ends with a closing brace, so the text is cut there. Which braces end an element
depends on the depth of brackets and on whether a string is open. Each byte range gives the change it makes
for both cases, a string open at its start or none; running sums over the ranges settle which holds.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.functions.text import variant_sql_type
from tablewright.session import checkpointed
from tablewright.sources.byte_ranges import joined_records, segments

END = "}"
_CHANGES = "file string, start long, quotes long, outside long, inside long"


def _structure(texts: pa.Array, inside: bool) -> tuple[np.ndarray, np.ndarray]:
    """After each segment, its closing brace included: is a string open, and the change of depth so far."""
    # escaped signs gone, what quotes are left open or close strings; no escape lies across a brace
    plain = pc.replace_substring(pc.replace_substring(texts, "\\\\", ""), '\\"', "").cast(pa.large_string())
    _, limits, data = plain.buffers()
    limits = np.frombuffer(limits, np.int64)[plain.offset : plain.offset + len(plain) + 1]
    data = np.frombuffer(data, np.uint8)[limits[0] : limits[-1]] if data is not None else np.zeros(0, np.uint8)
    ends = limits[1:] - limits[0]
    quotes = np.concatenate([[0], np.cumsum(data == 0x22)])
    open_at = (quotes[:-1] + inside) % 2 == 1
    opens, closes = (data == 0x7B) | (data == 0x5B), (data == 0x7D) | (data == 0x5D)
    depth = np.concatenate([[0], np.cumsum(np.where(open_at, 0, opens.astype(np.int64) - closes))])[ends]
    after = (quotes[ends] + inside) % 2 == 1
    return after, depth - np.cumsum(~after)


def _changes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per range of a task: quotes, and the change of depth if no string is open at its start and if one is."""
    found = {}
    for batch in batches:
        for (file, start), rows in _runs(batch):
            quotes, outside, inside = found.get((file, start), (0, 0, 0))
            changes = []
            for first in (False, True):
                after, depth = _structure(rows, bool(first ^ (quotes % 2)))
                changes.append(int(depth[-1]))
            odd = bool(after[-1]) ^ True ^ bool(quotes % 2)
            found[file, start] = quotes + odd, outside + changes[0], inside + changes[1]
    columns = list(zip(*((*k, *v) for k, v in found.items()))) or [()] * 5
    kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["file", "start", "quotes", "outside", "inside"])


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[tuple, pa.Array]]:
    files, starts = batch.column("file"), batch.column("start").to_numpy()
    named = files.dictionary_encode().indices.to_numpy() if batch.num_rows else np.zeros(0, int)
    limits = [0, *(np.flatnonzero((np.diff(named) != 0) | (np.diff(starts) != 0)) + 1).tolist(), batch.num_rows]
    for a, b in zip(limits[:-1], limits[1:]):
        if b > a:
            yield (files[a].as_py(), int(starts[a])), batch.column("value").slice(a, b - a)


def ranges(spark: SparkSession, path: str) -> DataFrame:
    """(file, start, ordinal, open, depth, torn): the state at the start of each byte range."""
    sums = segments(spark, path, END).mapInArrow(_changes, _CHANGES)
    until = Window.partitionBy("file").orderBy("start")
    running = F.sum("quotes").over(until)
    opened = sums.withColumn("open", (running - F.col("quotes")) % 2 == 1).withColumn("shut", running % 2 == 1)
    change = F.when(F.col("open"), F.col("inside")).otherwise(F.col("outside"))
    depth = F.sum(change).over(until)
    placed = opened.withColumn("ordinal", (F.row_number().over(until) - 1).cast("long")).withColumn("after", depth).withColumn("depth", depth - change)
    torn = F.col("open") | F.col("shut") | (F.col("depth") > 1) | (F.col("after") > 1)
    return placed.select("file", "start", "ordinal", "open", "depth", torn.alias("torn"))


def _scan(texts: pa.Array, state: tuple) -> tuple[np.ndarray, tuple]:
    after, depth = _structure(texts, state[0])
    depth = depth + state[1]
    return ~after & (depth <= 1), (bool(after[-1]), int(depth[-1]))


def records(spark: SparkSession, path: str) -> DataFrame:
    """(record): the text of each object of the arrays."""
    of_ranges = checkpointed(ranges(spark, path))
    every = joined_records(segments(spark, path, END), of_ranges, ["open", "depth"], END, _scan, lambda state: state[0] or state[1] > 1)
    text = F.regexp_replace("record", r"^[\[,\s]+", "")
    # what is left at the end of a file is the array's own bracket
    return every.select(text.alias("record")).where(~F.col("record").rlike(r"^\]?\s*$")).select(F.concat("record", F.lit(END)).alias("record"))


def infer(texts: DataFrame, corrupt: str) -> T.StructType:
    """The merged schema of all objects, from one aggregate; with a column for what is no JSON where there is any."""
    value = F.try_parse_json("record")
    found = texts.agg(F.schema_of_variant_agg(value).alias("shape"), F.max(value.isNull()).alias("corrupt")).first()
    shape = T._parse_datatype_string(variant_sql_type(found["shape"])) if found["shape"].startswith("OBJECT<") and found["shape"] != "OBJECT<>" else T.StructType()
    return T.StructType([*shape.fields, *([T.StructField(corrupt, T.StringType())] if found["corrupt"] else [])])


def read(spark: SparkSession, path: str, schema=None, corrupt: str = "_corrupt_record") -> DataFrame:
    """The objects of arrays of objects as rows, several tasks a file, in no set order.

    Without a ``schema`` one pass finds it. An array without objects gives no rows.
    """
    texts = records(spark, path)
    if schema is None:
        schema = infer(texts, corrupt)
        if not schema.fields:
            return spark.createDataFrame([], schema)
    shape = schema if isinstance(schema, T.StructType) else T._parse_datatype_string(schema)
    options = {"columnNameOfCorruptRecord": corrupt}
    return texts.select(F.from_json("record", shape, options).alias("_row")).select("_row.*")
