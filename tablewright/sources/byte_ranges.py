"""Records that no line marks, put together by tasks that each have a byte range of a file.

Spark cuts a file into byte ranges and a text into segments at one character. Whether a segment ends a
record depends on a state that all segments before it have made (inside a cell, how deep in brackets). The
state at the start of each range is known beforehand, one small row a range; each task then puts together
the records of its range. A record that crosses the end of a range comes out in fragments, at most two a
range, which are joined in order of the ranges.
"""

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

MOST_RANGES = 2_000_000  # one small row a range is sent to every task
WHOLE, TAIL, HEAD = 0, 1, 2
_RECORDS = "file string, ordinal long, kind int, record string"

# of segments and the state before them: which of them end a record, and the state after them
Scan = Callable[[pa.Array, tuple], tuple[np.ndarray, tuple]]


def segments(spark: SparkSession, path: str, end: str) -> DataFrame:
    """(value, file, start): the segments of the files, and the byte range that each begins in."""
    text = spark.read.option("lineSep", end).text(path)
    return text.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"))


def put_together(end: str, scan: Scan, mid: Callable[[tuple], bool]):
    """A function over (value, file, ordinal, *state) in order that gives the records of the ranges.

    ``mid`` tells whether a state lies inside a record. ``ordinal`` is that of the range, and -1 for the
    first record of a file that is not empty. Of fragments, ``kind`` is HEAD where the record begins and
    TAIL where it goes on; the end of a segment stands between them, not after.
    """

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, state, goes_on, untitled = None, [], (), False, False

        def rows(texts: list[str], kinds: list[int]) -> pa.RecordBatch:
            nonlocal untitled
            ordinals = [at[1]] * len(texts)
            if untitled:
                first = next((i for i, r in enumerate(texts) if r.rstrip("\r")), None)
                if first is not None:
                    ordinals[first], untitled = -1, False
            columns = [pa.array([at[0]] * len(texts), pa.string()), pa.array(ordinals, pa.int64()), pa.array(kinds, pa.int32()), pa.array(texts, pa.string())]
            return pa.RecordBatch.from_arrays(columns, names=["file", "ordinal", "kind", "record"])

        def left() -> Iterator[pa.RecordBatch]:
            if held:
                yield rows([end.join(held)], [TAIL if goes_on else HEAD])

        for batch in batches:
            files, ordinals = batch.column("file"), batch.column("ordinal").to_numpy()
            named = files.dictionary_encode().indices.to_numpy() if batch.num_rows else np.zeros(0, int)
            change = np.flatnonzero((np.diff(named) != 0) | (np.diff(ordinals) != 0)) + 1
            limits = [0, *change.tolist(), batch.num_rows]
            for a, b in zip(limits[:-1], limits[1:]):
                if a == b:
                    continue
                here = (files[a].as_py(), int(ordinals[a]))
                if here != at:
                    yield from left()
                    at, held, state = here, [], tuple(batch.column(i)[a].as_py() for i in range(3, batch.num_columns))
                    goes_on, untitled = mid(state), here[1] == 0
                values = batch.column("value").slice(a, b - a)
                ends, state = scan(values, state)
                stops = np.flatnonzero(ends) + 1
                unfinished = len(stops) == 0 or stops[-1] < len(values)
                groups = np.concatenate([[0], stops, [len(values)] if unfinished else []]).astype(np.int32)
                out = pc.binary_join(pa.ListArray.from_arrays(pa.array(groups), values), end).to_pylist()
                rest = [out.pop()] if unfinished else []
                if out and held:  # what was held ends here
                    out[0], held = end.join([*held, out[0]]), []
                held = held + rest
                if out:
                    yield rows(out, [TAIL if goes_on else WHOLE] + [WHOLE] * (len(out) - 1))
                    goes_on = False
        yield from left()

    return records


def joined_records(cut: DataFrame, of_ranges: DataFrame, state: list[str], end: str, scan: Scan, mid: Callable[[tuple], bool]) -> DataFrame:
    """(ordinal, record) of all files from their segments.

    ``of_ranges`` is checkpointed and has (file, start, ordinal, *state, torn); ``torn`` is true where the
    range starts or ends inside a record. A range that is not in it (Spark cut the file otherwise, as the
    number of cores had changed) is an error, not a wrong record.
    """
    count = of_ranges.count()
    if count > MOST_RANGES:
        raise ValueError(f"{count} byte ranges; raise spark.sql.files.maxPartitionBytes")
    lines = cut.join(F.broadcast(of_ranges.select("file", "start", "ordinal", "torn", *state)), ["file", "start"], "left")
    known = F.when(F.col("ordinal").isNull(), F.raise_error(F.lit("the byte ranges of the file have changed; read it again"))).otherwise(F.col("ordinal"))
    lines = lines.select("value", "file", known.alias("ordinal"), *state, "torn")
    together = put_together(end, scan, mid)
    whole = lines.drop("torn").mapInArrow(together, _RECORDS).where(F.col("kind") == WHOLE)
    # only torn ranges have fragments
    parts = lines.where("torn").drop("torn").mapInArrow(together, _RECORDS).where(F.col("kind") != WHOLE)
    owner = F.sum(F.when(F.col("kind") == HEAD, 1).otherwise(0)).over(Window.partitionBy("file").orderBy("ordinal", "kind"))
    in_order = F.sort_array(F.collect_list(F.struct("ordinal", "kind", "record")))
    joined = (
        parts.withColumn("owner", owner)
        .groupBy("file", "owner")
        .agg(F.min("ordinal").alias("ordinal"), F.array_join(F.transform(in_order, lambda p: p["record"]), end).alias("record"))
    )
    return whole.select("ordinal", "record").unionByName(joined.select("ordinal", "record"))
