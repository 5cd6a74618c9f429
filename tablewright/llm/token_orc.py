"""Token ids as ORC files: run-length encoded integers, row indexes, Bloom filters on document ids.

Files hold documents in ascending id order. A reader's tasks take stripes; a filter on ``doc_id``
reaches the file's, the stripes' and the row groups' statistics and the Bloom filters.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from tablewright.llm.bpe import encoder
from tablewright.llm.common import portions, text_bytes

STRIPE_BYTES = 16 * 1024 * 1024
ROWS_PER_INDEX = 1000
BLOOM_FPP = 0.01
END_ID = 1
PORTION = 1 << 20


def _encode(tokenizer_path: str, end_id: int):
    kind = pa.schema([("doc_id", pa.int64()), ("before", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.list_(pa.int32()))])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, before = encoder(tokenizer_path), 0
        try:
            for batch in batches:
                _, limits = text_bytes(batch.column(1))
                for first, last in portions(limits, PORTION):
                    texts = batch.column(1).slice(first, last - first).fill_null("").to_pylist()
                    ids, sizes = words.encode(texts)
                    ends = np.cumsum(sizes + 1)
                    out = np.full(int(ends[-1]), end_id, np.int32)
                    own = np.ones(len(out), bool)
                    own[ends - 1] = False
                    out[own] = ids
                    starts = np.concatenate([[0], ends[:-1]])
                    lists = pa.ListArray.from_arrays(pa.array(np.append(starts, ends[-1]), pa.int32()), pa.array(out))
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).slice(first, last - first), pa.array(before + starts), pa.array(sizes + 1), lists],
                        schema=kind,
                    )
                    before += int(ends[-1])
        finally:
            words.forget()

    return encode


def write_tokens(
    documents: DataFrame, path: str, tokenizer_path: str, end_id: int = END_ID, doc_id: str = "doc_id", text: str = "text",
    stripe_bytes: int = STRIPE_BYTES, rows_per_index: int = ROWS_PER_INDEX, compression: str = "zstd",
) -> None:
    """Encode every text (null: empty), append ``end_id``, write ascending by id (null ids first, ties by text).

    Columns: ``doc_id``, ``before`` (ids of the documents before it in its file), ``n_tokens``,
    ``ids``. The texts are dealt by id range once; their ids are never shuffled. Other columns are
    not read. An empty table gives files without rows.
    """
    ordered = (
        documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
        .repartitionByRange("doc_id")
        .sortWithinPartitions("doc_id", "text")
    )
    encoded = ordered.mapInArrow(_encode(tokenizer_path, end_id), "doc_id long, before long, n_tokens long, ids array<int>")
    (
        encoded.write.option("orc.stripe.size", stripe_bytes)
        .option("orc.row.index.stride", rows_per_index)
        .option("orc.create.index", "true")
        .option("orc.bloom.filter.columns", "doc_id")
        .option("orc.bloom.filter.fpp", BLOOM_FPP)
        .option("compression", compression)
        .orc(path)
    )


def read_tokens(spark: SparkSession, path: str, doc_ids: list[int] | None = None) -> DataFrame:
    """The written rows; with ``doc_ids`` only theirs, by a filter that the ORC metadata serves."""
    tokens = spark.read.schema("doc_id long, before long, n_tokens long, ids array<int>").orc(path)
    return tokens if doc_ids is None else tokens.where(F.col("doc_id").isin(doc_ids))


@F.arrow_udf(LongType())
def _crc32_of_lists(lists: pa.Array) -> pa.Array:
    ids = lists.values.to_numpy(zero_copy_only=False).astype("<u4")
    limits = lists.offsets.to_numpy()
    return pa.array([zlib.crc32(ids[a:b]) for a, b in zip(limits[:-1], limits[1:])], pa.int64())


def document_index(spark: SparkSession, path: str) -> DataFrame:
    """Per written document: ``doc_id``, ``start`` (ids of all documents before it), ``n_tokens``, ``ids_crc32``.

    File names follow the id order, so a document starts at its place in its file plus the ids of
    the files before; one total per file is all that is brought together.
    """
    tokens = read_tokens(spark, path).withColumn("file", F.col("_metadata.file_name"))
    totals = sorted((r.file, r.total) for r in tokens.groupBy("file").agg(F.sum("n_tokens").alias("total")).collect())
    firsts, so_far = [], 0
    for file, total in totals:
        firsts.append((file, so_far))
        so_far += total
    starts = spark.createDataFrame(firsts, "file string, file_start long")
    placed = tokens.join(F.broadcast(starts), "file")
    return placed.select(
        "doc_id", (F.col("file_start") + F.col("before")).alias("start"), "n_tokens", _crc32_of_lists("ids").alias("ids_crc32")
    )
