"""Best-fit packing of documents into sequences of several permitted lengths."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.llm.bpe import encoder
from tablewright.llm.common import portions, text_bytes
from tablewright.session import checkpointed

LENGTHS = (1024, 2048, 4096, 8192)
OVERHEAD = 16
PIECES_PER_SHARD = 50_000


def linear_cost(capacity: int) -> float:
    """Cost of one sequence: its places, and a fixed overhead for each sequence."""
    return capacity + OVERHEAD


def _fill(sizes: Sequence[int], openings: Callable[[int, int], int], lengths: Sequence[int]) -> tuple[list[int], list[int]]:
    """Best fit in the order given: bin of each piece, and what each bin holds."""
    room: list[tuple[int, int]] = []  # (free places, bin), ascending
    bins, held, left = [], [], sum(sizes)
    for size in sizes:
        at = bisect_left(room, (size, -1))
        if at < len(room):
            free, b = room.pop(at)
        else:
            free, b = openings(size, left), len(held)
            held.append(0)
        bins.append(b)
        held[b] += size
        left -= size
        if free > size:
            insort(room, (free - size, b))
    return bins, held


def pack(sizes: Sequence[int], lengths: Sequence[int] = LENGTHS, cost: Callable[[int], float] = linear_cost) -> tuple[list[int], list[int], list[int]]:
    """Bin and offset of each piece, and the capacity of each bin; no piece is longer than the longest length.

    Pieces go longest first (ties in the order given) into the bin that they leave the least room in.
    Where none fits, the size opened is the one of least cost for each place that the pieces still to
    come can fill. That rule and the rules that open no size under each permitted length are all
    tried, bins are then cut down to the shortest length that holds their contents, and the cheapest
    of these plans is returned.
    """
    lengths = sorted(lengths)
    order = sorted(range(len(sizes)), key=lambda i: -sizes[i])
    descending = [sizes[i] for i in order]

    def cheapest(size: int, left: int) -> int:
        return min((c for c in lengths if c >= size), key=lambda c: (cost(c) / min(c, max(size, left)), c))

    rules = [cheapest] + [lambda size, left, least=c: next(x for x in lengths if x >= max(size, least)) for c in lengths]
    best = None
    for rule in rules:
        bins, held = _fill(descending, rule, lengths)
        capacity = [lengths[bisect_left(lengths, h)] for h in held]
        total = sum(map(cost, capacity))
        if best is None or total < best[0]:
            best = total, bins, capacity
    _, bins, capacity = best
    bin_of, offset, used = [0] * len(sizes), [0] * len(sizes), [0] * len(capacity)
    for i, b in zip(order, bins):
        bin_of[i], offset[i] = b, used[b]
        used[b] += sizes[i]
    return bin_of, offset, capacity


def token_count(text: Column, tokenizer_path: str) -> Column:
    """Number of ids of a text, an end id included; a null text has that one only."""

    @F.arrow_udf("long")
    def count(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        words = encoder(tokenizer_path)
        try:
            for texts in batches:
                limits = text_bytes(texts)[1]
                parts = [words.counts(texts.slice(a, b - a).fill_null("").to_pylist()) for a, b in portions(limits, 1 << 20)]
                yield pa.array(np.concatenate(parts) + 1 if parts else np.zeros(0, np.int64), pa.int64())
        finally:
            words.forget()

    return count(text)


def pack_documents(
    documents: DataFrame, tokenizer_path: str, lengths: Sequence[int] = LENGTHS, cost: Callable[[int], float] = linear_cost,
    doc_id: str = "doc_id", text: str = "text", pieces_per_shard: int = PIECES_PER_SHARD,
) -> DataFrame:
    """One row per piece: id, ``piece``, ``token_start``, ``n_tokens``, ``bin_id``, ``bin_offset``, ``bin_capacity``.

    A document longer than the longest length is cut into pieces of that length and a rest; nothing
    is dropped. Null and empty texts are one end id long and are packed too; a repeated row is packed
    as often as it comes. Only ids and lengths are shuffled, in even shards of about
    ``pieces_per_shard`` pieces, each packed by one task; ``bin_id`` is unique over all shards.
    Columns other than the two named are not read. An empty table gives no rows.
    """
    lengths, longest = sorted(lengths), max(lengths)
    counted = documents.select(F.col(doc_id).alias("id"), token_count(F.col(text), tokenizer_path).alias("tokens"))
    pieces = counted.select(
        "id", "tokens", F.explode(F.sequence(F.lit(0), F.floor((F.col("tokens") - 1) / longest).cast("int"))).alias("piece")
    ).select(
        "id", "piece", (F.col("piece").cast("long") * longest).alias("token_start"),
        F.least(F.col("tokens") - F.col("piece").cast("long") * longest, F.lit(longest).cast("long")).alias("n_tokens"),
    )
    pieces = checkpointed(pieces)
    shards = max(1, -(-pieces.count() // pieces_per_shard))
    id_type = pieces.schema["id"].dataType.simpleString()

    def in_shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard, done = TaskContext.get().partitionId(), 0
        for table in _chunks(batches, 2 * pieces_per_shard):
            table = table.sort_by([("n_tokens", "descending"), ("id", "ascending"), ("token_start", "ascending")])
            bins, offsets, capacity = pack(table["n_tokens"].to_pylist(), lengths, cost)
            table = table.append_column("bin_id", pa.array((shard << 32) + done + np.array(bins, np.int64)))
            table = table.append_column("bin_offset", pa.array(offsets, pa.int64()))
            table = table.append_column("bin_capacity", pa.array([capacity[b] for b in bins], pa.int32()))
            done += len(capacity)
            yield from table.combine_chunks().to_batches()

    kind = f"id {id_type}, piece int, token_start long, n_tokens long, bin_id long, bin_offset long, bin_capacity int"
    return pieces.repartition(shards).mapInArrow(in_shards, kind).withColumnRenamed("id", doc_id)


def _chunks(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.Table]:
    """Tables of about ``most`` rows, so that a task's memory stays bounded whatever its share is."""
    waiting, rows = [], 0
    for batch in batches:
        waiting.append(batch)
        rows += batch.num_rows
        if rows >= most:
            yield pa.Table.from_batches(waiting)
            waiting, rows = [], 0
    if rows:
        yield pa.Table.from_batches(waiting)
