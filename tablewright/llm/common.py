"""Helpers that several operators of this package share."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablewright.session import checkpointed

BROADCAST_LABELS = 10_000
WORD_MIX = np.uint64(0x9E3779B97F4A7C15)


def in_fold(doc_id: str, folds: int, remainder: int) -> Column:
    """True where crc32 of the id's text leaves ``remainder``; false for a null id."""
    crc = F.crc32(F.col(doc_id).cast("string").cast("binary"))
    return F.coalesce(F.pmod(crc, F.lit(folds)) == remainder, F.lit(False))


def sample_texts(documents: DataFrame, labels: DataFrame, label: str, per_class: int, doc_id: str, text: str) -> DataFrame:
    """At most ``per_class`` documents of each label value, as columns id, label, text.

    ``labels`` holds the rows that may be learnt from. Ids are chosen by the hash of the id, so the
    choice does not depend on how the input is split. Of several labels of one id the largest holds,
    of several texts the least; null ids and labels are never chosen. Only hashes so low that a few
    times ``per_class`` ids of a label have them are ranked, so a label that nearly all rows have
    does not meet in one task. The bound on the ids (classes times ``per_class``) is what allows
    their broadcast.
    """
    each = (
        labels.where(F.col(doc_id).isNotNull() & F.col(label).isNotNull())
        .groupBy(F.col(doc_id).alias("id"))
        .agg(F.max(label).alias("label"))
    )
    sizes = each.groupBy("label").agg(F.count("*").alias("n"))
    low = (F.xxhash64("id") / F.lit(2.0**64) + 0.5) * F.col("n") <= F.lit(4.0 * per_class + 100)
    place = F.row_number().over(Window.partitionBy("label").orderBy(F.xxhash64("id"), "id"))
    # the sizes go to the rows, so that rows are not dealt by label before the low ones are picked
    sizes = checkpointed(sizes)
    sizes = F.broadcast(sizes) if sizes.count() <= BROADCAST_LABELS else sizes
    few = each.join(sizes, "label").where(low).select("id", "label", place.alias("place"))
    chosen = few.where(F.col("place") <= per_class).drop("place")
    texts = documents.select(F.col(doc_id).alias("id"), F.col(text).alias("text"))
    return (
        texts.join(F.broadcast(chosen), "id")
        .groupBy("id", "label")
        .agg(F.min("text").alias("text"))
    )


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column, one text after the other, and their n + 1 limits; nulls are empty."""
    column = column.fill_null("").cast(pa.large_string())
    _, limits, data = column.buffers()
    limits = np.frombuffer(limits, np.int64)[column.offset : column.offset + len(column) + 1]
    everything = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return everything[limits[0] : limits[-1]], limits - limits[0]


def portions(limits: np.ndarray, most: int, most_texts: int | None = None):
    """Ranges of texts holding about ``most`` bytes each, and no more than ``most_texts``; a longer text is a portion of its own."""
    first, n = 0, len(limits) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(limits, limits[first] + most, side="right")) - 1)
        last = min(last, n, first + (most_texts or n))
        yield first, last
        first = last


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser over unsigned integers."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def byte_table(seed: int) -> np.ndarray:
    """256 pseudo-random unsigned 64-bit values, made by a rule."""
    with np.errstate(over="ignore"):
        return mixed((np.arange(256, dtype=np.uint64) + np.uint64(seed * 256 + 1)) * WORD_MIX)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40, 40)))


class Adam:
    """The usual moment estimates, one state per parameter array."""

    def __init__(self, parameters: list[np.ndarray], rate: float):
        self.rate, self.steps = rate, 0
        self.moments = [(np.zeros_like(p), np.zeros_like(p)) for p in parameters]

    def step(self, parameters: list[np.ndarray], gradients: list[np.ndarray]) -> None:
        self.steps += 1
        for p, g, (m, v) in zip(parameters, gradients, self.moments):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            p -= self.rate * (m / (1 - 0.9**self.steps)) / (np.sqrt(v / (1 - 0.999**self.steps)) + 1e-8)
