"""Benchmark decontamination: item-sized windows compared by SimHash, then exactly.

Every window of an item's length that shares a shingle with an item of that length gets a SimHash
over its shingles. The fingerprint is cut into blocks; two fingerprints within the radius agree in
one block up to radius // blocks bits, so looking each block up in a table of all values that near
gives every item within the radius. Those items are compared exactly, by weighted shingle
similarity (sum of the smaller over sum of the larger counts). With ``clipped`` also the windows that
reach over an end of a text are tried, on the words that are there, as long as enough of them are.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tablewright.llm.common import WORD_MIX, mixed, portions, text_bytes

SHINGLE = 5
SIMILARITY = 0.8
RADIUS, BLOCK_BITS = 19, (13, 13, 13, 13, 12)
BLOCK_ITEMS = 2000  # items for one pass over the documents
PORTION = 1 << 19  # bytes of text looked at together; the search holds some 200 bytes for each


def _letters() -> np.ndarray:
    """True for code points that are part of words: letters and digits."""
    return np.array([chr(c).isalnum() for c in range(0x110000)])


WORD_POINTS = _letters()
POINT_MIX = mixed(np.arange(1, 0x3001, dtype=np.uint64) * WORD_MIX)


def words_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, first and last code point (exclusive, within its text) and text of each lowered word.

    A word is a run of letters and digits. Its hash is a sum of hashed code points, each mixed with
    its place in the word.
    """
    raw = [(t.lower() if len(t.lower()) == len(t) else "".join(c.lower() if len(c.lower()) == 1 else c for c in t)) for t in texts]
    sizes = np.fromiter(map(len, raw), np.int64, len(raw))
    points = np.frombuffer((" ".join(raw) + " ").encode("utf-32-le", "surrogatepass"), np.uint32) if raw else np.zeros(0, np.uint32)
    inside = WORD_POINTS[points]
    edge = np.diff(inside.astype(np.int8), prepend=0)
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(start):
        none = np.zeros(0, np.int64)
        return none.astype(np.uint64), none, none, none
    at = np.flatnonzero(inside)
    size = end - start
    place = np.arange(len(at)) - np.repeat(np.cumsum(size) - size, size)
    own = points[at]
    value = POINT_MIX[np.minimum(own, len(POINT_MIX) - 1)] + own
    with np.errstate(over="ignore"):
        value = (value ^ (value >> np.uint64(29))) * (place.astype(np.uint64) * np.uint64(2) + np.uint64(1)) * WORD_MIX
        value ^= value >> np.uint64(32)
        hashes = mixed(np.add.reduceat(value, np.cumsum(size) - size))
    first = np.concatenate([[0], np.cumsum(sizes + 1)])
    owner = np.searchsorted(first, start, "right") - 1
    return hashes, start - first[owner], end - first[owner], owner


def shingles(words: np.ndarray, width: int) -> np.ndarray:
    """Hashes of the runs of ``width`` words."""
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(width):
            out = out * np.uint64(0x9E3779B97F4A7C55) + (words[k : k + n] ^ (words[k : k + n] >> np.uint64(31)))
    return mixed(out)


def _bit_sums(values: np.ndarray) -> np.ndarray:
    """Running sums, for each bit, of +1 where it is set and -1 where not; one row more than values."""
    bits = np.unpackbits(values.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    out = np.zeros((len(values) + 1, 64), np.int32)
    np.cumsum(bits.astype(np.int8) * 2 - 1, axis=0, dtype=np.int32, out=out[1:])
    return out


def simhash(values: np.ndarray) -> int:
    """A bit is set if it is set in over half of the shingles; repeats count."""
    return int(np.packbits(_bit_sums(values)[-1] > 0, bitorder="little").view("<u8")[0])


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Weighted similarity of two bags of shingles."""
    keys, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    left = np.bincount(at[: len(a)], minlength=len(keys))
    right = np.bincount(at[len(a) :], minlength=len(keys))
    top = np.maximum(left, right).sum()
    return float(np.minimum(left, right).sum() / top) if top else 0.0


class Index:
    """Items of one block: their shingles, and tables of near block values of their fingerprints."""

    def __init__(self, items: list[tuple[int, str]], radius: int = RADIUS):
        self.ids, self.bags, self.length, prints, self.radius = [], [], [], [], radius
        words, _, _, owner = words_of([t or "" for _, t in items])
        for i, (item_id, _) in enumerate(items):
            own = words[owner == i] if len(owner) else words
            if len(own):
                bag = shingles(own, min(SHINGLE, len(own)))
                self.ids.append(item_id)
                self.bags.append(bag)
                self.length.append(len(own))
                prints.append(simhash(bag))
        self.prints = np.array(prints, np.uint64)
        lengths = np.array(self.length, np.int64)
        self.widths = sorted({min(SHINGLE, n) for n in self.length})
        sizes = np.array([len(b) for b in self.bags], np.int64)
        flat = np.concatenate(self.bags) if self.bags else np.zeros(0, np.uint64)
        pairs = np.unique(np.stack([flat, np.repeat(lengths, sizes).astype(np.uint64)], axis=1), axis=0) if len(flat) else np.zeros((0, 2), np.uint64)
        self.keys, self.key_length = pairs[:, 0].copy(), pairs[:, 1].astype(np.int64)
        self.maybe = np.zeros(1 << 22, bool)
        self.maybe[(self.keys >> np.uint64(42)).astype(np.int64)] = True
        self.blocks = [self._near_values(b) for b in range(len(BLOCK_BITS))]

    def _block(self, prints: np.ndarray, b: int) -> np.ndarray:
        return (prints >> np.uint64(sum(BLOCK_BITS[:b])) & np.uint64(2 ** BLOCK_BITS[b] - 1)).astype(np.int64)

    def _near_values(self, b: int) -> tuple[np.ndarray, np.ndarray]:
        """For each value of a block the items whose own value is near: limits and item numbers."""
        bits, most = BLOCK_BITS[b], self.radius // len(BLOCK_BITS)
        flips = np.array([sum(1 << i for i in c) for k in range(most + 1) for c in combinations(range(bits), k)], np.int64)
        near = (self._block(self.prints, b)[:, None] ^ flips).ravel()
        order = np.argsort(near, kind="stable")
        limits = np.searchsorted(near[order], np.arange(2**bits + 1))
        return limits, (order // len(flips)).astype(np.int32)

    def within(self, print_: np.uint64, length: int) -> list[int]:
        """Numbers of the items of one length whose fingerprint is within the radius."""
        found = []
        for b, (limits, items) in enumerate(self.blocks):
            value = int(self._block(np.array([print_], np.uint64), b)[0])
            found.append(items[limits[value] : limits[value + 1]])
        some = np.unique(np.concatenate(found))
        near = np.bitwise_count(self.prints[some] ^ print_) <= self.radius
        return [int(i) for i in some[near] if self.length[i] == length]

    def matches(self, texts: list[str], least: float = SIMILARITY, clipped: bool = False) -> list[tuple[int, int, float, int, int]]:
        """(text number, item id, similarity, first and last code point) of the best window of each pair."""
        words, start, end, owner = words_of(texts)
        best: dict[tuple[int, int], tuple[float, int, int]] = {}
        for width in self.widths:
            hashes = shingles(words, width)
            if not len(hashes):
                continue
            hit = np.flatnonzero(self.maybe[(hashes >> np.uint64(42)).astype(np.int64)])
            low, high = (np.searchsorted(self.keys, hashes[hit], side) for side in ("left", "right"))
            real = (high > low) & (owner[hit] == owner[hit + width - 1])
            hit, low, high = hit[real], low[real], high[real]
            many = high - low
            which = np.repeat(low, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
            places, lengths = np.repeat(hit, many), self.key_length[which]
            for length in np.unique(lengths):
                if min(SHINGLE, int(length)) == width:
                    self._windows(hashes, owner, places[lengths == length], int(length), width, start, end, least, best, clipped)
        return [(t, self.ids[i], s, a, b) for (t, i), (s, a, b) in sorted(best.items())]

    def _windows(self, hashes, owner, hits, length, width, start, end, least, best, clipped) -> None:
        span = length - width + 1  # shingles of a whole window
        for group in np.array_split(hits, max(1, len(hits) * span // 200_000)):
            low, high = (np.searchsorted(owner, owner[group], side)[:, None] for side in ("left", "right"))
            first = group[:, None] - np.arange(span)
            a, b = np.maximum(first, low).ravel(), np.minimum(first + length, high).ravel()
            # fewer shingles than this cannot be similar enough
            fewest = max(1, least * span - 1e-9) if clipped else span
            ends = np.unique((a * (len(owner) + 1) + b)[b - a - width + 1 >= fewest])
            if not len(ends):
                continue
            first, last = np.divmod(ends, len(owner) + 1)
            many = last - first - width + 1
            needed = np.unique((first[:, None] + np.arange(span))[np.arange(span) < many[:, None]])
            sums = _bit_sums(hashes[needed])
            at = np.searchsorted(needed, first)
            prints = np.packbits(sums[at + many] - sums[at] > 0, axis=1, bitorder="little").view("<u8")[:, 0]
            for s, e, n, p in zip(first.tolist(), last.tolist(), many.tolist(), prints):
                for i in self.within(p, length):
                    like = similarity(hashes[s : s + n], self.bags[i])
                    key = int(owner[s]), i
                    if like >= least and (key not in best or like > best[key][0]):
                        best[key] = like, int(start[s]), int(end[e - 1])


def keep_clean(
    documents: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text",
    least: float = SIMILARITY, block_items: int = BLOCK_ITEMS, clipped: bool = False,
) -> DataFrame:
    """The documents that hold no item of the benchmark, all columns; the same search, as a filter on the text.

    Null, empty and too short texts hold no item and stay; repeated rows stay or go together; an empty
    table gives an empty one, an empty benchmark takes nothing away.
    """
    items = benchmark.select(F.col(item_id).alias("item_id"), F.col(item_text).alias("text"))
    blocks = max(1, -(-items.count() // block_items))
    for b in range(blocks):
        block = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b)
        shared = documents.sparkSession.sparkContext.broadcast(sorted(map(tuple, block.distinct().collect()), key=repr))
        documents = documents.where(~_holds(shared, least, clipped)(F.col(text)))
    return documents


def _holds(shared, least: float, clipped: bool):
    @F.arrow_udf("boolean")
    def holds(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        index = Index(shared.value)
        for column in batches:
            out = np.zeros(len(column), bool)
            for a, texts in _parts(column):
                out[[a + t for t, *_ in index.matches(texts, least, clipped)]] = True
            yield pa.array(out)

    return holds


def _parts(column: pa.Array) -> Iterator[tuple[int, list[str]]]:
    """Texts to be searched together, with the number of the first; a long text is one by itself."""
    for a, b in portions(text_bytes(column)[1], PORTION):
        yield a, column.slice(a, b - a).fill_null("").to_pylist()


def find_leaks(
    documents: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text",
    least: float = SIMILARITY, block_items: int = BLOCK_ITEMS, clipped: bool = False,
) -> DataFrame:
    """One row for each document row and item it holds: ids, similarity and the span of the best window.

    Columns: id, item id, ``similarity`` (at least ``least``), ``char_start``, ``char_end``. Words
    are lowered runs of letters and digits; items under five words are compared as one whole shingle;
    items and texts without words (null and empty ones too) match nothing; among equal
    windows the first counts. ``clipped`` also compares items with what a text holds of them at its
    start or end, and with texts shorter than they are. The benchmark is the query set: its items go to all tasks in blocks of
    ``block_items``, one pass over the documents for each block. Only the columns named are read.
    """
    spark = documents.sparkSession
    texts = documents.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    items = benchmark.select(F.col(item_id).alias("item_id"), F.col(item_text).alias("text"))
    id_type, item_type = (x.schema[0].dataType.simpleString() for x in (texts, items))
    kind = f"doc_id {id_type}, item_id {item_type}, similarity double, char_start long, char_end long"
    arrow_item = to_arrow_type(items.schema[0].dataType)
    blocks = max(1, -(-items.count() // block_items))
    found = spark.createDataFrame([], kind)
    for b in range(blocks):
        block = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b)
        shared = spark.sparkContext.broadcast(sorted(map(tuple, block.distinct().collect()), key=repr))
        found = found.unionByName(texts.mapInArrow(_search(shared, least, arrow_item, clipped), kind))
    return found.withColumnsRenamed({"doc_id": doc_id, "item_id": item_id})


def _search(shared, least: float, item_type: pa.DataType, clipped: bool):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(shared.value)
        for batch in batches:
            for a, texts in _parts(batch.column(1)):
                rows = index.matches(texts, least, clipped)
                if rows:
                    t, item, like, start, end = zip(*rows)
                    ids = batch.column(0).take(pa.array([a + i for i in t], pa.int64()))
                    yield pa.RecordBatch.from_arrays(
                        [ids, pa.array(item, item_type), pa.array(like, pa.float64()), pa.array(start, pa.int64()), pa.array(end, pa.int64())],
                        names=["doc_id", "item_id", "similarity", "char_start", "char_end"],
                    )

    return search
