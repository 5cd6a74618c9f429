"""Document fingerprints by content-defined chunking with a gear hash and normalised boundaries."""

from __future__ import annotations

import hashlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.llm.common import byte_table, mixed

LEAST, NORMAL, MOST = 8, 32, 128
REACH = 32
BLOCK = 1 << 18
ROWS_PER_BUCKET = 4000
MOST_RANGES = 100_000  # cuts that the driver holds and every task gets, 16 bytes each

GEAR = (byte_table(1) >> np.uint64(32)).astype(np.uint32)
DIGEST = byte_table(2)
BASE = np.uint64(0xD1342543DE82EF95)


def _powers(base: int, n: int) -> np.ndarray:
    """Powers of an odd base modulo 2^64."""
    out = np.ones(n, np.uint64)
    done = 1
    with np.errstate(over="ignore"):
        while done < n:
            take = min(done, n - done)
            out[done : done + take] = out[:take] * np.uint64(pow(base, done, 1 << 64))
            done += take
    return out


POWERS = _powers(int(BASE), MOST + 1)


def gear_hash(data: np.ndarray) -> np.ndarray:
    """Rolling hash after each byte: the sum of the gear values of the last 32 bytes, each shifted by its age."""
    h, span = GEAR[data], 1
    while span < REACH:
        older = h[:-span] << np.uint32(span)
        h = h.copy()
        h[span:] += older
        span *= 2
    return h


def boundaries(data: np.ndarray) -> list[int]:
    """Ends of the chunks. A cut needs more zero bits before the normal size than after it."""
    n = len(data)
    if n <= LEAST:
        return [n] if n else []
    bits = NORMAL.bit_length() - 1
    strict, loose = [], []
    for at in range(0, n, BLOCK):
        from_ = max(0, at - REACH)
        top = gear_hash(data[from_ : at + BLOCK])[at - from_ :] >> np.uint32(32 - bits - 2)
        found = np.flatnonzero((top & np.uint32(2 ** (bits - 2) - 1)) == 0)
        loose += (found + (at + 1)).tolist()
        strict += (found[top[found] == 0] + (at + 1)).tolist()
    ends, start = [], 0
    while n - start > LEAST:
        normal, most = start + NORMAL, min(start + MOST, n)
        i = bisect_left(strict, start + LEAST)
        if i < len(strict) and strict[i] <= normal:
            start = strict[i]
        else:
            i = bisect_right(loose, normal)
            start = loose[i] if i < len(loose) and loose[i] < most else most
        ends.append(start)
    if start < n:
        ends.append(n)
    return ends


def chunk_set(text: bytes) -> np.ndarray:
    """Distinct chunks in ascending order, each as 48 bits of digest and 8 bits of length."""
    data = np.frombuffer(text, np.uint8)
    ends = np.array(boundaries(data), np.int64)
    if not len(ends):
        return np.zeros(0, np.uint64)
    sizes = np.diff(ends, prepend=0)
    digests = np.empty(len(ends), np.uint64)
    with np.errstate(over="ignore"):
        for first in range(0, len(ends), 8192):
            size, end = sizes[first : first + 8192], ends[first : first + 8192]
            start = end - size
            part = data[start[0] : end[-1]]
            age = np.repeat(end, size) - np.arange(start[0], end[-1])
            digests[first : first + 8192] = np.add.reduceat(DIGEST[part] * POWERS[age], start - start[0])
        digests = mixed(digests + sizes.astype(np.uint64))
    return np.unique(digests >> np.uint64(16) << np.uint64(8) | sizes.astype(np.uint64))


def containment(own: np.ndarray, other: np.ndarray) -> float:
    """Share of the own chunks' length that the other set has too. Two empty sets: 1; one empty: 0."""
    if not len(own) or not len(other):
        return float(len(own) == len(other))
    lengths = (own & np.uint64(255)).astype(np.int64)
    at = np.minimum(np.searchsorted(other, own), len(other) - 1)
    return float(lengths[other[at] == own].sum() / lengths.sum())


def as_text(chunks: np.ndarray) -> str:
    """14 hex digits for each chunk: 12 of its digest, 2 of its length."""
    digits = chunks.astype(">u8").tobytes().hex()
    kept = np.frombuffer(digits.encode(), np.uint8).reshape(-1, 16)
    return kept[:, 2:].tobytes().decode()


def from_text(fingerprint: str) -> np.ndarray:
    digits = np.frombuffer(fingerprint.encode(), np.uint8).reshape(-1, 14)
    padded = np.concatenate([np.full((len(digits), 2), ord("0"), np.uint8), digits], axis=1)
    return np.frombuffer(bytes.fromhex(padded.tobytes().decode()), ">u8").astype(np.uint64)


def edited(text: str, following: str) -> str:
    """The last quarter of the code points replaced by the first as many of the following text."""
    k = len(text) // 4
    return text[: len(text) - k] + following[:k]


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order of bucket and id; a borrowed row only lends its text to the row before."""
    waiting = None
    for batch in batches:
        out = [[] for _ in KIND]
        for i in range(batch.num_rows):
            bucket, borrowed, doc_id, text = (batch.column(c)[i].as_py() for c in range(4))
            chunks = chunk_set(text.encode("utf-8", "surrogatepass"))
            if waiting and waiting[0] == bucket:
                _, own_id, own, mine = waiting
                new = edited(own, text).encode("utf-8", "surrogatepass")
                after = chunk_set(new)
                row = (own_id, len(own), hashlib.sha256(new).hexdigest(), as_text(mine), as_text(after), containment(mine, after), containment(mine, chunks))
                for column, value in zip(out, row):
                    column.append(value)
            waiting = None if borrowed else (bucket, doc_id, text, chunks)
        yield pa.RecordBatch.from_arrays([pa.array(c, k.type) for c, k in zip(out, KIND)], schema=KIND)


RESULT = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
    "near_edited double, near_next double"
)
KIND = pa.schema([
    ("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()),
    ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64()),
])


def _every(rows: int):
    """Of sorted rows, the first of each partition and every ``rows``-th after it."""

    def some(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = 0
        for batch in batches:
            yield batch.take(pa.array(range(-seen % rows, batch.num_rows, rows), pa.int64()))
            seen += batch.num_rows

    return some


def _targets(cuts: list[tuple[int, int]]):
    """UDF: the range that a place falls in, and for the first place of a range also the range before it."""
    ids, ties = (np.array([c[i] for c in cuts], np.int64) for i in (0, 1))
    kind = pa.list_(pa.struct([("bucket", pa.int32()), ("borrowed", pa.bool_())]))

    @F.arrow_udf("array<struct<bucket:int,borrowed:boolean>>")
    def targets(at: pa.Array, tie: pa.Array) -> pa.Array:
        out = []
        at, tie = at.to_numpy(), tie.to_numpy()
        low, high = np.searchsorted(ids, at, "left"), np.searchsorted(ids, at, "right")
        for t, a, b in zip(tie, low, high):
            own = int(a + np.searchsorted(ties[a:b], t, "right")) - 1
            out.append([{"bucket": own, "borrowed": False}])
            if a <= own < b and ties[own] == t:
                out[-1].append({"bucket": (own - 1) % len(ids), "borrowed": True})
        return pa.array(out, kind)

    return targets


def compare_with_edited(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """Fingerprint of every text and of its edited text, and how much of it the edited and the next text contain.

    The next text is that of the next row in order of id (null ids first, ties by the text's hash);
    the last row's is the first's. Null texts are empty. The order is cut into ranges of about
    ``rows_per_bucket`` rows, found from ids and hashes alone; a range also borrows the first row of
    the range after it, so every text is shuffled once and a task streams its rows. Only the cuts (one id
    and hash for each range) come to the driver: beyond ``MOST_RANGES`` times ``rows_per_bucket`` rows the ranges
    grow instead of their number. Only the two columns named are read, so other columns
    cannot clash. An empty table gives no rows; the next text of a single row is its own.
    """
    places = documents.select(
        F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")
    ).withColumns({"at": F.coalesce("doc_id", F.lit(-(2**63))), "tie": F.xxhash64("text")})
    ordered = places.select("at", "tie").repartitionByRange("at", "tie").sortWithinPartitions("at", "tie")
    step = max(rows_per_bucket, -(-documents.count() // MOST_RANGES))
    some = ordered.mapInArrow(_every(step), "at long, tie long")
    cuts = sorted({(r.at, r.tie) for r in some.collect()})
    to = F.explode(_targets(cuts)("at", "tie")).alias("to")
    dealt = places.select("*", to).select("to.bucket", "to.borrowed", "doc_id", "text", "at", "tie")
    ranges = dealt.repartitionById(max(1, len(cuts)), "bucket").sortWithinPartitions("bucket", "borrowed", "at", "tie")
    return ranges.select("bucket", "borrowed", "doc_id", "text").mapInArrow(_compare, RESULT)
