"""Source divergence audit: how the terms of each source of a language differ from the other sources.

Two passes over the texts. The first finds the terms that enough documents of a language hold. Their
minimal perfect hashes, in shards, are broadcast, and the second pass counts into dense slots, one for
each kept term. All arithmetic is on whole numbers.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tablewright.llm.perfect_hash import PerfectHash, Shards, unpacked
from tablewright.session import checkpointed, scratch_path

TERM = re.compile(rb"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
NO_TERM = re.compile(rb"[\x00-\x40\x5B-\x60\x7B-\x7F]")
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
LEAST_DOCUMENTS = 3
UNIT = 1_000_000_000
TOP = 200
PIECE = 1 << 20  # bytes of a text whose terms are listed at once
HELD_TERMS, HELD_TOKENS = 600_000, 16 << 20  # distinct terms, and tokens, that a task holds before it hands counts on
SHARD_KEYS = 200_000
BUNDLE_BYTES = 64 << 20  # most that is broadcast at once; more shards take more passes
BLOCK_CELLS = 1 << 17  # terms times sources of one table of counts


def pieces(data: bytes) -> Iterator[bytes]:
    """A text in pieces that cut no term."""
    at = 0
    while at < len(data):
        cut = NO_TERM.search(data, at + PIECE) if at + PIECE < len(data) else None
        end = cut.end() if cut else len(data)
        yield data[at:end]
        at = end


def terms(data: bytes) -> Iterator[list[bytes]]:
    """The terms of a text in order, A-Z in lower case, piece by piece."""
    for piece in pieces(data):
        yield TERM.findall(piece.translate(LOWER))


def _repeated(value: str, n: int) -> pa.Array:
    return pa.DictionaryArray.from_arrays(pa.array(np.zeros(n, np.int32)), pa.array([value], pa.string())).cast(pa.string())


def _documents_with(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, term, number of documents) of a task, in parts."""
    held: dict[str, Counter] = {}

    def handed_on():
        for lang, counts in held.items():
            names = pa.array(list(counts), pa.binary()).cast(pa.string())
            n = pa.array(np.fromiter(counts.values(), np.int64, len(counts)))
            yield pa.RecordBatch.from_arrays([_repeated(lang, len(n)), names, n], names=["lang", "term", "n"])
        held.clear()

    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            found = set()
            for some in terms(text.as_buffer().to_pybytes()):
                found.update(some)
            held.setdefault(lang, Counter()).update(found)
            if sum(map(len, held.values())) > HELD_TERMS:
                yield from handed_on()
    yield from handed_on()


def kept_terms(documents: DataFrame, least: int) -> DataFrame:
    """(lang, term) that at least ``least`` documents of the language hold, counted exactly."""
    some = documents.select("lang", "text").mapInArrow(_documents_with, "lang string, term string, n long")
    return some.groupBy("lang", "term").agg(F.sum("n").alias("n")).where(F.col("n") >= least).select("lang", "term")


def build_shards(kept: DataFrame, bits: int) -> DataFrame:
    """(lang, shard, n, bytes, packed): the perfect hash of each shard of a language's terms."""

    def built(key, group):
        table = PerfectHash([t.encode() for t in group.column("term").to_pylist()])
        packed = table.packed()
        return pa.table({
            "lang": pa.array([key[0].as_py()], pa.string()), "shard": pa.array([key[1].as_py()], pa.int32()), "n": pa.array([len(table)], pa.int64()),
            "bytes": pa.array([len(packed)], pa.int64()), "packed": pa.array([packed], pa.binary()),
        })

    # the top bits of the hash, as Shards reads them
    shard = F.shiftrightunsigned(F.xxhash64("term"), 64 - bits).cast("int") if bits else F.lit(0)
    dealt = kept.withColumn("shard", shard).groupBy("lang", "shard")
    return dealt.applyInArrow(built, "lang string, shard int, n long, bytes long, packed binary")


def bundles(shards: list, most: int) -> list[list]:
    """Shards in order, in runs of at most ``most`` bytes (one shard at least)."""
    out, size = [], 0
    for s in shards:
        if not out or size + s.bytes > most:
            out.append([])
            size = 0
        out[-1].append(s)
        size += s.bytes
    return out


def _loaded(sent: Broadcast) -> dict[str, Shards]:
    bits, rows = sent.value
    out = {}
    for lang in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == lang]
        out[lang] = Shards(bits, {r[1]: unpacked(r[3]) for r in own}, {r[1]: r[2] for r in own})
    return out


class _Numbers(dict):
    """Numbers terms as they are first asked for."""

    def __missing__(self, term: bytes) -> int:
        self[term] = number = len(self)
        return number


CELLS = "lang string, block long, source string, total long, slots binary, n binary, names array<string>"


def recount(documents: DataFrame, sent: Broadcast, block: int) -> DataFrame:
    """Occurrences of the broadcast terms in each group, a row for each group and block of slots.

    ``slots`` and ``n`` are the numbers of the block's terms that occur (32 bits) and how often (64
    bits), ``total`` their sum. One row of each block, without a source, has its terms as ``names``.
    """

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = _loaded(sent)
        numbers, held, size = {lang: _Numbers() for lang in tables}, {}, 0

        def handed_on():
            of = {}
            for lang, known in numbers.items():
                found = tables[lang].find(list(known))
                of[lang] = np.where(found >= 0, found, tables[lang].size)
            for (lang, source), parts in held.items():
                table = tables[lang]
                dense = np.bincount(of[lang][np.concatenate(parts)], minlength=table.size + 1)[:-1]
                slots = np.flatnonzero(dense)
                yield _cells(lang, source, slots + table.first, dense[slots], block)
            held.clear()
            for known in numbers.values():
                known.clear()

        for batch in batches:
            for lang, source, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                known = numbers.get(lang)
                if known is None:
                    continue
                for some in terms(text.as_buffer().to_pybytes()):
                    held.setdefault((lang, source), []).append(np.fromiter(map(known.__getitem__, some), np.int32, len(some)))
                    size += len(some)
                    if size > HELD_TOKENS or len(known) > HELD_TERMS:
                        yield from handed_on()
                        size = 0
        yield from handed_on()

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # rows come sorted by block and source
        tables, at, dense = _loaded(sent), None, np.zeros(block, np.int64)

        def done(lang, number, source):
            slots = np.flatnonzero(dense)
            out = _cells(lang, source, slots + number * block, dense[slots], block)
            dense[:] = 0
            return out

        for batch in batches:
            for lang, number, source, slots, n in zip(*(batch.column(i).to_pylist() for i in (0, 1, 2, 4, 5))):
                if at and at != (lang, number, source):
                    yield done(*at)
                if not at or at[:2] != (lang, number):
                    yield _names(lang, number, tables[lang], block)
                at = lang, number, source
                dense[np.frombuffer(slots, np.uint32)] += np.frombuffer(n, np.int64)
        if at:
            yield done(*at)

    some = documents.select("lang", "source", "text").mapInArrow(counted, CELLS)
    return some.repartition("lang", "block").sortWithinPartitions("lang", "block", "source").mapInArrow(merged, CELLS)


_KINDS = (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.string()))


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * len(_KINDS)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, _KINDS)], names=["lang", "block", "source", "total", "slots", "n", "names"])


def _names(lang: str, number: int, table: Shards, block: int) -> pa.RecordBatch:
    """The row of a block that names its terms, as far as they are here."""
    own = np.arange(max(table.first, number * block), min(table.first + table.size, (number + 1) * block))
    slots = (own - number * block).astype(np.uint32)
    return _rows([(lang, number, None, 0, slots.tobytes(), b"", [t.decode() for t in table.keys(own)])])


def _cells(lang: str, source: str, slots: np.ndarray, n: np.ndarray, block: int) -> pa.RecordBatch:
    """Counts by rising slot, a row for each block."""
    number = slots // block
    limits = np.concatenate([[0], np.flatnonzero(np.diff(number)) + 1, [len(slots)]]).tolist() if len(slots) else [0]
    inside, n = (slots - number * block).astype(np.uint32), n.astype(np.int64)
    return _rows([
        (lang, int(number[a]), source, int(n[a:b].sum()), inside[a:b].tobytes(), n[a:b].tobytes(), None) for a, b in zip(limits[:-1], limits[1:])
    ])


def counts(spark: SparkSession, documents: DataFrame, least: int, block: int, bundle_bytes: int = BUNDLE_BYTES, shard_keys: int = SHARD_KEYS) -> tuple[DataFrame, DataFrame]:
    """Rows of ``recount`` over all shards, slots from nought in each language; and (lang, v), the kept terms of each."""
    kept = checkpointed(kept_terms(documents, least))
    largest = kept.groupBy("lang").count().agg(F.max("count")).first()[0] or 0
    bits = max(0, int(-(-largest // shard_keys) - 1).bit_length())
    shards = checkpointed(build_shards(kept, bits))
    after = F.sum("n").over(Window.partitionBy("lang").orderBy("shard"))
    listed = shards.select("lang", "shard", "n", "bytes", (after - F.col("n")).alias("base")).orderBy("lang", "shard").collect()
    path = scratch_path(spark, "recount")
    spark.createDataFrame([], CELLS).write.parquet(path)
    for bundle in bundles(listed, bundle_bytes):
        base = {(s.lang, s.shard): s.base for s in bundle}
        wanted = spark.createDataFrame(list(base), "lang string, shard int")
        rows = shards.join(F.broadcast(wanted), ["lang", "shard"]).select("lang", "shard", "packed").collect()
        sent = spark.sparkContext.broadcast((bits, [(r.lang, r.shard, base[r.lang, r.shard], bytes(r.packed)) for r in rows]))
        recount(documents, sent, block).write.mode("append").parquet(path)
        sent.unpersist()
    return spark.read.schema(CELLS).parquet(path), shards.groupBy("lang").agg(F.sum("n").alias("v"))


def shares(n: np.ndarray, total) -> np.ndarray:
    """1 + floor(UNIT * (n + 1) / total), on whole numbers of any size."""
    if int(n.max(initial=0)) < 9_000_000_000:
        return 1 + (UNIT * (n + 1)) // total
    return 1 + ((n.astype(object) + 1) * UNIT // total).astype(np.int64)


def compare_block(sources: list[str], sizes: np.ndarray, v: int, n: np.ndarray, names: list[str], top: int):
    """Of a block of kept terms: sums over the terms for each pair of sources, and each source's best terms.

    ``n`` has a row for each source and a column for each term. A pair's value is the row source's
    against the column source's. Of each source the ``top`` best terms and all that tie with the last come back.
    """
    p = shares(n, (sizes + v)[:, None])
    pairs = np.zeros((len(sources), len(sources)), np.int64)
    for i in range(len(sources)):
        d = p[i] - p
        pairs[i] = (d * d // p).sum(axis=1)
    q = shares(n.sum(axis=0), int(sizes.sum()) + v)
    best = []
    for i in range(len(sources)):
        at = np.flatnonzero((n[i] > 0) & (p[i] > q))
        d = p[i, at] - q[at]
        f = d * d // q[at]
        if len(at) > top:
            good = f >= np.partition(f, len(f) - top)[len(f) - top]
            at, f = at[good], f[good]
        best += [(sources[i], names[j], int(x)) for j, x in zip(at.tolist(), f.tolist())]
    return pairs, best


def audit(
    documents: DataFrame, lang: str = "lang", source: str = "source", text: str = "text", least: int = LEAST_DOCUMENTS, top: int = TOP,
    bundle_bytes: int = BUNDLE_BYTES, shard_keys: int = SHARD_KEYS,
) -> DataFrame:
    """Per group (lang, source) and part: ``item``, ``value`` and ``rank``.

    Part ``pair`` has every other source of the language, part ``term`` the ``top`` kept terms that the
    group uses more than its language does. Null texts, languages and sources are read as ''. A
    repeated row is a document of its own. Ties are ranked by the item's bytes. A group without terms
    has pairs only; a language without kept terms has pairs of value 0; a language of one source has
    no pairs; an empty table gives no rows. No other column is read.
    """
    spark = documents.sparkSession
    docs = documents.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(a) for c, a in ((lang, "lang"), (source, "source"), (text, "text"))))
    groups = checkpointed(docs.select("lang", "source").distinct())
    most = groups.groupBy("lang").count().agg(F.max("count")).first()[0] or 1
    block = max(256, min(1 << 16, BLOCK_CELLS // most))
    found, sizes = counts(spark, docs, least, block, bundle_bytes, shard_keys)
    used = found.where("source IS NOT NULL").groupBy("lang", "source").agg(F.sum("total").alias("total"))
    groups = groups.join(used, ["lang", "source"], "left").join(sizes, "lang", "left")
    groups = checkpointed(groups.select("lang", "source", F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("v", F.lit(0)).alias("v")))

    def compared(key, cells, stats):
        stats = stats.sort_by("source")
        sources, totals = stats.column("source").to_pylist(), stats.column("total").to_numpy()
        own, at = key[0].as_py(), {s: i for i, s in enumerate(sources)}
        n, names = np.zeros((len(sources), block), np.int64), np.empty(block, object)
        for source, slots, counted, called in zip(*(cells.column(c).to_pylist() for c in ("source", "slots", "n", "names"))):
            slots = np.frombuffer(slots, np.uint32)
            if source is None:
                names[slots] = called
            else:
                n[at[source], slots] = np.frombuffer(counted, np.int64)
        here = np.flatnonzero(n.any(axis=0))
        pairs, best = compare_block(sources, totals, stats.column("v")[0].as_py(), n[:, here], names[here].tolist(), top)
        a, b = np.nonzero(~np.eye(len(sources), dtype=bool))
        rows = [("pair", sources[i], sources[j], int(pairs[i, j])) for i, j in zip(a.tolist(), b.tolist())] + [("term", *r) for r in best]
        part, source_, item, value = list(zip(*rows)) or ((),) * 4
        strings = [pa.array(c, pa.string()) for c in ([own] * len(rows), source_, part, item)]
        return pa.table([*strings, pa.array(value, pa.int64())], names=["lang", "source", "part", "item", "value"])

    blocks = F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(v - 1) div {block}")))
    stats = groups.where("v > 0").select("*", blocks.alias("block"))
    rows = (
        found.groupBy("lang", "block")
        .cogroup(stats.groupBy("lang", "block"))
        .applyInArrow(compared, "lang string, source string, part string, item string, value long")
    )
    rows = checkpointed(rows)
    sums = rows.where("part = 'pair'").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    others = groups.select("lang", F.col("source").alias("item"))
    pairs = groups.select("lang", "source").join(others, "lang").where("source != item")
    pairs = pairs.join(sums, ["lang", "source", "item"], "left").select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0)).alias("value"))
    ranked = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    best = rows.where("part = 'term'").withColumn("rank", ranked).where(F.col("rank") <= top)
    return pairs.withColumn("rank", ranked).unionByName(best)
