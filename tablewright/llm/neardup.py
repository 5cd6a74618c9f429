"""SimHash near-duplicates, found by covering locality-sensitive hashing.

Two fingerprints within ``radius`` bits always meet: every bit position has a vector of radius + 1
bits, and every non-zero vector v gives a mask of the positions whose vector has an odd product with
v. The vectors of at most ``radius`` differing positions leave at least one v orthogonal to all of
them, and under that mask both fingerprints are equal. Buckets with more members than a task should
compare are covered again on their free bits, which bounds a bucket by 2 to the number of free bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.llm.components import connected
from tablewright.session import checkpointed

BITS = 64
SEED = 42
MOST_MEMBERS = 256
BROADCAST_BUCKETS = 200_000  # of 20 bytes each


def fingerprint_of(text: str, words: int = 3) -> int:
    """Bits set in over half the XXH64 values of the shingles, as a signed 64-bit integer."""
    w = text.encode("utf-8", "surrogatepass").lower().split()
    if not w:
        return 0
    one = xxhash.xxh64_intdigest
    if len(w) < words:
        hashes = [one(b" ".join(w), SEED)]
    else:
        hashes = [one(b" ".join(s), SEED) for s in zip(*(w[i:] for i in range(words)))]
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 65536):
        part = np.array(hashes[at : at + 65536], "<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<i8")[0])


def fingerprint(text: Column, words: int = 3) -> Column:
    """SimHash of a text column as a long. A-Z are lowered, words are runs without ASCII white space.

    Fewer words than a shingle has: the whole sequence is the one shingle. Null or no word: zero.
    """

    @F.arrow_udf("long")
    def simhash(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.array([fingerprint_of(t.as_py() or "", words) for t in texts], pa.int64())

    return simhash(text)


def covering_masks(free: int, radius: int) -> list[int]:
    """Masks over the bits of ``free`` such that up to ``radius`` differing bits are avoided by one of them."""
    vectors = 2 ** (radius + 1) - 1
    place = [b for b in range(BITS) if free >> b & 1]
    return [
        sum(1 << b for i, b in enumerate(place) if ((1 + i % vectors) & v).bit_count() & 1)
        for v in range(1, vectors + 1)
    ]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _linked_within(radius: int):
    """UDF: the members of one bucket to the links of a spanning forest of them."""

    @F.arrow_udf("array<struct<a:bigint,b:bigint>>")
    def forest(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        kind = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))
        for buckets in batches:
            out = []
            for bucket in buckets:
                fps = np.unique(np.array(bucket.as_py(), np.int64))
                near = np.bitwise_count((fps[:, None] ^ fps[None, :]).view(np.uint64)) <= radius
                links, waiting = [], np.ones(len(fps), bool)
                while waiting.any():
                    todo = [int(np.argmax(waiting))]
                    waiting[todo[0]] = False
                    while todo:
                        at = todo.pop()
                        for other in np.flatnonzero(near[at] & waiting):
                            waiting[other] = False
                            todo.append(int(other))
                            links.append({"a": int(min(fps[at], fps[other])), "b": int(max(fps[at], fps[other]))})
                out.append(links)
            yield pa.array(out, kind)

    return forest


def near_links(fingerprints: DataFrame, radius: int = 3, most_members: int = MOST_MEMBERS) -> DataFrame:
    """Links (a, b) that connect all distinct fingerprints of column ``fp`` within ``radius`` bits.

    The links connect exactly what all pairs would: pairs of a bucket give a spanning forest. Bucket
    sizes are counted by a pre-aggregated group-by before any bucket is gathered, and only buckets of
    up to ``most_members`` are; larger ones are covered again on the bits their mask leaves free.
    """
    spark = fingerprints.sparkSession
    members = fingerprints.select(F.lit(0).cast("int").alias("scope"), "fp")
    scopes, found, near = {0: 0}, [], _linked_within(radius)
    while True:
        rows, inner = [], {}
        for scope, fixed in scopes.items():
            for mask in covering_masks(~fixed & (1 << BITS) - 1, radius):
                inner[len(inner)] = fixed | mask
                rows.append((scope, len(inner) - 1, _signed(fixed | mask)))
        if len(scopes) == 1:
            masked = F.inline(F.array(*[F.struct(F.lit(part).alias("part"), F.lit(mask).cast("long").alias("mask")) for _, part, mask in rows]))
            masked = members.select("fp", masked)
        else:
            tables = spark.createDataFrame(rows, "scope int, part int, mask long")
            masked = members.join(F.broadcast(tables), "scope")
        keyed = masked.select("part", F.col("fp").bitwiseAND(F.col("mask")).alias("key"), "fp")
        sizes = checkpointed(
            keyed.groupBy("part", "key")
            .agg(F.count("*").alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b"))
            .where("n > 1")
        )
        found.append(sizes.where((F.col("n") == 2) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius)).select("a", "b"))
        crowded = sizes.where("n > 2").select("part", "key", "n")
        buckets = crowded.count()
        if not buckets:
            break
        crowd = keyed.join(F.broadcast(crowded) if buckets <= BROADCAST_BUCKETS else crowded, ["part", "key"])
        gathered = crowd.where(F.col("n") <= most_members).groupBy("part", "key").agg(F.collect_list("fp").alias("fps"))
        found.append(gathered.select(F.explode(near("fps")).alias("link")).select("link.a", "link.b"))
        large = [r.part for r in sizes.where(F.col("n") > most_members).select("part").distinct().collect()]
        if not large:
            break
        members = checkpointed(crowd.where(F.col("n") > most_members).select(F.col("part").alias("scope"), "fp"))
        scopes = {part: inner[part] for part in sorted(large)}
    links = found[0]
    for more in found[1:]:
        links = links.unionByName(more)
    return links.distinct()


def _grouped(prints: DataFrame, radius: int) -> DataFrame:
    """(fp, root, component_id) of every fingerprint in (id, fp); the root, a fingerprint, is never null."""
    kinds = prints.groupBy("fp").agg(F.min("id").alias("least"))
    links = checkpointed(near_links(kinds.select("fp"), radius))
    roots = connected(links).withColumnRenamed("node", "fp")
    smallest = roots.join(kinds, "fp").groupBy("root").agg(F.min("least").alias("smallest"))
    linked = roots.join(smallest, "root").select("fp", "root", "smallest")
    return kinds.join(linked, "fp", "left").select(
        "fp", F.coalesce("root", "fp").alias("root"), F.coalesce("smallest", "least").alias("component_id")
    )


def near_duplicates(
    documents: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = 3, radius: int = 3
) -> DataFrame:
    """One row per document row: id, ``fingerprint`` (16 hex digits) and ``component_id``.

    ``component_id`` is the smallest id reachable over fingerprints at most ``radius`` bits apart.
    Empty and null texts have fingerprint zero and link like any other. Repeated rows come back as
    often as they came. A null id is nobody's component id unless no other id is in the component.
    Only the two columns named are read, so other columns cannot clash. An empty table gives no rows.
    """
    prints = checkpointed(documents.select(F.col(doc_id).alias("id"), fingerprint(F.col(text), words).alias("fp")))
    return prints.join(_grouped(prints, radius).drop("root"), "fp").select(
        F.col("id").alias(doc_id), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def keep_one(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = 3, radius: int = 3) -> DataFrame:
    """One row of each component of near copies, all columns: that of the least id, null ids last.

    Of rows of one component that share this id the one with the least digest of all columns stays;
    of rows that are equal in all columns, one. Rows are chosen by component, never by id alone.
    Null, empty and blank texts are one component; an empty table gives an empty one.
    """
    digest = F.sha2(F.to_json(F.struct(*[F.col(f"`{c}`") for c in documents.columns]), {"ignoreNullFields": "false"}), 256)
    prints = checkpointed(documents.select(F.col(doc_id).alias("id"), fingerprint(F.col(text), words).alias("fp"), digest.alias("digest")))
    order = F.struct(F.col("id").isNull().alias("nameless"), "id", "digest")
    chosen = prints.join(_grouped(prints, radius).select("fp", "root"), "fp").groupBy("root").agg(F.min(order).alias("first"))
    kept = checkpointed(chosen.select("first.digest"))
    rows = documents.withColumn("_digest_of_row", digest)
    once = rows.join(kept, rows["_digest_of_row"] == kept["digest"], "left_semi")
    # equal rows: only those that were chosen and occur more than once are grouped
    copies = prints.join(kept, "digest", "left_semi").groupBy("digest").count().where("count > 1").select("digest")
    copies = checkpointed(copies)
    if copies.isEmpty():
        return once.drop("_digest_of_row")
    single = once.join(copies, once["_digest_of_row"] == copies["digest"], "left_anti").drop("_digest_of_row")
    several = once.join(copies, once["_digest_of_row"] == copies["digest"], "left_semi")
    row = F.struct(*[several[f"`{c}`"] for c in documents.columns])
    one = several.groupBy("_digest_of_row").agg(F.first(row).alias("row")).select("row.*")
    return single.unionByName(one)
