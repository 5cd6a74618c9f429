"""Language-model scoring: smoothed n-grams as a weighted automaton with failure arcs.

The model is an n-gram model with Dirichlet-smoothed back-off, counted over all training texts. As an
automaton its states are the seen histories; a state has an arc for each word seen after it, and a
failure arc to the next shorter history that carries the weight of backing off. A text is read once from
left to right: the state is carried along, and the weights of the arcs taken add up to its log-probability.

The counts of all n-grams are spread over the cluster and never brought together. Texts are dealt into
chunks; a chunk sends the n-grams that it holds (sorted keys, in buckets of the key's top bits) and gets
their counts over the whole corpus back. From these it builds the part of the automaton that its own
texts can reach, which is all that reading them needs.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, BooleanType, DoubleType, LongType, StructType

from tablewright.llm.common import WORD_MIX, in_fold, mixed
from tablewright.llm.perfect_hash import hashes
from tablewright.session import scratch_path

LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
SPACE = re.compile(rb"[\x20\x09-\x0D]")
END = b""  # no word is empty
FOLDS, HELD_OUT = 7, 2
ORDER = 2
STRENGTH = 500.0  # weight of the shorter history, in tokens
CHUNK, PIECE = 6 << 20, 4 << 20  # bytes of text of a chunk, and of a piece of a long text
BUCKET_KEYS = 1 << 20
AT_ONCE = 1 << 17  # keys looked up, or tokens weighed, in one go
STRIDE = 128  # tokens that one reader of the automaton takes


def planes(x: np.ndarray) -> bytes:
    """Bytes of an array, all first bytes, then all second ones, ...: like bytes pack well."""
    return x.view(np.uint8).reshape(len(x), x.itemsize).T.tobytes()


def from_planes(data: bytes, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.frombuffer(data, np.uint8).reshape(size, -1).T.copy().view(kind).ravel()


def words_of(data: bytes) -> Iterator[list[bytes]]:
    """The words of a text, A-Z in lower case, in lists of a piece each; at least one list."""
    at = 0
    while True:
        cut = SPACE.search(data, at + PIECE) if at + PIECE < len(data) else None
        yield data[at : cut.start() if cut else None].translate(LOWER).split()
        if cut is None:
            return
        at = cut.end()


class _Numbers(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self)
        return number


def _distinct(keys: np.ndarray) -> np.ndarray:
    """Sorted distinct keys."""
    keys = np.sort(keys)
    return keys[np.concatenate([[True], keys[1:] != keys[:-1]])] if len(keys) else keys


def _places(sorted_keys: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Place of each key in some sorted keys, -1 where it is missing; looked up in order, which the cache likes."""
    out = np.full(len(keys), -1, np.int32)
    for a in range(0, len(keys) if len(sorted_keys) else 0, AT_ONCE):
        part = keys[a : a + AT_ONCE]
        by = np.argsort(part)
        part = part[by]
        place = np.searchsorted(sorted_keys, part)
        place[place == len(sorted_keys)] = 0
        out[a : a + AT_ONCE][by] = np.where(sorted_keys[place] == part, place, -1)
    return out


def _chunk_schema(doc_id) -> StructType:
    many = [("row", LongType()), ("id", doc_id), ("held", BooleanType()), ("before", LongType()), ("size", LongType())]
    schema = StructType().add("chunk", LongType()).add("trained", LongType()).add("tokens", BinaryType()).add("words", ArrayType(BinaryType()))
    for name, kind in many:
        schema = schema.add(name, ArrayType(kind))
    return schema


def chunks(documents: DataFrame, order: int) -> DataFrame:
    """Texts as chunks of numbered words.

    A chunk has its words sorted by hash, the tokens as numbers of words, and a list entry for each
    piece of a text: its text's row number, id and fold, how many tokens before the piece are repeated
    in front of it (``before``, they are read but not counted) and how many it has beside them.
    """
    schema = _chunk_schema(documents.schema["id"].dataType)
    names = schema.names

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, row, number, held, size = TaskContext.get().partitionId() << 36, 0, 0, [], 0
        known, pack = _Numbers(), zstandard.ZstdCompressor(level=1)

        def closed(id_kind: pa.DataType) -> pa.RecordBatch:
            words = list(known)
            h = hashes(words)
            by = np.argsort(h)
            place = np.empty(len(words), np.int32)
            place[by] = np.arange(len(words), dtype=np.int32)
            tokens = place[np.concatenate([p[5] for p in held])]
            rows, ids, folds, before, sizes = (list(c) for c in list(zip(*held))[:5])
            trained = sum(n for n, f in zip(sizes, folds) if not f)
            lists = [pa.array([c], pa.list_(k)) for c, k in zip((rows, ids, folds, before, sizes), (pa.int64(), id_kind, pa.bool_(), pa.int64(), pa.int64()))]
            return pa.RecordBatch.from_arrays(
                [pa.array([part + number], pa.int64()), pa.array([trained], pa.int64()), pa.array([pack.compress(planes(tokens))], pa.binary()),
                 pa.array([[words[i] for i in by.tolist()]], pa.list_(pa.binary())), *lists],
                names=names,
            )

        for batch in batches:
            id_kind = batch.schema.field(0).type
            for doc, fold, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                data = text.as_buffer().to_pybytes() if text.is_valid else b""
                carried, lists = [], words_of(data)
                words = next(lists)
                while words is not None:
                    after = next(lists, None)
                    context = np.fromiter(map(known.__getitem__, carried), np.int32)
                    own = np.fromiter(map(known.__getitem__, words if after is not None else [*words, END]), np.int32)
                    held.append((part + row, doc, fold, len(context), len(own), np.concatenate([context, own])))
                    size += min(len(data), PIECE) + 64
                    carried = [*carried, *words][-order + 1 :] if order > 1 else []
                    if size >= CHUNK:
                        yield closed(id_kind)
                        number, held, size = number + 1, [], 0
                        known.clear()
                    words = after
                row += 1
        if held:
            yield closed(id_kind)

    return documents.select("id", "held", "text").mapInArrow(dealt, schema)


class Chunk:
    """A chunk unpacked: words and their hashes, tokens, and the keys of the n-grams that end at each token."""

    def __init__(self, words: list[bytes], packed: bytes, before, sizes, held, order: int):
        self.words, self.h = words, hashes(words)
        self.tokens = from_planes(zstandard.ZstdDecompressor().decompress(packed), np.int32)
        self.before, self.sizes = np.asarray(before, np.int64), np.asarray(sizes, np.int64)
        whole = self.before + self.sizes
        self.first = np.cumsum(whole) - whole  # of each piece, where its repeated tokens begin
        since = np.arange(len(self.tokens), dtype=np.int32) - np.repeat(self.first.astype(np.int32), whole)
        self.own = since >= np.repeat(self.before.astype(np.int32), whole)
        self.train = self.own & ~np.repeat(np.asarray(held, bool), whole)
        self.since = since
        self.keys = [self.h[self.tokens]]  # keys[k - 1][i]: of the k tokens up to i; of no use where since < k - 1
        for _ in range(order - 1):
            with np.errstate(over="ignore"):
                longer = self.keys[0].copy()
                for a in range(len(longer) - 1, 0, -AT_ONCE):
                    b = max(1, a + 1 - AT_ONCE)
                    longer[b : a + 1] += self.keys[-1][b - 1 : a] * WORD_MIX
                for a in range(0, len(longer), AT_ONCE):
                    longer[a : a + AT_ONCE] = mixed(longer[a : a + AT_ONCE])
                self.keys.append(longer)

    def grams(self) -> np.ndarray:
        """Sorted distinct keys of all n-grams of two words and more."""
        found = [k[self.since >= n] for n, k in enumerate(self.keys) if n]
        return _distinct(np.concatenate(found)) if found else np.zeros(0, np.uint64)

    def trained(self, grams: np.ndarray) -> np.ndarray:
        """How often each n-gram ends at a training token here."""
        found = [k[self.train & (self.since >= n)] for n, k in enumerate(self.keys) if n]
        out = np.zeros(len(grams), np.int64)
        if found:
            keys = np.sort(np.concatenate(found))
            first = np.flatnonzero(np.concatenate([np.full(min(1, len(keys)), True), keys[1:] != keys[:-1]]))
            out[np.searchsorted(grams, keys[first])] = np.diff(first, append=len(keys))
        return out


def _limits(sorted_keys: np.ndarray, bits: int) -> np.ndarray:
    """Where each bucket begins in sorted keys, and the end."""
    return np.searchsorted(sorted_keys >> np.uint64(64 - bits), np.arange((1 << bits) + 1)) if bits else np.array([0, len(sorted_keys)])


SENT = "bucket int, chunk long, grams binary, gram_counts binary, words array<binary>, word_counts binary"
GOT = "chunk long, bucket int, gram_counts binary, word_counts binary, words long"


def counted(table: DataFrame, order: int, bits: int) -> DataFrame:
    """For each chunk and bucket: the counts over all training texts of the n-grams and words it asked for, in its order.

    The row of each bucket with a null chunk has the number of its words that occur in training texts.
    """

    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                number, _, packed, words, _, _, held, before, sizes = (c[r].as_py() for c in batch.columns)
                c = Chunk(words, packed, before, sizes, held, order)
                grams = c.grams()
                n, m = c.trained(grams), np.bincount(c.tokens[c.train], minlength=len(words))
                a, b = _limits(grams, bits).tolist(), _limits(c.h, bits).tolist()
                rows = []
                for k in range(1 << bits):
                    if a[k + 1] > a[k] or b[k + 1] > b[k]:
                        part, w = slice(a[k], a[k + 1]), slice(b[k], b[k + 1])
                        rows.append((k, number, planes(np.diff(grams[part], prepend=np.uint64(0))), planes(n[part]), words[w], planes(m[w])))
                kinds = (pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.binary()), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), kinds)], names=["bucket", "chunk", "grams", "gram_counts", "words", "word_counts"])

    def summed(key, group):
        sent = [np.cumsum(from_planes(x, np.uint64), dtype=np.uint64) for x in group.column("grams").to_pylist()]
        n = [from_planes(x, np.int64) for x in group.column("gram_counts").to_pylist()]
        _, place = np.unique(np.concatenate(sent), return_inverse=True)
        total = np.zeros(int(place.max(initial=-1)) + 1, np.int64)
        np.add.at(total, place, np.concatenate(n))
        back, at = [], 0
        for x in sent:
            back.append(planes(total[place[at : at + len(x)]]))
            at += len(x)
        words, m = group.column("words").to_pylist(), [from_planes(x, np.int64) for x in group.column("word_counts").to_pylist()]
        known = _Numbers()
        places = [np.fromiter(map(known.__getitem__, w), np.int64, len(w)) for w in words]
        total = np.zeros(len(known), np.int64)
        for p, x in zip(places, m):
            total[p] += x
        wrote = [planes(total[p]) for p in places]
        bucket = key[0].as_py()
        rows = [(c, bucket, g, w, 0) for c, g, w in zip(group.column("chunk").to_pylist(), back, wrote)]
        rows.append((None, bucket, b"", b"", int((total > 0).sum())))
        kinds = (pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.int64())
        return pa.table([pa.array(x, t) for x, t in zip(zip(*rows), kinds)], names=["chunk", "bucket", "gram_counts", "word_counts", "words"])

    return table.mapInArrow(asked, SENT).groupBy("bucket").applyInArrow(summed, GOT)


class Automaton:
    """The part of the back-off automaton that a chunk's texts can reach.

    Nodes are the chunk's words and n-grams. Those seen in training and shorter than the order are
    states; state -1 is the empty history.
    """

    def __init__(self, c: Chunk, grams: np.ndarray, word_counts: np.ndarray, gram_counts: np.ndarray, n: int, v: int, strength: float):
        order, width = len(c.keys), len(c.words)
        count = np.concatenate([word_counts, gram_counts]).astype(np.float64)
        share = np.zeros(len(count))
        share[:width] = (word_counts + 1.0) / (n + v + 1)
        shorter = np.full(len(count), -1, np.int32)  # the same words without the first
        state, arcs, into, weights = np.full(len(count), False), [], [], []
        end = c.words.index(END) if END in c.words else -1
        state[:width] = (word_counts > 0) & (np.arange(width) != end) & (order > 1)
        nodes = c.tokens
        for k in range(1, order):
            found = np.full(len(nodes), -1, np.int32)
            one = np.full(len(count), -1, np.int32)
            for a in range(0, len(nodes), AT_ONCE):
                at = np.flatnonzero(c.since[a : a + AT_ONCE] >= k) + a
                place = _places(grams, c.keys[k][at]) + np.int32(width)
                found[at] = place
                one[place] = at  # a position of each n-gram of this length
            gram = np.flatnonzero(one >= 0).astype(np.int32)
            at = one[gram]
            del one
            shorter[gram], history = nodes[at], nodes[at - 1]
            share[gram] = (count[gram] + strength * share[nodes[at]]) / (count[history] + strength)
            seen = count[gram] > 0
            gram, at, history = gram[seen], at[seen], history[seen]
            arcs.append(history.astype(np.int64) * width + c.tokens[at])
            into.append(gram if k < order - 1 else shorter[gram])
            weights.append(np.log10(share[gram]))
            state[gram] = (k < order - 1) & (c.tokens[at] != end)
            nodes = found
            del gram, at, history, seen
        self.width = width
        self.root = np.log10(share[:width])
        self.after_root = np.where(state[:width], np.arange(width), -1)
        self.shorter, self.back_off = shorter, np.log10(strength / (count + strength))
        del share, count, nodes
        arcs, into, weights = (x[0] if len(x) == 1 else np.concatenate([*x, np.zeros(0, t)]) for x, t in ((arcs, np.int64), (into, np.int32), (weights, np.float64)))
        by = np.argsort(arcs)
        self.arcs, self.weights = arcs[by], weights[by]
        del arcs, weights
        self.into = np.where(state[into], into, np.int32(-1))[by]

    def read(self, states: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """From each state read one word: the next state and the weight of the arcs taken."""
        states, total = states.copy(), np.zeros(len(states))
        left = np.arange(len(states))
        while len(left):
            rooted = states[left] < 0
            at_root = left[rooted]
            total[at_root] += self.root[words[at_root]]
            states[at_root] = self.after_root[words[at_root]]
            left = left[~rooted]
            if not len(left):
                break
            place = _places(self.arcs, states[left].astype(np.int64) * self.width + words[left])
            hit = place >= 0
            total[left[hit]] += self.weights[place[hit]]
            states[left[hit]] = self.into[place[hit]]
            left = left[~hit]
            total[left] += self.back_off[states[left]]
            states[left] = self.shorter[states[left]]
        return states, total

    def log10(self, c: Chunk) -> np.ndarray:
        """Weight of the arcs taken at each token.

        Readers start every ``STRIDE`` tokens, a history's length ahead: reading that many words from
        the empty history leads to the state that one reader from the start of the piece would be in.
        """
        whole = c.before + c.sizes
        reach = len(c.keys) - 1
        count = -(-whole // STRIDE)
        start = np.repeat(c.first, count) + (np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)) * STRIDE
        stop = np.minimum(start + STRIDE, np.repeat(c.first + whole, count))
        at = np.maximum(start - reach, np.repeat(c.first, count))
        out, states = np.zeros(len(c.tokens)), np.full(len(start), -1, np.int64)
        while len(at):
            states, weight = self.read(states, c.tokens[at])
            counts = at >= start
            out[at[counts]] = weight[counts]
            at = at + 1
            on = at < stop
            at, start, stop, states = at[on], start[on], stop[on], states[on]
        return out


def score_chunk(c: Chunk, word_counts: np.ndarray, gram_counts: np.ndarray, n: int, v: int, strength: float):
    """Of each piece: tokens, known tokens, the base score and the model's score."""
    model = Automaton(c, c.grams(), word_counts, gram_counts, n, v, strength)
    c.keys = [None] * len(c.keys)  # only their number counts from here
    weights = model.log10(c)
    del model
    base, known = np.log10((word_counts + 1.0) / (n + v + 1)), word_counts > 0
    # a piece at a time: short sums lose less than differences of long ones
    limits = c.first + c.before
    parts = [slice(a, a + s) for a, s in zip(limits.tolist(), c.sizes.tolist())]
    n_known = np.array([np.count_nonzero(known[c.tokens[p]]) for p in parts], np.int64)
    return c.sizes, n_known, np.array([base[c.tokens[p]].sum() for p in parts]), np.array([weights[p].sum() for p in parts])


def score_documents(
    documents: DataFrame, doc_id: str = "doc_id", text: str = "text", order: int = ORDER, strength: float = STRENGTH, folds: int = FOLDS, held_out: int = HELD_OUT,
    bucket_keys: int = BUCKET_KEYS,
) -> DataFrame:
    """Per document row: id, ``held_out``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score`` and ``score`` (log10).

    Learns from the rows whose id's crc32 does not leave ``held_out`` modulo ``folds``; null ids are
    learnt from. A null text is an empty one, which has the end token alone. Repeated rows are learnt
    and returned as often as they came. Without anything to learn from every token has probability 1.
    Pieces of a text of over 4 MB are read in different chunks and added up. An empty table gives no
    rows; no other column is read.
    """
    spark = documents.sparkSession
    docs = documents.select(F.col(doc_id).alias("id"), in_fold(doc_id, folds, held_out).alias("held"), F.col(text).alias("text"))
    path = scratch_path(spark, "lm-chunks")
    chunks(docs, order).write.parquet(path)
    table = spark.read.schema(_chunk_schema(docs.schema["id"].dataType)).parquet(path)
    sizes = table.agg(F.sum("trained").alias("n"), F.sum(F.aggregate("size", F.lit(0).cast("long"), lambda a, x: a + x)).alias("all")).first()
    n, bits = sizes.n or 0, max(0, int(-(-(sizes["all"] or 0) * max(1, order - 1) // bucket_keys) - 1).bit_length())
    back = scratch_path(spark, "lm-counts")
    counted(table, order, bits).write.parquet(back)
    found = spark.read.schema(GOT).parquet(back)
    v = found.where("chunk IS NULL").agg(F.sum("words")).first()[0] or 0
    return _scored(table, found.where("chunk IS NOT NULL"), docs, doc_id, order, strength, n, v)


def _scored(table: DataFrame, found: DataFrame, docs: DataFrame, doc_id: str, order: int, strength: float, n: int, v: int) -> DataFrame:
    shape = StructType().add("row", LongType()).add("id", docs.schema["id"].dataType).add("held", BooleanType())
    for name in ("n_tokens", "n_known"):
        shape = shape.add(name, LongType())
    shape = shape.add("base_score", DoubleType()).add("score", DoubleType())

    def scored(key, texts, got):
        got = got.sort_by("bucket")
        both = [np.concatenate([from_planes(x, np.int64) for x in got.column(c).to_pylist()]) for c in ("word_counts", "gram_counts")]
        packed, words, before, sizes, held = (texts.column(c)[0].as_py() for c in ("tokens", "words", "before", "size", "held"))
        out = score_chunk(Chunk(words, packed, before, sizes, held, order), *both, n, v, strength)
        lists = [texts.column(c).combine_chunks().flatten() for c in ("row", "id", "held")]
        return pa.table([*lists, *(pa.array(x) for x in out)], names=shape.names)

    pieces = table.groupBy("chunk").cogroup(found.groupBy("chunk")).applyInArrow(scored, shape)
    sums = [F.sum(c).alias(c) for c in ("n_tokens", "n_known", "base_score", "score")]
    whole = pieces.groupBy("row").agg(F.first("id").alias(doc_id), F.first("held").alias("held_out"), *sums)
    return whole.select(doc_id, "held_out", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score")
