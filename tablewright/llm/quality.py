"""Quality: attention-based multiple-instance learning over the passages of a document."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from tablewright.llm.common import Adam, in_fold, portions, sample_texts, sigmoid, text_bytes

PASSAGE = 512
TRIGRAMS, REPEATS = 256, 4096
FEATURES = 256 + TRIGRAMS + 2
HIDDEN, ATTENTION = 32, 16
PER_CLASS = 1200
PASSAGES_PER_TEXT = 24
FOLDS = 5
EPOCHS = 20
KEEP_FROM = 0.3
PORTION, TEXTS = 1 << 18, 512  # bytes and texts whose passages are held at once


@dataclass(frozen=True)
class Model:
    """Centre and scale of the features; encoder; gated attention (V, U, w); classifier."""

    centre: np.ndarray
    scale: np.ndarray
    encode: np.ndarray
    encode_bias: np.ndarray
    v: np.ndarray
    u: np.ndarray
    w: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray


def passages(data: np.ndarray, limits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Feature rows of all passages of some texts, and the number of passages of each text.

    A passage is up to 512 bytes; an empty text has one empty passage. Features: shares of bytes and
    of hashed three-byte runs (as roots), the share of distinct runs, and the length. Callers hand over
    a portion at a time: a passage takes about 10 kB here.
    """
    lengths = np.diff(limits)
    counts = np.maximum(1, -(-lengths // PASSAGE))
    first = np.concatenate([[0], np.cumsum(counts)])
    total = int(first[-1])
    owner = np.repeat(first[:-1], lengths) + (np.arange(len(data)) - np.repeat(limits[:-1], lengths)) // PASSAGE
    size = np.bincount(owner, minlength=total).astype(np.float32)
    rows = np.zeros((total, FEATURES), np.float32)
    rows[:, :256] = np.bincount(owner * 256 + data, minlength=total * 256).reshape(total, 256)
    if len(data) > 2:
        wide = data.astype(np.uint32)
        code = ((wide[:-2] << 16 | wide[1:-1] << 8 | wide[2:]) * np.uint32(0x9E3779B1)) >> np.uint32(20)
        inside = owner[:-2] == owner[2:]
        code, place = code[inside].astype(np.int64), owner[:-2][inside]
        rows[:, 256 : 256 + TRIGRAMS] = np.bincount(place * TRIGRAMS + (code >> 4), minlength=total * TRIGRAMS).reshape(total, TRIGRAMS)
        seen = np.zeros(total * REPEATS, bool)
        seen[place * REPEATS + code] = True
        rows[:, -2] = seen.reshape(total, REPEATS).sum(axis=1)
    per = np.maximum(size, 1)[:, None]
    rows[:, : 256 + TRIGRAMS] = np.sqrt(rows[:, : 256 + TRIGRAMS] / per)
    rows[:, -2] /= per[:, 0]
    rows[:, -1] = size / PASSAGE
    return rows, counts


def _forward(x: np.ndarray, starts: np.ndarray, m: Model):
    """Scores of bags of passages, with what the gradient needs."""
    h = np.tanh(x @ m.encode + m.encode_bias)
    t, g = np.tanh(h @ m.v), sigmoid(h @ m.u)
    e = (t * g) @ m.w
    sizes = np.diff(np.append(starts, len(x)))
    e = np.exp(e - np.repeat(np.maximum.reduceat(e, starts), sizes))
    a = e / np.repeat(np.add.reduceat(e, starts), sizes)
    z = np.add.reduceat(a[:, None] * h, starts, axis=0)
    return sigmoid(z @ m.out + m.out_bias[0]), h, t, g, a, z, sizes


def fit(x: np.ndarray, counts: np.ndarray, y: np.ndarray) -> Model:
    """Learn encoder, attention and classifier from document labels alone."""
    random = np.random.default_rng(5)
    centre, scale = x.mean(axis=0), x.std(axis=0) + 0.01
    x = (x - centre) / scale

    def draw(*shape):
        return random.normal(0, 1 / np.sqrt(shape[0]), shape).astype(np.float32)

    m = Model(
        centre, scale, draw(FEATURES, HIDDEN), np.zeros(HIDDEN, np.float32), draw(HIDDEN, ATTENTION), draw(HIDDEN, ATTENTION),
        draw(ATTENTION), draw(HIDDEN), np.zeros(1, np.float32),
    )
    parameters = [m.encode, m.encode_bias, m.v, m.u, m.w, m.out, m.out_bias]
    adam = Adam(parameters, 0.003)
    first = np.concatenate([[0], np.cumsum(counts)])
    positives = y.sum()
    balance = np.where(y > 0, len(y) / (2 * positives), len(y) / (2 * (len(y) - positives))).astype(np.float32)
    for _ in range(EPOCHS):
        for bags in np.array_split(random.permutation(len(y)), max(1, len(y) // 32)):
            rows = np.concatenate([np.arange(first[b], first[b + 1]) for b in bags])
            starts = np.concatenate([[0], np.cumsum(counts[bags])[:-1]])
            part = x[rows]
            p, h, t, g, a, z, sizes = _forward(part, starts, m)
            error = (balance[bags] * (p - y[bags]) / len(bags)).astype(np.float32)
            of_row = np.repeat(error, sizes)
            value = of_row * (h @ m.out)
            mean = np.repeat(error * (z @ m.out), sizes)
            de = a * (value - mean)
            dt, dg = de[:, None] * m.w * g * (1 - t * t), de[:, None] * m.w * t * g * (1 - g)
            dh = (a * of_row)[:, None] * m.out + dt @ m.v.T + dg @ m.u.T
            dh *= 1 - h * h
            adam.step(parameters, [
                part.T @ dh + 1e-4 * m.encode, dh.sum(0), h.T @ dt, h.T @ dg, (t * g).T @ de, z.T @ error, np.array([error.sum()], np.float32),
            ])
    return m


@F.arrow_udf(BinaryType())
def _bag(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """Up to 24 evenly spaced passages of a text, for training only."""
    for texts in batches:
        data, limits = text_bytes(texts)
        out = []
        for a, b in zip(limits[:-1], limits[1:]):
            n = max(1, -(-(b - a) // PASSAGE))
            at = np.unique(np.linspace(0, n - 1, min(n, PASSAGES_PER_TEXT)).astype(int))
            parts = [data[a + i * PASSAGE : min(b, a + (i + 1) * PASSAGE)] for i in at]
            x, _ = passages(np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])]))
            out.append(x.astype(np.float16).tobytes())
        yield pa.array(out, pa.binary())


def train(documents: DataFrame, labels: DataFrame, label: str = "quality", doc_id: str = "doc_id", text: str = "text", per_class: int = PER_CLASS) -> Model | None:
    """Fit on at most ``per_class`` labelled documents of each class and 24 passages of each document.

    None where there are not both classes to learn from.
    """
    chosen = sample_texts(documents, labels, label, per_class, doc_id, text)
    rows = sorted(chosen.select("id", "label", _bag("text").alias("bag")).collect(), key=lambda r: r.id)
    y = np.array([r.label > 0 for r in rows], np.float32)
    if len(np.unique(y)) < 2:
        return None
    x = np.frombuffer(b"".join(r.bag for r in rows), np.float16).reshape(-1, FEATURES).astype(np.float32)
    return fit(x, np.array([len(r.bag) // (2 * FEATURES) for r in rows]), y)


def scores_of(texts: pa.Array, model: Model | None) -> np.ndarray:
    if model is None:
        return np.full(len(texts), 0.5)
    data, limits = text_bytes(texts)
    out = []
    for first, last in portions(limits, PORTION, TEXTS):
        out.append(_scores(data[limits[first] : limits[last]], limits[first : last + 1] - limits[first], model))
    return np.concatenate(out) if out else np.zeros(0)


def _scores(data: np.ndarray, limits: np.ndarray, m: Model) -> np.ndarray:
    if len(data) <= PORTION or len(limits) > 2:
        x, counts = passages(data, limits)
        return _forward((x - m.centre) / m.scale, np.concatenate([[0], np.cumsum(counts)[:-1]]), m)[0]
    # one long text: the attention sums over its passages are carried from part to part
    top, weight, sum_ = -np.inf, 0.0, np.zeros(HIDDEN)
    for at in range(0, len(data), PORTION // PASSAGE * PASSAGE):
        part = data[at : at + PORTION // PASSAGE * PASSAGE]
        x, _ = passages(part, np.array([0, len(part)]))
        h = np.tanh((x - m.centre) / m.scale @ m.encode + m.encode_bias)
        e = (np.tanh(h @ m.v) * sigmoid(h @ m.u)) @ m.w
        new = max(top, float(e.max()))
        old, e = np.exp(top - new), np.exp(e - new)
        weight, sum_, top = weight * old + e.sum(), sum_ * old + e @ h, new
    return sigmoid(np.array([sum_ / weight @ m.out + m.out_bias[0]]))


def score(text: Column, model: Model | None) -> Column:
    """Probability of good quality of a whole text; a null text scores as an empty one."""

    @F.arrow_udf("double")
    def scored(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.array(scores_of(texts, model).astype(np.float64), pa.float64())

    return scored(text)


def _trained(documents: DataFrame, labels: DataFrame, doc_id: str, text: str, label: str, per_class: int) -> Model | None:
    return train(documents, labels.where(~in_fold(doc_id, FOLDS, 0)), label, doc_id, text, per_class)


def classify(documents: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality", per_class: int = PER_CLASS) -> DataFrame:
    """Per document row: id, ``held_out``, ``score`` and ``predicted`` (1 from 0.3 up).

    Learns from labels whose id's crc32 leaves no 0 modulo 5; the score sees the text alone. Without
    both classes every score is 0.5. Repeated rows come back as often as they came, null ids are not
    held out, no other column is read, an empty table gives no rows.
    """
    model = _trained(documents, labels, doc_id, text, label, per_class)
    scored = documents.select(doc_id, in_fold(doc_id, FOLDS, 0).alias("held_out"), score(F.col(text), model).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= KEEP_FROM).cast("int"))


def keep_good(documents: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality", per_class: int = PER_CLASS) -> DataFrame:
    """The documents that the classifier does not reject, all columns.

    Null and empty texts are scored as one empty passage; repeated rows stay or go together; without
    both classes to learn from every document stays; an empty table gives an empty one.
    """
    model = _trained(documents, labels, doc_id, text, label, per_class)
    return documents.where(score(F.col(text), model) >= KEEP_FROM)
