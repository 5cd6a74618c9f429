"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes log-count ratios."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from tablewright.llm.common import WORD_MIX, Adam, in_fold, sample_texts, sigmoid
from tablewright.session import checkpointed

GRAMS = (3, 4, 5, 6)
BITS = 18
PER_CLASS = 2000
COUNTERS = 8  # tasks that count the n-grams of the sample
MOST_FEATURES = 65_536
LEAST_TEXTS = 5
LEAST_SURE = 6.6  # chi-squared with one degree of freedom at 0.01
FOLDS = 5
BLOCK = 1 << 19
EPOCHS = 12


@dataclass(frozen=True)
class Model:
    """Weight of each hashed n-gram (log-count ratio times learnt weight), which are chosen, the intercept."""

    weights: np.ndarray
    chosen: np.ndarray
    intercept: float

    def margin(self, codes: np.ndarray) -> float:
        """The distinct n-grams of a text as a vector of length one, weighed."""
        length = np.sqrt(max(1, np.count_nonzero(self.chosen[codes])))
        return float(self.weights[codes].sum(dtype=np.float64) / length) + self.intercept


def gram_codes(text: str) -> Iterator[np.ndarray]:
    """Hashed n-grams of the lowered text, block after block; blocks overlap so that no n-gram is lost."""
    points = np.frombuffer((" " + text.lower() + " ").encode("utf-32-le", "surrogatepass"), np.uint32)
    lap = max(GRAMS) - 1
    for at in range(0, max(1, len(points) - lap), BLOCK):
        part = points[at : at + BLOCK + lap].astype(np.uint64) * WORD_MIX
        out, grown = [], part >> np.uint64(17)
        for n in range(2, max(GRAMS) + 1):
            if len(part) < n:
                break
            grown = (grown[:-1] * np.uint64(0x9E3779B1)) ^ part[n - 1 :] >> np.uint64(17)
            if n in GRAMS:
                out.append(((grown + np.uint64(n)) * WORD_MIX) >> np.uint64(64 - BITS))
        if out:
            yield np.concatenate(out).astype(np.int64)


class Distinct:
    """The distinct n-grams of texts, found without sorting by who wrote last to a slot."""

    def __init__(self):
        self.slot = np.zeros(1 << BITS, np.int64)
        self.at = 1

    def of(self, text: str) -> np.ndarray:
        first, kept = self.at, []
        for codes in gram_codes(text):
            new = codes[self.slot[codes] < first]
            mark = np.arange(self.at, self.at + len(new))
            self.slot[new] = mark
            kept.append(new[self.slot[new] == mark])
            self.at += len(new)
        self.at += 1
        return np.concatenate(kept) if kept else np.zeros(0, np.int64)


@F.arrow_udf(BinaryType())
def _features(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    distinct = Distinct()
    for texts in batches:
        yield pa.array([distinct.of(t.as_py() or "").astype("<u4").tobytes() for t in texts], pa.binary())


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """In how many of a task's texts of either class each n-gram stands."""
    counts = np.zeros((2, 1 << BITS), np.uint32)
    texts = np.zeros(2, np.int64)
    for batch in batches:
        for label, codes in zip(batch.column(0).to_pylist(), batch.column(1)):
            counts[label, np.frombuffer(codes.as_py(), "<u4")] += 1
            texts[label] += 1
    yield pa.RecordBatch.from_pydict({"texts": [texts.tobytes()], "counts": [counts.tobytes()]})


def _places(place: np.ndarray):
    """UDF: the chosen n-grams of a text by their place among the chosen."""

    @F.arrow_udf("binary")
    def chosen(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in batches:
            at = (place[np.frombuffer(c.as_py(), "<u4")] for c in column)
            yield pa.array([x[x >= 0].astype("<u4").tobytes() for x in at], pa.binary())

    return chosen


def log_count_ratios(counts: np.ndarray, texts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams that tell the classes apart, and their log-count ratios.

    The ratio is that of the smoothed shares of either class's texts that hold the n-gram. Chosen
    are the n-grams whose independence of the class a chi-squared test rejects, the surest first.
    """
    share = np.log((counts + 0.5) / (texts[:, None] + 1))
    ratio = share[1] - share[0]
    (b, a), (no, yes) = counts, texts
    product = (a + b) * (no + yes - a - b) * no * yes
    sure = (no + yes) * (a * (no - b) - b * (yes - a)) ** 2 / np.maximum(product, 1)
    sure[counts.sum(axis=0) < LEAST_TEXTS] = 0
    used = np.argsort(-sure, kind="stable")[:MOST_FEATURES]
    used = np.sort(used[sure[used] > LEAST_SURE])
    return used, ratio[used]


def train(documents: DataFrame, labels: DataFrame, label: str = "toxic", doc_id: str = "doc_id", text: str = "text", per_class: int = PER_CLASS) -> Model:
    """Fit on at most ``per_class`` labelled documents of each class (a bound, see ``sample_texts``).

    Tasks make the features; ``COUNTERS`` tasks at most count them, however many parts the sample has, and to
    the driver come their counts (2 MB each) and then, for each sampled document, which of the chosen
    n-grams it holds. Without both classes the
    model is an intercept: the smoothed share of label 1.
    """
    chosen = sample_texts(documents, labels, label, per_class, doc_id, text)
    is_one = (F.col("label") > 0).cast("int").alias("label")
    sample = checkpointed(chosen.select("id", is_one, _features("text").alias("codes")))
    counts, texts = np.zeros((2, 1 << BITS)), np.zeros(2)
    for part in sample.select("label", "codes").coalesce(COUNTERS).mapInArrow(_counts, "texts binary, counts binary").toLocalIterator():
        counts += np.frombuffer(part.counts, np.uint32).reshape(2, -1)
        texts += np.frombuffer(part.texts, np.int64)
    if not texts.all():
        return Model(np.zeros(1 << BITS, np.float32), np.zeros(1 << BITS, bool), float(np.log((texts[1] + 1) / (texts[0] + 1))))
    used, ratio = log_count_ratios(counts, texts)
    place = np.full(1 << BITS, -1, np.int32)
    place[used] = np.arange(len(used))
    rows = sample.select("id", "label", _places(place)("codes").alias("at")).toArrow().sort_by("id")
    return fit([np.frombuffer(a.as_py(), "<u4") for a in rows["at"]], rows["label"].to_numpy().astype(float), used, ratio)


def fit(sets: list[np.ndarray], y: np.ndarray, used: np.ndarray, ratio: np.ndarray) -> Model:
    """Logistic regression over log-count ratios; classes weigh the same, as the sample is cut by class."""
    weights, intercept, positives = np.zeros(len(used)), np.zeros(1), y.sum()
    balance = np.where(y > 0, len(y) / (2 * positives), len(y) / (2 * (len(y) - positives)))
    values = [ratio[s] / np.sqrt(max(1, len(s))) for s in sets]
    adam, order = Adam([weights, intercept], 0.01), np.random.default_rng(7)
    for _ in range(EPOCHS):
        for batch in np.array_split(order.permutation(len(y)), max(1, len(y) // 64)):
            gradient, slope = 1e-4 * weights, np.zeros(1)
            for i in batch:
                own = values[i]
                error = balance[i] * (sigmoid(weights[sets[i]] @ own + intercept[0]) - y[i]) / len(batch)
                gradient[sets[i]] += error * own
                slope += error
            adam.step([weights, intercept], [gradient, slope])
    table = np.zeros(1 << BITS, np.float32)
    table[used] = weights * ratio
    chosen = np.zeros(1 << BITS, bool)
    chosen[used] = True
    return Model(table, chosen, float(intercept[0]))


def score(text: Column, model: Model) -> Column:
    """Probability of toxicity of a whole text; null and empty texts score as the blank alone does."""

    @F.arrow_udf("double")
    def scored(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        distinct = Distinct()
        for texts in batches:
            margins = [model.margin(distinct.of(t.as_py() or "")) for t in texts]
            yield pa.array(sigmoid(np.array(margins, np.float64)), pa.float64())

    return scored(text)


def classify(documents: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", per_class: int = PER_CLASS) -> DataFrame:
    """Per document row: id, ``held_out``, ``score`` and ``predicted`` (1 from 0.5 up).

    Learns from labels whose id's crc32 leaves no 0 modulo 5; the score sees the text alone. Repeated
    rows come back as often as they came, null ids are not held out, no other column is read, an
    empty table gives no rows.
    """
    model = train(documents, labels.where(~in_fold(doc_id, FOLDS, 0)), label, doc_id, text, per_class)
    scored = documents.select(doc_id, in_fold(doc_id, FOLDS, 0).alias("held_out"), score(F.col(text), model).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
