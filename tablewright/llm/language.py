"""Language identification by a convolutional network over bytes, trained in numpy."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from tablewright.llm.common import Adam, in_fold, sample_texts

WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 16
PER_LANGUAGE = 500
WINDOWS_PER_TEXT = 6
FOLDS = 4
EPOCHS = 8
BATCH = 64
UNDETERMINED = "und"
LETTER = regex.compile(r"\p{L}")


@dataclass(frozen=True)
class Model:
    """A table of filter values by byte for each place of each filter width, biases, a dense layer."""

    languages: tuple[str, ...]
    tables: tuple[np.ndarray, ...]  # one (width, 256, FILTERS) for each width
    bias: np.ndarray
    dense: np.ndarray
    offset: np.ndarray


def windows_of(text: str) -> np.ndarray:
    """All windows of a text's lowered UTF-8 bytes, the last one padded by zeros."""
    data = text.lower().encode("utf-8", "surrogatepass")
    count = -(-len(data) // WINDOW)
    return np.frombuffer(data.ljust(count * WINDOW, b"\0"), np.uint8).reshape(count, WINDOW)


def pooled(windows: np.ndarray, tables: tuple[np.ndarray, ...], places: bool = False):
    """Largest value of each filter over a window, and with ``places`` where it was.

    A filter over one-hot bytes is a sum of table rows, so the convolution is a gather and a sum.
    """
    out, where = [], []
    for table in tables:
        width = len(table)
        span = WINDOW - width + 1
        total = np.take(table[0], windows[:, :span], axis=0)
        for k in range(1, width):
            total += np.take(table[k], windows[:, k : k + span], axis=0)
        if places:
            where.append(total.argmax(axis=1))
        out.append(total.max(axis=1))
    return (np.concatenate(out, axis=1), where) if places else np.concatenate(out, axis=1)


def log_softmax(z: np.ndarray) -> np.ndarray:
    z = z - z.max(axis=1, keepdims=True)
    return z - np.log(np.exp(z).sum(axis=1, keepdims=True))


def fit(windows: np.ndarray, y: np.ndarray, languages: tuple[str, ...]) -> Model:
    """Train filters, biases and dense layer on labelled windows; the largest place alone gets a filter's gradient."""
    random = np.random.default_rng(11)
    tables = [random.normal(0, 0.3, (w, 256, FILTERS)).astype(np.float32) for w in WIDTHS]
    bias = np.zeros(FILTERS * len(WIDTHS), np.float32)
    dense = random.normal(0, 0.2, (len(bias), len(languages))).astype(np.float32)
    offset = np.zeros(len(languages), np.float32)
    parameters = [*tables, bias, dense, offset]
    adam = Adam(parameters, 0.01)
    share = np.bincount(y, minlength=len(languages))
    weight = (len(y) / (np.maximum(share, 1) * len(languages)))[y].astype(np.float32)
    for _ in range(EPOCHS):
        for rows in np.array_split(random.permutation(len(y)), max(1, len(y) // BATCH)):
            top, where = pooled(windows[rows], tables, places=True)
            hidden = np.maximum(top + bias, 0)
            error = np.exp(log_softmax(hidden @ dense + offset))
            error[np.arange(len(rows)), y[rows]] -= 1
            error *= weight[rows, None] / len(rows)
            back = (error @ dense.T) * (hidden > 0)
            steps = []
            for i, table in enumerate(tables):
                slope = np.zeros_like(table)
                part = back[:, i * FILTERS : (i + 1) * FILTERS]
                filters = np.broadcast_to(np.arange(FILTERS), part.shape)
                for k in range(len(table)):
                    np.add.at(slope[k], (windows[rows[:, None], where[i] + k], filters), part)
                steps.append(slope)
            adam.step(parameters, [*steps, back.sum(0), hidden.T @ error, error.sum(0)])
    return Model(languages, tuple(tables), bias, dense, offset)


@F.arrow_udf(BinaryType())
def _evenly_chosen(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for texts in batches:
        out = []
        for t in texts:
            w = windows_of(t.as_py() or "")
            at = np.unique(np.linspace(0, len(w) - 1, min(len(w), WINDOWS_PER_TEXT)).astype(int)) if len(w) else []
            out.append(w[at].tobytes() if len(w) else b"")
        yield pa.array(out, pa.binary())


def train(documents: DataFrame, learnable: Column, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", per_language: int = PER_LANGUAGE) -> Model | None:
    """Fit on at most ``per_language`` documents of each language, up to six windows of each (both are bounds).

    None where no row may be learnt from.
    """
    labelled = documents.where(learnable).select(doc_id, lang)
    chosen = sample_texts(documents, labelled, lang, per_language, doc_id, text)
    rows = sorted(chosen.select("id", "label", _evenly_chosen("text").alias("windows")).collect(), key=lambda r: r.id)
    languages = tuple(sorted({r.label for r in rows}))
    if not languages:
        return None
    number = {c: i for i, c in enumerate(languages)}
    data = np.frombuffer(b"".join(r.windows for r in rows), np.uint8).reshape(-1, WINDOW)
    y = np.repeat([number[r.label] for r in rows], [len(r.windows) // WINDOW for r in rows])
    return fit(data, y.astype(np.int64), languages)


def probabilities(text: str, model: Model) -> np.ndarray:
    """Mean probability over all windows, each weighed by its bytes: passages of another language count by their length."""
    w = windows_of(text)
    total = np.zeros(len(model.languages))
    for at in range(0, len(w), BATCH):
        part = w[at : at + BATCH]
        logs = log_softmax(np.maximum(pooled(part, model.tables) + model.bias, 0) @ model.dense + model.offset)
        total += np.exp(logs.astype(np.float64)).T @ (part > 0).sum(axis=1)
    return total / total.sum() if total.any() else np.full(len(total), 1 / len(total))


def identify(text: Column, model: Model | None) -> Column:
    """Struct of ``lang_pred`` and ``score``. Null texts and texts without a letter: ``und`` and 0."""

    @F.arrow_udf("lang_pred string, score double")
    def predict(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            names, scores = [], []
            for t in texts:
                t = t.as_py() or ""
                p = probabilities(t, model) if model and LETTER.search(t) else None
                names.append(UNDETERMINED if p is None else model.languages[int(p.argmax())])
                scores.append(0.0 if p is None else float(p.max()))
            yield pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["lang_pred", "score"])

    return predict(text)


def identify_documents(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", per_language: int = PER_LANGUAGE) -> DataFrame:
    """Per document row: id, ``held_out``, ``lang_pred`` and ``score``.

    Learns from non-null languages of ids whose crc32 modulo 4 is not 2; predictions see the text
    alone. Repeated rows come back as often as they came, null ids are not held out and not learnt
    from, other columns are not read, an empty table gives no rows.
    """
    held_out = in_fold(doc_id, FOLDS, 2)
    model = train(documents, ~held_out, doc_id, text, lang, per_language)
    found = documents.select(doc_id, held_out.alias("held_out"), identify(F.col(text), model).alias("found"))
    return found.select(doc_id, "held_out", "found.lang_pred", "found.score")
