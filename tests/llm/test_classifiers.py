import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pytest

from tablewright.llm import common, language, quality, toxicity

LABELS = "doc_id long, toxic int, quality int, text string"


def fold(doc_id, folds):
    return zlib.crc32(str(doc_id).encode()) % folds


def test_folds_follow_crc32(spark):
    df = spark.range(200).withColumnRenamed("id", "doc_id")
    got = {r.doc_id: r.h for r in df.select("doc_id", common.in_fold("doc_id", 5, 0).alias("h")).collect()}
    assert got == {i: fold(i, 5) == 0 for i in range(200)}


def test_sample_is_bounded_even_by_class_and_by_id(spark, table):
    docs = table([(i % 40, f"text {i}") for i in range(80)] + [(None, "x")])
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)] + [(None, 1), (3, None), (4, 1)], "doc_id long, toxic int")
    got = common.sample_texts(docs, labels, "toxic", 7, "doc_id", "text").collect()
    assert len({r.id for r in got}) == len(got) == 14
    assert sorted(r.label for r in got) == [0] * 7 + [1] * 7


def test_text_bytes_of_a_slice():
    column = pa.array(["ab", None, "é", "", "xyz"])[1:4]
    data, limits = common.text_bytes(column)
    assert data.tobytes().decode() == "é" and limits.tolist() == [0, 0, 2, 2]
    assert list(common.portions(np.array([0, 5, 6, 7, 30]), 6)) == [(0, 2), (2, 3), (3, 4)]


def test_distinct_grams_by_hand():
    def plain(text):
        text = f" {text.lower()} "
        codes = set()
        for n in toxicity.GRAMS:
            for i in range(len(text) - n + 1):
                codes.add(text[i : i + n])
        return codes

    once = toxicity.Distinct()
    for text in ("", "a", "Trash TRASH", "Ünï 漢字😀", "ab" * 40):
        assert len(once.of(text)) == len(set(once.of(text).tolist()))
        assert len(once.of(text)) <= len(plain(text)) and len(once.of(text)) >= 0.98 * len(plain(text))
    old = toxicity.BLOCK
    whole = sorted(once.of("quick brown fox " * 30))
    try:
        toxicity.BLOCK = 50
        assert sorted(once.of("quick brown fox " * 30)) == whole
    finally:
        toxicity.BLOCK = old


@pytest.fixture(scope="module")
def small(spark):
    return spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")


def held_out_accuracy(rows, labels, name, folds=5):
    truth = {r.doc_id: r[name] for r in labels.collect()}
    pairs = [(r.predicted, truth[r.doc_id]) for r in rows if r.held_out and r.doc_id in truth]
    assert all(r.held_out == (fold(r.doc_id, folds) == 0) for r in rows)
    return sum(p == t for p, t in pairs) / len(pairs)


def test_toxicity_on_held_out_labels(small):
    rows = toxicity.classify(*small).collect()
    assert len(rows) == 1000 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    assert held_out_accuracy(rows, small[1], "toxic") > 0.9


def test_quality_on_held_out_labels(small):
    rows = quality.classify(*small).collect()
    assert len(rows) == 1000 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    assert held_out_accuracy(rows, small[1], "quality") > 0.9


def test_language_on_held_out_texts(small):
    rows = language.identify_documents(small[0]).collect()
    truth = {r.doc_id: r.lang for r in small[0].select("doc_id", "lang").collect()}
    held = [r for r in rows if r.held_out]
    assert {r.doc_id for r in held} == {i for i in truth if fold(i, 4) == 2}
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) / len(held) > 0.95


def test_held_out_labels_do_not_count(small):
    documents, labels = small
    turned = labels.selectExpr("doc_id", "quality", f"CASE WHEN pmod(crc32(CAST(CAST(doc_id AS STRING) AS BINARY)), 5) = 0 THEN 1 - toxic ELSE toxic END AS toxic")
    some = documents.limit(50)
    a, b = (sorted(map(tuple, toxicity.classify(documents, t).join(some.select("doc_id"), "doc_id").collect())) for t in (labels, turned))
    assert a == b


def test_ratios_by_hand():
    counts = np.array([[5.0, 50, 0, 1], [40, 50, 20, 1]])
    used, ratio = toxicity.log_count_ratios(counts, np.array([100.0, 100]))
    assert used.tolist() == [0, 2]
    assert np.allclose(ratio, [np.log(40.5 / 101) - np.log(5.5 / 101), np.log(20.5 / 101) - np.log(0.5 / 101)])


def test_quality_of_one_long_text_is_carried_from_part_to_part(small):
    documents, labels = small
    model = quality.train(documents, labels)
    text = pa.array(["".join(r.text for r in documents.select("text").collect())])
    old = quality.PORTION
    whole = quality.scores_of(text, model)[0]
    try:
        quality.PORTION = 1 << 16
        assert abs(quality.scores_of(text, model)[0] - whole) < 1e-3
    finally:
        quality.PORTION = old


def test_odd_rows(spark, odd, table):
    labels = spark.createDataFrame([(i, i % 2, i % 2, "clash") for i in range(10)] + [(None, 1, 1, "")], LABELS)
    none = spark.createDataFrame([], LABELS)
    for classify in (toxicity.classify, quality.classify):
        for given in (labels, none):
            rows = classify(odd, given).collect()
            assert sorted((r.doc_id for r in rows), key=repr) == sorted([3, 1, 2, 5, 5, 4, None, 9, 7, 8], key=repr)
            assert all(0 <= r.score <= 1 and r.held_out is not None for r in rows)
        assert classify(table([]), labels).collect() == []
    kept = quality.keep_good(odd, labels)
    assert kept.columns == odd.columns
    found = {r.doc_id: r.lang_pred for r in language.identify_documents(odd).collect()}
    assert all(found[i] == "und" for i in (1, 2, 4, 8)) and found[9] == "en"
    assert language.identify_documents(table([])).collect() == []


def test_windows_are_the_whole_text():
    text = "Añb" * 300
    w = language.windows_of(text)
    assert w.tobytes().rstrip(b"\0").decode() == text.lower() and w.shape[1] == language.WINDOW
    assert len(language.windows_of("")) == 0


def test_convolution_by_hand():
    random = np.random.default_rng(3)
    tables = tuple(random.normal(size=(w, 256, language.FILTERS)).astype(np.float32) for w in language.WIDTHS)
    windows = random.integers(0, 256, (3, language.WINDOW)).astype(np.uint8)
    got, at = [], 0
    for t in tables:
        span = language.WINDOW - len(t) + 1
        got.append(np.array([[max(sum(t[k, w[p + k], f] for k in range(len(t))) for p in range(span)) for f in range(2)] for w in windows]))
    top = language.pooled(windows, tables)
    for i, g in enumerate(got):
        assert np.allclose(top[:, i * language.FILTERS : i * language.FILTERS + 2], g, atol=1e-5)


def plain_quality(text, m):
    """Score of one text by loops: features of each passage, gated attention, classifier."""
    parts = [text[i : i + quality.PASSAGE] for i in range(0, max(1, len(text)), quality.PASSAGE)]
    hidden, weights = [], []
    for part in parts:
        x = np.zeros(quality.FEATURES)
        for b in part:
            x[b] += 1
        codes = [((a << 16 | b << 8 | c) * 0x9E3779B1 & 0xFFFFFFFF) >> 20 for a, b, c in zip(part, part[1:], part[2:])]
        for code in codes:
            x[256 + (code >> 4)] += 1
        x[:-2] = np.sqrt(x[:-2] / max(1, len(part)))
        x[-2], x[-1] = len(set(codes)) / max(1, len(part)), len(part) / quality.PASSAGE
        h = np.tanh((x - m.centre) / m.scale @ m.encode + m.encode_bias)
        hidden.append(h)
        weights.append(np.exp((np.tanh(h @ m.v) / (1 + np.exp(-(h @ m.u)))) @ m.w))
    z = sum(w * h for w, h in zip(weights, hidden)) / sum(weights)
    return 1 / (1 + np.exp(-(z @ m.out + m.out_bias[0])))


def some_model(seed):
    draw = np.random.default_rng(seed)
    shapes = [(quality.FEATURES,), (quality.FEATURES,), (quality.FEATURES, quality.HIDDEN), (quality.HIDDEN,), (quality.HIDDEN, quality.ATTENTION), (quality.HIDDEN, quality.ATTENTION), (quality.ATTENTION,), (quality.HIDDEN,), (1,)]
    arrays = [draw.normal(0, 0.3, s) for s in shapes]
    arrays[1] = np.abs(arrays[1]) + 0.1
    return quality.Model(*arrays)


def test_quality_by_plain_loops(monkeypatch):
    model, draw = some_model(1), np.random.default_rng(2)
    texts = ["", "a", "ab", "abc" * 300, "é" * 700] + ["".join(map(chr, draw.integers(32, 600, n))) for n in (5, 511, 512, 513, 3000, 20_000)]
    want = [plain_quality(t.encode(), model) for t in texts]
    assert quality.scores_of(pa.array(texts), model) == pytest.approx(want, abs=1e-5)
    # small portions and streamed long texts give the same
    monkeypatch.setattr(quality, "PORTION", 1024)
    monkeypatch.setattr(quality, "TEXTS", 2)
    assert quality.scores_of(pa.array(texts), model) == pytest.approx(want, abs=1e-5)


def test_quality_memory_does_not_follow_the_texts():
    model = some_model(3)
    for texts in (["word and word " * 500_000], [""] * 20_000, ["some words of a text " * 50] * 5000):
        column = pa.array(texts)
        tracemalloc.start()
        quality.scores_of(column, model)
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < 60e6, (len(texts), peak)


def test_a_letter_is_a_letter_by_category():
    for text, letter in [("½", False), ("²", False), ("Ⅷ", False), ("①", False), ("12 _ !", False), ("é", True), ("漢", True), ("x²", True), ("ʰ", True), ("ǅ", True)]:
        assert bool(language.LETTER.search(text)) == letter, text


def test_language_by_plain_loops():
    draw = np.random.default_rng(6)
    tables = tuple(draw.normal(0, 0.3, (w, 256, language.FILTERS)).astype(np.float32) for w in language.WIDTHS)
    wide = language.FILTERS * len(language.WIDTHS)
    model = language.Model(("a", "b", "c"), tables, draw.normal(size=wide), draw.normal(size=(wide, 3)), draw.normal(size=3))
    for text in ["x", "some words of a text " * 40, "é" * 300]:
        total = np.zeros(3)
        for row in language.windows_of(text):
            best = []
            for table in tables:
                width = len(table)
                values = [sum(table[k, row[i + k]].astype(float) for k in range(width)) for i in range(language.WINDOW - width + 1)]
                best.append(np.max(values, axis=0))
            logits = np.maximum(np.concatenate(best) + model.bias, 0) @ model.dense + model.offset
            total += np.exp(logits) / np.exp(logits).sum() * (row > 0).sum()
        assert language.probabilities(text, model) == pytest.approx(total / total.sum(), abs=1e-5)
