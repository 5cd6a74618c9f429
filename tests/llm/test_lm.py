import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from tablewright.llm import lm as f


def plain_words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({i: i + 32 for i in range(65, 91)}))


def held(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 7 == 2


def plain(rows, order, strength):
    """Base and smoothed scores of (doc_id, text) rows, by the formulas, recursively."""
    docs = [(i, [*plain_words(t), None]) for i, t in rows]
    n = Counter()
    for i, ws in docs:
        if not held(i):
            n.update(tuple(ws[j - k : j]) for k in range(1, order + 1) for j in range(k, len(ws) + 1))
    total, distinct = sum(c for g, c in n.items() if len(g) == 1), sum(len(g) == 1 for g in n)

    def p(history, w):
        if not history:
            return (n[w,] + 1) / (total + distinct + 1)
        return (n[(*history, w)] + strength * p(history[1:], w)) / (n[history] + strength)

    out = []
    for i, ws in docs:
        base = math.fsum(math.log10((n[w,] + 1) / (total + distinct + 1)) for w in ws)
        score = math.fsum(math.log10(p(tuple(ws[max(0, j - order + 1) : j]), w)) for j, w in enumerate(ws))
        out.append((i, held(i), len(ws), sum(n[w,] > 0 for w in ws), total, base, score))
    return out


def same(df, want):
    columns = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    assert df.columns == columns
    key = lambda r: (r[0] is not None, r[0] or 0, r[2], round(r[5], 6))
    got, want = sorted(map(tuple, df.collect()), key=key), sorted(want, key=key)
    assert [r[:5] for r in got] == [r[:5] for r in want]
    for a, b in zip(got, want):
        assert a[5:] == pytest.approx(b[5:], rel=1e-11, abs=1e-11)


@pytest.mark.parametrize("order", [1, 2, 3])
def test_against_the_formulas(given, order):
    docs = given("documents")
    same(f.score_documents(docs, order=order, strength=7.0), plain([(r.doc_id, r.text) for r in docs.collect()], order, 7.0))


def test_chunks_pieces_and_buckets_change_nothing(given, monkeypatch):
    docs = given("documents")
    want = plain([(r.doc_id, r.text) for r in docs.collect()], 3, 20.0)
    monkeypatch.setattr(f, "CHUNK", 20_000)
    monkeypatch.setattr(f, "PIECE", 500)
    monkeypatch.setattr(f, "STRIDE", 5)
    rows = [(r.doc_id, held(r.doc_id), r.text) for r in docs.collect()]
    pieces = [list(f.words_of(t.encode())) for _, _, t in rows if t]
    assert max(map(len, pieces)) > 3
    assert [[w.decode() for p in ps for w in p] for ps in pieces] == [plain_words(t) for _, _, t in rows if t]
    same(f.score_documents(docs, order=3, strength=20.0, bucket_keys=500), want)


def automaton(texts, order, strength, stride):
    """One chunk built by hand, with its texts as training texts; context of two tokens before each later piece."""
    words = sorted({w for t in texts for w in t} | {f.END}, key=lambda w: int(f.hashes([w])[0]))
    number = {w: i for i, w in enumerate(words)}
    tokens = np.array([number[w] for t in texts for w in t], np.int32)
    import zstandard

    sizes = [len(t) for t in texts]
    c = f.Chunk(words, zstandard.ZstdCompressor().compress(f.planes(tokens)), [0] * len(texts), sizes, [False] * len(texts), order)
    grams = c.grams()
    m = f.Automaton(c, grams, np.bincount(tokens, minlength=len(words)), c.trained(grams), len(tokens), len(words), strength)
    f.STRIDE, before = stride, f.STRIDE
    try:
        return c, m, m.log10(c)
    finally:
        f.STRIDE = before


@pytest.mark.parametrize("order", [2, 3, 4])
def test_readers_agree_with_one_reader(order):
    random = np.random.default_rng(order)
    texts = [[b"abcdef"[i : i + 1] for i in random.integers(0, 6, n)] + [f.END] for n in (0, 1, 2, 3, 200, 57)]
    _, _, one = automaton(texts, order, 3.0, 10**6)
    for stride in (1, 2, 7, 64):
        assert np.array_equal(automaton(texts, order, 3.0, stride)[2], one)


def test_arcs_of_a_state_sum_to_one():
    texts = [[*t.split(), f.END] for t in (b"a b a c", b"a b b", b"c a b a", b"")]
    c, m, _ = automaton(texts, 3, 2.0, 128)
    n, v = len(c.tokens), len(c.words)
    for state in {-1, *m.into.tolist(), *m.after_root.tolist()}:
        words = np.arange(v)
        total = (10 ** m.read(np.full(v, state), words)[1]).sum()
        unknown = 1 / (n + v + 1)
        at = state
        while at >= 0:
            unknown *= 10 ** m.back_off[at]
            at = m.shorter[at]
        assert total + unknown == pytest.approx(1)


def test_odd_rows(odd, table):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    same(f.score_documents(odd), plain(rows, f.ORDER, f.STRENGTH))
    assert f.score_documents(table([])).collect() == []
    alone = next(i for i in range(100) if held(i))
    only = f.score_documents(table([(alone, "nothing learnt")])).collect()
    assert [tuple(r) for r in only] == [(alone, True, 3, 0, 0, 0.0, 0.0)]


def test_a_long_text_in_pieces(table):
    text = "the quick brown fox jumps over the lazy dog near Oslo " * 160_000  # 8.6 MB
    rows = [(1, text), (2, "the quick dog"), (3, None)]
    same(f.score_documents(table(rows)), plain(rows, f.ORDER, f.STRENGTH))


def test_the_order_of_words_is_learnt(given):
    rows = f.score_documents(given("documents")).collect()
    assert sum(r.score for r in rows if not r.held_out) > sum(r.base_score for r in rows if not r.held_out)


def test_scoring_a_chunk_takes_little_memory():
    import tracemalloc

    import zstandard

    tokens = (np.arange(400_000, dtype=np.int64) ** 2 % 99_991).astype(np.int32)
    words = [b"w%d" % i for i in range(99_991)]
    packed = zstandard.ZstdCompressor().compress(f.planes(tokens))
    tracemalloc.start()
    c = f.Chunk(words, packed, [0] * 400, [1000] * 400, [False] * 400, 2)
    grams = c.grams()
    counts = c.trained(grams), np.bincount(c.tokens, minlength=len(words))
    start = tracemalloc.get_traced_memory()[0]
    tracemalloc.reset_peak()
    f.score_chunk(c, counts[1], counts[0], 400_000, len(words), 500.0)
    peak = tracemalloc.get_traced_memory()[1] - start
    tracemalloc.stop()
    assert peak < 80 * (len(tokens) + len(grams) + len(words)) / 2
