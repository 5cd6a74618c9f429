import re
from collections import Counter

import numpy as np
import pytest

from tablewright.llm import decontaminate as f


def words(text):
    return re.findall(r"[^\W_]+", (text or "").lower())


def bag(w):
    k = min(5, len(w))
    return Counter(tuple(w[i : i + k]) for i in range(len(w) - k + 1))


def likeness(a, b):
    return sum((a & b).values()) / sum((a | b).values())


def brute(docs, items, least=0.8):
    out = {}
    for d, text in docs:
        w = words(text)
        for i, item in items:
            own = words(item)
            best = max((likeness(bag(w[s : s + len(own)]), bag(own)) for s in range(len(w) - len(own) + 1)), default=0) if own else 0
            if best >= least:
                out[d, i] = round(best, 9)
    return out


@pytest.fixture
def items(spark):
    texts = [
        (1, "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen"), (2, "short item"), (3, None), (4, " .. "),
        (5, "a b a b a b a b a b a b"), (1, "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen"), (6, "Ünï cödé 漢字 x yz"),
        (7, " ".join(f"w{i}" for i in range(60))),
    ]
    return spark.createDataFrame([(i, t, "x") for i, t in texts], "item_id long, text string, similarity string")


CASES = [
    (1, "zzz ONE, two; three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen zzz"),
    (2, "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen"), (3, "a short item"), (4, "short  items"), (5, None), (6, ""),
    (7, "x a b a b a b a b a b a b y"), (8, "ÜNÏ CÖDÉ 漢字 x yz"), (9, "clean text " * 500),
    (10, " ".join(f"w{i}" for i in range(60)) + " end"), (11, " ".join(f"w{i}" for i in range(58)) + " other words"), (12, " ".join(f"w{i}" if i != 30 else "no" for i in range(60))),
]


def test_by_hand(items, table, spark):
    rows = f.find_leaks(table(CASES), items).collect()
    got = {(r.doc_id, r.item_id): round(r.similarity, 9) for r in rows}
    want = brute(CASES, [(r.item_id, r.text) for r in items.collect()])
    assert got == want and (1, 1) in got and (11, 7) in got and (12, 7) in got
    assert len(rows) == len(got)
    (one,) = [r for r in rows if (r.doc_id, r.item_id) == (1, 1)]
    assert CASES[0][1][one.char_start : one.char_end].startswith("ONE, two") and CASES[0][1][: one.char_end].endswith("sixteen")
    blocks = {(r.doc_id, r.item_id): round(r.similarity, 9) for r in f.find_leaks(table(CASES), items, block_items=2).collect()}
    assert blocks == want
    kept = f.keep_clean(table(CASES), items, block_items=3)
    assert kept.columns == table(CASES).columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted({d for d, _ in CASES} - {d for d, _ in want})


def test_every_fingerprint_within_the_radius_is_found():
    random = np.random.default_rng(1)
    index = f.Index([(i, " ".join(f"t{x}" for x in random.integers(0, 10**6, 30))) for i in range(300)])
    for _ in range(300):
        i, k = int(random.integers(300)), int(random.integers(f.RADIUS + 1))
        flips = sum(1 << int(b) for b in random.choice(64, k, replace=False))
        near = index.prints[i] ^ np.uint64(flips)
        want = np.flatnonzero(np.bitwise_count(index.prints ^ near) <= f.RADIUS).tolist()
        assert index.within(near, 30) == want and i in want


def test_documents_against_brute_force(given):
    docs, items = given("documents"), given("benchmark")
    pairs = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    own = [(r.item_id, r.text) for r in items.collect()]
    shared = {s for _, t in own for s in bag(words(t))}
    some = [(d, t) for d, t in pairs if shared & set(bag(words(t)))]
    got = {(r.doc_id, r.item_id): round(r.similarity, 9) for r in f.find_leaks(docs, items).collect()}
    assert got == brute(some, own)


def test_odd_rows(odd, table, items, spark):
    none = spark.createDataFrame([], items.schema)
    assert f.find_leaks(odd, items).collect() == []
    assert f.find_leaks(odd, none).collect() == [] and f.find_leaks(table([]), items).collect() == []
    assert f.keep_clean(odd, none).count() == 10
    twice = table([(1, "short item"), (1, "short item"), (None, "short item")])
    assert sorted(((r.doc_id, r.item_id) for r in f.find_leaks(twice, items).collect()), key=repr) == sorted([(1, 2), (1, 2), (None, 2)], key=repr)


def brute_clipped(docs, items, least=0.8):
    """Windows of an item's length at every place that touches the text, on the words that are there."""
    out = {}
    for d, text in docs:
        w = words(text)
        for i, item in items:
            own = words(item)
            k, best = min(5, len(own)), 0
            for s in range(1 - len(own), len(w)) if own else ():
                window = w[max(s, 0) : max(s + len(own), 0)]
                if len(window) >= k:
                    best = max(best, likeness(Counter(tuple(window[i : i + k]) for i in range(len(window) - k + 1)), bag(own)))
            if best >= least:
                out[d, i] = round(best, 9)
    return out


def test_items_cut_at_the_ends_of_texts(items, table, spark):
    long = [f"u{i}" for i in range(100)]
    more = items.unionByName(spark.createDataFrame([(8, " ".join(long), "x")], items.schema))
    other = " ".join(f"foreign{i}" for i in range(120))
    cases = CASES + [
        (20, " ".join(long[:95])), (21, " ".join(long[5:])), (22, " ".join(long[8:94])), (23, " ".join(long[:85]) + " " + other), (24, other + " " + " ".join(long[:85])),
        (25, " ".join(long[15:]) + " " + other), (26, " ".join(long[:70])), (27, other + " " + " ".join(long[:70])), (28, "a b a b a b a b a b a"), (29, "item"),
        (30, " ".join(long[:40] + ["no"] + long[41:95])),
    ]
    own = [(r.item_id, r.text) for r in more.collect()]
    want = brute_clipped(cases, own)
    assert {(2, 1), (20, 8), (21, 8), (22, 8), (24, 8), (25, 8), (30, 8)} <= set(want) and not {(26, 8), (27, 8), (29, 2)} & set(want)
    assert set(brute(cases, own)) < set(want)
    rows = f.find_leaks(table(cases), more, clipped=True).collect()
    assert {(r.doc_id, r.item_id): round(r.similarity, 9) for r in rows} == want and len(rows) == len(want)
    (one,) = [r for r in rows if (r.doc_id, r.item_id) == (24, 8)]
    assert dict(cases)[24][one.char_start : one.char_end] == " ".join(long[:85])
    kept = f.keep_clean(table(cases), more, block_items=3, clipped=True)
    assert sorted(r.doc_id for r in kept.collect()) == sorted({d for d, _ in cases} - {d for d, _ in want})


def test_query_and_pipeline_try_the_ends(spark, given, tmp_path):
    import corpus_pipeline
    from tablewright.llm.queries import QUERIES

    item = next(r for r in given("benchmark").orderBy("item_id").collect() if len(words(r.text)) >= 25)
    text = " ".join(words(item.text)[:-1])
    docs = given("documents").limit(1).drop("doc_id", "text").selectExpr("CAST(1 AS BIGINT) AS doc_id", f"'{text}' AS text", "*")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    given("benchmark").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert item.item_id in {r.item_id for r in QUERIES["op3_decontamination"](spark, str(tmp_path)).collect()}
    assert corpus_pipeline.without_benchmark(spark, docs, str(tmp_path)).count() == 0
