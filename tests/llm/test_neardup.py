import itertools

import numpy as np
import pytest
import xxhash

from tablewright.llm import neardup as f
from tablewright.llm.components import connected


def plain_print(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words, word = [], ""
    for c in lowered + " ":
        if c in " \t\n\x0b\x0c\r":
            words += [word] if word else []
            word = ""
        else:
            word += c
    runs = [words[i : i + 3] for i in range(len(words) - 2)] or ([words] if words else [])
    hashes = [xxhash.xxh64_intdigest(" ".join(r).encode(), 42) for r in runs]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def roots(n, pairs):
    parent = list(range(n))

    def top(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in pairs:
        parent[top(a)] = top(b)
    return [top(i) for i in range(n)]


def expected(pairs, radius=3):
    prints = [plain_print(t) for _, t in pairs]
    kinds = sorted(set(prints))
    arr = np.array(kinds, np.uint64)
    near = [(i, int(j)) for i in range(len(arr)) for j in np.flatnonzero(np.bitwise_count(arr ^ arr[i]) <= radius) if j > i]
    root = dict(zip(kinds, roots(len(kinds), near)))
    least = {}
    for (i, _), p in zip(pairs, prints):
        if i is not None:
            least[root[p]] = min(i, least.get(root[p], i))
    return sorted(((i, f"{p:016x}", least.get(root[p])) for (i, _), p in zip(pairs, prints)), key=repr)


def test_masks_miss_no_three_bits():
    masks = f.covering_masks((1 << 64) - 1, 3)
    assert len(masks) == 15
    for bits in itertools.combinations(range(0, 64, 3), 3):
        change = sum(1 << b for b in bits)
        assert any(m & change == 0 for m in masks)


@pytest.mark.parametrize("most", [16, 256])
def test_links_of_crowded_fingerprints(spark, most):
    random = np.random.default_rng(4)
    centre = [int(x) for x in random.integers(-(2**62), 2**62, 5)]
    prints = sorted({c ^ sum(1 << int(b) for b in random.choice(63, k, replace=False)) for c in centre for k in range(6) for _ in range(15)})
    links = f.near_links(spark.createDataFrame([(p,) for p in prints], "fp long"), most_members=most)
    found = {(r.a, r.b) for r in links.collect()}
    assert all(((a ^ b) & (2**64 - 1)).bit_count() <= 3 for a, b in found)
    place = {p: i for i, p in enumerate(prints)}
    arr = np.array(prints, np.int64).view(np.uint64)
    near = [(i, j) for i in range(len(arr)) for j in range(i) if int(arr[i] ^ arr[j]).bit_count() <= 3]
    want, got = roots(len(prints), near), roots(len(prints), [(place[a], place[b]) for a, b in found])
    assert [want.index(x) for x in want] == [got.index(x) for x in got]


def test_components_of_a_long_chain_and_a_hub(spark):
    chain = [(i, i + 1) for i in range(60)] + [(1000, 1000 + i) for i in range(1, 50)] + [(5, 5)]
    got = {r.node: r.root for r in connected(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, **{1000 + i: 1000 for i in range(50)}}
    assert connected(spark.createDataFrame([], "a long, b long")).collect() == []


def test_documents_against_brute_force(given):
    docs = given("documents")
    pairs = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    got = sorted((tuple(r) for r in f.near_duplicates(docs).collect()), key=repr)
    assert got == expected(pairs)
    kept = f.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.select("doc_id").collect()) == sorted(i for i, _, c in got if i == c)


def test_odd_rows(odd, table):
    pairs = [(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()]
    assert sorted((tuple(r) for r in f.near_duplicates(odd).collect()), key=repr) == expected(pairs)
    assert f.near_duplicates(table([])).collect() == []
    kept = sorted((r.doc_id for r in f.keep_one(odd).collect()), key=repr)
    assert kept == sorted([1, 3, 7, 8, 9, None], key=repr)
    again = table([(1, "a b c d"), (1, "a b c d"), (2, "x y z")])
    assert sorted(r.doc_id for r in f.keep_one(again).collect()) == [1, 2]


def test_one_row_of_each_component_whatever_the_ids(table):
    a, b, c = "alpha beta gamma delta", "one two three four five", "red green blue white"
    kept = lambda pairs: sorted(((r.doc_id, r.text) for r in f.keep_one(table(pairs)).collect()), key=repr)
    order = lambda *pairs: sorted(pairs, key=repr)
    # three components without an id, one of them twice
    assert kept([(None, a), (None, b), (None, c), (None, c)]) == order((None, a), (None, b), (None, c))
    # two texts under one id, both the least of their component
    assert kept([(1, a), (1, b), (2, b)]) == order((1, a), (1, b))
    # only one of the rows with id 2 names its component; the other is a copy of row 1
    assert kept([(1, a), (2, a), (2, b), (3, b)]) == order((1, a), (2, b))
    # copies that differ in case only, under one id and under none
    assert len(kept([(4, a), (4, a.upper()), (None, a)])) == 1
