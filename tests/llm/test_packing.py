from collections import defaultdict

import numpy as np
from tokenizers import Tokenizer

from tablewright.llm import packing as f
from tablewright.llm.queries import TOKENIZER


def test_bins_hold_their_pieces_and_are_as_short_as_they_can_be():
    random = np.random.default_rng(1)
    for n in (0, 1, 5, 400):
        sizes = random.integers(1, 8193, n).tolist()
        bins, offsets, capacity = f.pack(sizes)
        held = defaultdict(list)
        for s, b, o in zip(sizes, bins, offsets):
            held[b].append((o, s))
        assert sorted(held) == list(range(len(capacity)))
        for b, parts in held.items():
            end = 0
            for o, s in sorted(parts):
                assert o == end
                end += s
            assert capacity[b] == min(c for c in f.LENGTHS if c >= end)


def test_sizes_are_chosen_jointly():
    assert sorted(f.pack([1000] * 3)[2]) == [1024] * 3 or sum(f.pack([1000] * 3)[2]) <= 3 * 1024 + 1024
    _, _, capacity = f.pack([1024, 1024, 2048, 4096])
    assert capacity == [8192]
    # with a cost that grows faster than the length, short sequences win
    assert sorted(f.pack([1024, 1024], cost=lambda c: c * c)[2]) == [1024, 1024]
    random = np.random.default_rng(2)
    sizes = random.integers(1, 3000, 2000).tolist()
    assert sum(f.pack(sizes)[2]) <= sum(sizes) * 1.01 + 8192


def check(docs, rows, lengths=f.LENGTHS):
    tokenizer = Tokenizer.from_file(TOKENIZER)
    want = sorted((d, len(tokenizer.encode(t or "", add_special_tokens=False).ids) + 1) for d, t in docs if d is not None)
    got = defaultdict(list)
    for r in rows:
        if r.doc_id is not None:
            got[r.doc_id].append((r.token_start, r.n_tokens))
    total = defaultdict(int)
    for d, n in want:
        total[d] += n
    assert {d: sum(n for _, n in p) for d, p in got.items()} == dict(total)
    bins = defaultdict(list)
    for r in rows:
        bins[r.bin_id].append((r.bin_offset, r.n_tokens, r.bin_capacity))
    for parts in bins.values():
        end = 0
        for o, n, c in sorted(parts):
            assert o == end
            end += n
        assert {c for *_, c in parts} == {min(x for x in lengths if x >= end)}


def test_documents(given):
    docs = given("documents")
    rows = f.pack_documents(docs, TOKENIZER, pieces_per_shard=60).collect()
    check([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()], rows)


def test_odd_rows(odd, table):
    rows = f.pack_documents(odd, TOKENIZER).collect()
    check([(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()], rows)
    assert sum(r.doc_id == 5 for r in rows) == 2 and any(r.doc_id is None for r in rows)
    assert max(r.piece for r in rows if r.doc_id == 9) > 5
    assert f.pack_documents(table([]), TOKENIZER).collect() == []
