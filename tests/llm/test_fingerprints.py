import hashlib

import numpy as np

from tablewright.llm import fingerprints as f


def plain_gear(data):
    h, out = 0, []
    for b in data:
        h = (h << 1 & 0xFFFFFFFF) + int(f.GEAR[b]) & 0xFFFFFFFF
        out.append(h)
    return out


def plain_boundaries(data):
    ends, start, bits = [], 0, 5
    h = plain_gear(data)
    while start < len(data):
        end, at = None, start + f.LEAST
        while end is None:
            if at >= len(data) or at - start >= f.MOST:
                end = min(at, len(data))
            elif at - start <= f.NORMAL and h[at - 1] >> 32 - bits - 2 == 0:
                end = at
            elif at - start > f.NORMAL and h[at - 1] >> 32 - bits - 2 & 2 ** (bits - 2) - 1 == 0:
                end = at
            else:
                at += 1
        ends.append(min(end, len(data)))
        start = ends[-1]
    return ends


def test_gear_and_boundaries_as_written_out():
    data = np.random.default_rng(1).integers(0, 256, 5000).astype(np.uint8)
    assert f.gear_hash(data).tolist() == plain_gear(data.tolist())
    for n in (0, 1, 8, 9, 31, 33, 129, 5000):
        assert f.boundaries(data[:n]) == plain_boundaries(data[:n].tolist())


def test_blocks_do_not_show():
    data = np.random.default_rng(2).integers(0, 256, 3 * f.BLOCK // 2).astype(np.uint8)
    whole, old = f.boundaries(data), f.BLOCK
    try:
        f.BLOCK = 4096
        assert f.boundaries(data) == whole
    finally:
        f.BLOCK = old


def test_shifted_text_keeps_most_chunks():
    text = " ".join(str(x) for x in np.random.default_rng(3).integers(0, 10**6, 3000)).encode()
    assert f.containment(f.chunk_set(text), f.chunk_set(b"x" * 7 + text)) > 0.95
    assert f.containment(f.chunk_set(text), f.chunk_set(text[: len(text) // 2])) < 0.6
    assert (f.from_text(f.as_text(f.chunk_set(text))) == f.chunk_set(text)).all()


def expected(pairs):
    order = sorted(pairs, key=lambda p: (p[0] is not None, p[0] or 0))
    out = []
    for i, (doc_id, text) in enumerate(order):
        text, after = text or "", order[(i + 1) % len(order)][1] or ""
        k = len(text) // 4
        new = text[: len(text) - k] + after[:k]
        own, changed, other = (f.chunk_set(t.encode()) for t in (text, new, after))
        out.append((doc_id, len(text), hashlib.sha256(new.encode()).hexdigest(), f.as_text(own), f.as_text(changed), f.containment(own, changed), f.containment(own, other)))
    return sorted(out, key=repr)


def test_query_rows_by_hand_over_many_ranges(given):
    docs = given("documents")
    got = f.compare_with_edited(docs, rows_per_bucket=7)
    want = expected([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])
    assert sorted(map(tuple, got.collect()), key=repr) == want


def test_odd_rows(odd, table):
    got = f.compare_with_edited(odd, rows_per_bucket=2)
    want = expected([(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()])
    assert sorted(map(tuple, got.collect()), key=repr) == want
    assert f.compare_with_edited(table([])).collect() == []
    (one,) = f.compare_with_edited(table([(1, "abcdefgh")])).collect()
    assert one.edited_sha256 == hashlib.sha256(b"abcdefab").hexdigest() and one.near_next == 1.0


def test_ranges_grow_beyond_their_largest_number(given, monkeypatch):
    monkeypatch.setattr(f, "MOST_RANGES", 3)
    docs = given("documents")
    got = f.compare_with_edited(docs, rows_per_bucket=7)
    want = expected([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])
    assert sorted(map(tuple, got.collect()), key=repr) == want
