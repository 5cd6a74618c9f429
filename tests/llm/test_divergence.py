import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from tablewright.llm import divergence as f
from tablewright.llm.perfect_hash import PerfectHash, Shards, hashes, unpacked


def plain(rows, least=3, top=200):
    """The contract read word for word, on (lang, source, text) rows."""
    rows = [tuple(x or "" for x in r) for r in rows]
    lower = {i: i + 32 for i in range(65, 91)}
    terms = [re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", t.translate(lower)) for _, _, t in rows]
    holds = Counter((r[0], t) for r, ts in zip(rows, terms) for t in set(ts))
    kept = defaultdict(list)
    for (lang, t), n in holds.items():
        if n >= least:
            kept[lang].append(t)
    n = Counter((r[0], r[1], t) for r, ts in zip(rows, terms) for t in ts)
    sources = defaultdict(set)
    for lang, source, _ in rows:
        sources[lang].add(source)
    out = set()
    for lang in sources:
        ks, own = kept[lang], sorted(sources[lang])
        total = {s: sum(n[lang, s, t] for t in ks) for s in own}
        p = {(s, t): 1 + 1_000_000_000 * (n[lang, s, t] + 1) // (total[s] + len(ks)) for s in own for t in ks}
        q = {t: 1 + 1_000_000_000 * (sum(n[lang, s, t] for s in own) + 1) // (sum(total.values()) + len(ks)) for t in ks}
        for s in own:
            pairs = [(o, sum((p[s, t] - p[o, t]) ** 2 // p[o, t] for t in ks)) for o in own if o != s]
            best = [(t, (p[s, t] - q[t]) ** 2 // q[t]) for t in ks if n[lang, s, t] and p[s, t] > q[t]]
            for part, items in (("pair", pairs), ("term", best)):
                items = sorted(items, key=lambda x: (-x[1], x[0].encode()))
                out |= {(lang, s, part, i, v, k) for k, (i, v) in enumerate(items, 1) if part == "pair" or k <= top}
    return out


def got(df):
    rows = [tuple(r) for r in df.select("lang", "source", "part", "item", "value", "rank").collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def frame(spark, rows):
    return spark.createDataFrame([(*r, i, 1, "x", 2, 0.5) for i, r in enumerate(rows)], "lang string, source string, text string, doc_id long, n long, term string, slot long, value double")


@pytest.mark.parametrize("n", [0, 1, 2, 63, 1000, 50_000])
def test_perfect_hash(n):
    keys = [f"wörd{i}".encode() for i in range(n)]
    table = unpacked(PerfectHash(keys[::-1]).packed())
    slots = table.find(keys, hashes(keys))
    assert sorted(slots.tolist()) == list(range(n)) and table.keys(slots) == keys
    others = [b"", b"x"] + [k + b"!" for k in keys[:500]] + [k[:-1] + b"\xff" for k in keys[:500]]
    assert (table.find(others, hashes(others)) == -1).all()


def test_equal_hashes(monkeypatch):
    from tablewright.llm import perfect_hash

    monkeypatch.setattr(perfect_hash, "hashes", lambda keys: np.full(len(keys), 7, np.uint64))
    keys = [b"a", b"bb", b"ccc"]
    table = PerfectHash(keys)
    slots = table.find([*keys, b"dd"], np.full(4, 7, np.uint64))
    assert sorted(slots.tolist()) == [-1, 0, 1, 2] and table.keys(slots[:3]) == keys


def test_shards():
    keys = [f"k{i}".encode() for i in range(5000)]
    shard = (hashes(keys) >> np.uint64(61)).astype(int)
    tables = {s: PerfectHash([k for k, x in zip(keys, shard) if x == s]) for s in range(8)}
    bases, at = {}, 0
    for s in range(8):
        bases[s], at = at, at + len(tables[s])
    whole = Shards(3, tables, bases)
    slots = whole.find([*keys, b"none"])
    assert sorted(slots[:-1].tolist()) == list(range(5000)) and slots[-1] == -1 and whole.keys(slots[:-1]) == keys


def test_pieces_cut_no_term(monkeypatch):
    monkeypatch.setattr(f, "PIECE", 5)
    text = ("Ab cdéf  GHIJKLMNOPQRST u1v " * 20).encode()
    lower = [t.lower() for t in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text.decode())]
    assert [t.decode() for part in f.terms(text) for t in part] == lower


def test_against_the_contract(spark, given):
    rows = [(r.lang, r.source, r.text) for r in given("documents").collect()]
    want = plain(rows)
    assert got(f.audit(given("documents"))) == want
    # many shards, one a pass, give the same
    assert got(f.audit(given("documents"), bundle_bytes=1, shard_keys=300)) == want
    assert got(f.audit(given("documents"), top=3)) == plain(rows, top=3)


def test_odd_rows(spark):
    rows = [
        ("en", "a", "Alpha beta ALPHA"), ("en", "a", "alpha beta"), ("en", "b", "alpha beta beta"), ("en", "b", None), ("en", None, ""), ("en", "c", "1 2 3"),
        (None, None, "x"), ("fr", "a", "rien"), ("fr", "b", "rien du tout"), ("", "z", "x x"), ("", "y", "x É é É"), ("xx", "only", "q q q"), ("en", "a", "Alpha beta ALPHA"),
        ("en", "long", "alpha gamma " * 200_000),
    ]
    assert got(f.audit(frame(spark, rows))) == plain(rows)
    assert got(f.audit(frame(spark, rows), least=1)) == plain(rows, least=1)
    assert f.audit(frame(spark, [])).collect() == []


def test_large_counts_stay_exact():
    n = np.array([[9_100_000_000_000, 3, 0]])
    total = int(n.sum()) + 3
    assert f.shares(n, total).tolist() == [[1 + 10**9 * (c + 1) // total for c in n[0].tolist()]]
