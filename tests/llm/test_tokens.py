import random
import zlib

import numpy as np
from tokenizers import Tokenizer

from tablewright.llm import token_orc as f
from tablewright.llm.bpe import WordEncoder
from tablewright.llm.queries import TOKENIZER
from tablewright.session import scratch_path


def expected(pairs):
    tokenizer, out, start = Tokenizer.from_file(TOKENIZER), [], 0
    for doc_id, text in sorted(pairs, key=lambda p: (p[0] is not None, p[0] or 0)):
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [1]
        out.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_words_encode_as_texts_do():
    texts = ["", " ", "İstanbul K ſ ǅ Σας", "á É ́x", "<|endoftext|> x", "it's IT'S 'Ll x\x85y\xa0z　w", "a\x1cb", "ﬁ 10½ _x_", "The THE the"]
    encoder, tokenizer = WordEncoder(TOKENIZER), Tokenizer.from_file(TOKENIZER)
    assert encoder.by_words
    for t in texts:
        want = tokenizer.encode(t, add_special_tokens=False).ids
        assert encoder.encode([t])[0].tolist() == want, t
        assert encoder.counts([t, "x"]).tolist() == [len(want), 1]


def test_special_signs_in_any_case():
    encoder, tokenizer = WordEncoder(TOKENIZER), Tokenizer.from_file(TOKENIZER)
    draw, texts = random.Random(4), []
    for sign in ("<|endoftext|>", "<|startoftext|>"):
        for way in (str, str.upper, str.title, str.capitalize, str.swapcase, lambda s: "".join(draw.choice((c, c.upper())) for c in s)):
            texts += [way(sign), f"{way(sign)} a", f"x{way(sign)}y", f"A {way(sign)}{way(sign)}", f"{way(sign)[:-1]} {way(sign)[1:]}"]
    for t in texts:
        want = tokenizer.encode(t, add_special_tokens=False).ids
        assert encoder.encode([t])[0].tolist() == want and encoder.counts([t]).tolist() == [len(want)], t


def test_random_unicode():
    encoder, tokenizer = WordEncoder(TOKENIZER), Tokenizer.from_file(TOKENIZER)
    draw = random.Random(5)
    pools = [range(32, 127), range(0, 0x250), range(0x300, 0x600), range(0x1E00, 0x2100), range(0x3000, 0x3100), range(0xAC00, 0xAD00), range(0xFB00, 0xFB50), range(0x1F600, 0x1F650)]
    for _ in range(1500):
        parts = ["".join(chr(draw.choice(draw.choice(pools))) for _ in range(draw.randint(1, 9))) for _ in range(draw.randint(1, 8))]
        text = draw.choice(" \t\n  ").join([*parts, draw.choice(["<|EndOfText|>", "<|endoftext|>", "it's", ""])])
        assert encoder.encode([text])[0].tolist() == tokenizer.encode(text, add_special_tokens=False).ids, text


def test_known_words_are_bounded_and_forgotten(monkeypatch):
    from tablewright.llm import bpe

    monkeypatch.setattr(bpe, "MOST_BYTES", 20_000)
    encoder, tokenizer = WordEncoder(TOKENIZER), Tokenizer.from_file(TOKENIZER)
    for k in range(30):
        text = " ".join(f"word{k}x{i}" for i in range(100))
        assert encoder.encode([text])[0].tolist() == tokenizer.encode(text, add_special_tokens=False).ids
        assert len(encoder.known) <= 300
    encoder.forget()
    assert not encoder.known and len(encoder.ids) == 0


def test_documents_round_trip(spark, given):
    path, docs = scratch_path(spark, "tokens"), given("documents")
    f.write_tokens(docs, path, TOKENIZER)
    got = sorted(map(tuple, f.document_index(spark, path).collect()))
    assert got == expected([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])


def test_metadata_prunes(spark, given):
    path = scratch_path(spark, "tokens")
    f.write_tokens(given("documents"), path, TOKENIZER)
    some = f.read_tokens(spark, path, [3, 77])
    plan = some._jdf.queryExecution().toString()
    assert "PushedFilters: [In(doc_id, [3,77])]" in plan
    assert sorted(r.doc_id for r in some.collect()) == [3, 77]


def test_odd_rows(spark, odd, table):
    path = scratch_path(spark, "tokens")
    f.write_tokens(odd, path, TOKENIZER)
    got = sorted(map(tuple, f.document_index(spark, path).collect()), key=lambda r: r[1])
    assert got == expected([(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()])
    empty = scratch_path(spark, "tokens")
    f.write_tokens(table([]), empty, TOKENIZER)
    assert f.document_index(spark, empty).collect() == []
