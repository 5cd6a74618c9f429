import hashlib
import random
import re

import pytest

from tablewright.llm import secrets as f


def plain(text):
    out = []
    for m in re.finditer(r"""(?a)(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text):
        if len(m[1]) >= 6:
            out.append((m.start(), 0, m.end()))
    for m in re.finditer("AKIA[A-Z0-9]+", text):
        if len(m[0]) >= 20:
            out.append((m.start(), 1, m.end()))
    for m in re.finditer("[0-9a-f]+", text):
        if len(m[0]) >= 24:
            out.append((m.start(), 2, m.end()))
    return ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in sorted(out))


CASES = [
    "", "password=abc", "password=abcdef", "PassWord' : 'a.b-c_d=", "token=token:abcdef", "api_key=12 apikey = \"zzzzzz\"", "ſecret=abcdef Key",
    "AKIA" + "A" * 16, "AKIA" + "A" * 15, "xAKIAAKIA" + "9" * 12, "f" * 24, "0" * 23 + "g" + "1" * 30, "é😀 secret: abcdefg",
    "token=" + "deadbeef" * 4, "passwd=\npasswd:  abcdef", "secretsecret=abcdef", "password==abcdef",
]


def test_base_spans_as_the_patterns_say():
    random.seed(1)
    parts = ["password", "Token", "secret", "apikey", "api_key", "=", ":", " ", '"', "'", "abc", "ABCDEF", "AKIA", "0" * 9, "f" * 13, "é", "\n", ".", "-"]
    for text in CASES + ["".join(random.choices(parts, k=40)) for _ in range(3000)]:
        assert f.written(f.base_spans(text)) == plain(text), text


def test_novelty():
    key = "q7Zx9LmP2vKt8RwB4nYc6HdJ"
    text = f"Set the Authorization header with bearer {key} and go on."
    assert [(s.kind, text[s.start : s.end]) for s in f.spans_of(text)[1]] == [(3, key)]
    # known from its surroundings, plain words, no sensitive word, too far away
    assert f.spans_of(f"{key} is public. bearer {key}")[1] == []
    assert f.spans_of("the private internationalization_of_everything")[1] == []
    assert f.spans_of(f"the value {key} stands alone")[1] == []
    assert f.spans_of("bearer" + " " * 80 + key)[1] == []
    # a base span is never given up for a novel one
    assert [s.kind for s in f.spans_of(f"token={key}")[1]] == [0]


@pytest.mark.parametrize("alphabet", [
    "0123456789", "0123456789ABCDEF", f.ALPHABETS[5], f.ALPHABETS[6], f.ALPHABETS[8], f.ALPHABETS[9], f.ALPHABETS[9] + "+/",
])
@pytest.mark.parametrize("length", [20, 40, 64, 128, 257, 1024, 4096])
def test_random_strings_are_found_whole(alphabet, length):
    draw, found = random.Random(length), 0
    for _ in range(40):
        value = "".join(draw.choices(alphabet, k=length))
        text = f"please send the bearer {value} to the gate and go on"
        found += any(text[s.start : s.end] == value for s in f.spans_of(text)[1])
    assert found >= 38
    assert value not in f.redacted(text)


def test_words_are_not():
    for text in [
        "session com.example.application.configuration.SettingsManager", "token access_token_expiry_seconds", "bearer version-2.10.3-release-candidate-1",
        "key https://www.example.org/path/to/some/article", "secret " + "ab" * 200, "private " + "0123456789abcdef" * 4 + "x", "key " + "=" * 80,
    ]:
        assert [s for s in f.spans_of(text)[1] if s.kind == 3] == [], text


def test_context_reaches_over_lines_and_both_ways():
    draw = random.Random(3)
    key = "".join(draw.choices(f.ALPHABETS[9], k=32))
    lines = "\n".join("".join(draw.choices(f.ALPHABETS[9] + "+/", k=64)) for _ in range(6))
    for text in [f"credential:\n  {key}\n", f"{key} is the session key", f"bearer {key}~tail.of_it", f"my secret\n\n\t{key}"]:
        assert any(key in text[s.start : s.end] for s in f.spans_of(text)[1]), text
    block = f"-----BEGIN RSA PRIVATE KEY-----\n{lines}\nabCD12==\n-----END RSA PRIVATE KEY-----"
    assert [(s.kind, block[s.start : s.end]) for s in f.spans_of(block)[1] if s.kind == 3] == [(3, f"{lines}\nabCD12==")]
    assert lines[:20] not in f.redacted(block)
    # lines that go on with a found string, far beyond the word's reach
    assert f.redacted(f"signature:\n{lines}\nand on").count("[SECRET]") == 6


def test_marginal_bytes_recounted():
    import zstandard

    draw = random.Random(8)
    for n in (16, 100, 3000):
        value = "".join(draw.choices(f.ALPHABETS[9], k=n))
        text = "x" * 700 + value + "y" * 600
        primed = zstandard.ZstdCompressionDict((f.IDENTIFIERS + "\n" + "x" * 512 + "\n" + "y" * 512).encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        size = [len(zstandard.ZstdCompressor(level=19, dict_data=primed, write_content_size=False).compress(v)) for v in (value.encode(), b"")]
        assert f.marginal_bytes(text, 700, 700 + n) == size[0] - size[1]


def test_redaction_keeps_the_rest():
    text = "a password=hunter2hunter2 b AKIA" + "Q" * 16 + " c token='" + "ab12" * 10 + "' d"
    assert f.redacted(text) == "a password=[SECRET] b [SECRET] c token='[SECRET]' d"
    assert f.redacted("nothing here") == "nothing here" and f.redacted("") == ""


def test_documents(given):
    docs = given("documents")
    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    rows = f.scan_documents(docs).collect()
    assert len(rows) == len(texts)
    for r in rows:
        want = plain(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(want.encode()).hexdigest()
        assert set(filter(None, want.split(","))) <= set(r.spans.split(","))
        assert [want.count(k) for k in ("assign", "access", "hex")] == [r.n_assign, r.n_access, r.n_hex]


def test_odd_rows(odd, table):
    rows = f.scan_documents(odd).collect()
    assert len(rows) == 10 and all(r.spans == "" and r.base_sha256 == hashlib.sha256(b"").hexdigest() for r in rows)
    assert f.scan_documents(table([])).collect() == []
    docs = table([(1, "password=abcdefgh"), (2, None), (2, None), (3, "")])
    out = f.redact(docs)
    assert out.schema == docs.schema
    assert sorted((r.doc_id, r.text, r.n_chars) for r in out.collect()) == [(1, "password=[SECRET]", 17), (2, None, 0), (2, None, 0), (3, "", 0)] or sorted(
        ((r.doc_id, r.text or "", r.n_chars) for r in out.collect())
    ) == [(1, "password=[SECRET]", 17), (2, "", 0), (2, "", 0), (3, "", 0)]
