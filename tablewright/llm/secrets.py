"""Secret scans: fixed patterns, and strings that a dictionary-primed compressor finds new.

The fixed patterns always count. Beside them, a string that stands in a sensitive context is a
secret if zstandard, primed with an identifier dictionary and the text around the string, saves
almost nothing on it: its marginal compressed bytes come close to those of a random string of the same
length and alphabet. The context reaches over line ends and to both sides of a sensitive word, and the
body of a private key block is a string of its own. Strings count whole, however long they are.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("assign", "access", "hex", "novel")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
ASSIGN_VALUE, ACCESS_LENGTH = 6, 20

# words after which a string is looked at
SENSITIVE_WORDS = (
    "password", "passwd", "pwd", "secret", "token", "key", "credential", "authorization", "bearer", "private", "signature", "session",
)
SENSITIVE = re.compile("|".join(SENSITIVE_WORDS), re.IGNORECASE | re.ASCII)
PLAIN = "A-Za-z0-9+/_=.~-"
CANDIDATE, RUN = re.compile(f"[{PLAIN}]{{16,}}"), re.compile(f"[{PLAIN}]*")
BEFORE = re.compile(f"[^{PLAIN}]")
KEY_BLOCK = re.compile(r"-----BEGIN [A-Z0-9 ]*PRIVATE KEY[A-Z ]*-----\s*([A-Za-z0-9+/=\s]{15,}[A-Za-z0-9+/=])")
LEAST = 16
REACH = 64  # code points between the word and the string
GAP = 4  # code points between a found string and one that goes on with it
AROUND = 512  # code points on either side that prime the compressor
LEAST_NOVEL = 0.9

# alphabets that random strings are written in, small ones first
ALPHABETS = (
    "0123456789", "0123456789abcdef", "0123456789ABCDEF", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "0123456789abcdefghijklmnopqrstuvwxyz", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz",
    "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz+/_=.~-",
)
HEX_ALPHABETS = ALPHABETS[:3]

# pairs of letters that words of Latin script are full of, random strings are not
WORD_PAIRS = frozenset(
    "th he in er an re on at en nd ti es or te of ed is it al ar st to nt ng se ha as ou io le ve co me de hi ri ro ic ne ea ra ce li ch ll"
    " be ma si om ur".split()
)
WORDY, LEAST_PAIRS = 0.25, 4

# names that code is full of; they prime the compressor
IDENTIFIERS = (
    "password passwd secret token api_key apikey access_key secret_key private_key public_key client_id client_secret "
    "authorization bearer session session_id cookie signature credential credentials username user_name user_id email "
    "https:// http:// www. .com .org .example localhost 127.0.0.1 application/json text/html charset=utf-8 "
    "import export return function class const static public private protected void string integer boolean "
    "get_ set_ is_ has_ make_ create_ update_ delete_ config configuration settings environment production development "
    "0123456789 abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ"
)


class Span(NamedTuple):
    start: int
    kind: int
    end: int
    value: int  # where the secret itself begins


def base_spans(text: str) -> list[Span]:
    """Spans of the fixed patterns, leftmost and not overlapping within a kind."""
    out = []
    low = text.lower()
    if any(w in low for w in ("password", "passwd", "secret", "token", "apikey", "api_key")):
        out += [
            Span(m.start(), 0, m.end(), m.start(2)) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_VALUE
        ]
    if "AKIA" in text:
        out += [Span(m.start(), 1, m.end(), m.start()) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LENGTH]
    out += [Span(m.start(), 2, m.end(), m.start()) for m in HEX.finditer(text)]
    return sorted(out)


def marginal_bytes(text: str, start: int, end: int) -> int:
    """Compressed bytes that a string adds, given the identifiers and the text on either side of it."""
    around = f"{IDENTIFIERS}\n{text[max(0, start - AROUND):start]}\n{text[end:end + AROUND]}".encode("utf-8", "surrogatepass")
    primed = zstandard.ZstdCompressionDict(around, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    write = zstandard.ZstdCompressor(level=19, dict_data=primed, write_content_size=False, write_checksum=False)
    return len(write.compress(text[start:end].encode())) - len(write.compress(b""))


def alphabet_of(value: str) -> str:
    """The first alphabet that has all the string's characters."""
    used = set(value)
    return next((a for a in ALPHABETS if used <= set(a)), ALPHABETS[-1])


@lru_cache(maxsize=4096)
def random_bytes(length: int, alphabet: str) -> int:
    """Compressed bytes that a random string adds: what it is made of is in no dictionary."""
    draw = random.Random(length)
    return marginal_bytes("".join(draw.choices(alphabet, k=length)), 0, length)


def wordy(value: str) -> bool:
    """True where many neighbouring letters are such as words have, so that the string is made of names."""
    if alphabet_of(value) in HEX_ALPHABETS:
        return False
    pairs = [value[i : i + 2].lower() for i in range(len(value) - 1) if value[i : i + 2].isalpha()]
    common = sum(p in WORD_PAIRS for p in pairs)
    return common >= LEAST_PAIRS and common >= WORDY * len(pairs)


def is_novel(text: str, start: int, end: int) -> bool:
    value = text[start:end]
    if wordy(value):
        return False
    # what random strings cost is measured up to a length; beyond it, it grows in proportion
    size, alphabet = len(value), alphabet_of(value)
    known = min(size, 1024)
    return marginal_bytes(text, start, end) >= LEAST_NOVEL * random_bytes(known, alphabet) * size / known


def _windows(text: str) -> Iterator[tuple[int, int]]:
    """Stretches of the text within reach of a sensitive word, with the whole strings at their ends; none overlap."""
    at = end = -1
    for word in SENSITIVE.finditer(text):
        low, high = max(0, word.start() - REACH), word.end() + REACH
        if low > end:
            if end >= 0:
                yield at, end
            while low and not BEFORE.match(text, low - 1):
                low -= 1
            at = max(low, end, 0)
        end = max(end, RUN.match(text, min(high, len(text))).end())
    if end >= 0:
        yield at, end


def _pieces(start: int, end: int, known: list[Span]) -> list[tuple[int, int]]:
    """A string without the assignments in it; none where a fixed pattern has all of it."""
    over = [s for s in known if s.start < end and start < s.end]
    if any(s.start <= start and end <= s.end for s in over):
        return []
    out, at = [], start
    for s in over:
        if s.kind == 0:
            out.append((at, s.start))
            at = max(at, s.end)
    return [(a, b) for a, b in [*out, (at, end)] if b - a >= LEAST]


def novel_spans(text: str, known: list[Span]) -> list[Span]:
    """Strings near a sensitive word that the primed compressor finds as new as random ones."""
    low = text.lower()
    if not any(w in low for w in SENSITIVE_WORDS):
        return []
    out, done = [], 0
    for block in KEY_BLOCK.finditer(text):
        if is_novel("".join(block[1].split()), 0, len("".join(block[1].split()))):
            out.append(Span(block.start(1), 3, block.end(1), block.start(1)))
    blocks = list(out)
    for first, last in _windows(text):
        at = max(first, done)
        while m := CANDIDATE.search(text, at, last):
            at = m.end()
            if any(s.start < m.end() and m.start() < s.end for s in blocks):
                continue
            for start, end in _pieces(m.start(), m.end(), known):
                if is_novel(text, start, end):
                    out.append(Span(start, 3, end, start))
                    if end == m.end():  # the next line may go on with it
                        more = CANDIDATE.search(text, end, end + GAP + LEAST)
                        last = max(last, RUN.match(text, more.start()).end()) if more and more.start() <= end + GAP else last
        done = max(at, done)
    return sorted(set(out))


def spans_of(text: str) -> tuple[list[Span], list[Span]]:
    """Base spans, and all spans in order of start and kind."""
    base = base_spans(text)
    return base, sorted(base + novel_spans(text, base))


def written(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[s.kind]}:{s.start}:{s.end}" for s in spans)


def redacted(text: str, mark: str = "[SECRET]") -> str:
    """The text with each secret's value replaced; what overlaps is replaced once."""
    out, at = [], 0
    for start, end in sorted((s.value, s.end) for s in spans_of(text)[1]):
        if start >= at:
            out += [text[at:start], mark]
        at = max(at, end)
    return "".join([*out, text[at:]])


REPORT = pa.struct([
    ("n_assign", pa.int64()), ("n_access", pa.int64()), ("n_hex", pa.int64()), ("n_novel", pa.int64()),
    ("base_sha256", pa.string()), ("spans", pa.string()),
])


def report(text: Column) -> Column:
    """Struct of the counts of each kind, the digest of the base spans and all spans of a text (null: empty)."""

    @F.arrow_udf("n_assign long, n_access long, n_hex long, n_novel long, base_sha256 string, spans string")
    def scan(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            rows = []
            for t in texts:
                base, spans = spans_of(t.as_py() or "")
                kinds = [s.kind for s in spans]
                digest = hashlib.sha256(written(base).encode()).hexdigest()
                rows.append((*(kinds.count(k) for k in range(4)), digest, written(spans)))
            columns = list(zip(*rows)) or [()] * len(REPORT)
            yield pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(columns, REPORT)], fields=list(REPORT))

    return scan(text)


def scan_documents(documents: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document row: id, counts by kind, ``base_sha256`` and ``spans``.

    Offsets count code points, ends are exclusive. Null and empty texts have no spans; repeated rows
    come back as often as they came; no other column is read; an empty table gives no rows.
    """
    return documents.select(doc_id, report(F.col(text)).alias("found")).select(doc_id, "found.*")


def redact(documents: DataFrame, text: str = "text", n_chars: str = "n_chars", mark: str = "[SECRET]") -> DataFrame:
    """The documents with every secret's value replaced by ``mark``; all columns, the length counted anew.

    Null texts stay null with their length, empty ones empty; every row comes back, repeated rows too.
    """

    @F.arrow_udf("string")
    def cover(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.array([None if t is None else redacted(t, mark) for t in texts.to_pylist()], pa.string())

    out = documents.withColumn(text, cover(F.col(text)))
    if n_chars not in documents.columns:
        return out
    kind = documents.schema[n_chars].dataType
    return out.withColumn(n_chars, F.when(F.col(text).isNull(), F.col(n_chars)).otherwise(F.length(text)).cast(kind))
