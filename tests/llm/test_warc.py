import base64
import gzip
import hashlib
import io

from tablewright.llm import warc as f
from tablewright.llm.queries import ORACLES
from tablewright.session import scratch_path


def pages(spark, rows):
    return spark.createDataFrame([(i, u, h, "x", 1) for i, u, h in rows], "page_id long, url string, html string, own string, digest long")


def expected(rows, least=0):
    payload = [(i, (h or "").encode()) for i, _, h in rows]
    out = []
    for i, p in payload:
        same = [j for j, q in payload if q == p and j is not None]
        top = max(same, default=None)
        later = len(p) >= least and i != top
        out.append((i, len(p), base64.b32encode(hashlib.sha1(p).digest()).decode(), "revisit" if later else "response", top if later else None))
    return sorted(out, key=repr)


ODD = [
    (1, "http://a/ b\r\nX: y", "<p>one</p>"), (2, None, "<p>one</p>"), (3, "u", None), (4, "u", ""), (5, "ü", "<p>é漢😀</p>"),
    (6, "u", "WARC/1.1\r\nWARC-Type: response\r\n\r\n"), (7, "u", "x" * 3_000_000), (None, "u", "<p>one</p>"), (8, "u", "x" * 3_000_000), (9, "u", "t"), (9, "u", "t"),
]


def write(spark, df, **more):
    return f.write_archives(df, scratch_path(spark, "warc"), **more)


def test_round_trip_of_odd_pages_at_any_split(spark):
    archives = write(spark, pages(spark, ODD), level=1)
    for split in (50, 1000, 1 << 20):
        got = f.read_archives(spark, archives, split).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
        assert sorted(map(tuple, got.collect()), key=repr) == expected(ODD)
    least = f.read_archives(spark, write(spark, pages(spark, ODD), least_bytes=100))
    assert sorted(map(tuple, least.drop("path", "offset").collect()), key=repr) == expected(ODD, 100)


def test_empty_table(spark):
    assert f.read_archives(spark, write(spark, pages(spark, []))).collect() == []


def test_archives_are_plain_gzip_members(spark):
    for path, size in write(spark, pages(spark, ODD[:5])):
        data = open(path, "rb").read()
        assert len(data) == size and gzip.decompress(data).startswith(b"WARC/1.1\r\n")


def test_false_magic_and_damage_are_passed_over():
    good = f.member(f.record(1, "u", b"<p>1</p>", None, False))
    other = f.member(f.record(2, "u", b"<p>2</p>", None, False))
    noise = f.MAGIC + b"\x00 not a member " + gzip.compress(b"not a record") + f.MAGIC
    data = noise + good + good[:-9] + noise + other + f.MAGIC
    ids = lambda a, b: [h["warc-record-id"] for _, h, _ in f.records_between(io.BytesIO(data), a, b)]
    whole = ids(0, len(data))
    assert whole == ["<urn:x-page:1>", "<urn:x-page:2>"]
    for cut in range(0, len(data), 7):
        assert ids(0, cut) + ids(cut, len(data)) == whole


def test_query_has_a_twin():
    assert "op6_warc" in ORACLES
