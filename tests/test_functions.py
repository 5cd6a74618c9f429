"""Column expressions on hand-worked values."""

import hashlib

import pytest
from pyspark.sql import functions as F

from tablewright.functions import hints, masking, text, urls


def apply(spark, expression, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] for r in df.select(expression(F.col("v")).alias("o"), "i").orderBy("i").select("o").collect()]


def test_text_key(spark):
    got = apply(
        spark,
        text.text_key,
        ["  ACME Company, Limited. ", "acme co ltd", "10 Main Street\x1c", "北京市 朝阳", "北京市朝阳", "Élan_1 (x)", "unlimited", None],
    )
    assert got == ["acme co ltd", "acme co ltd", "10 main st", "北京 朝阳", "北京市朝阳", "élan_1 x", "unlimited", None]


def test_trim_covers_unicode_space(spark):
    assert apply(spark, text.trim_spaces, ["　a b\t\x1f", " ", "x"]) == ["a b", "", "x"]


def test_phone(spark):
    assert apply(spark, text.phone_digits, ["138-0000-1111", "138 0000 1111", "2380000111", "+86 13800001111", None]) == [
        "13800001111", "13800001111", "2380000111", "+86 13800001111", None,
    ]


def test_dates(spark):
    got = apply(
        spark, text.date_text,
        ["2026/2/20", "2026-02-20", "20260220", "2/20/2026", "2026-02-20T10:11:12.5Z", "2026-02-20 10:11:12", "2026/02/20 08:30:00", "2026-02-20 08:30", "20260220 083000", "20260220T0830", "Feb 20, 2026", "february 20 2026",
         "20 Feb. 2026 08:30", "2026-02-20 08:30:00 +08:00", "2026-13-01", "Feb 30, 2026", "Foo 1, 2026", "2026-02-20 at noon", "bad", "", None],
    )
    assert got == ["2026-02-20"] * 14 + ["2026-13-01", "Feb 30, 2026", "Foo 1, 2026", "2026-02-20 at noon", "bad", "", None]


def test_masks(spark):
    cases = {
        hints.PHONE: (["13812345678", "138-1234-5678", "1381234", "12345", "", "  ", None], ["138****5678", "138****5678", "138****34", "***", "", "  ", None]),
        hints.ID_CARD: (["11010519491231002X", "110105194912310021", "123456789012345", "123"], ["1101**********002X", "1101**********0021", "1234**********2345", "***"]),
        hints.EMAIL: (["ab@x.com", "zhang@x.com", "none", "a@b@c"], ["*@x.com", "zh***@x.com", "***@***", "***@***"]),
        hints.BANK_CARD: (["6222 0212 3456 7890", "123456789", "12345678"], ["6222 **** **** 7890", "1234****6789", "***"]),
        hints.NAME: (["张", "张三", "张小三", "Robert"], ["*", "张*", "张*三", "R****t"]),
        hints.ADDRESS: (["北京市朝阳区", "北京朝阳", "杭州市西湖区文三路", "杭州"], ["北京市***", "北京***", "杭州市西湖区***", "***"]),
        "other": (["abcdef", "abcd"], ["ab***ef", "***"]),
    }
    for kind, (values, expected) in cases.items():
        assert apply(spark, lambda c: masking.masked(c, kind, "mask"), values) == expected, kind


def test_other_strategies(spark):
    values = ["13812345678", "", None]
    assert apply(spark, lambda c: masking.masked(c, hints.PHONE, "full"), values) == ["***", "", None]
    assert apply(spark, lambda c: masking.masked(c, hints.PHONE, "null"), values) == ["", "", ""]
    digest = hashlib.sha256(b"s13812345678").hexdigest()[:16]
    assert apply(spark, lambda c: masking.masked(c, hints.PHONE, "hash", "s"), values) == [digest, "", None]
    with pytest.raises(ValueError):
        masking.masked(F.col("v"), hints.PHONE, "hash")
    with pytest.raises(ValueError):
        masking.masked(F.col("v"), hints.PHONE, "blur")


def test_urls(spark):
    addresses = [
        "https://www.toutiao.com/article/123/?share=1", "https://m.ixigua.com/1", "https://api.example.com/x", "https://example.com/api/v1",
        "https://example.com/data.json", "https://example.com/", "https://www.zhihu.com/question/1", "not a url",
    ]
    assert apply(spark, urls.platform, addresses) == ["toutiao", "toutiao", None, None, None, None, "zhihu", None]
    assert apply(spark, urls.fetch_mode, addresses) == ["autocli", "autocli", "api", "api", "api", "static", "autocli", "static"]
    assert apply(spark, lambda c: urls.fetch_mode(c, "dynamic"), addresses) == ["dynamic"] * 8
    assert apply(spark, urls.canonical_article, addresses)[0] == "https://www.toutiao.com/article/123/"
    assert apply(spark, urls.canonical_article, addresses)[5] == "https://example.com/"


def test_unsafe_urls(spark):
    got = apply(
        spark, urls.is_safe,
        ["http://169.254.169.254/latest", "http://127.0.0.1:8000/", "ftp://example.com/x", "https://example.com/", "http://172.20.1.1/",
         "http://172.32.1.1/", "http://[fe80::1]/", "http://localhost/"],
    )
    assert got == [False, False, False, True, False, True, False, True]


def test_reader_and_name(spark):
    paths = ["https://a.example.com/b/c.csv", "/d/My Sales-Data.XLSX", "x.tsv", "x.jsonl", "noext", "a.tar.gz", "/a.b/c.db"]
    assert apply(spark, urls.reader_of, paths) == ["web", "excel", "csv", "json", "csv", "csv", "sqlite"]
    assert apply(spark, urls.source_name, paths) == ["a_example_com_b_c.csv", "my_sales_data", "x", "x", "noext", "a.tar", "c"]
