"""Pages, URLs, payloads, and the chain and contract of steps."""

from pyspark.sql import functions as F

from catalog.inputs import MIXED, ORDERS, frame, q_trim, table, with_src
from catalog.registry import query
from tablewright.functions import urls
from tablewright.operators import clean, pages
from tablewright.plans import chain
from tablewright.session import sql_over

# text between tags, without scripts, styles and comments; the entities the pages use are put back
_TEXT = r"regexp_replace(regexp_replace(regexp_replace(html, '<(script|style)[^>]*>.*?</(script|style)>', chr(10), 'gs'), '<!--.*?-->', chr(10), 'gs'), '<[^>]*>', chr(10), 'g')"


def _unescape(text):
    """Entities put back; a page cut short may end one without its semicolon."""
    for name, mark in (("lt", "'<'"), ("gt", "'>'"), ("quot", "'\"'"), ("nbsp", "chr(160)"), ("copy", "'©'"), ("middot", "'·'"), ("amp", "'&'")):
        text = f"regexp_replace({text}, '&{name};?', {mark}, 'g')"
    return text


def _pages(spark, sf):
    return pages.spread(table(spark, sf, "pages"))


_LINES = f"""SELECT page_id, content FROM (SELECT page_id, {q_trim(_unescape('line'))} AS content FROM (SELECT page_id, unnest(string_split({_TEXT}, chr(10))) AS line FROM pages)) WHERE content <> ''"""


@query("w1_text_lines", f"SELECT page_id, content, count(*) AS n FROM ({_LINES}) GROUP BY ALL")
def w1(spark, sf):
    lines = pages.text_lines(_pages(spark, sf), keep=["page_id"])
    return lines.groupBy("page_id", "content").agg(F.count(F.lit(1)).alias("n"))


_LINKS = """SELECT page_id, unnest(regexp_extract_all(html, '<li><a href="([^"]*)">([^<]*)</a></li>', 1)) AS link,
    unnest(regexp_extract_all(html, '<li><a href="([^"]*)">([^<]*)</a></li>', 2)) AS label FROM pages"""


@query("w2_extract_containers", f"SELECT page_id, link, {_unescape('label')} AS label FROM ({_LINKS})")
def w2(spark, sf):
    rules = [
        {"name": "link", "container": "nav li", "selector": "a", "attr": "href"},
        {"name": "label", "selector": "a", "attr": "text"},
    ]
    return pages.extract_rows(_pages(spark, sf), rules, keep=["page_id"]).drop("row")


# each whole page forty times in one page: the work must not grow with the square of its elements
@query("w2_extract_large_pages", f"SELECT page_id, link, CAST(40 * count(*) AS BIGINT) AS n FROM ({_LINKS}) GROUP BY ALL")
def w2_large(spark, sf):
    rules = [{"name": "link", "container": "nav li", "selector": "a", "attr": "href"}]
    rows = pages.extract_rows(_pages(spark, sf).withColumn("html", F.repeat("html", 40)), rules, keep=["page_id"])
    return rows.groupBy("page_id", "link").agg(F.count(F.lit(1)).alias("n"))


@query(
    "w3_extract_columns",
    rf"""SELECT page_id, link, CASE WHEN place = 1 THEN title ELSE '' END AS title FROM (SELECT page_id, unnest(regexp_extract_all(html, '<li><a href="([^"]*)"', 1)) AS link,
        unnest(range(1, len(regexp_extract_all(html, '<li><a href="([^"]*)"', 1)) + 1)) AS place,
        {q_trim(_unescape("regexp_extract(html, '<h1>([^<]*)</h1>', 1)"))} AS title FROM pages)""",
)
def w3(spark, sf):
    rules = [{"name": "link", "selector": "li a", "attr": "href"}, {"name": "title", "selector": "article h1"}]
    return pages.extract_rows(_pages(spark, sf), rules, keep=["page_id"]).drop("row")


@query(
    "w4_attribute_values",
    r"""SELECT page_id, regexp_extract(html, '<html lang="([^"]*)"', 1) AS lang, regexp_extract(html, '<meta charset="([^"]*)"', 1) AS charset, '' AS missing FROM pages""",
)
def w4(spark, sf):
    rules = [
        {"name": "lang", "container": "html", "selector": "", "attr": "lang"},
        {"name": "charset", "selector": "head meta", "attr": "charset"},
        {"name": "missing", "selector": ".ad", "attr": "data-none"},
    ]
    return pages.extract_rows(_pages(spark, sf), rules, keep=["page_id"]).drop("row")


@query(
    "w5_paged_urls",
    """WITH src AS (SELECT page_id, CASE WHEN page_id % 2 = 0 THEN concat(url, '&p={page}') ELSE url END AS url, page_id % 4 AS last FROM pages)
    SELECT page_id, n AS page_number, CASE WHEN contains(url, '{page}') THEN replace(url, '{page}', n::VARCHAR)
        ELSE concat(url, CASE WHEN contains(url, '?') THEN '&' ELSE '?' END, 'page=', n) END AS page_url
    FROM (SELECT *, unnest(range(1, last + 1)) AS n FROM src)""",
)
def w5(spark, sf):
    patterns = table(spark, sf, "pages").select(
        "page_id",
        F.when(F.col("page_id") % 2 == 0, F.concat("url", F.lit("&p={page}"))).otherwise(F.col("url")).alias("url"),
        (F.col("page_id") % 4).alias("last"),
    )
    return pages.paged_urls(patterns, start=F.lit(1).cast("bigint"), end=F.col("last")).select("page_id", "page_number", "page_url")


# payloads of every shape: a list under two keys, a bare list, one object
_SHAPES = """SELECT event_id, CASE event_id % 4
    WHEN 0 THEN concat('{"data": [', item, ', ', item, ']}') WHEN 1 THEN concat('{"total": 1, "results": [', item, ']}')
    WHEN 2 THEN concat('[', item, ', ', item, ', ', item, ']') ELSE item END AS payload, n, event_type, k
    FROM (SELECT event_id, event_type, concat('{"kind": "', event_type, '", "k": ', k, '}') AS item, k, CASE event_id % 4 WHEN 0 THEN 2 WHEN 1 THEN 1 WHEN 2 THEN 3 ELSE 1 END AS n
        FROM (SELECT event_id, event_type, regexp_extract(props, '([0-9]+)', 1) AS k FROM events) AS p) AS e"""


def _payloads(spark, sf):
    return sql_over(spark, _SHAPES, {"events": table(spark, sf, "events")}).select("event_id", "payload")


@query("w6_payload_rows", f"SELECT event_id, unnest(range(n)) AS \"row\", event_type AS kind, k FROM ({_SHAPES})", row="INTEGER")
def w6(spark, sf):
    return pages.payload_rows(_payloads(spark, sf), "payload", fields=["kind", "k"])


@query("w6_payload_positional", f"SELECT event_id, unnest(range(n)) AS \"row\", event_type AS field_0, k AS field_1 FROM ({_SHAPES})", row="INTEGER")
def w6_positional(spark, sf):
    return pages.payload_rows(_payloads(spark, sf), "payload", positional=2)


# two records of different keys in each list; one key holds whole numbers and fractions, one a nested record
_KEYS = """SELECT event_id, user_id, event_type, k, concat('[{"kind": "', event_type, '", "k": ', k, '}, {"at": {"user": ', CAST(user_id AS STRING), ', "tags": ["', event_type, '", "x"]}, "k": ', k, '.5}]') AS payload
    FROM (SELECT event_id, user_id, event_type, regexp_extract(props, '([0-9]+)', 1) AS k FROM events) AS p"""


@query(
    "w6_payload_records",
    f"""SELECT event_id, 0 AS "row", event_type AS kind, CAST(k AS DOUBLE) AS k, NULL::BIGINT AS at_user, NULL::VARCHAR AS first_tag FROM ({_KEYS})
    UNION ALL SELECT event_id, 1, NULL, CAST(concat(k, '.5') AS DOUBLE), user_id, event_type FROM ({_KEYS})""",
    row="INTEGER", at_user="BIGINT",
)
def w6_records(spark, sf):
    payloads = sql_over(spark, _KEYS, {"events": table(spark, sf, "events")}).select("event_id", "payload")
    rows = pages.payload_records(payloads, "payload")
    return rows.select(
        "event_id", "row", "record.kind", "record.k", F.col("record.at.user").alias("at_user"), F.get("record.at.tags", F.lit(0)).alias("first_tag")
    )


# page addresses, some moved to known hosts, API hosts, share links and unsafe targets
_URLS = """SELECT page_id, CASE page_id % 14 WHEN 0 THEN replace(url, 'https://', 'https://www.zhihu.com/') WHEN 1 THEN concat('https://m.toutiao.com/article/', CAST(page_id AS STRING), '/?share=1')
    WHEN 2 THEN concat('https://api.example.com/', CAST(page_id AS STRING)) WHEN 3 THEN concat(url, '.json') WHEN 4 THEN concat('http://127.0.0.1:80', CAST(page_id AS STRING), '/')
    WHEN 5 THEN concat('http://192.168.', CAST(page_id % 250 AS STRING), '.1/x') WHEN 6 THEN concat('ftp://example.com/', CAST(page_id AS STRING)) WHEN 7 THEN concat('http://user@10.0.0.', CAST(page_id % 250 AS STRING))
    WHEN 8 THEN concat('https://example.com/api/v', CAST(page_id AS STRING)) WHEN 9 THEN concat('http://[::1]/', CAST(page_id AS STRING)) WHEN 10 THEN concat('https://space.bilibili.com/', CAST(page_id AS STRING)) ELSE url END AS url FROM {pages}"""
_HOST = "lower(regexp_extract(url, '://([^/?#]*)', 1))"
_PLATFORM = f"""CASE WHEN regexp_matches({_HOST}, 'toutiao.com|今日头条|ixigua.com') THEN 'toutiao' WHEN regexp_matches({_HOST}, 'xiaohongshu.com|小红书') THEN 'xiaohongshu'
    WHEN regexp_matches({_HOST}, '(bilibili|zhihu|weibo|douyin|xueqiu|douban)[.]com') THEN regexp_extract({_HOST}, '(bilibili|zhihu|weibo|douyin|xueqiu|douban)[.]com', 1) END"""


@query("w7_platform", with_src(_URLS, f"SELECT page_id, url, {_PLATFORM} AS platform FROM src"))
def w7(spark, sf):
    return frame(spark, sf, _URLS).select("page_id", "url", urls.platform(F.col("url")).alias("platform"))


@query(
    "w8_fetch_mode",
    with_src(_URLS, f"""SELECT page_id, CASE WHEN {_PLATFORM} IS NOT NULL THEN 'autocli' WHEN contains(url, '/api/') OR starts_with({_HOST}, 'api.') OR ends_with(url, '.json') THEN 'api' ELSE 'static' END AS mode FROM src"""),
)
def w8(spark, sf):
    return frame(spark, sf, _URLS).select("page_id", urls.fetch_mode(F.col("url")).alias("mode"))


@query("w8_fetch_mode_preferred", with_src(_URLS, "SELECT page_id, 'browser' AS mode FROM src"))
def w8_preferred(spark, sf):
    return frame(spark, sf, _URLS).select("page_id", urls.fetch_mode(F.col("url"), "browser").alias("mode"))


@query(
    "w9_canonical_article",
    with_src(_URLS, "SELECT page_id, CASE WHEN regexp_matches(url, '/article/[0-9]+') THEN concat('https://www.toutiao.com/article/', regexp_extract(url, '/article/([0-9]+)', 1), '/') ELSE url END AS url FROM src"),
)
def w9(spark, sf):
    return frame(spark, sf, _URLS).select("page_id", urls.canonical_article(F.col("url")).alias("url"))


_TALLIED = "SELECT page_id, CASE WHEN page_id % 25 = 0 THEN NULL WHEN page_id % 25 = 1 THEN '<script>x</script>' ELSE html END AS html FROM {pages}"


@query(
    "w10_crawl_tally",
    f"""WITH good AS (SELECT page_id, count(*) AS n FROM ({_LINES}) WHERE page_id % 25 > 1 GROUP BY page_id)
    SELECT (SELECT count(*) FROM pages) AS total_pages, count(*) AS pages_ok, (SELECT count(*) FROM pages) - count(*) AS pages_fail, CAST(sum(n) AS BIGINT) AS total_rows FROM good""",
)
def w10(spark, sf):
    return pages.crawl_tally(pages.spread(frame(spark, sf, _TALLIED)))


@query(
    "w11_safe_urls",
    with_src(_URLS, r"""SELECT page_id, url FROM src WHERE regexp_matches(url, '^https?://') AND NOT regexp_matches(regexp_replace(regexp_replace(regexp_extract(url, '://([^/?#]*)', 1), '^.*@', ''), '^\[', ''),
        '^(127\.|10\.|172\.(1[6-9]|2[0-9]|3[01])\.|192\.168\.|169\.254\.|0\.|::1|fe80:|fc00:)')"""),
)
def w11(spark, sf):
    return frame(spark, sf, _URLS).where(urls.is_safe(F.col("url")))


_STEPS = {
    "dedup": clean.drop_duplicates,
    "trim": clean.trim_strings,
    "per_status": lambda df: df.groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"), F.count("o_totalprice").alias("priced")),
}


@query("x1_chain", with_src(ORDERS, "SELECT o_orderstatus, count(*) AS n, count(o_totalprice) AS priced FROM (SELECT DISTINCT * FROM src) GROUP BY ALL"))
def x1(spark, sf):
    return chain.run_chain(frame(spark, sf, ORDERS), ["dedup", "trim", "per_status"], _STEPS)


@query(
    "x2_input_contract",
    with_src(MIXED, r"""SELECT 'missing_field' AS "column", 'missing' AS issue, count(*) AS n FROM src
        UNION ALL SELECT 'reading', 'not integer', count_if(NOT regexp_matches(reading, '^[0-9]+$')) FROM src
        UNION ALL SELECT 'event_type', 'not number', count(*) FROM src"""),
    n="BIGINT",
)
def x2(spark, sf):
    schema = {
        "properties": {"event_id": {"type": "integer"}, "reading": {"type": "integer"}, "event_type": {"type": "number"}, "user_no": {"type": "integer"}},
        "required": ["event_id", "missing_field"],
    }
    return chain.input_violations(frame(spark, sf, MIXED), schema)
