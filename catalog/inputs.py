"""Inputs derived from the given tables, as SQL texts that both engines run unchanged.

The tables hold no nulls, outliers, copies or personal data, so those are put in by expressions
over whole tables. ``frame`` runs a text on Spark, ``twin`` turns it into text for the other engine.
"""

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()

# nulls, outliers, exact copies (every row stays, some come twice)
ORDERS = """
SELECT o_orderkey, o_custkey, o_orderstatus,
       CASE WHEN o_orderkey % 7 = 0 THEN NULL WHEN o_orderkey % 97 = 0 THEN o_totalprice * 50 ELSE o_totalprice END AS o_totalprice,
       o_orderdate, o_orderpriority
FROM {orders}
JOIN (VALUES (0), (1)) AS copies(copy) ON copy <= CASE WHEN o_orderkey % 11 = 0 THEN 1 ELSE 0 END
"""

# two nullable numbers, some rows with both null; few columns, so that all-null rows exist
PRICES = """
SELECT CASE WHEN o_orderkey % 13 = 0 OR o_orderkey % 7 = 0 THEN NULL WHEN o_orderkey % 97 = 0 THEN o_totalprice * 50 ELSE o_totalprice END AS price,
       CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE o_orderkey % 500 END AS bucket,
       CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE o_orderstatus END AS status
FROM {orders}
"""

# personal data of every kind, with malformed, blank and missing cells
PEOPLE = """
SELECT c_custkey AS cust_id, c_name AS name,
       CASE WHEN c_custkey % 23 = 0 THEN NULL WHEN c_custkey % 29 = 0 THEN '  '
            WHEN c_custkey % 17 = 0 THEN substr(digits, 1, 6)
            WHEN c_custkey % 5 = 0 THEN concat(substr(digits, 1, 3), '-', substr(digits, 4, 4), '-', substr(digits, 8, 4))
            ELSE digits END AS phone,
       CASE WHEN c_custkey % 31 = 0 THEN NULL WHEN c_custkey % 19 = 0 THEN 'not-an-email'
            WHEN c_custkey % 4 = 0 THEN concat(' User', CAST(c_custkey AS STRING), '@Mail', CAST(c_custkey % 9 AS STRING), '.example.com')
            ELSE concat('u', CAST(c_custkey % 7 AS STRING), '@mail', CAST(c_custkey % 9 AS STRING), '.example.com') END AS email,
       CASE WHEN c_custkey % 37 = 0 THEN '12345' WHEN c_custkey % 41 = 0 THEN concat(lpad(CAST(c_custkey AS STRING), 17, '1'), 'X')
            ELSE lpad(CAST(c_custkey AS STRING), 18, '1') END AS id_card,
       CASE WHEN c_custkey % 43 = 0 THEN '6222 0000' WHEN c_custkey % 47 = 0 THEN '6222-0000-9' ELSE lpad(CAST(c_custkey AS STRING), 19, '6') END AS bank_card,
       CASE c_nationkey % 6 WHEN 0 THEN concat('广东省深圳市第', CAST(c_custkey AS STRING), '号') WHEN 1 THEN concat('北京朝阳区', c_name)
            WHEN 2 THEN concat('上海市', c_name) WHEN 3 THEN '杭州' WHEN 4 THEN concat(CAST(c_custkey AS STRING), ' Main Street') ELSE '' END AS address,
       c_acctbal AS amount, c_mktsegment AS status,
       CASE c_custkey % 4 WHEN 0 THEN '2024-02-29' WHEN 1 THEN concat('2023/', CAST(1 + c_custkey % 12 AS STRING), '/7') WHEN 2 THEN '20240131' ELSE 'bad' END AS created_date
FROM (SELECT *, concat('13', lpad(CAST(c_custkey AS STRING), 9, '0')) AS digits FROM {customer}) AS c
"""

# padded text and near copies of names
SEGMENTS = """
SELECT c_custkey, c_nationkey,
       CASE WHEN c_custkey % 3 = 0 THEN concat('  ', c_mktsegment, chr(9)) ELSE c_mktsegment END AS segment,
       CASE c_custkey % 4 WHEN 0 THEN concat('Firm ', CAST(c_custkey % 200 AS STRING), ' Limited')
            WHEN 1 THEN concat('FIRM  ', CAST((c_custkey - 1) % 200 AS STRING), ' Ltd!')
            WHEN 2 THEN concat(' firm ', CAST((c_custkey - 2) % 200 AS STRING), ', ltd.')
            ELSE concat('Street of ', c_name) END AS firm
FROM {customer}
"""

# order dates as text in several shapes
DATES = """
SELECT o_orderkey,
       CASE o_orderkey % 11 WHEN 0 THEN substr(CAST(o_orderdate AS STRING), 1, 10)
            WHEN 1 THEN replace(substr(CAST(o_orderdate AS STRING), 1, 10), '-', '/')
            WHEN 2 THEN replace(substr(CAST(o_orderdate AS STRING), 1, 10), '-', '')
            WHEN 3 THEN concat(substr(CAST(o_orderdate AS STRING), 1, 10), 'T08:30:00')
            WHEN 4 THEN concat(replace(substr(CAST(o_orderdate AS STRING), 1, 10), '-', '/'), ' 08:30:00')
            WHEN 5 THEN concat(substr(CAST(o_orderdate AS STRING), 1, 10), ' 08:30')
            WHEN 6 THEN concat(replace(substr(CAST(o_orderdate AS STRING), 1, 10), '-', ''), ' 083000')
            WHEN 7 THEN concat(substr('JanFebMarAprMayJunJulAugSepOctNovDec', CAST(3 * month(o_orderdate) - 2 AS INT), 3), ' ', CAST(day(o_orderdate) AS STRING), ', ', CAST(year(o_orderdate) AS STRING))
            WHEN 8 THEN concat(CAST(day(o_orderdate) AS STRING), ' ', substr('JanFebMarAprMayJunJulAugSepOctNovDec', CAST(3 * month(o_orderdate) - 2 AS INT), 3), ' ', CAST(year(o_orderdate) AS STRING), ' 08:30')
            WHEN 9 THEN concat(substr(CAST(o_orderdate AS STRING), 1, 10), ' at noon') ELSE 'bad' END AS order_date,
       concat('13', lpad(CAST(o_custkey AS STRING), CASE WHEN o_orderkey % 17 = 0 THEN 5 ELSE 9 END, '0')) AS mobile,
       concat('user', CAST(o_custkey AS STRING), '@Example.COM ') AS mail
FROM {orders}
"""

# one text column that mixes numbers, decimals and words
MIXED = """
SELECT event_id, event_type,
       CASE event_id % 3 WHEN 0 THEN CAST(event_id AS STRING) WHEN 1 THEN concat(CAST(event_id AS STRING), '.5') ELSE event_type END AS reading,
       CAST(user_id AS STRING) AS user_no
FROM {events}
"""

# table edges: one recording per document landing, per document cleaning and per conversation turn
EDGES = """
SELECT concat('bronze:', source) AS source, concat('silver:', source, '/', lang) AS target, 'integrate' AS operation,
       TIMESTAMP '2026-01-01 00:00:00' + CAST(doc_id % 1000 AS INT) * INTERVAL '1' SECOND AS ts
FROM {documents}
UNION ALL
SELECT concat('silver:', source, '/', lang), concat('gold:', lang), 'aggregate',
       TIMESTAMP '2026-01-02 00:00:00' + CAST(doc_id % 1000 AS INT) * INTERVAL '1' SECOND FROM {documents}
UNION ALL
SELECT concat('turn:', CAST(conv_id AS STRING), '/', CAST(turn AS STRING)), concat('turn:', CAST(conv_id AS STRING), '/', CAST(turn + 1 AS STRING)), role,
       TIMESTAMP '2026-01-03 00:00:00' FROM {conversations}
"""

# each user's events as a chain, longer than any path may grow
CHAINS = """
SELECT concat('event:', CAST(before AS STRING)) AS source, concat('event:', CAST(event_id AS STRING)) AS target, event_type AS operation,
       CAST(ts AS TIMESTAMP) AS ts
FROM (SELECT event_id, event_type, ts, lag(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM {events}) AS e
WHERE before IS NOT NULL
"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def frame(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    used = set(re.findall(r"\{(\w+)\}", text))
    return spark.sql(text, **{name: table(spark, sf_dir, name) for name in used})


def twin(text: str) -> str:
    return re.sub(r"\{(\w+)\}", r"\1", text)


# ---- pieces of SQL for the other engine ------------------------------------

_SPACE = r"[\s\x0b\x1c-\x1f\x{85}\p{Z}]"


def q_trim(x):
    return rf"regexp_replace({x}, '^{_SPACE}+|{_SPACE}+$', '', 'g')"


def q_blank(x):
    return f"({q_trim(x)} = '')"


def q_digits(x):
    return f"regexp_replace({x}, '[^0-9]', '', 'g')"


def q_key(x):
    key = rf"regexp_replace(lower({q_trim(x)}), '[^\p{{L}}\p{{N}}_\s\x0b\x1c-\x1f\x{{85}}\p{{Z}}]', '', 'g')"
    key = q_trim(rf"regexp_replace({key}, '{_SPACE}+', ' ', 'g')")
    for long, short in (
        ("limited", "ltd"), ("corporation", "corp"), ("incorporated", "inc"),
        ("company", "co"), ("street", "st"), ("avenue", "ave"),
    ):
        key = rf"regexp_replace({key}, '\b{long}\b', '{short}', 'g')"
    return key


def q_date(x):
    return (
        f"CASE WHEN regexp_matches({x}, ' at ') THEN NULL "
        f"WHEN regexp_matches({x}, '^[0-9]{{8}}( [0-9]{{6}})?$') THEN CAST(try_strptime(substr({x}, 1, 8), '%Y%m%d') AS DATE) "
        f"WHEN regexp_matches({x}, '^[A-Z]') THEN CAST(try_strptime({x}, '%b %d, %Y') AS DATE) "
        f"WHEN regexp_matches({x}, '^[0-9]+ [A-Z]') THEN CAST(try_strptime(regexp_extract({x}, '^[^ ]+ [^ ]+ [^ ]+'), '%d %b %Y') AS DATE) "
        f"WHEN regexp_matches({x}, '^[0-9]{{4}}/') THEN CAST(try_strptime(regexp_extract({x}, '^[^ ]+'), '%Y/%m/%d') AS DATE) "
        f"WHEN regexp_matches({x}, '^[0-9]{{1,2}}/') THEN CAST(try_strptime({x}, '%m/%d/%Y') AS DATE) "
        f"ELSE CAST(try_strptime(substr({x}, 1, 10), '%Y-%m-%d') AS DATE) END"
    )


def q_outside(x, source):
    """Count of values of x strictly outside the nearest-rank quartile fences."""
    low = f"(SELECT percentile_disc(0.75) WITHIN GROUP (ORDER BY {x} DESC) FROM {source})"
    high = f"(SELECT percentile_disc(0.25) WITHIN GROUP (ORDER BY {x} DESC) FROM {source})"
    return (
        f"(SELECT count(*) FROM {source} WHERE {x} < {low} - 1.5 * ({high} - {low}) OR {x} > {high} + 1.5 * ({high} - {low}))"
    )


def per_column(columns, piece, tail=""):
    """UNION ALL of one SELECT per column."""
    return "\nUNION ALL\n".join(piece(c) for c in columns) + tail


def with_src(text, body):
    return f"WITH src AS ({twin(text)})\n{body}"
