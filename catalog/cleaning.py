"""Cleaning queries."""

from pyspark.sql import functions as F

from catalog.inputs import (
    DATES, ORDERS, PEOPLE, PRICES, SEGMENTS, frame, per_column, q_date, q_digits, q_key, q_outside, q_trim, table, with_src,
)
from catalog.registry import query
from tablewright.functions import text as tx
from tablewright.operators import clean, profile
from tablewright.plans import prepare

_ORDER_TYPES = {
    "o_orderkey": "integer", "o_custkey": "integer", "o_orderstatus": "string", "o_totalprice": "float",
    "o_orderdate": "string", "o_orderpriority": "string",
}
_NUMBERS = ["o_orderkey", "o_custkey", "o_totalprice"]
_DUPLICATES = "(SELECT count(*) FROM src) - (SELECT count(*) FROM (SELECT DISTINCT * FROM src))"


@query(
    "c1_clean_profile",
    with_src(ORDERS, per_column(_ORDER_TYPES, lambda c: f"""SELECT '{c}' AS "column", '{_ORDER_TYPES[c]}' AS dtype, count(*) AS "rows", 6 AS "columns",
        count(*) - count({c}) AS nulls, {q_outside(c, 'src') if c in _NUMBERS else 0} AS outliers, {_DUPLICATES} AS duplicates FROM src""")),
    columns="BIGINT",
)
def c1(spark, sf):
    return profile.clean_profile(frame(spark, sf, ORDERS))


_LINE_NUMBERS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query("c3_outlier_count", per_column(_LINE_NUMBERS, lambda c: f"""SELECT '{c}' AS "column", {q_outside(c, 'lineitem')} AS outliers"""))
def c3(spark, sf):
    lines = table(spark, sf, "lineitem").select(*_LINE_NUMBERS)
    row = profile.outlier_counts(lines)
    return profile.to_long(row, [{"column": F.lit(c), "outliers": F.col(f"outliers_{i}")} for i, c in enumerate(_LINE_NUMBERS)])


@query("c4_duplicate_count", with_src(ORDERS, f"SELECT {_DUPLICATES} AS duplicates"))
def c4(spark, sf):
    return profile.duplicate_count(frame(spark, sf, ORDERS))


def _filled(fill):
    return with_src(ORDERS, f"""SELECT o_orderkey, o_custkey, o_orderstatus,
        round(coalesce(o_totalprice, ({fill})), 4) AS o_totalprice, o_orderdate, o_orderpriority FROM src""")


def _fill(spark, sf, strategy):
    filled = clean.fill_missing(frame(spark, sf, ORDERS), strategy)
    return filled.withColumn("o_totalprice", F.round("o_totalprice", 4))


_MEDIAN = "SELECT percentile_disc(0.5) WITHIN GROUP (ORDER BY o_totalprice DESC) FROM src"


@query("c5_fill_mean", _filled("SELECT avg(o_totalprice) FROM src"))
def c5(spark, sf):
    return _fill(spark, sf, "fill_mean")


@query("c6_fill_median", _filled(_MEDIAN))
def c6(spark, sf):
    return _fill(spark, sf, "fill_median")


_MODE = "SELECT o_totalprice FROM src WHERE o_totalprice IS NOT NULL GROUP BY o_totalprice ORDER BY count(*) DESC, o_totalprice LIMIT 1"


@query("c7_fill_mode", _filled(_MODE))
def c7(spark, sf):
    return _fill(spark, sf, "fill_mode")


def _bounded(columns, source="src"):
    """CTE with the interpolated fences of columns."""
    q = [f"quantile_cont({c}, {p}) AS {c}_{n}" for c in columns for n, p in (("q1", 0.25), ("q3", 0.75))]
    return f"(SELECT {', '.join(q)} FROM {source})"


def _inside(c):
    return (
        f"CASE WHEN {c} BETWEEN {c}_q1 - 1.5 * ({c}_q3 - {c}_q1) AND {c}_q3 + 1.5 * ({c}_q3 - {c}_q1) THEN {c} END AS {c}"
    )


@query(
    "c8_null_outliers",
    with_src(ORDERS, f"""SELECT {_inside('o_orderkey')}, {_inside('o_custkey')}, o_orderstatus, {_inside('o_totalprice')}, o_orderdate, o_orderpriority
        FROM src, {_bounded(_NUMBERS)} AS b"""),
)
def c8(spark, sf):
    return clean.null_outliers(frame(spark, sf, ORDERS))


@query(
    "c9_drop_empty_rows",
    with_src(PRICES, f"""SELECT * FROM (SELECT {_inside('price')}, {_inside('bucket')}, status FROM src, {_bounded(['price', 'bucket'])} AS b)
        WHERE price IS NOT NULL OR bucket IS NOT NULL OR status IS NOT NULL"""),
)
def c9(spark, sf):
    # the injected outliers make the drop happen
    return clean.null_outliers(frame(spark, sf, PRICES))


@query("c10_dedup", with_src(ORDERS, "SELECT DISTINCT * FROM src"))
def c10(spark, sf):
    return clean.drop_duplicates(frame(spark, sf, ORDERS))


@query("c11_trim_strings", with_src(SEGMENTS, f"SELECT c_custkey, c_nationkey, {q_trim('segment')} AS segment, {q_trim('firm')} AS firm FROM src"))
def c11(spark, sf):
    return clean.trim_strings(frame(spark, sf, SEGMENTS))


@query(
    "c12_near_text_dedup",
    with_src(SEGMENTS, f"""SELECT c_custkey, c_nationkey, segment, firm FROM (SELECT *, row_number() OVER (
        PARTITION BY concat_ws('|', {q_key('segment')}, {q_key('firm')}) ORDER BY c_custkey) AS place FROM src) WHERE place = 1"""),
)
def c12(spark, sf):
    return clean.near_text_dedup(frame(spark, sf, SEGMENTS), order_by=[F.col("c_custkey")])


@query(
    "c12_document_dedup",
    f"""SELECT doc_id, text, lang, source, n_chars FROM (SELECT *, row_number() OVER (PARTITION BY {q_key('text')} ORDER BY doc_id) AS place FROM documents) WHERE place = 1""",
)
def c12_documents(spark, sf):
    return clean.near_text_dedup(table(spark, sf, "documents"), ["text"], row_key="doc_id")


_SHARE = "avg(CASE WHEN length({0}) > 2 THEN 1.0 ELSE 0.0 END)"
_DOC_TEXTS = ["text", "lang", "source"]


@query(
    "c13_text_columns",
    per_column(_DOC_TEXTS, lambda c: f"""SELECT '{c}' AS "column", round({_SHARE.format(c)}, 4) AS share, {_SHARE.format(c)} > 0.3 AS is_text FROM documents"""),
)
def c13(spark, sf):
    return clean.text_columns(table(spark, sf, "documents"))


@query("c14_text_key", f"SELECT doc_id, sha256({q_key('text')}) AS key FROM documents UNION ALL SELECT * FROM ({with_src(SEGMENTS, f'SELECT c_custkey, sha256({q_key(chr(102) + chr(105) + chr(114) + chr(109))}) FROM src')})")
def c14(spark, sf):
    documents = table(spark, sf, "documents").select("doc_id", F.sha2(tx.text_key(F.col("text")), 256).alias("key"))
    firms = frame(spark, sf, SEGMENTS).select("c_custkey", F.sha2(tx.text_key(F.col("firm")), 256))
    return documents.union(firms)


@query(
    "c15_phone_digits",
    with_src(PEOPLE, f"SELECT cust_id, CASE WHEN regexp_matches({q_digits('phone')}, '^1[0-9]{{10}}$') THEN {q_digits('phone')} ELSE phone END AS phone FROM src"),
)
def c15(spark, sf):
    return frame(spark, sf, PEOPLE).select("cust_id", tx.phone_digits(F.col("phone")).alias("phone"))


@query("c16_email_text", with_src(PEOPLE, f"SELECT cust_id, lower({q_trim('email')}) AS email FROM src"))
def c16(spark, sf):
    return frame(spark, sf, PEOPLE).select("cust_id", tx.email_text(F.col("email")).alias("email"))


@query("c17_date_text", with_src(DATES, f"SELECT o_orderkey, coalesce(strftime({q_date('order_date')}, '%Y-%m-%d'), order_date) AS order_date FROM src"))
def c17(spark, sf):
    return frame(spark, sf, DATES).select("o_orderkey", tx.date_text(F.col("order_date")).alias("order_date"))


# fill with the upper median, null the outliers, drop copies, trim: the default chain as CTEs
_CHAIN = f"""
filled AS (SELECT o_orderkey, o_custkey, o_orderstatus,
    coalesce(o_totalprice, ({_MEDIAN})) AS o_totalprice, o_orderdate, o_orderpriority FROM src),
bounded AS (SELECT {_inside('o_orderkey')}, {_inside('o_custkey')}, o_orderstatus, {_inside('o_totalprice')}, o_orderdate, o_orderpriority
    FROM filled, {_bounded(_NUMBERS, 'filled')} AS b),
cleaned AS (SELECT DISTINCT * FROM bounded)
"""


@query(
    "c19_clean_report",
    with_src(ORDERS, f""", {_CHAIN},
    n AS (SELECT (SELECT count(*) FROM src) AS before, (SELECT count(*) FROM cleaned) AS after,
        (SELECT count(*) - count(o_totalprice) FROM src) AS nulls,
        (SELECT 3 * count(*) - count(o_orderkey) - count(o_custkey) - count(o_totalprice) FROM bounded) AS outliers)
    SELECT t.op, '*' AS "column", t.detail, CAST(t.n AS BIGINT) AS n, t.pct FROM n, LATERAL (VALUES
        ('rows_before', '', before, NULL), ('rows_after', '', after, NULL),
        ('rows_removed', '', before - after, round((before - after) * 100.0 / before, 1)),
        ('fill_missing', 'fill_median', nulls, NULL), ('remove_outliers', 'iqr', outliers, NULL),
        ('dedup', '', before - after, NULL), ('normalize_strings', '', 0, NULL)) AS t(op, detail, n, pct)""".lstrip()),
)
def c19(spark, sf):
    return prepare.clean_report(frame(spark, sf, ORDERS))


@query("c20_full_clean", with_src(ORDERS, f", {_CHAIN} SELECT * FROM cleaned"))
def c20(spark, sf):
    return prepare.clean(frame(spark, sf, ORDERS))


# keys beyond 2^53 and a decimal with more digits than a double: cleaning must not merge them
_WIDE = """SELECT o_orderkey + 9007199254740992 AS big_key, CAST(o_orderkey AS DECIMAL(20, 0)) * 100000000000000 + 12345678901234 AS wide,
    CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE CAST(o_custkey AS INT) END AS cust, o_orderstatus AS status
FROM {orders}"""


@query(
    "c20_clean_wide_keys",
    with_src(_WIDE, """SELECT big_key, CAST(wide AS VARCHAR) AS wide, coalesce(cust, (SELECT percentile_disc(0.5) WITHIN GROUP (ORDER BY cust DESC) FROM src)) AS cust, status FROM src"""),
)
def c20_wide(spark, sf):
    cleaned = prepare.clean(frame(spark, sf, _WIDE), prepare.CleanOptions(outlier_method="none"))
    return cleaned.withColumn("wide", F.col("wide").cast("decimal(38,0)").cast("string"))


@query("c20_clean_none", with_src(_WIDE, "SELECT big_key, CAST(wide AS VARCHAR) AS wide, cust, status FROM src"))
def c20_none(spark, sf):
    options = prepare.CleanOptions(missing_strategy="none", outlier_method="none")
    return prepare.clean(frame(spark, sf, _WIDE), options).withColumn("wide", F.col("wide").cast("decimal(38,0)").cast("string"))


@query(
    "c9_drop_all_null",
    with_src(PRICES, "SELECT price, bucket, status FROM src WHERE price IS NOT NULL OR bucket IS NOT NULL OR status IS NOT NULL"),
)
def c9_all_null(spark, sf):
    return clean.drop_empty_rows(frame(spark, sf, PRICES))


_PHONE = f"CASE WHEN regexp_matches({q_digits('phone')}, '^1[0-9]{{10}}$') THEN {q_digits('phone')} ELSE {q_trim('phone')} END"


@query(
    "c20_semantic_clean",
    with_src(PEOPLE, f"""SELECT cust_id, name, {_PHONE} AS phone, lower({q_trim('email')}) AS email,
        coalesce(strftime({q_date('created_date')}, '%Y-%m-%d'), created_date) AS created_date
        FROM (SELECT *, row_number() OVER (PARTITION BY {q_key('status')} ORDER BY cust_id) AS place FROM src) WHERE place = 1"""),
)
def c20_semantic(spark, sf):
    options = prepare.CleanOptions(
        missing_strategy="none", outlier_method="none", semantic=True, text_columns=["status"], order_by=[F.col("cust_id")]
    )
    cleaned = prepare.clean(frame(spark, sf, PEOPLE), options)
    return cleaned.select("cust_id", "name", "phone", "email", "created_date")
