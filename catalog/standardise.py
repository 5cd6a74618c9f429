"""Standardisation queries."""

from pyspark.sql import functions as F

from catalog.inputs import DATES, PEOPLE, frame, per_column, q_date, q_digits, table, with_src
from catalog.registry import query
from tablewright.functions import hints
from tablewright.operators import standardize

# the built-in keywords are Chinese; the given texts are not, so a table of their own words is passed
_WORDS = {"transport": ["ship", "freight", "the"], "finance": ["bank", "price", "and"], "press": ["the", "and", "of"], "law": ["license"]}
_CJK = """SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN '银行 账户' WHEN 1 THEN concat('交易 ', c_name) ELSE '患者' END AS note_text FROM {customer}"""


def _hits(words, source, column):
    seen = lambda w: f"coalesce(bool_or(contains(lower({column}), '{w}')), false)::INT"
    rows = [
        f"SELECT {k} AS position, '{name}' AS industry, {' + '.join(map(seen, keys))} AS hits FROM {source}"
        for k, (name, keys) in enumerate(words.items())
    ]
    return " UNION ALL ".join(rows)


_DOC = "concat_ws(' ', text, lang, source)"


@query(
    "t1_industry",
    f"SELECT industry, CAST(hits AS BIGINT) AS hits, 'GB/T 43697-2024 数据分类分级规则(通用)' AS standard FROM ({_hits(_WORDS, 'documents', _DOC)}) ORDER BY hits DESC, position LIMIT 1",
)
def t1(spark, sf):
    return standardize.industry(table(spark, sf, "documents"), industries=_WORDS)


@query(
    "t1_industry_default",
    with_src(_CJK, f"SELECT industry, CAST(hits AS BIGINT) AS hits, 'JR/T 0197-2020 金融数据安全分级指南' AS standard FROM ({_hits(hints.INDUSTRIES, 'src', 'note_text')}) ORDER BY hits DESC, position LIMIT 1"),
)
def t1_default(spark, sf):
    return standardize.industry(frame(spark, sf, _CJK))


# the classes written out again: the twin must not read the table under test
_CLASSES = """id|编号|代码|code|编码=标识类
name|名称|title|标题|姓名=名称类
phone|电话|mobile|手机|email|邮箱|address|地址=联系信息类
date|日期|time|时间|created|updated=时间类
amount|金额|price|价格|cost|成本|fee|费用=金额类
status|状态|type|类型|category|分类=状态类
desc|描述|remark|备注|note|说明=描述类"""


def _class_sql(x):
    arms = " ".join("WHEN regexp_matches(lower({}), '{}') THEN '{}'".format(x, *line.split("=")) for line in _CLASSES.splitlines())
    return f"CASE {arms} ELSE '其他' END"


# names found in the data: event types, JSON keys of their properties, and words of documents
_NAMES = """
SELECT event_type AS name FROM {events} UNION ALL SELECT concat(role, '_', CASE turn % 4 WHEN 0 THEN 'id' WHEN 1 THEN 'name' WHEN 2 THEN 'created_at' ELSE 'fee' END) FROM {conversations}
UNION ALL SELECT concat(lang, '_', CASE doc_id % 6 WHEN 0 THEN 'price' WHEN 1 THEN '状态' WHEN 2 THEN '备注' WHEN 3 THEN 'Email' WHEN 4 THEN 'title' ELSE 'q' END) FROM {documents}
"""


@query("t2_field_class", with_src(_NAMES, f"SELECT name, {_class_sql('name')} AS label, count(*) AS n FROM src GROUP BY ALL"))
def t2(spark, sf):
    names = frame(spark, sf, _NAMES)
    return names.groupBy("name", standardize.field_class(F.col("name")).alias("label")).agg(F.count(F.lit(1)).alias("n"))


_PEOPLE_CLASSES = {
    "cust_id": "标识类", "name": "名称类", "phone": "联系信息类", "email": "联系信息类", "id_card": "标识类",
    "bank_card": "其他", "address": "联系信息类", "amount": "金额类", "status": "状态类", "created_date": "时间类",
}


@query("t2_field_classes", with_src(PEOPLE, per_column(_PEOPLE_CLASSES, lambda c: f"""SELECT '{c}' AS "column", '{_PEOPLE_CLASSES[c]}' AS label, count({c}) AS n FROM src""")))
def t2_table(spark, sf):
    return standardize.field_classes(frame(spark, sf, PEOPLE))


_INDUSTRY_OF = """SELECT c_custkey, CASE c_nationkey % 8 WHEN 0 THEN '工业' WHEN 1 THEN '金融' WHEN 2 THEN '电信' WHEN 3 THEN '政务' WHEN 4 THEN '能源' WHEN 5 THEN '医疗' ELSE '教育' END AS industry FROM {customer}"""


@query(
    "t3_industry_standard",
    with_src(_INDUSTRY_OF, """SELECT c_custkey, industry, CASE industry WHEN '工业' THEN 'SJ/T 12043-2025 工业数据分类分级指南'
        WHEN '金融' THEN 'JR/T 0197-2020 金融数据安全分级指南' WHEN '电信' THEN 'YD/T 4251-2023 电信大数据安全管控分类分级'
        WHEN '政务' THEN 'DB3212/T 1116-2022 政务数据安全分类分级指南' WHEN '能源' THEN 'DB14/T 3551-2025 能源数据安全保护分类分级指南'
        WHEN '医疗' THEN 'GB/T 39725-2020 健康医疗数据安全指南' ELSE 'GB/T 43697-2024 数据分类分级规则(通用)' END AS standard FROM src"""),
)
def t3(spark, sf):
    return frame(spark, sf, _INDUSTRY_OF).withColumn("standard", standardize.standard_of(F.col("industry")))


# an id number hides in a column whose name says nothing
_GRADED = f"SELECT p.*, concat(id_card, ' seen') AS remark FROM ({PEOPLE}) AS p"
_BY_NAME = {"id_card": "核心数据", "phone": "重要数据", "email": "重要数据", "bank_card": "重要数据"}
_GRADED_COLUMNS = [*_PEOPLE_CLASSES, "remark"]


def _grade(c):
    name = _BY_NAME.get(c, "一般数据")
    rule = "column_name" if c in _BY_NAME else "default"
    if name == "核心数据" or c in ("cust_id", "amount"):
        return f"""SELECT '{c}' AS "column", '{name}' AS label, '{rule}' AS rule"""
    seen = f"(SELECT bool_or(regexp_matches({c}, '^[0-9]{{17}}[0-9Xx]')) FROM src)"
    return f"""SELECT '{c}' AS "column", CASE WHEN {seen} THEN '核心数据' ELSE '{name}' END AS label, CASE WHEN {seen} THEN 'value' ELSE '{rule}' END AS rule"""


@query("t4_field_grades", with_src(_GRADED, per_column(_GRADED_COLUMNS, _grade)))
def t4(spark, sf):
    return standardize.field_grades(frame(spark, sf, _GRADED))


@query(
    "t5_table_grade",
    with_src(_GRADED, f""", g AS ({per_column(_GRADED_COLUMNS, _grade)})
    SELECT k.label, (SELECT count(*) FROM g WHERE g.label = k.label) AS n, k.label = '核心数据' AS is_table_grade
    FROM (VALUES ('核心数据'), ('重要数据'), ('一般数据')) AS k(label)""".lstrip()),
)
def t5(spark, sf):
    return standardize.table_grade(frame(spark, sf, _GRADED))


_BAD_DATE = f"count_if({q_date('order_date')} IS NULL AND order_date <> '')"
_BAD_PHONE = f"count_if(mobile <> '' AND NOT regexp_matches({q_digits('mobile')}, '^1[0-9]{{10}}$'))"


def _issue(column, issue, n, advice):
    return f"""SELECT '{column}' AS "column", '{issue}' AS issue, 'warning' AS severity, {n} AS n, round({n} * 100.0 / count(*), 1) AS pct, '{advice}' AS action FROM src"""


_DATE_ISSUE = _issue("order_date", "date_format", _BAD_DATE, hints.DATE_FORMAT_ADVICE)
_PHONE_ISSUE = _issue("mobile", "phone_format", _BAD_PHONE, hints.PHONE_FORMAT_ADVICE)


@query("t6_date_format", with_src(DATES, _DATE_ISSUE), n="BIGINT")
def t6(spark, sf):
    return standardize.format_issues(frame(spark, sf, DATES)).where("issue = 'date_format'")


@query("t7_phone_format", with_src(DATES, _PHONE_ISSUE), n="BIGINT")
def t7(spark, sf):
    return standardize.format_issues(frame(spark, sf, DATES)).where("issue = 'phone_format'")


@query(
    "t8_alignment_score",
    with_src(DATES, f""", i AS (SELECT * FROM ({_DATE_ISSUE} UNION ALL {_PHONE_ISSUE}) WHERE n > 0)
    SELECT greatest(0, least(100, 100 - 5 * count(*)))::DOUBLE AS score, CASE WHEN 100 - 5 * count(*) >= 95 THEN '优化级(5)' ELSE '量化管理级(4)' END AS level,
        concat('分类覆盖率仅50%; ', count(*), '个格式问题') AS notes FROM i""".lstrip()),
)
def t8(spark, sf):
    return standardize.alignment_score(frame(spark, sf, DATES))
