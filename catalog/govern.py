"""Governance queries."""

from pyspark.sql import functions as F

from catalog.inputs import EDGES, MIXED, PEOPLE, frame, per_column, q_blank, q_date, table, with_src
from catalog.registry import query
from tablewright.operators import govern, lineage

AS_OF = "2024-06-30"
_PEOPLE = "cust_id name phone email id_card bank_card address amount status created_date".split()
_TYPES = {c: {"cust_id": "integer", "amount": "number"}.get(c, "string") for c in _PEOPLE}
_NAMES = {"name": "名称", "phone": "联系电话", "email": "电子邮箱", "address": "地址", "amount": "金额", "status": "状态"}
_TAGS = {
    "cust_id": ["PII-potential", "numeric"], "phone": ["PII"], "email": ["PII"], "id_card": ["PII-potential"],
    "amount": ["financial", "numeric"], "created_date": ["temporal"],
}
_EMAIL = r"[\p{L}\p{N}_.-]+@[\p{L}\p{N}_.-]+\.[\p{L}\p{N}_]+"


@query(
    "g1_catalog",
    with_src(PEOPLE, per_column(_PEOPLE, lambda c: f"""SELECT '{c}' AS "column", '{_NAMES.get(c, c)}' AS display_name, '{_TYPES[c]}' AS dtype,
        count({c}) < count(*) AS nullable, round((count(*) - count({c})) * 100.0 / count(*), 1) AS null_pct, count(DISTINCT {c}) AS "distinct",
        '{','.join(_TAGS.get(c, []))}' AS tags, (SELECT string_agg(v, ' | ' ORDER BY v) FROM (SELECT DISTINCT CAST({c} AS VARCHAR) AS v FROM src WHERE {c} IS NOT NULL ORDER BY v LIMIT 5)) AS samples
        FROM src""")),
)
def g1(spark, sf):
    return govern.catalog(frame(spark, sf, PEOPLE))


@query(
    "g2_tags",
    with_src(PEOPLE, " UNION ALL ".join(f"""SELECT '{c}' AS "column", '{t}' AS label, count({c}) AS n FROM src""" for c, ts in _TAGS.items() for t in ts)),
)
def g2(spark, sf):
    return govern.tags(frame(spark, sf, PEOPLE))


@query(
    "g4_glossary",
    with_src(PEOPLE, per_column(_PEOPLE, lambda c: f"""SELECT '{c}' AS technical_name, '{_NAMES.get(c, c)}' AS business_name,
        '{"mapped" if c in _NAMES else "unmapped"}' AS status, {100.0 * len(_NAMES) / len(_PEOPLE)}::DOUBLE AS coverage_pct, count({c}) AS n FROM src""")),
)
def g4(spark, sf):
    return govern.glossary(frame(spark, sf, PEOPLE))


_FILLED = " + ".join(f"count({c})" for c in _PEOPLE)
_SHARE = "count_if(regexp_matches({0}, '{1}')) * 100.0::DOUBLE / count({0})"
_PHONE = _SHARE.format("phone", "^1[0-9]{10}$")
_MAIL = _SHARE.format("email", f"^{_EMAIL}$")
_ID = _SHARE.format("id_card", "^[0-9]{17}[0-9Xx]$")
_DIMENSIONS = {
    "completeness": f"({_FILLED}) * 100.0::DOUBLE / (count(*) * 10)",
    "accuracy": f"least(100.0::DOUBLE, {_PHONE}, {_MAIL}, {_ID})",
    "uniqueness": "(SELECT count(*) FROM (SELECT DISTINCT * FROM src)) * 100.0::DOUBLE / count(*)",
    "freshness": f"count_if(coalesce(date_diff('day', {q_date('created_date')}, DATE '{AS_OF}') < 365, false)) * 100.0::DOUBLE / count(*)",
    "compliance": f"(count_if(regexp_matches(phone, '^1[0-9]{{10}}$')) + count_if(regexp_matches(email, '^{_EMAIL}$'))) * 100.0::DOUBLE / (count(phone) + count(email))",
    "documentation": "CASE WHEN count(*) > 0 THEN 60.0::DOUBLE END",
}


def _dimension(name, metric):
    @query(name, with_src(PEOPLE, f"SELECT '{metric}' AS metric, round({_DIMENSIONS[metric]}, 1) AS score FROM src"))
    def run(spark, sf):
        scores = govern.asset_score(frame(spark, sf, PEOPLE), AS_OF)
        return scores.where(F.col("metric") == metric).select("metric", "score")


for _name, _metric in (
    ("g5_completeness", "completeness"), ("g6_uniqueness", "uniqueness"), ("g7_freshness", "freshness"),
    ("g8_accuracy", "accuracy"), ("g10_compliance", "compliance"), ("g11_documentation", "documentation"),
):
    _dimension(_name, _metric)


@query("g9_consistency", with_src(MIXED, "SELECT 'consistency' AS metric, round(CASE WHEN count(DISTINCT regexp_matches(reading, '^[0-9]')) > 1 THEN 3 ELSE 4 END * 100.0 / 4, 1) AS score FROM src"))
def g9(spark, sf):
    return govern.asset_score(frame(spark, sf, MIXED), AS_OF).where("metric = 'consistency'").select("metric", "score")


# every text column of the table has values of one class only where the class test says so
_CLASS = r"""CASE WHEN regexp_matches({0}, '^\s*[+-]?[0-9]+\s*$') THEN 'i' WHEN regexp_matches({0}, '^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$') THEN 'f' WHEN {0} IS NOT NULL THEN 's' END"""
_UNIFORM = " + ".join(f"(count(DISTINCT {_CLASS.format(c)}) <= 1)::INT" for c in _PEOPLE if _TYPES[c] == "string")
_GRADE = "CASE WHEN overall >= 90 THEN 'A (卓越)' WHEN overall >= 75 THEN 'B (良好)' WHEN overall >= 60 THEN 'C (合格)' WHEN overall >= 40 THEN 'D (待改进)' ELSE 'F (不合格)' END"
_ALL = {**_DIMENSIONS, "consistency": f"(2 + {_UNIFORM}) * 100.0::DOUBLE / 10"}


@query(
    "g12_asset_score",
    with_src(PEOPLE, f""", d AS (SELECT {', '.join(f'{v} AS {k}' for k, v in _ALL.items())} FROM src),
    o AS (SELECT *, (completeness + accuracy + uniqueness + consistency + freshness + compliance + documentation) / 7 AS overall FROM d)
    SELECT t.metric, round(t.score, 1) AS score, t.grade FROM o, LATERAL (VALUES {', '.join(f"('{k}', {k}, NULL)" for k in _ALL)}, ('overall', overall, {_GRADE})) AS t(metric, score, grade)""".lstrip()),
)
def g12(spark, sf):
    return govern.asset_score(frame(spark, sf, PEOPLE), AS_OF)


def _contract_piece(c):
    rules = [("unique", "error")] if "id" in c else []
    rules += [("pattern:^1\\d{10}$", "warn")] if c == "phone" else []
    rows = [(f"'{r}'", f"'{s}'") for r, s in rules] or [("NULL", "NULL")]
    return " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", '{_TYPES[c]}' AS dtype, count({c}) < count(*) AS nullable, {r}::VARCHAR AS rule, {s}::VARCHAR AS severity FROM src""" for r, s in rows
    )


@query("g13_contract", with_src(PEOPLE, per_column(_PEOPLE, _contract_piece)))
def g13(spark, sf):
    return govern.contract(frame(spark, sf, PEOPLE))


_UNIQUE = "count({0}) - count(DISTINCT {0})"
_VALID = f"(SELECT {_UNIQUE.format('cust_id')} = 0 AND {_UNIQUE.format('id_card')} = 0 FROM src)"


@query(
    "g14_check_contract",
    with_src(PEOPLE, f"""SELECT 'cust_id' AS "column", 'unique' AS rule, 'error' AS severity, {_UNIQUE.format('cust_id')} AS n, {_VALID} AS valid FROM src
        UNION ALL SELECT 'id_card', 'unique', 'error', {_UNIQUE.format('id_card')}, {_VALID} FROM src
        UNION ALL SELECT 'phone', 'pattern:^1\\d{{10}}$', 'warn', count_if(NOT regexp_matches(phone, '^1[0-9]{{10}}$')), {_VALID} FROM src"""),
    n="BIGINT",
)
def g14(spark, sf):
    return govern.check_contract(frame(spark, sf, PEOPLE))


def _sensitive(c):
    seen = lambda p: f"bool_or(regexp_matches(CAST({c} AS VARCHAR), '{p}'))"
    id_card, mobile, email = seen(r"\b[0-9]{17}[0-9Xx]\b"), seen(r"\b1[3-9][0-9]{9}\b"), seen(rf"\b{_EMAIL}\b")
    by_name = {"id_card": "high_risk", "phone": "medium_risk", "email": "medium_risk"}.get(c, "safe")
    by_rule = "'name_inference'" if by_name != "safe" else "NULL"
    return f"""SELECT '{c}' AS "column", CASE WHEN {id_card} THEN 'high_risk' WHEN {mobile} OR {email} THEN 'medium_risk' ELSE '{by_name}' END AS label,
        CASE WHEN {id_card} THEN '身份证号' WHEN {mobile} THEN '手机号' WHEN {email} THEN '邮箱' ELSE {by_rule} END AS rule FROM src"""


@query("g15_sensitivity", with_src(PEOPLE, per_column(_PEOPLE, _sensitive)))
def g15(spark, sf):
    return govern.sensitivity(frame(spark, sf, PEOPLE))


@query("g15_sensitivity_documents", with_src("SELECT * FROM {documents}", per_column(["doc_id", "text", "lang", "source", "n_chars"], _sensitive)))
def g15_documents(spark, sf):
    return govern.sensitivity(table(spark, sf, "documents"))


# a third of the notes is missing or blank
_NOTES = "SELECT c_custkey, c_name, CASE c_custkey % 6 WHEN 0 THEN NULL WHEN 1 THEN ' ' ELSE c_mktsegment END AS note, CASE c_custkey % 9 WHEN 0 THEN NULL ELSE c_acctbal END AS balance FROM {customer}"


def _empty_share(c):
    n = f"count_if(coalesce({q_blank(f'CAST({c} AS VARCHAR)')}, true))"
    return f"""SELECT '{c}' AS "column", 'high_null_rate' AS issue, 'warning' AS severity, {n} AS n, round({n} * 100.0 / count(*), 1) AS pct, count(*) AS total FROM src"""


@query(
    "g16_audit",
    with_src(_NOTES, "SELECT \"column\", issue, severity, n, pct FROM (" + per_column(["c_custkey", "c_name", "note", "balance"], _empty_share) + ") AS t WHERE n > 0.2 * total"),
    n="BIGINT",
)
def g16(spark, sf):
    return govern.audit(frame(spark, sf, _NOTES))


_ISSUES = "(SELECT count(*) FROM (" + per_column(["c_custkey", "c_name", "note", "balance"], _empty_share) + ") AS t WHERE n > 0.2 * total)"


@query("g16_audit_verdict", with_src(_NOTES, f"SELECT 4 AS columns, {_ISSUES} AS issues, {_ISSUES} = 0 AS passed UNION ALL SELECT 2, 0, true"), columns="INTEGER")
def g16_verdict(spark, sf):
    dirty, clean = frame(spark, sf, _NOTES), table(spark, sf, "region")
    return govern.audit_verdict(dirty).union(govern.audit_verdict(clean))


_TABLE = "silver:src7/en"
_LINE = """concat('    ', translate(source, ':/', '__'), '[', source, '] -->|', left(arg_min(operation, (ts, operation)), 8), '| ', translate(target, ':/', '__'), '[', target, ']')"""


@query(
    "g17_lineage_report",
    with_src(EDGES, f"""SELECT 'upstream' AS section, source AS detail, count(*) AS n FROM src WHERE target = '{_TABLE}' GROUP BY source
        UNION ALL SELECT 'downstream', target, count(*) FROM src WHERE source = '{_TABLE}' GROUP BY target
        UNION ALL SELECT 'full_path', concat(arg_min(source, (ts, source)), ' → {_TABLE}'), 2 FROM src WHERE target = '{_TABLE}'
        UNION ALL SELECT 'mermaid', {_LINE}, count(*) FROM src WHERE source = '{_TABLE}' OR target = '{_TABLE}' GROUP BY source, target
        UNION ALL SELECT 'stats', 'tables', count(*) FROM (SELECT source FROM src UNION SELECT target FROM src)
        UNION ALL SELECT 'stats', 'table_edges', count(*) FROM src UNION ALL SELECT 'stats', 'column_edges', 4 * count(*) FROM part
        UNION ALL SELECT 'stats', concat('operation:', operation), count(*) FROM src GROUP BY operation"""),
)
def g17(spark, sf):
    from catalog.lineage import part_columns

    edges = lineage.table_edges(frame(spark, sf, EDGES))
    return lineage.report(edges, lineage.column_edges_by_position(part_columns(spark, sf)), _TABLE)
