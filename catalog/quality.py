"""Quality queries: one per dimension, then levels, tiers and snapshots."""

from pyspark.sql import functions as F

from catalog.inputs import MIXED, ORDERS, PEOPLE, frame, per_column, q_date, q_outside, table, with_src
from catalog.registry import ORACLES, query
from tablewright.operators import clean, profile, quality
from tablewright.plans import prepare
from tablewright.session import scratch_path
from tablewright.sources import runs

AS_OF = "2024-06-30"
ORDERS_AS_OF = "1999-01-01"
_PEOPLE = "cust_id name phone email id_card bank_card address amount status created_date".split()
_ORDERS = "o_orderkey o_custkey o_orderstatus o_totalprice o_orderdate o_orderpriority".split()
_NUMBERS = ["o_orderkey", "o_custkey", "o_totalprice"]


def _filled(columns):
    return " + ".join(f"count({c})" for c in columns)


_EMAIL = r"^[\p{L}\p{N}_.-]+@[\p{L}\p{N}_.-]+\.[\p{L}\p{N}_]+$"
_AGE = f"date_diff('day', {q_date('created_date')}, DATE '{AS_OF}')"
_DUPLICATES = "((SELECT count(*) FROM src) - (SELECT count(*) FROM (SELECT DISTINCT * FROM src)))"


def _score(name, metric, sql, text, as_of=AS_OF):
    @query(name, with_src(text, f"SELECT '{metric}' AS metric, CAST(round({sql}, 1) AS DOUBLE) AS score FROM src"))
    def run(spark, sf):
        return quality.quality_scores(frame(spark, sf, text), as_of).where(F.col("metric") == metric).select("metric", "score")


_COMPLETENESS = f"(1 - (count(*) * 10 - ({_filled(_PEOPLE)})) / CAST(count(*) * 10 AS DOUBLE)) * 100"
_VALIDITY = (
    f"(count_if(coalesce(regexp_matches(phone, '^1[0-9]{{10}}$'), false)) + count_if(coalesce(regexp_matches(email, '{_EMAIL}'), false))) * 100.0 / (count(*) * 2)"
)
_TIMELINESS = f"count_if(coalesce({_AGE} <= 365, false)) * 100.0 / count(*)"
_ACCURACY_ORDERS = f"(1 - ({' + '.join(q_outside(c, 'src') for c in _NUMBERS)}) / CAST(count(*) * 6 AS DOUBLE)) * 100"
_score("q_completeness", "completeness", _COMPLETENESS, PEOPLE)
_score("q_accuracy", "accuracy", _ACCURACY_ORDERS, ORDERS)
_score("q_timeliness", "timeliness", _TIMELINESS, PEOPLE)
_score("q_uniqueness", "uniqueness", f"(1 - {_DUPLICATES} / CAST(count(*) AS DOUBLE)) * 100", ORDERS)
_score("q_validity", "validity", _VALIDITY, PEOPLE)

_CLASS = r"CASE WHEN regexp_matches({0}, '^[+-]?[0-9]+$') THEN 'i' WHEN regexp_matches({0}, '^[+-]?[0-9]+\.[0-9]*$') THEN 'f' ELSE 's' END"
_MIXED_TEXT = ["event_type", "reading", "user_no"]
_score(
    "q_consistency", "consistency",
    "(1 + " + " + ".join(f"(count(DISTINCT {_CLASS.format(c)}) <= 1)::INT" for c in _MIXED_TEXT) + ") * 100.0 / 4", MIXED,
)

# all orders at once: six dimensions with the weighted overall score and its level
_LEVEL = """CASE WHEN overall >= 95 THEN '优化级(5)' WHEN overall >= 85 THEN '量化管理级(4)' WHEN overall >= 70 THEN '稳健级(3)'
    WHEN overall >= 50 THEN '受管理级(2)' ELSE '初始级(1)' END"""


@query(
    "q_overall",
    with_src(ORDERS, f""", d AS (SELECT
        round((1 - (count(*) * 6 - ({_filled(_ORDERS)})) / CAST(count(*) * 6 AS DOUBLE)) * 100, 1) AS completeness,
        round({_ACCURACY_ORDERS}, 1) AS accuracy, 100.0::DOUBLE AS consistency,
        round(count_if(date_diff('day', o_orderdate::DATE, DATE '{ORDERS_AS_OF}') <= 365) * 100.0 / count(*), 1) AS timeliness,
        round((1 - {_DUPLICATES} / CAST(count(*) AS DOUBLE)) * 100, 1) AS uniqueness, 100.0::DOUBLE AS validity FROM src),
    o AS (SELECT *, 0.25::DOUBLE * completeness + 0.25::DOUBLE * accuracy + 0.15::DOUBLE * consistency + 0.1::DOUBLE * timeliness + 0.15::DOUBLE * uniqueness + 0.1::DOUBLE * validity AS overall FROM d)
    SELECT t.metric, t.score, t.level FROM o, LATERAL (VALUES ('completeness', completeness, NULL), ('accuracy', accuracy, NULL),
        ('consistency', consistency, NULL), ('timeliness', timeliness, NULL), ('uniqueness', uniqueness, NULL),
        ('validity', validity, NULL), ('overall', round(overall, 1), {_LEVEL})) AS t(metric, score, level)""".lstrip()),
)
def q_overall(spark, sf):
    return quality.quality_scores(frame(spark, sf, ORDERS), ORDERS_AS_OF)


@query(
    "q_maturity_level",
    """SELECT p_partkey, CASE WHEN p_size * 2.0 >= 95 THEN '优化级(5)' WHEN p_size * 2.0 >= 85 THEN '量化管理级(4)' WHEN p_size * 2.0 >= 70 THEN '稳健级(3)'
        WHEN p_size * 2.0 >= 50 THEN '受管理级(2)' ELSE '初始级(1)' END AS level FROM part""",
)
def q_level(spark, sf):
    return table(spark, sf, "part").select("p_partkey", quality.maturity_level(F.col("p_size") * 2.0).alias("level"))


@query(
    "q_below_threshold",
    with_src(ORDERS, f"""SELECT metric, score, threshold FROM (
        SELECT 'completeness' AS metric, round((1 - (count(*) * 6 - ({_filled(_ORDERS)})) / CAST(count(*) * 6 AS DOUBLE)) * 100, 1) AS score, 95.0::DOUBLE AS threshold FROM src
        UNION ALL SELECT 'accuracy', round({_ACCURACY_ORDERS}, 1), 90 FROM src
        UNION ALL SELECT 'uniqueness', round((1 - {_DUPLICATES} / CAST(count(*) AS DOUBLE)) * 100, 1), 98 FROM src) WHERE score < threshold"""),
)
def q_below(spark, sf):
    scores = quality.quality_scores(frame(spark, sf, ORDERS), ORDERS_AS_OF)
    return quality.below_threshold(scores).select("metric", "score", "threshold")


def _tier(c):
    pct = f"((count(*) - count({c})) * 100.0 / count(*))"
    fill = "'fill_mode'" if c in ("status", "category") else "'fill_median'"
    return f"""SELECT '{c}' AS "column", 'null_fill' AS issue, CASE WHEN {pct} < 10 THEN 'auto' WHEN {pct} < 30 THEN 'rule' ELSE 'manual' END AS severity,
        count(*) - count({c}) AS n, round({pct}, 1) AS pct, CASE WHEN {pct} < 10 THEN {fill} WHEN {pct} < 30 THEN 'fill_by_business_rule'
        ELSE 'manual_review: high null rate' END AS action FROM src HAVING count(*) > count({c})"""


def _outlier_tier(c):
    return f"""SELECT '{c}' AS "column", 'outliers' AS issue, 'rule' AS severity, {q_outside(c, 'src')} AS n, NULL::DOUBLE AS pct, 'iqr_clip_or_flag' AS action"""


_FORMATS = {"phone": "^1[0-9]{10}$", "email": _EMAIL, "id_card": "^[0-9]{17}[0-9Xx]$"}


def _format_tier(c):
    return f"""SELECT '{c}' AS "column", 'format_violation' AS issue, 'manual' AS severity, count_if(NOT regexp_matches({c}, '{_FORMATS[c]}')) AS n,
        NULL::DOUBLE AS pct, 'manual_review: data integrity' AS action FROM src"""


@query(
    "q_repair_tiers_people",
    with_src(PEOPLE, per_column(_PEOPLE, _tier) + " UNION ALL SELECT * FROM (" + per_column(["cust_id", "amount"], _outlier_tier)
             + ") WHERE n > 0 UNION ALL SELECT * FROM (" + per_column(_FORMATS, _format_tier) + ") WHERE n > 0"),
    n="BIGINT",
)
def q_tiers_people(spark, sf):
    return quality.repair_tiers(frame(spark, sf, PEOPLE))


@query(
    "q_repair_tiers",
    with_src(ORDERS, per_column(_ORDERS, _tier) + " UNION ALL SELECT * FROM (" + per_column(_NUMBERS, _outlier_tier) + ") WHERE n > 0"),
)
def q_tiers(spark, sf):
    return quality.repair_tiers(frame(spark, sf, ORDERS))


@query("c20_assess_tiers", ORACLES["q_repair_tiers"])
def c20_tiers(spark, sf):
    return prepare.clean_and_assess(frame(spark, sf, ORDERS), "orders", "2026-01-01")["tiers"]


@query("c20_assess_data", ORACLES["c20_full_clean"])
def c20_data(spark, sf):
    return prepare.clean_and_assess(frame(spark, sf, ORDERS), "orders", "2026-01-01")["data"]


@query(
    "q_column_profile",
    with_src(PEOPLE, per_column(_PEOPLE, lambda c: f"""SELECT '{c}' AS "column", '{dict(cust_id="integer", amount="float").get(c, "string")}' AS dtype,
        count(*) AS "rows", count(*) - count({c}) AS nulls, round((count(*) - count({c})) * 100.0 / count(*), 1) AS null_pct, count(DISTINCT {c}) AS "distinct",
        {q_outside(c, 'src') if c in ('cust_id', 'amount') else 0} AS outliers,
        {f"count_if(NOT regexp_matches({c}, '{_FORMATS[c]}'))" if c in _FORMATS else 0} AS format_violations FROM src""")),
    format_violations="BIGINT",
)
def q_profile(spark, sf):
    return profile.column_profile(frame(spark, sf, PEOPLE))


_SNAPSHOT = """SELECT TIMESTAMP '2026-01-01 00:00:00' AS ts, '{s}' AS source, (SELECT count(*) FROM (SELECT DISTINCT * FROM src)) AS "rows",
    (SELECT count(*) FROM (SELECT DISTINCT * FROM src)) - (SELECT count(*) FROM src) AS delta,
    left(sha256('{names}'), 8) AS schema_hash, {n} AS "columns", 'healthy' AS health"""


@query("q_snapshot", with_src(ORDERS, _SNAPSHOT.format(s="orders", names=",".join(sorted(_ORDERS)), n=6)), columns="BIGINT")
def q_snapshot(spark, sf):
    orders = frame(spark, sf, ORDERS)
    return quality.snapshot(orders, clean.drop_duplicates(orders), "orders", "2026-01-01 00:00:00")


@query(
    "q_run_history",
    with_src(ORDERS, f""", d AS (SELECT count(*) AS n FROM (SELECT DISTINCT * FROM src)), s AS (SELECT count(*) AS n FROM src)
    SELECT TIMESTAMP '2026-01-01 00:00:00' AS ts, 'orders' AS source, d.n AS "rows", d.n - s.n AS delta, left(sha256('{",".join(sorted(_ORDERS))}'), 8) AS schema_hash,
        6 AS "columns", 'healthy' AS health, NULL::BIGINT AS previous_rows, NULL::BIGINT AS row_change, NULL::BOOLEAN AS schema_changed FROM d, s
    UNION ALL SELECT TIMESTAMP '2026-01-02 00:00:00', 'orders', s.n, 0, left(sha256('{",".join(sorted(set(_ORDERS) - {"o_orderdate"}))}'), 8), 5, 'healthy', d.n, s.n - d.n, true FROM d, s""".lstrip()),
    columns="BIGINT", delta="BIGINT",
)
def q_history(spark, sf):
    orders, path = frame(spark, sf, ORDERS), scratch_path(spark, "runs")
    runs.append_run(quality.snapshot(orders, clean.drop_duplicates(orders), "orders", "2026-01-01 00:00:00"), path)
    runs.append_run(quality.snapshot(orders, orders.drop("o_orderdate"), "orders", "2026-01-02 00:00:00"), path)
    return runs.run_changes(runs.read_runs(spark, path)).drop("run", "previous_run")


@query(
    "q_schema_hash",
    """SELECT 'orders' AS source, left(sha256('o_custkey,o_orderdate,o_orderkey,o_orderpriority,o_orderstatus,o_totalprice'), 8) AS schema_hash, count(*) AS "rows" FROM orders
    UNION ALL SELECT 'customer', left(sha256('c_acctbal,c_custkey,c_mktsegment,c_name,c_nationkey'), 8), count(*) FROM customer""",
)
def q_hash(spark, sf):
    parts = []
    for name in ("orders", "customer"):
        df = table(spark, sf, name)
        parts.append(quality.snapshot(df, df, name, "2026-01-01 00:00:00").select("source", "schema_hash", "rows"))
    return parts[0].unionByName(parts[1])


def _spread(c):
    q = lambda p: f"percentile_disc({p}) WITHIN GROUP (ORDER BY {c} DESC)"
    return f"""SELECT '{c}' AS "column", min({c})::DOUBLE AS "min", {q(0.75)}::DOUBLE AS p25, {q(0.5)}::DOUBLE AS p50, {q(0.25)}::DOUBLE AS p75,
        max({c})::DOUBLE AS "max", round(avg({c}), 2) AS mean FROM lineitem"""


_NUMERIC = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query("q_distribution", per_column(_NUMERIC, _spread))
def q_distribution(spark, sf):
    return profile.numeric_distribution(table(spark, sf, "lineitem"), _NUMERIC)
