"""Analysis queries."""

from pyspark.sql import functions as F

from catalog.inputs import ORDERS, PEOPLE, frame, per_column, table, twin, with_src
from catalog.registry import query
from tablewright.operators import profile
from tablewright.session import scratch_path
from tablewright.sources import layers


@query("a1_load_layers", "SELECT 'bronze' AS layer, count(*) AS n FROM customer UNION ALL SELECT 'silver', count(*) FROM orders UNION ALL SELECT 'gold', count(*) FROM nation")
def a1(spark, sf):
    base = scratch_path(spark, "lake")
    layers.bronze_append(table(spark, sf, "customer"), base, "crm", "2026-01-01")
    layers.silver_write(table(spark, sf, "orders"), base, "sales", "orders")
    layers.gold_write(table(spark, sf, "nation"), base, "nations")
    counts = [
        layers.load(spark, base, address).agg(F.count(F.lit(1)).alias("n")).select(F.lit(address.split(":")[0]).alias("layer"), "n")
        for address in ("bronze:crm", "silver:sales/orders", "gold:nations")
    ]
    return counts[0].unionByName(counts[1]).unionByName(counts[2])


def _summary(types, numbers, source):
    def piece(c):
        if c in numbers:
            spread = (
                f"min({c})::DOUBLE AS \"min\", max({c})::DOUBLE AS \"max\", round(avg({c}), 2)::DOUBLE AS mean, "
                f"(percentile_disc(0.5) WITHIN GROUP (ORDER BY {c} DESC))::DOUBLE AS median, NULL::BIGINT AS \"distinct\""
            )
        else:
            spread = f"NULL::DOUBLE AS \"min\", NULL::DOUBLE AS \"max\", NULL::DOUBLE AS mean, NULL::DOUBLE AS median, count(DISTINCT {c}) AS \"distinct\""
        return f"""SELECT '{c}' AS "column", '{types[c]}' AS dtype, count(*) AS "rows", count({c}) AS non_null,
            round((count(*) - count({c})) * 100.0 / count(*), 1) AS null_pct, {spread} FROM {source}"""

    return per_column(types, piece)


_ORDERS = {
    "o_orderkey": "integer", "o_custkey": "integer", "o_orderstatus": "string", "o_totalprice": "number",
    "o_orderdate": "string", "o_orderpriority": "string",
}


@query("a2_summary", with_src(ORDERS, _summary(_ORDERS, ["o_orderkey", "o_custkey", "o_totalprice"], "src")))
def a2(spark, sf):
    return profile.summary(frame(spark, sf, ORDERS))


_LINES = {
    "l_orderkey": "integer", "l_partkey": "integer", "l_suppkey": "integer", "l_linenumber": "integer", "l_quantity": "number",
    "l_extendedprice": "number", "l_discount": "number", "l_tax": "number", "l_returnflag": "string", "l_linestatus": "string",
    "l_shipdate": "string",
}


@query("a2_summary_lineitem", _summary(_LINES, list(_LINES)[:8], "lineitem"))
def a2_lineitem(spark, sf):
    return profile.summary(table(spark, sf, "lineitem"))


def _top(column, source, n):
    return f"""SELECT CAST({column} AS VARCHAR) AS value, count(*) AS n, (SELECT count({column}) FROM {source}) AS total,
        (SELECT count(DISTINCT {column}) FROM {source}) AS "distinct" FROM {source} WHERE {column} IS NOT NULL GROUP BY {column}
        ORDER BY n DESC, value LIMIT {n}"""


@query("a3_distribution", _top("user_id", "events", 20))
def a3(spark, sf):
    return profile.distribution(table(spark, sf, "events"), "user_id")


@query("a3_distribution_nulls", f"WITH src AS ({twin(PEOPLE)}) {_top('phone', 'src', 20)}")
def a3_nulls(spark, sf):
    return profile.distribution(frame(spark, sf, PEOPLE), "phone")


@query("a4_top_n", _top("p_brand", "part", 25))
def a4(spark, sf):
    return profile.top_n(table(spark, sf, "part"), "p_brand", 25)
