"""Integration queries."""

from pyspark.sql import functions as F

from catalog.inputs import frame, table, twin
from catalog.registry import query
from tablewright.operators import integrate
from tablewright.plans import prepare
from tablewright.session import scratch_path
from tablewright.sources import layers

# two sources with a shared key; the second has several rows per key, and keys the first lacks
_A = "SELECT c_custkey AS cust_id, c_name AS name, CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE c_mktsegment END AS tier FROM {customer}"
_B = """SELECT CASE WHEN o_orderkey % 50 = 0 THEN NULL ELSE o_custkey + 100 END AS cust_id, o_orderpriority AS tier, o_totalprice AS amount, o_orderdate AS ordered, o_orderkey
FROM {orders}"""
_ORDER = lambda: [F.col("ordered"), F.col("o_orderkey")]
_WITH = f"WITH a AS ({twin(_A)}), b AS ({twin(_B)})"
_UNION = """SELECT cust_id, name, tier, NULL::DOUBLE AS amount, NULL::TIMESTAMP AS ordered, NULL::BIGINT AS o_orderkey FROM a
UNION ALL SELECT cust_id, NULL, tier, amount, ordered, o_orderkey FROM b"""


def _sources(spark, sf):
    return frame(spark, sf, _A), frame(spark, sf, _B)


@query("i1_align", f"""{_WITH} SELECT 1 AS source, cust_id, name, tier, NULL::DOUBLE AS amount, NULL::TIMESTAMP AS ordered, NULL::BIGINT AS o_orderkey FROM a
    UNION ALL SELECT 2, cust_id, NULL, tier, amount, ordered, o_orderkey FROM b""")
def i1(spark, sf):
    first, second = integrate.align(list(_sources(spark, sf)))
    return first.withColumn("source", F.lit(1)).union(second.withColumn("source", F.lit(2)).select("cust_id", "name", "tier", "amount", "ordered", "o_orderkey", "source"))


@query("i2_union", f"{_WITH} {_UNION}")
def i2(spark, sf):
    return integrate.union_all(list(_sources(spark, sf)))


_LAST = "(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY cust_id ORDER BY ordered DESC, o_orderkey DESC) AS place FROM b) WHERE place = 1)"
_JOINED = f"SELECT a.cust_id, a.name, coalesce(a.tier, l.tier) AS tier, l.amount, l.ordered, l.o_orderkey FROM a {{}} JOIN {_LAST} AS l ON a.cust_id IS NOT DISTINCT FROM l.cust_id"


@query("i3_join", f"{_WITH} {_JOINED.format('INNER')}")
def i3(spark, sf):
    return integrate.join_sources(*_sources(spark, sf), "cust_id", _ORDER())


@query("i3_join_orders", f"""{_WITH} SELECT b.cust_id, coalesce(b.tier, a.tier) AS tier, b.amount, b.ordered, b.o_orderkey, a.name
    FROM b JOIN a ON a.cust_id IS NOT DISTINCT FROM b.cust_id""")
def i3_orders(spark, sf):
    a, b = _sources(spark, sf)
    return integrate.join_sources(b, a, "cust_id")


@query("i3_join_by_row_key", f"{_WITH} {_JOINED.format('INNER')}")
def i3_row_key(spark, sf):
    return integrate.join_sources(*_sources(spark, sf), "cust_id", _ORDER(), row_key="o_orderkey")


@query("i4_enrich", f"{_WITH} {_JOINED.format('LEFT')}")
def i4(spark, sf):
    return integrate.enrich(*_sources(spark, sf), "cust_id", _ORDER(), how="left")


@query(
    "i5_dedup",
    f"""{_WITH} SELECT cust_id, tier, amount, ordered, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY cust_id, tier ORDER BY ordered, o_orderkey) AS place FROM b) WHERE place = 1""",
)
def i5(spark, sf):
    return integrate.dedup_on(_sources(spark, sf)[1], ["cust_id", "tier", "unknown"], _ORDER())


@query(
    "i5_dedup_by_row_key",
    f"""{_WITH} SELECT cust_id, tier, amount, ordered, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY cust_id, tier ORDER BY ordered, o_orderkey) AS place FROM b) WHERE place = 1""",
)
def i5_row_key(spark, sf):
    return integrate.dedup_on(_sources(spark, sf)[1], ["cust_id", "tier", "unknown"], _ORDER(), "o_orderkey")


@query(
    "i6_integrate",
    f"""{_WITH}, u AS (SELECT 0 AS source, * FROM (SELECT cust_id, name, tier, NULL::DOUBLE AS amount, NULL::TIMESTAMP AS ordered, NULL::BIGINT AS o_orderkey FROM a)
        UNION ALL SELECT 1, cust_id, NULL, tier, amount, ordered, o_orderkey FROM b)
    SELECT cust_id, name, tier, amount, ordered, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY cust_id ORDER BY source, ordered, o_orderkey) AS place FROM u) WHERE place = 1""",
)
def i6(spark, sf):
    a, b = _sources(spark, sf)
    base = scratch_path(spark, "lake")
    layers.bronze_append(a, base, "crm", "2026-01-01")
    layers.bronze_append(b, base, "erp", "2026-01-01")
    prepare.integrate_to_silver(
        spark, base, ["crm", "erp"], "sales", "people", "union", dedup_keys=["cust_id"], order_by=_ORDER()
    )
    return layers.load(spark, base, "silver:sales/people")


# a third source, which only joins can lose
_C = "SELECT c_custkey AS cust_id, CAST(c_nationkey AS BIGINT) AS nation FROM {customer} WHERE c_custkey % 3 > 0"
_THREE = f"""{_WITH}, c AS ({twin(_C)}) SELECT j.cust_id, j.name, j.tier, j.amount, j.ordered, j.o_orderkey, c.nation
    FROM ({_JOINED}) AS j {{}} JOIN c ON j.cust_id IS NOT DISTINCT FROM c.cust_id"""


def _three(spark, sf, strategy, how):
    base = scratch_path(spark, "lake")
    for name, df in zip(("crm", "erp", "geo"), (*_sources(spark, sf), frame(spark, sf, _C))):
        layers.bronze_append(df, base, name, "2026-01-01")
    prepare.integrate_to_silver(spark, base, ["crm", "erp", "geo"], "sales", "people", strategy, "cust_id", order_by=_ORDER(), how=how)
    return layers.load(spark, base, "silver:sales/people")


@query("i6_join_three", _THREE.format("INNER", "INNER"))
def i6_join(spark, sf):
    return _three(spark, sf, "join", "inner")


@query("i6_enrich_three", _THREE.format("LEFT", "LEFT"))
def i6_enrich(spark, sf):
    return _three(spark, sf, "enrich", "left")


@query("i6_source_counts", "SELECT 'customer' AS source, count(*) AS n FROM customer UNION ALL SELECT 'orders', count(*) FROM orders")
def i6_counts(spark, sf):
    return integrate.source_counts({"customer": table(spark, sf, "customer"), "orders": table(spark, sf, "orders")})
