"""Lineage queries over edges recorded per document, conversation turn, event and part."""

from pyspark.sql import functions as F

from catalog.inputs import CHAINS, EDGES, frame, with_src
from catalog.registry import query
from tablewright.operators import lineage
from tablewright.session import scratch_path

_ID = "left(sha256(concat(source, '→', target)), 12) AS id"
_EDGE = f"SELECT {_ID}, source, target, operation, ts FROM src"

# four source columns per part, two of them renamed in the target
_PARTS = "SELECT concat('bronze:part/', CAST(p_partkey AS STRING)) AS source, concat('silver:part/', p_brand) AS target, TIMESTAMP '2026-01-01 00:00:00' AS ts FROM {part}"


def part_columns(spark, sf):
    names = lambda *xs: F.array(*[F.lit(x) for x in xs])
    return frame(spark, sf, _PARTS).select(
        "source", names("p_partkey", "p_name", "p_size", "p_type").alias("source_columns"),
        "target", names("part_key", "part_name").alias("target_columns"), F.lit("rename").alias("transform"), "ts",
    )


def _edges(spark, sf):
    return lineage.table_edges(frame(spark, sf, EDGES))


@query("n1_table_edges", with_src(EDGES, _EDGE))
def n1(spark, sf):
    path = scratch_path(spark, "edges")
    lineage.append_edges(_edges(spark, sf), path)
    return spark.read.parquet(path)


_COLUMNS = """SELECT left(sha256(concat(source, '.', c.s, '→', target, '.', c.t)), 12) AS id, source, c.s AS source_column, target, c.t AS target_column,
    'rename' AS transform, '' AS expression, ts FROM src, (VALUES ('p_partkey', 'part_key'), ('p_name', 'part_name'), ('p_size', 'p_size'), ('p_type', 'p_type')) AS c(s, t)"""


@query(
    "n2_column_edges",
    with_src(EDGES, """SELECT left(sha256(concat(source, '.text→', target, '.', operation)), 12) AS id, source, 'text' AS source_column, target, operation AS target_column,
        'compute' AS transform, 'text_key(text)' AS expression, ts FROM src"""),
)
def n2(spark, sf):
    columns = frame(spark, sf, EDGES).select(
        "source", F.lit("text").alias("source_column"), "target", F.col("operation").alias("target_column"),
        F.lit("compute").alias("transform"), F.lit("text_key(text)").alias("expression"), "ts",
    )
    return lineage.column_edges(columns)


@query("n3_column_edges_by_position", with_src(_PARTS, _COLUMNS))
def n3(spark, sf):
    return lineage.column_edges_by_position(part_columns(spark, sf))


@query("n4_upstream", with_src(EDGES, f"{_EDGE} WHERE target = 'silver:src7/en'"))
def n4(spark, sf):
    return lineage.upstream(_edges(spark, sf), "silver:src7/en")


@query("n5_downstream", with_src(EDGES, f"{_EDGE} WHERE source = 'silver:src7/en'"))
def n5(spark, sf):
    return lineage.downstream(_edges(spark, sf), "silver:src7/en")


def _walk(most=11):
    return f""", first AS (SELECT target, arg_min(source, (ts, source)) AS source FROM src GROUP BY target),
walk AS (SELECT target AS start, target AS at, target AS path, 1 AS nodes FROM first
    UNION ALL SELECT start, f.source, concat(f.source, ' → ', path), nodes + 1 FROM walk JOIN first f ON f.target = walk.at WHERE nodes < {most})
SELECT start AS "table", arg_max(path, nodes) AS path, max(nodes) AS nodes, arg_max(walk.at, nodes) NOT IN (SELECT target FROM first) AS complete FROM walk GROUP BY start"""


_WALK = _walk()


def _paths(spark, sf, text, most=11):
    edges = lineage.table_edges(frame(spark, sf, text))
    return lineage.full_paths(edges, edges.select(F.col("target").alias("table")).distinct(), most)


@query("n6_full_path", with_src(CHAINS, _WALK).replace("WITH src", "WITH RECURSIVE src"), nodes="BIGINT")
def n6(spark, sf):
    return _paths(spark, sf, CHAINS)


@query("n6_full_path_tables", with_src(EDGES, _WALK).replace("WITH src", "WITH RECURSIVE src"), nodes="BIGINT")
def n6_tables(spark, sf):
    return _paths(spark, sf, EDGES)


# all the way: 128 nodes are more than any user's events
@query("n6_full_path_whole", with_src(CHAINS, _walk(128)).replace("WITH src", "WITH RECURSIVE src"), nodes="BIGINT")
def n6_whole(spark, sf):
    return _paths(spark, sf, CHAINS, 128)


@query("n7_column_upstream", with_src(_PARTS, f"SELECT * FROM ({_COLUMNS}) WHERE target = 'silver:part/Brand#7' AND target_column = 'part_name'"))
def n7(spark, sf):
    columns = lineage.column_edges_by_position(part_columns(spark, sf))
    return lineage.column_upstream(columns, "silver:part/Brand#7", "part_name")


@query(
    "n8_mermaid",
    with_src(EDGES, """SELECT concat('    ', translate(source, ':/', '__'), '[', source, '] -->|', left(arg_min(operation, (ts, operation)), 8), '| ', translate(target, ':/', '__'), '[', target, ']') AS line,
        count(*) AS n FROM src GROUP BY source, target"""),
)
def n8(spark, sf):
    return lineage.mermaid_lines(_edges(spark, sf))


@query(
    "n9_stats",
    with_src(EDGES, """SELECT 'tables' AS metric, count(*) AS n FROM (SELECT source FROM src UNION SELECT target FROM src)
        UNION ALL SELECT 'table_edges', count(*) FROM src UNION ALL SELECT 'column_edges', 4 * count(*) FROM part
        UNION ALL SELECT concat('operation:', operation), count(*) FROM src GROUP BY operation"""),
)
def n9(spark, sf):
    return lineage.stats(_edges(spark, sf), lineage.column_edges_by_position(part_columns(spark, sf)))
