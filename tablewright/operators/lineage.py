"""Lineage as two edge tables: table edges and column edges."""

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.session import scratch_path

EDGE_SCHEMA = "id string, source string, target string, operation string, ts timestamp"
COLUMN_EDGE_SCHEMA = (
    "id string, source string, source_column string, target string, target_column string, "
    "transform string, expression string, ts timestamp"
)
MAX_PATH = 11  # by default a path that has grown past ten nodes stops
WINDOW = 16  # nodes of a way among which one is chosen to go on from


def _edge_id(text):
    return F.left(F.sha2(text, 256), F.lit(12))


def table_edges(df: DataFrame) -> DataFrame:
    """Edge rows from (source, target, operation, ts); every recording is a row of its own."""
    edge_id = _edge_id(F.concat("source", F.lit("→"), "target"))
    return df.select(edge_id.alias("id"), "source", "target", "operation", "ts")


def column_edges(df: DataFrame) -> DataFrame:
    """Edge rows from (source, source_column, target, target_column, transform, expression, ts)."""
    edge_id = _edge_id(
        F.concat("source", F.lit("."), "source_column", F.lit("→"), "target", F.lit("."), "target_column")
    )
    return df.select(
        edge_id.alias("id"), "source", "source_column", "target", "target_column", "transform", "expression", "ts"
    )


def column_edges_by_position(df: DataFrame) -> DataFrame:
    """Column edges from (source, source_columns, target, target_columns, transform, ts).

    Columns pair up by position; a source column without a partner keeps its name.
    """
    pairs = df.select(
        "source", "target", "target_columns", "transform", "ts", F.posexplode("source_columns").alias("_at", "source_column")
    )
    target = F.coalesce(F.get("target_columns", F.col("_at")), F.col("source_column"))
    return column_edges(pairs.withColumn("target_column", target).withColumn("expression", F.lit("")))


def append_edges(edges: DataFrame, path: str) -> None:
    """Append to a stored edge table."""
    edges.write.mode("append").parquet(path)


def upstream(edges: DataFrame, table: str) -> DataFrame:
    return edges.where(F.col("target") == table)


def downstream(edges: DataFrame, table: str) -> DataFrame:
    return edges.where(F.col("source") == table)


def column_upstream(edges: DataFrame, table: str, column: str) -> DataFrame:
    return edges.where((F.col("target") == table) & (F.col("target_column") == column))


def first_upstream(edges: DataFrame) -> DataFrame:
    """(target, source): the earliest recorded edge into each table, ties by source."""
    earliest = F.min(F.struct("ts", "source")).alias("first")
    return edges.groupBy("target").agg(earliest).select("target", F.col("first.source").alias("source"))


def _joined(ways: DataFrame, known: DataFrame) -> DataFrame:
    """Ways continued by the known way of the node that they have reached, if there is one."""
    on = known.select(F.col("node").alias("_at"), F.col("at").alias("_up"), F.col("way").alias("_way"))
    # many ways that meet in one ancestor are a skewed left side; files pack ways so well that their size says nothing on a broadcast
    way = F.when(F.col("_way").isNull(), F.col("way")).otherwise(F.concat("_way", "way"))
    return ways.join(on.hint("merge"), F.col("at") == F.col("_at"), "left").select("node", F.col("_up").alias("at"), way.alias("way"), "n")


def _written(ways: DataFrame) -> DataFrame:
    path = scratch_path(ways.sparkSession, "ways")
    ways.write.parquet(path)
    return ways.sparkSession.read.schema(ways.schema).parquet(path)


def _grown(ways: DataFrame, nodes: int) -> DataFrame:
    """Ways doubled until they end or have as many nodes; each is written once it does, and in every round before."""
    done, short = [], F.col("at").isNotNull() & (F.size("way") < nodes)
    for _ in range((nodes - 1).bit_length()):
        ways = _written(ways)
        left = ways.where(short)
        if left.isEmpty():
            break
        done.append(ways.where(~short))
        ways = _joined(left, reduce(DataFrame.unionByName, [left, *done]))
    return reduce(DataFrame.unionByName, [ways, *done])


def full_paths(edges: DataFrame, tables: DataFrame, max_nodes: int = MAX_PATH) -> DataFrame:
    """(table, path, nodes, complete): each table's chain of first upstream edges.

    ``tables`` has one column ``table``. A path ends where no edge leads further up; ``complete`` is
    false where it was cut at ``max_nodes`` instead, as a cycle always is. All tables walk at the
    same time and every round doubles the length of the known ways up, so eleven nodes take four
    joins. Where paths may be longer than ``WINDOW``, a way of so many nodes goes on from the one
    whose name has the least hash: neighbours mostly choose the same, so that only few ways
    are doubled further, and every other one is joined to one of those once.
    """
    wanted = tables.groupBy("table").agg(F.count(F.lit(1)).alias("n"))
    first = first_upstream(edges).select(F.col("target").alias("node"), F.col("source").alias("at"), F.array("source").alias("way"))
    ways = first.join(wanted, F.col("node") == F.col("table"), "full").select(
        F.coalesce("node", "table").alias("node"), "at", F.coalesce("way", F.array().cast("array<string>")).alias("way"), F.coalesce("n", F.lit(0)).alias("n"),
    )
    ways = _grown(ways, min(max_nodes, WINDOW))
    if max_nodes > WINDOW:
        is_open = F.col("at").isNotNull()
        least = F.array_min(F.transform("way", lambda x, i: F.struct(F.xxhash64(x).alias("hash"), i.alias("place"))))["place"]
        ways = ways.withColumn("_place", F.when(is_open, least).otherwise(0))
        ways = _written(ways.select(
            "node", F.when(is_open, F.get("way", "_place")).alias("at"), F.slice("way", F.col("_place") + 1, F.size("way") - F.col("_place")).alias("way"), "n"
        ))
        left = ways.where(is_open)
        chosen = left.select(F.col("at").alias("_chosen")).distinct()
        far = _grown(ways.join(chosen, F.col("node") == F.col("_chosen"), "left_semi"), max_nodes)
        ways = _joined(left, far).unionByName(ways.where(~is_open))
    # a way that is still open is longer than a path may be
    whole = F.concat("way", F.array("node"))
    path = F.slice(whole, F.greatest(F.size(whole) - max_nodes, F.lit(0)) + 1, F.lit(max_nodes))
    walk = ways.where("n > 0").select("node", path.alias("path"), (F.col("at").isNull() & (F.size(whole) <= max_nodes)).alias("complete"), "n")
    walk = walk.withColumn("_copy", F.explode(F.sequence(F.lit(1), "n")))
    return walk.select(
        F.col("node").alias("table"), F.array_join("path", " → ").alias("path"), F.size("path").cast("bigint").alias("nodes"), "complete"
    )


def full_path(edges: DataFrame, table: str, max_nodes: int = MAX_PATH) -> DataFrame:
    spark = edges.sparkSession
    return full_paths(edges, spark.createDataFrame([(table,)], "table string"), max_nodes)


def mermaid_lines(edges: DataFrame, table: str | None = None) -> DataFrame:
    """(line, n): one flow-chart line per distinct edge, with the number of its recordings.

    The line carries the operation of the earliest recording.
    """
    if table is not None:
        edges = edges.where((F.col("source") == table) | (F.col("target") == table))
    distinct = edges.groupBy("source", "target").agg(
        F.min(F.struct("ts", "operation")).alias("first"), F.count(F.lit(1)).alias("n")
    )
    node = lambda c: F.translate(c, ":/", "__")
    line = F.concat(
        F.lit("    "), node("source"), F.lit("["), "source", F.lit("] -->|"),
        F.substring(F.col("first.operation"), 1, 8), F.lit("| "), node("target"), F.lit("["), "target", F.lit("]"),
    )
    return distinct.select(line.alias("line"), "n")


def mermaid_text(edges: DataFrame, table: str) -> str:
    """The flow chart around one table as text; its size is the table's number of neighbours."""
    rows = mermaid_lines(edges, table).orderBy("line").toLocalIterator()
    return "\n".join(["```mermaid", "graph LR", *[r["line"] for r in rows], "```"])


def stats(edges: DataFrame, columns: DataFrame) -> DataFrame:
    """(metric, n): nodes, edges, column edges, and edges per operation."""
    nodes = edges.select(F.col("source").alias("node")).union(edges.select("target")).distinct()
    count = lambda df, name: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("metric"), "n")
    operations = edges.groupBy("operation").agg(F.count(F.lit(1)).alias("n"))
    parts = [
        count(nodes, "tables"),
        count(edges, "table_edges"),
        count(columns, "column_edges"),
        operations.select(F.concat(F.lit("operation:"), "operation").alias("metric"), "n"),
    ]
    return reduce(DataFrame.unionByName, parts)


def report(edges: DataFrame, columns: DataFrame, table: str) -> DataFrame:
    """(section, detail, n): upstream, downstream, path, flow chart and statistics of one table."""
    section = lambda df, name, detail, n: df.select(F.lit(name).alias("section"), detail.alias("detail"), n.alias("n"))
    per = lambda df, c: df.groupBy(c).agg(F.count(F.lit(1)).alias("n"))
    statistics = stats(edges, columns)
    return reduce(
        DataFrame.unionByName,
        [
            section(per(upstream(edges, table), "source"), "upstream", F.col("source"), F.col("n")),
            section(per(downstream(edges, table), "target"), "downstream", F.col("target"), F.col("n")),
            section(full_path(edges, table), "full_path", F.col("path"), F.col("nodes")),
            section(mermaid_lines(edges, table), "mermaid", F.col("line"), F.col("n")),
            section(statistics, "stats", F.col("metric"), F.col("n")),
        ],
    )
