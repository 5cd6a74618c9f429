"""Headline queries at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``; prints one JSON line.

Every query is run to its last row with a sink that keeps nothing; each figure is the best of two
runs. The given files hold one row group each, which is one task however many cores there are, so
the tables are first laid out as one file per core; that time counts as ``lay_out_tables``.
"""

import json
import os
import sys
import time
from pathlib import Path

from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parent))

from catalog.inputs import CHAINS, ORDERS, PEOPLE, frame, table  # noqa: E402
from tablewright.operators import clean, govern, integrate, lineage, mask, pages, profile, quality  # noqa: E402
from tablewright.operators.frames import numeric_columns  # noqa: E402
from tablewright.operators.order_stats import SUMMARY, order_stats  # noqa: E402
from tablewright.plans import prepare  # noqa: E402
from tablewright.sources import layers  # noqa: E402
from tablewright.session import local_session, scratch_path  # noqa: E402


def _customer_orders(spark, sf):
    customers = table(spark, sf, "customer").withColumnRenamed("c_custkey", "cust_id")
    return table(spark, sf, "orders").withColumnRenamed("o_custkey", "cust_id"), customers


LINK_RULES = [
    {"name": "link", "container": "nav li", "selector": "a", "attr": "href"}, {"name": "label", "selector": "a", "attr": "text"},
]


def _chains(spark, sf):
    return lineage.table_edges(frame(spark, sf, CHAINS))


def _bronze(spark, sf):
    base = scratch_path(spark, "bench-lake")
    layers.bronze_append(table(spark, sf, "orders"), base, "orders", "2026-01-01")
    return layers.read_latest(spark, base, "orders")


HEADLINE = {
    "profile_lineitem": lambda spark, sf: profile.column_profile(table(spark, sf, "lineitem")),
    "summary_lineitem": lambda spark, sf: profile.summary(table(spark, sf, "lineitem")),
    "exact_quantiles_lineitem": lambda spark, sf: order_stats(
        table(spark, sf, "lineitem"), numeric_columns(table(spark, sf, "lineitem")), SUMMARY
    ),
    "full_clean_orders": lambda spark, sf: prepare.clean(frame(spark, sf, ORDERS)),
    "clean_report_orders": lambda spark, sf: prepare.clean_report(frame(spark, sf, ORDERS)),
    "row_dedup_lineitem": lambda spark, sf: clean.drop_duplicates(table(spark, sf, "lineitem")),
    "near_text_dedup_documents": lambda spark, sf: clean.near_text_dedup(
        table(spark, sf, "documents"), ["text"], row_key="doc_id"
    ),
    **{
        f"mask_{s}_customer": (lambda s: lambda spark, sf: mask.desensitize(frame(spark, sf, PEOPLE), s, "bench-salt"))(s)
        for s in ("mask", "full", "hash", "null", "token")
    },
    "integrate_join_orders_customer": lambda spark, sf: integrate.join_sources(*_customer_orders(spark, sf), "cust_id"),
    "quality_scores_orders": lambda spark, sf: quality.quality_scores(table(spark, sf, "orders"), "1999-01-01"),
    "asset_score_customer": lambda spark, sf: govern.asset_score(frame(spark, sf, PEOPLE), "2024-06-30"),
    "sensitivity_documents": lambda spark, sf: govern.sensitivity(table(spark, sf, "documents")),
    "page_text_lines": lambda spark, sf: pages.text_lines(table(spark, sf, "pages")),
    "page_extract_containers": lambda spark, sf: pages.extract_rows(table(spark, sf, "pages"), LINK_RULES, keep=["page_id"]),
    "lineage_paths_events": lambda spark, sf: lineage.full_paths(_chains(spark, sf), _chains(spark, sf).select(F.col("target").alias("table"))),
    "mask_token_by_cells_customer": lambda spark, sf: mask.tokenize(
        frame(spark, sf, PEOPLE), mask.personal_kinds(frame(spark, sf, PEOPLE)), broadcast_bytes=0, row_key="cust_id"
    ),
    "bronze_append_and_read_orders": _bronze,
}


def _lay_out(spark, sf, cpus):
    base = scratch_path(spark, "bench")
    for name in ("lineitem", "orders", "customer", "documents", "pages", "events"):
        table(spark, sf, name).repartition(cpus).write.parquet(f"{base}/{name}.parquet")
    return base


def _seconds(query, spark, sf):
    start = time.perf_counter()
    query(spark, sf).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main():
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    wanted = sys.argv[1:]
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, "bench")
    spark.sparkContext.setLogLevel("ERROR")
    table(spark, sf, "nation").write.format("noop").mode("overwrite").save()
    start = time.perf_counter()
    tables = _lay_out(spark, sf, int(cpus))
    seconds = {"lay_out_tables": round(time.perf_counter() - start, 3)}
    for name, query in HEADLINE.items():
        if not wanted or name in wanted:
            seconds[name] = round(min(_seconds(query, spark, tables) for _ in range(2)), 3)
    print(json.dumps({"metric": "headline_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": sf}))


if __name__ == "__main__":
    main()
