"""Run queries on Spark and their SQL twins on a second engine and compare the rows.

``python tests/compare.py [--sf DIR] [name prefix …]``
"""

import datetime
import decimal
import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from catalog import ORACLES, QUERIES  # noqa: E402
from catalog.inputs import TABLES  # noqa: E402
from tablewright.session import local_session  # noqa: E402


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _value(v):
    if isinstance(v, bool) or v is None or isinstance(v, str):
        return v
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, (int, float)):
        return "NaN" if math.isnan(v) else float(v)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return str(v)


def _sorted(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted((tuple(_value(r[i]) for i in order) for r in rows), key=repr)


def spark_rows(df):
    return _sorted(df.columns, [tuple(r) for r in df.collect()])


def oracle_rows(con, sql):
    cur = con.execute(sql)
    return _sorted([d[0] for d in cur.description], cur.fetchall())


def difference(ours, theirs):
    """None when equal, else a short text."""
    if ours[0] != theirs[0]:
        return f"columns {ours[0]} against {theirs[0]}"
    if len(ours[1]) != len(theirs[1]):
        a, b = set(ours[1]), set(theirs[1])
        return f"{len(ours[1])} rows against {len(theirs[1])}: {sorted(a - b, key=repr)[:2]} / {sorted(b - a, key=repr)[:2]}"
    wrong = [(a, b) for a, b in zip(ours[1], theirs[1]) if a != b]
    return f"{len(wrong)} rows differ, first {wrong[0]}" if wrong else None


def main(args):
    sf_dir = args[args.index("--sf") + 1] if "--sf" in args else "/root/testdata/sf0.01"
    wanted = [a for i, a in enumerate(args) if a != "--sf" and (i == 0 or args[i - 1] != "--sf")]
    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    bad = 0
    for name, fn in QUERIES.items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        start = time.time()
        try:
            ours = spark_rows(fn(spark, sf_dir))
            took = time.time() - start
            problem = difference(ours, oracle_rows(con, ORACLES[name])) if name in ORACLES else None
        except Exception as e:
            took, problem = time.time() - start, f"{type(e).__name__}: {str(e)[:600]}"
        bad += problem is not None
        rows = len(ours[1]) if problem is None else "-"
        print(f"{'ok ' if problem is None else 'BAD'} {name:28} {took:6.1f}s {rows:>7} {'' if name in ORACLES else '(rows only)'} {problem or ''}", flush=True)
    print(f"{bad} bad")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
