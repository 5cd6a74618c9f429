"""Files named by a table of paths, each read with the reader its name asks for."""

import re
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.functions import urls
from tablewright.operators.frames import col
from tablewright.operators.integrate import union_all
from tablewright.sources import files

SCANNED = ("csv", "json", "parquet")
ORIGIN = ("source_path", "source_name", "reader")


def routed(paths: DataFrame, column: str = "path") -> DataFrame:
    """(path, name, reader, readable): each distinct path once; web, Excel and SQLite are not scanned here."""
    path = F.col("path")
    found = paths.select(col(column).alias("path")).where("path IS NOT NULL").distinct()
    reader = urls.reader_of(path)
    return found.select("path", urls.source_name(path).alias("name"), reader.alias("reader"), reader.isin(*SCANNED).alias("readable"))


def _plain(path: str) -> str:
    """A path without its local scheme and doubled slashes, to tell which files lie below which path."""
    return re.sub(r"/+", "/", re.sub(r"^file:", "", path)).rstrip("/")


def _origin_of(file: str, given: dict[str, str]) -> str:
    """The given path that a file is, or lies below, the deepest one; for a pattern the file itself."""
    at = whole = _plain(unquote(file))
    while at and at not in given:
        at = at.rpartition("/")[0]
    return given.get(at, whole)


def _scan(spark: SparkSession, scan: DataFrame, paths: list[str]) -> DataFrame:
    """The rows of one scan with the path that each came from.

    The list of files is the scan's own, which its plan holds already; it is joined by a broadcast
    of one short row per file.
    """
    given = {_plain(p): p for p in paths}
    # a plan writes local names as file:///…, a scan as file:/…
    rows = [(re.sub(r"^file:/+", "file:/", f), _origin_of(f, given)) for f in scan.inputFiles()]
    origins = spark.createDataFrame(rows, "_origin_file string, source_path string")
    file = F.regexp_replace("_metadata.file_path", "^file:/+", "file:/")
    placed = scan.select("*", file.alias("_origin_file"))
    return placed.join(F.broadcast(origins), "_origin_file", "left").drop("_origin_file")


def _by_header(spark: SparkSession, paths: list[str]) -> dict[tuple, list[str]]:
    """CSV paths by separator and columns, so that each group is one scan; only headers are read."""
    groups = {}
    for path in paths:
        sep = "\t" if path.lower().endswith(".tsv") else files.sniff_separator(spark, path)
        names = spark.read.options(header=True, sep=sep, quote='"', escape='"').csv(path).columns
        groups.setdefault((sep, *names), []).append(path)
    return groups


def _csv(spark: SparkSession, paths: list[str], schema) -> list[DataFrame]:
    scans = []
    for (sep, *_), same in _by_header(spark, paths).items():
        reader = spark.read.options(header=True, sep=sep, quote='"', escape='"', enforceSchema=True)
        scan = reader.schema(schema).csv(same) if schema else reader.option("inferSchema", True).csv(same)
        scans.append(_scan(spark, scan, same))
    return scans


def _json(spark: SparkSession, paths: list[str], schema) -> list[DataFrame]:
    """Files of lines in one scan; each array file has a scan of its own, of many tasks."""
    lines = [p for p in paths if p.lower().endswith((".jsonl", ".ndjson")) or files._first_sign(spark, p) == ""]
    scans = []
    if lines:
        reader = spark.read.schema(schema) if schema else spark.read
        scans.append(_scan(spark, reader.json(lines), lines))
    whole = [p for p in paths if p not in lines]
    return scans + [files.read_json(spark, p, schema, lines=False).withColumn("source_path", F.lit(p)) for p in whole]


def read_paths(paths: DataFrame, column: str = "path", schemas: dict | None = None) -> DataFrame:
    """All rows of the files that a table of paths names, with ``source_path``, ``source_name`` and ``reader``.

    Paths are grouped by reader, and each group is one scan: Parquet, JSON lines, and CSV of equal
    columns and separator. ``schemas`` gives the schema of a reader's files; without one it is found,
    for CSV once per group. The results are united under the columns of all, types that clash
    meet as text. A path that comes twice is read once; null paths are none. Cells with line ends
    need ``files.read_csv``. A path without a scan (web, Excel, SQLite) is an error that names it, as are
    files with a column named like one of the three above. No path gives no rows. The paths are
    fetched: the driver plans a scan from a list of names.
    """
    spark, schemas = paths.sparkSession, schemas or {}
    found = routed(paths, column).orderBy("path").collect()
    others = [r["path"] for r in found if not r["readable"]]
    if others:
        raise ValueError(f"no scan for {others}")
    scans = []
    for kind in SCANNED:
        group = [r["path"] for r in found if r["reader"] == kind]
        if not group:
            continue
        if kind == "parquet":
            reader = spark.read.schema(schemas[kind]) if kind in schemas else spark.read.option("mergeSchema", True)
            parts = [_scan(spark, reader.parquet(*group), group)]
        else:
            parts = (_csv if kind == "csv" else _json)(spark, group, schemas.get(kind))
        scans += [p.withColumn("reader", F.lit(kind)) for p in parts]
    if not scans:
        return spark.createDataFrame([], ", ".join(f"{c} string" for c in ORIGIN))
    clashing = sorted({c for s in scans for c in s.columns if c in ORIGIN and s.columns.count(c) > 1})
    if clashing:
        raise ValueError(f"columns of the files clash with those of their origin: {clashing}")
    return union_all([s.withColumn("source_name", urls.source_name(F.col("source_path"))) for s in scans])
