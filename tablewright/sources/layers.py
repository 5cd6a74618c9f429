"""Bronze, silver and gold layers as Parquet folders.

bronze/{source}/ingest_date={date}/load={id}   append-only; a load counts once its record commit={id} is there
silver/{domain}/{table}/version={v}  the newest complete version is the table
gold/{name}/version={v}              the newest complete version is the dataset
"""

import json
import re
import uuid
from datetime import datetime, timezone

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.functions import hints
from tablewright.operators.frames import union
from tablewright.session import sql_over

_SAFE = re.compile(r"^[A-Za-z0-9_一-鿿][A-Za-z0-9_.一-鿿-]*$")


def _safe(name: str) -> str:
    if not _SAFE.match(name) or ".." in name:
        raise ValueError(f"not a dataset name: {name!r}")
    return name


def clean_names(df: DataFrame) -> DataFrame:
    """Blanks and '-' in column names become '_'; names that would then clash raise an error that lists them."""
    names = [re.sub(r"[ -]", "_", c) for c in df.columns]
    clashing = sorted({c for c, n in zip(df.columns, names) if [m.lower() for m in names].count(n.lower()) > 1})
    if clashing:
        raise ValueError(f"column names clash once cleaned: {clashing}")
    return df.toDF(*names)


def _new_version() -> str:
    """Sorts by time; the tail keeps two writers of the same instant apart."""
    return datetime.now(timezone.utc).strftime("%Y%m%d%H%M%S%f") + uuid.uuid4().hex[:6]


def _write_counted(df: DataFrame, write) -> int:
    """Write and count in the same pass."""
    seen = Observation()
    write(df.observe(seen, F.count(F.lit(1)).alias("rows")))
    return seen.get["rows"]


def _folders(spark: SparkSession, pattern: str) -> list[str]:
    """Folders (or marks) that a path pattern meets, in order; files are not listed."""
    path = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path)
    return sorted(s.getPath().toString() for s in found or [])


def _bytes(spark: SparkSession, folder: str) -> int:
    """Bytes below a folder, by the file system's own summary."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    return fs.getContentSummary(path).getLength() if fs.exists(path) else 0


_RECEIPT = (
    "dataset string, path string, partition string, rows long, size_bytes long, columns int, "
    "schema array<struct<name:string,type:string>>, metadata map<string,string>"
)


def _receipt(df: DataFrame, dataset: str, path: str, part: str, rows: int, folder: str = "", metadata: dict | None = None) -> DataFrame:
    """What one write landed: rows, the bytes of its own files, its schema and the caller's metadata."""
    spark = df.sparkSession
    size = _bytes(spark, folder) if rows else 0
    schema = [(f.name, f.dataType.simpleString()) for f in df.schema]
    given = {k: str(v) for k, v in (metadata or {}).items()}
    row = (dataset, f"{path}/{part}" if rows else "", part if rows else "", rows, size, len(schema), schema, given)
    return spark.createDataFrame([row], _RECEIPT)


# ---- bronze ----------------------------------------------------------------

def bronze_append(
    df: DataFrame, base: str, source: str, ingest_date: str | None = None, metadata: dict | None = None
) -> DataFrame:
    """Append all rows under the source and date; an empty table lands nothing. Gives a receipt.

    Every load has a folder of its own below the date and the date is no column of the files, so
    a column named ``ingest_date`` is kept like any other.
    """
    date = _safe(ingest_date or datetime.now(timezone.utc).strftime("%Y-%m-%d"))
    path, part = f"{base}/bronze/{_safe(source)}", f"ingest_date={date}"
    if df.isEmpty():
        return _receipt(df, source, path, part, 0, metadata=metadata)
    load = _new_version()
    folder = f"{path}/{part}/load={load}"
    rows = _write_counted(df, lambda d: d.write.mode("errorifexists").parquet(folder))
    receipt = _receipt(df, source, path, part, rows, folder, metadata)
    _commit(receipt, df.schema, source, date, load, f"{path}/{part}/commit={load}")
    return receipt


_COMMIT = "source string, ingest_date string, load string, rows long, files long, size_bytes long, schema string, metadata map<string,string>"


def _commit(receipt: DataFrame, schema: T.StructType, source: str, date: str, load: str, folder: str) -> None:
    """The record of a load, written after its files: a folder of one row whose success mark makes the load count."""
    spark, r = receipt.sparkSession, receipt.first()
    files = len(_folders(spark, f"{r['path']}/load={load}/part-*"))
    row = (source, date, load, r["rows"], files, r["size_bytes"], schema.json(), r["metadata"])
    spark.createDataFrame([row], _COMMIT).coalesce(1).write.mode("errorifexists").json(folder)


def _marks(spark: SparkSession, base: str, source: str = "*", date: str = "*") -> list[tuple[str, str, str]]:
    """(source, date, folder) of the records of committed loads; files are not listed."""
    marks = [f.rsplit("/", 4) for f in _folders(spark, f"{base}/bronze/{source}/ingest_date={date}/commit=*/_SUCCESS")]
    return [(s, d.removeprefix("ingest_date="), f"{top}/{s}/{d}/{c}") for top, s, d, c, _ in marks]


def bronze_loads(spark: SparkSession, base: str, source: str = "*", date: str = "*") -> DataFrame:
    """One row per committed load: source, date, load, rows, files, bytes, schema (as JSON) and metadata."""
    folders = [f for _, _, f in _marks(spark, base, source if source == "*" else _safe(source), date if date == "*" else _safe(date))]
    if not folders:
        return spark.createDataFrame([], _COMMIT)
    # the day in the path is no column of the record
    return spark.read.schema(_COMMIT).option("recursiveFileLookup", True).json(folders)


def bronze_append_csv(spark: SparkSession, csv_path: str, base: str, source: str, ingest_date: str | None = None):
    from tablewright.sources.files import read_csv

    return bronze_append(read_csv(spark, csv_path), base, source, ingest_date, {"source_path": csv_path})


def list_sources(spark: SparkSession, base: str) -> DataFrame:
    names = sorted({s for s, _, _ in _marks(spark, base)})
    return spark.createDataFrame([(s,) for s in names], "source string").orderBy("source")


def list_partitions(spark: SparkSession, base: str, source: str) -> DataFrame:
    days = sorted({(d,) for _, d, _ in _marks(spark, base, _safe(source))})
    return spark.createDataFrame(days, "ingest_date string").orderBy(F.desc("ingest_date"))


def merged_schema(schemas: list[T.StructType]) -> T.StructType:
    """All columns in first-seen order; a column whose type differs between loads is an error that names it."""
    fields: dict[str, T.StructField] = {}
    for field in (f for s in schemas for f in s.fields):
        seen = fields.setdefault(field.name, field)
        if seen.dataType != field.dataType:
            raise ValueError(f"column {field.name!r} is {seen.dataType.simpleString()} in one load and {field.dataType.simpleString()} in another")
    return T.StructType([T.StructField(f.name, f.dataType, True) for f in fields.values()])


def read_partition(spark: SparkSession, base: str, source: str, ingest_date: str) -> DataFrame:
    """All rows of one date under the columns of all its committed loads.

    Which folders are read and under which schema comes from the records of the loads, a row each;
    no footers are opened for it, and files of a load that was never committed are not seen.
    """
    loads = bronze_loads(spark, base, source, ingest_date).select("load", "schema").orderBy("load").collect()
    if not loads:
        raise FileNotFoundError(f"no partition {ingest_date} of {source}")
    shapes = [T.StructType.fromJson(json.loads(s)) for s in dict.fromkeys(r["schema"] for r in loads)]
    day = f"{base}/bronze/{source}/ingest_date={ingest_date}"
    reader = spark.read.schema(merged_schema(shapes)).option("recursiveFileLookup", True)
    return reader.parquet(*[f"{day}/load={r['load']}" for r in loads])


def read_latest(spark: SparkSession, base: str, source: str) -> DataFrame:
    """The newest day of a source that has a committed load; of the lake only this source's folders are listed."""
    days = [d for _, d, _ in _marks(spark, base, _safe(source))]
    if not days:
        raise FileNotFoundError(f"no data for source {source}")
    return read_partition(spark, base, source, max(days))


def bronze_stats(spark: SparkSession, base: str) -> DataFrame:
    """(source, partitions, latest, size_bytes) per source, from the records of the loads."""
    return (
        bronze_loads(spark, base)
        .groupBy("source")
        .agg(
            F.count_distinct("ingest_date").alias("partitions"),
            F.max("ingest_date").alias("latest"),
            F.sum("size_bytes").alias("size_bytes"),
        )
    )


# ---- silver and gold -------------------------------------------------------

def _write_version(df: DataFrame, dataset: str, path: str) -> DataFrame:
    """A new version; a table without rows writes none, so the newest stays."""
    named, part = clean_names(df), f"version={_new_version()}"
    if named.isEmpty():
        return _receipt(named, dataset, path, part, 0)
    rows = _write_counted(named, lambda d: d.write.mode("errorifexists").parquet(f"{path}/{part}"))
    return _receipt(named, dataset, path, part, rows, f"{path}/{part}")


def _versions(spark: SparkSession, pattern: str) -> list[str]:
    """Folders of the versions whose write has completed (they hold the success mark)."""
    return [mark.rpartition("/")[0] for mark in _folders(spark, f"{pattern}/version=*/_SUCCESS")]


def _newest_version(spark: SparkSession, path: str) -> str | None:
    found = _versions(spark, path)
    return found[-1].rpartition("/")[2] if found else None


def silver_write(df: DataFrame, base: str, domain: str, table: str) -> DataFrame:
    """A new version of domain/table with cleaned column names. Gives a receipt."""
    return _write_version(df, f"{domain}/{table}", f"{base}/silver/{_safe(domain)}/{_safe(table)}")


def silver_read(spark: SparkSession, base: str, domain: str, table: str) -> DataFrame:
    path = f"{base}/silver/{_safe(domain)}/{_safe(table)}"
    newest = _newest_version(spark, path)
    if newest is None:
        raise FileNotFoundError(f"no silver table {domain}/{table}")
    return spark.read.parquet(f"{path}/{newest}")


def silver_stats(spark: SparkSession, base: str) -> DataFrame:
    """(domain, tables, names, size_bytes) per domain, over the completed versions."""
    parts = [(*f.rsplit("/", 3)[1:3], _bytes(spark, f)) for f in _versions(spark, f"{base}/silver/*/*")]
    cut = spark.createDataFrame(parts, "domain string, table string, length bigint")
    tables = cut.groupBy("domain", "table").agg(F.sum("length").alias("length"))
    return tables.groupBy("domain").agg(
        F.count(F.lit(1)).alias("tables"),
        F.array_join(F.array_sort(F.collect_list("table")), ",").alias("names"),
        F.sum("length").alias("size_bytes"),
    )


def list_domains(spark: SparkSession, base: str) -> DataFrame:
    return silver_stats(spark, base).select("domain").orderBy("domain")


def gold_write(df: DataFrame, base: str, name: str) -> DataFrame:
    """A new version of a gold dataset. Gives a receipt."""
    return _write_version(df, name, f"{base}/gold/{_safe(name)}")


def check_select(sql: str) -> None:
    """Only a SELECT (or WITH … SELECT) without any of the forbidden words passes."""
    if re.search(hints.FORBIDDEN_SQL, sql, re.IGNORECASE):
        raise ValueError("the text holds a forbidden statement")
    if not re.match(r"\s*(SELECT|WITH)\s", sql, re.IGNORECASE):
        raise ValueError("only SELECT is allowed")


def gold_from_sql(spark: SparkSession, sql: str, base: str, name: str, views: dict[str, DataFrame] | None = None):
    """Run a SELECT over named tables and write its result as a gold dataset.

    The names hold for this text alone: views of a session are left as they are.
    """
    check_select(sql)
    return gold_write(sql_over(spark, sql, views or {}), base, name)


def gold_read(spark: SparkSession, base: str, name: str) -> DataFrame | None:
    """Newest version under the exact name; None when there is none."""
    path = f"{base}/gold/{_safe(name)}"
    newest = _newest_version(spark, path)
    return spark.read.parquet(f"{path}/{newest}") if newest else None


def _gold_parts(spark: SparkSession, base: str) -> DataFrame:
    parts = [(f.rsplit("/", 2)[1], _bytes(spark, f)) for f in _versions(spark, f"{base}/gold/*")]
    return spark.createDataFrame(parts, "name string, length bigint")


def list_gold(spark: SparkSession, base: str) -> DataFrame:
    return _gold_parts(spark, base).select("name").distinct().orderBy("name")


def storage_status(spark: SparkSession, base: str) -> DataFrame:
    """(layer, dataset, metric, value) over all three layers."""
    long = lambda df, layer, key, metrics: df.select(
        F.lit(layer).alias("layer"),
        F.col(key).alias("dataset"),
        F.inline(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("bigint").alias("value")) for m in metrics])),
    )
    gold = _gold_parts(spark, base).groupBy("name").agg(F.sum("length").alias("size_bytes"))
    return union(
        [
            long(bronze_stats(spark, base), "bronze", "source", ["partitions", "size_bytes"]),
            long(silver_stats(spark, base), "silver", "domain", ["tables", "size_bytes"]),
            long(gold, "gold", "name", ["size_bytes"]),
        ]
    )


def load(spark: SparkSession, base: str, address: str) -> DataFrame:
    """The table behind ``bronze:source``, ``silver:domain/table`` or ``gold:name``."""
    layer, _, name = address.partition(":")
    if layer == "bronze":
        return read_latest(spark, base, name)
    if layer == "silver" and "/" in name:
        return silver_read(spark, base, *name.split("/", 1))
    if layer == "gold":
        found = gold_read(spark, base, name)
        if found is None:
            raise FileNotFoundError(f"no gold dataset {name}")
        return found
    raise ValueError(f"unknown address {address!r}")
