"""History of runs: one snapshot per run and source, only ever added to, and what changed since the run before.

{path}/run={id}   the snapshots of one run; they count once the folder's success mark is there
"""

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tablewright.sources.layers import _folders, _new_version

RUN_SCHEMA = "ts timestamp, source string, rows long, delta long, schema_hash string, columns long, health string"


def append_run(snapshots: DataFrame, path: str) -> str:
    """Add snapshots (``quality.snapshot``) as one run; gives its id.

    Every run is a folder of its own, so two writers at once lose nothing. A run without rows is
    kept too: it is in no history, as it names no source.
    """
    run = _new_version()
    names = [c.strip().split(" ")[0] for c in RUN_SCHEMA.split(",")]
    snapshots.select(*names).write.mode("errorifexists").parquet(f"{path.rstrip('/')}/run={run}")
    return run


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """(run, …snapshot): the rows of all finished runs; unfinished ones are not seen."""
    folders = [m.rsplit("/", 1)[0] for m in _folders(spark, f"{path.rstrip('/')}/run=*/_SUCCESS")]
    if not folders:
        return spark.createDataFrame([], f"run string, {RUN_SCHEMA}")
    # the run stays text although it starts with digits
    kept = spark.read.schema(f"{RUN_SCHEMA}, run string").option("basePath", path).parquet(*folders)
    return kept.select("run", *[c for c in kept.columns if c != "run"])


def run_changes(runs: DataFrame) -> DataFrame:
    """Every run beside the one before it of the same source.

    Adds ``previous_run``, ``previous_rows``, ``row_change`` and ``schema_changed``; null for a source's
    first run. Runs follow each other by ``ts``, those of the same instant by id.
    """
    before = Window.partitionBy("source").orderBy("ts", "run")
    lagged = runs.select(
        "*", *[F.lag(c).over(before).alias(f"previous_{c}") for c in ("run", "rows", "schema_hash")]
    )
    return lagged.select(
        *runs.columns,
        "previous_run",
        "previous_rows",
        (F.col("rows") - F.col("previous_rows")).alias("row_change"),
        (F.col("schema_hash") != F.col("previous_schema_hash")).alias("schema_changed"),
    )


def runs_as_of(runs: DataFrame, at: str) -> DataFrame:
    """The last run of each source up to and including an instant; combined inside each task first."""
    rest = [c for c in runs.columns if c != "source"]
    last = F.max(F.struct("ts", "run", F.struct(*rest).alias("kept"))).alias("last")
    known = runs.where(F.col("ts") <= F.lit(at).cast("timestamp")).groupBy("source").agg(last)
    return known.select(*[F.col(c) if c == "source" else F.col("last.kept")[c].alias(c) for c in runs.columns])
