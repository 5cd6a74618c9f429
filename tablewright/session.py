"""Session helpers: shared scratch folder, plan sizes, a local session for tests and bench."""

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SMALL_PLAN_BYTES = 16 * 1024 * 1024


def local_session(cpus: str = "8", app: str = "tablewright") -> SparkSession:
    """Session for tests and bench on one machine; a cluster brings its own settings."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.driver.memory", os.environ.get("SPARK_DRIVER_MEMORY", "8g"))
        .config("spark.sql.adaptive.enabled", "true")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``, visible to every executor.

    Only a local session that names none (tests, one machine) gets a temporary folder; on a cluster
    a folder of the driver would be out of the executors' reach, so there it is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    current = spark.sparkContext.getCheckpointDir()
    if not named and not current:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        named = tempfile.mkdtemp(prefix="tablewright-")
    if not current:
        spark.sparkContext.setCheckpointDir(named)
    return named or current


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def checkpointed(df: DataFrame) -> DataFrame:
    """The rows written to the shared folder, so that every reader sees the same ones."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def sql_over(spark: SparkSession, sql: str, frames: dict[str, DataFrame]) -> DataFrame:
    """The result of a text that calls the given tables by name.

    The text is resolved at once; then the session's views are as they were before.
    """
    shadowed = {n: spark.table(n) for n in frames if any(t.isTemporary for t in spark.catalog.listTables(pattern=n))}
    try:
        for name, df in frames.items():
            df.createOrReplaceTempView(name)
        return spark.sql(sql)
    finally:
        for name in frames:
            if name in shadowed:
                shadowed[name].createOrReplaceTempView(name)
            else:
                spark.catalog.dropTempView(name)


def plan_bytes(df: DataFrame) -> int | None:
    """Catalyst's size estimate of the plan's output, None where it cannot be asked."""
    try:
        return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    except Exception:  # a remote session exposes no plan
        return None


def is_small(df: DataFrame, limit: int = SMALL_PLAN_BYTES) -> bool:
    size = plan_bytes(df)
    return size is not None and size <= limit
