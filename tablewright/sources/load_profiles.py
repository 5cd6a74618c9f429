"""Profile state kept beside each bronze load, so that a source's profile never reads its rows again.

bronze/{source}/ingest_date={date}/profile={load}/state={id}   the state of one load; the newest finished one counts
"""

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.operators.profile_state import STATE_SCHEMA, merged_state, profile_state, state_profile
from tablewright.sources.layers import _folders, _new_version, _safe, bronze_loads


def _states(spark: SparkSession, base: str, source: str, date: str) -> dict[str, str]:
    """Load -> folder of its newest finished state."""
    marks = _folders(spark, f"{base}/bronze/{source}/ingest_date={date}/profile=*/state=*/_SUCCESS")
    folders = [m.rsplit("/", 1)[0] for m in marks]
    return {f.rsplit("/", 2)[1].removeprefix("profile="): f for f in folders}


def profile_loads(spark: SparkSession, base: str, source: str, date: str = "*") -> list[str]:
    """Work out the state of every committed load that has none, reading those loads only; gives their ids.

    Two callers at once may both do a load: each writes a folder of its own, and the states are equal.
    """
    _safe(source)
    kept = _states(spark, base, source, date)
    loads = bronze_loads(spark, base, source, date).select("ingest_date", "load", "schema").orderBy("load").collect()
    new = [r for r in loads if r["load"] not in kept]
    for r in new:
        day = f"{base}/bronze/{source}/ingest_date={r['ingest_date']}"
        schema = T.StructType.fromJson(json.loads(r["schema"]))
        df = spark.read.schema(schema).option("recursiveFileLookup", True).parquet(f"{day}/load={r['load']}")
        state = profile_state(df, r["load"])
        state.coalesce(1).write.mode("errorifexists").parquet(f"{day}/profile={r['load']}/state={_new_version()}")
    return [r["load"] for r in new]


def load_states(spark: SparkSession, base: str, source: str, date: str = "*") -> DataFrame:
    """The rows of all kept states of committed loads; a state without its load's record is not seen."""
    committed = {r["load"] for r in bronze_loads(spark, base, _safe(source), date).select("load").collect()}
    folders = [f for load, f in _states(spark, base, source, date).items() if load in committed]
    if not folders:
        return spark.createDataFrame([], STATE_SCHEMA)
    return spark.read.schema(STATE_SCHEMA).option("recursiveFileLookup", True).parquet(*folders)


def source_profile(spark: SparkSession, base: str, source: str, date: str = "*") -> DataFrame:
    """Profile of all loads of a source (or of one day), merged from their states.

    Loads without a state are profiled first; nothing else of the source is read. A source
    without loads has a profile without rows.
    """
    profile_loads(spark, base, source, date)
    return state_profile(merged_state(load_states(spark, base, source, date)))


def profile_changes(spark: SparkSession, base: str, source: str) -> DataFrame:
    """(load, column, …): each load's own profile beside the rows and null share of the load before it.

    ``previous_rows`` and ``previous_null_pct`` are null for the first load that has the column. From the states alone.
    """
    profile_loads(spark, base, source)
    states = load_states(spark, base, source).withColumn("load", F.col("seen.part"))
    rows = states.where("column IS NULL").select(F.col("load").alias("_of"), F.col("filled").alias("rows"))
    # one row per load on the right
    own = states.where("column IS NOT NULL").join(F.broadcast(rows), F.col("load") == F.col("_of"))
    null_pct = F.round(F.try_divide((F.col("rows") - F.col("filled")).cast("double") * 100, F.col("rows").cast("double")), 1)
    own = own.select("load", "column", "rows", null_pct.alias("null_pct"))
    before = "OVER (PARTITION BY column ORDER BY load)"
    return own.selectExpr(
        "load", "column", "rows", "null_pct", f"lag(rows) {before} AS previous_rows", f"lag(null_pct) {before} AS previous_null_pct"
    )
