"""Equi-join to a table with at most one row per key."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.operators.frames import col


def attach(left: DataFrame, lookup: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """Left rows with the lookup's columns; keys match null-safely and the key appears once.

    ``lookup`` has one row per key. Adaptive execution sees the sizes that the stages before really
    had: it broadcasts a lookup below the session's threshold, and of a hot key's left rows it makes
    several tasks (the join kinds used here, inner and left, allow that for the left side).
    """
    other = lookup.withColumnRenamed(key, "_key")
    return left.join(other, col(key).eqNullSafe(F.col("_key")), how).drop("_key")
