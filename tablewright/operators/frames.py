"""Shared pieces: column kinds, one-row frames to long form, deterministic first rows."""

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Aggregates per job: more than this in one stage passes the limit for generated code.
CHUNK = 50


def numeric_columns(df: DataFrame) -> list[str]:
    """Numeric columns; booleans are not numbers, decimals are."""
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType)]


def string_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]


def col(name: str) -> Column:
    """Column by exact name, dots and blanks included."""
    return F.col(f"`{name.replace('`', '``')}`")


def number(name: str) -> Column:
    """Column as double, with -0.0 folded into 0.0."""
    return col(name).cast("double") + F.lit(0.0)


def text(name: str) -> Column:
    return col(name).cast("string")


def chunked(names: list[str], size: int = CHUNK) -> list[list[str]]:
    return [names[i : i + size] for i in range(0, len(names), size)]


def union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def beside(frames: list[DataFrame]) -> DataFrame:
    """One-row frames side by side."""
    return reduce(lambda a, b: a.crossJoin(F.broadcast(b)), frames)


def wide_agg(df: DataFrame, measures: list[Column]) -> DataFrame:
    """One row of aggregates over the whole table, in several stages when there are very many."""
    step = 4 * CHUNK
    return beside([df.agg(*measures[i : i + step]) for i in range(0, len(measures), step)])


def to_long(row: DataFrame, records: list[dict[str, Column]]) -> DataFrame:
    """One output row per record, computed from a one-row frame."""
    structs = [F.struct(*[v.alias(k) for k, v in r.items()]) for r in records]
    return row.select(F.inline(F.array(*structs)))


def keyed(names: list[str], columns: list[str]) -> dict[str, int]:
    """Position of each name among the table's columns: a safe suffix for measure names."""
    return {n: columns.index(n) for n in names}


def fresh_names(names: list[str], columns: list[str]) -> list[str]:
    """The names, with as many underscores before them as keep them apart from the columns."""
    taken = {c.lower() for c in columns}
    mark = "_"
    while any(mark + n in taken for n in names):
        mark += "_"
    return [mark + n for n in names]


def percent(part: Column, whole: Column) -> Column:
    """100 * part / whole to one decimal; null over nothing."""
    return F.round(F.try_divide(part.cast("double") * 100, whole.cast("double")), 1)


def score(bad: Column, whole: Column) -> Column:
    """100 * (1 - bad / whole) to one decimal; null over nothing."""
    return F.round((1 - F.try_divide(bad.cast("double"), whole.cast("double"))) * 100, 1)


def pick_rows(
    df: DataFrame, keys: list[str], order_by: list[Column] | None = None, last: bool = False, row_key: list[str] | None = None
) -> DataFrame:
    """One row per key: the first (or last) in the given order, ties broken by all columns.

    With ``row_key``, columns that together tell the rows apart, ties are broken by those, only keys and
    order are grouped, and the chosen rows follow by a semi-join.

    min / max of a struct combine inside each map task before the shuffle, so a key that holds
    a third of all rows arrives at its reducer as one row per task; equal nulls are one key.
    """
    order = [c.alias(f"o{i}") for i, c in enumerate(order_by or [])]
    at = {k: f"_k{i}" for i, k in enumerate(dict.fromkeys(keys))}
    if row_key:
        which = F.struct(*order, *[col(c).alias(f"r{i}") for i, c in enumerate(row_key)])
        found = df.groupBy(*[col(k).alias(n) for k, n in at.items()]).agg((F.max if last else F.min)(which).alias("_chosen"))
        found = found.select(*[F.col("_chosen")[f"r{i}"].alias(f"_chosen_r{i}") for i in range(len(row_key))])
        same = [col(c).eqNullSafe(F.col(f"_chosen_r{i}")) for i, c in enumerate(row_key)]
        return df.join(found, reduce(Column.__and__, same), "left_semi")
    rest = [c for c in df.columns if c not in keys]
    ranked = F.struct(*order, F.struct(F.lit(0).alias("_"), *[col(c) for c in rest]).alias("row"))
    chosen = (F.max if last else F.min)(ranked).alias("_chosen")
    picked = df.groupBy(*[col(k).alias(n) for k, n in at.items()]).agg(chosen)
    row = F.col("_chosen")["row"]
    return picked.select(*[(F.col(at[c]) if c in at else row[c]).alias(c) for c in df.columns])
