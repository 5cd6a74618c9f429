"""Integration of several sources: align, union, join, de-duplicate."""

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.operators.frames import col, pick_rows, text, union
from tablewright.operators.joins import attach


def all_columns(sources: list[DataFrame]) -> list[str]:
    """Column names in first-seen order over the sources."""
    return list(dict.fromkeys(c for df in sources for c in df.columns))


def align(sources: list[DataFrame]) -> list[DataFrame]:
    """Every source with all columns; absent ones are null, clashing types meet as text."""
    names = all_columns(sources)
    kinds = {c: {df.schema[c].dataType for df in sources if c in df.columns} for c in names}

    def cell(df, c):
        if c not in df.columns:
            kind = next(iter(kinds[c])) if len(kinds[c]) == 1 else "string"
            return F.lit(None).cast(kind).alias(c)
        return col(c) if len(kinds[c]) == 1 else text(c).alias(c)

    return [df.select(*[cell(df, c) for c in names]) for df in sources]


def union_all(sources: list[DataFrame]) -> DataFrame:
    """Rows of all sources under the aligned columns, copies kept."""
    return union(align(sources))


def join_sources(
    left: DataFrame,
    right: DataFrame,
    key: str,
    order_by: list[Column] | None = None,
    how: str = "inner",
    row_key: str | None = None,
) -> DataFrame:
    """Left rows with the last right row of the same key, one column per name.

    Last is by ``order_by`` over the right columns, ties by all its columns. A shared column takes
    the left value, else the right one. Null keys match each other; keys of different types meet
    as text. A key that a side lacks falls back to the union. With ``row_key``, a column that tells
    the right rows apart, ties go by it and whole right rows are not grouped.
    """
    if key not in left.columns or key not in right.columns:
        return union_all([left, right])
    names = all_columns([left, right])
    if left.schema[key].dataType != right.schema[key].dataType:
        left = left.withColumn(key, text(key))
        right = right.withColumn(key, text(key))
    last = pick_rows(right, [key], order_by, last=True, row_key=[row_key] if row_key else None)
    renamed = {c: f"_right_{i}" for i, c in enumerate(right.columns) if c != key}
    lookup = last.select(col(key), *[col(c).alias(n) for c, n in renamed.items()])
    joined = attach(left, lookup, key, how)

    def cell(c):
        if c not in renamed:
            return col(c)
        if c not in left.columns:
            return F.col(renamed[c]).alias(c)
        return F.coalesce(col(c), F.col(renamed[c])).alias(c)

    return joined.select(*[cell(c) for c in names])


def enrich(
    left: DataFrame, right: DataFrame, key: str, order_by: list[Column] | None = None, how: str = "inner", row_key: str | None = None
):
    """As ``join_sources``; ``how='left'`` keeps left rows without a match."""
    return join_sources(left, right, key, order_by, how, row_key)


def dedup_on(
    df: DataFrame, keys: list[str], order_by: list[Column] | None = None, row_key: str | list[str] | None = None
) -> DataFrame:
    """First row per key; unknown keys are ignored, and with none left nothing is dropped.

    ``row_key``: a column, or several, that tell the rows apart; then whole rows are not grouped.
    """
    known = [k for k in keys if k in df.columns]
    return pick_rows(df, known, order_by, row_key=[row_key] if isinstance(row_key, str) else row_key) if known else df


def integrate(
    sources: dict[str, DataFrame],
    strategy: str = "union",
    join_key: str = "",
    dedup_keys: list[str] | None = None,
    order_by: list[Column] | None = None,
    how: str = "inner",
    row_key: str | None = None,
) -> DataFrame:
    """Two or more sources merged by union, join or enrich, then de-duplicated on keys.

    For the union the first row per key is the one of the earlier source. Join and enrich attach
    each further source to what the earlier ones gave; ``order_by`` (which right row is the last,
    which merged row is the first) counts where all its columns exist. ``row_key`` names a column that
    every source has and that tells its rows apart (``files.read_parquet`` can add one): then rows are
    grouped by keys alone, but for those of a join other than inner or left.
    """
    if len(sources) < 2:
        raise ValueError("integration needs at least two sources")
    frames = list(sources.values())
    lacking = [s for s, df in sources.items() if row_key and row_key not in df.columns]
    if lacking:
        raise ValueError(f"no column {row_key!r} in {lacking}")
    if strategy == "union":
        numbered = [df.withColumn("_source", F.lit(i)) for i, df in enumerate(frames)]
        merged = union_all(numbered)
        order = [F.col("_source"), *(order_by or [])]
        return dedup_on(merged, dedup_keys or [], order, ["_source", row_key] if row_key else None).drop("_source")
    if strategy not in ("join", "enrich") or not join_key:
        raise ValueError(f"unknown strategy {strategy!r}, or no join key")
    merged = frames[0]
    for right in frames[1:]:
        merged = join_sources(merged, right, join_key, _known(right, order_by), how, row_key)
    # each left row meets one right row at most, so the left keys still tell the rows apart
    return dedup_on(merged, dedup_keys or [], _known(merged, order_by), row_key if how in ("inner", "left") else None)


def _known(df: DataFrame, order_by: list[Column] | None) -> list[Column] | None:
    """The order if the table has all its columns; only the plan is looked at."""
    try:
        df.select(*(order_by or []))
        return order_by
    except AnalysisException:
        return None


def source_counts(sources: dict[str, DataFrame]) -> DataFrame:
    """(source, n): rows per source."""
    return union([df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(s).alias("source"), "n") for s, df in sources.items()])
