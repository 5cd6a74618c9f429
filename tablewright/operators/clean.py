"""Cleaning: imputation, outliers, exact and near-text duplicates, normalisation."""

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.functions import hints
from tablewright.functions.text import date_text, email_text, phone_digits, text_key, trim_spaces
from tablewright.operators.frames import beside, col, keyed, number, numeric_columns, pick_rows, string_columns, to_long, wide_agg
from tablewright.operators.order_stats import LINEAR_QUARTILES, MEDIAN, fences, modes, order_stats

TEXT_SHARE = 0.3  # a text column: more than this share of rows holds text longer than two


def fill_values(df: DataFrame, columns: list[str], strategy: str, method: str = "auto") -> DataFrame:
    """One row with ``fill_{i}`` per column, as double; null where the strategy is unknown."""
    at = keyed(columns, df.columns)
    if strategy == "fill_mean":
        return wide_agg(df, [F.avg(number(c)).alias(f"fill_{i}") for c, i in at.items()])
    if strategy == "fill_median":
        row, stat = order_stats(df, columns, MEDIAN, method), "p50"
    elif strategy == "fill_mode":
        row, stat = modes(df, columns), "mode"
    else:
        return df.sparkSession.range(1).select(*[F.lit(None).cast("double").alias(f"fill_{i}") for i in at.values()])
    return row.select(*[F.col(f"{stat}_{i}").alias(f"fill_{i}") for i in at.values()])


def fit(row: DataFrame) -> dict:
    """The single row of a statistics frame, fetched once, for chains that use it more than once."""
    return row.first().asDict()


def fit_extent(df: DataFrame, columns: list[str]) -> dict:
    """Nulls of each column, and for numbers that a double may not hold the base to count from.

    A base is the column's least value: what lies above it is a small number again, on which
    statistics on doubles are exact.
    """
    at = keyed(columns, df.columns)
    measures = [F.count_if(col(c).isNull()).alias(f"nulls_{i}") for c, i in at.items()]
    wide = {c: i for c, i in at.items() if isinstance(df.schema[c].dataType, (T.LongType, T.DecimalType))}
    measures += [m for c, i in wide.items() for m in (F.min(col(c)).alias(f"least_{i}"), F.max(col(c)).alias(f"most_{i}"))]
    row, bases = fit(wide_agg(df, measures)), {}
    for c, i in wide.items():
        low, high, kind = row[f"least_{i}"], row[f"most_{i}"], df.schema[c].dataType
        many_digits = isinstance(kind, T.DecimalType) and kind.precision > 15
        if low is not None and (many_digits or max(abs(low), abs(high)) > 2**53):
            bases[c] = Decimal(low)
    return {"nulls": {c: row[f"nulls_{i}"] for c, i in at.items()}, "bases": bases}


def above(df: DataFrame, name: str, bases: dict) -> Column:
    """Column as double, counted from its base where it has one."""
    if name not in bases:
        return number(name)
    native = col(name) if isinstance(df.schema[name].dataType, T.DecimalType) else col(name).cast("decimal(20,0)")
    return (native - F.lit(bases[name])).cast("double")


def _above(df: DataFrame, bases: dict) -> DataFrame:
    return df.select(*_replaced(df, {c: above(df, c, bases) for c in bases})) if bases else df


def _replaced(df: DataFrame, new: dict[str, Column]) -> list[Column]:
    return [new[c].alias(c) if c in new else col(c) for c in df.columns]


def fit_fills(
    df: DataFrame, columns: list[str], strategy: str = "fill_median", method: str = "auto", extent: dict | None = None
) -> dict:
    """Fill value of each column that has nulls, fetched; none for an unknown strategy."""
    if not columns or strategy not in ("fill_mean", "fill_median", "fill_mode"):
        return {}
    extent = fit_extent(df, columns) if extent is None else extent
    row = fit(fill_values(_above(df, extent["bases"]), columns, strategy, method))
    fills = {}
    for c, i in keyed(columns, df.columns).items():
        value = row[f"fill_{i}"]
        if value is not None and extent["nulls"][c]:
            fills[c] = value if c not in extent["bases"] else extent["bases"][c] + Decimal(value)
    return fills


def fill_missing(
    df: DataFrame,
    strategy: str = "fill_median",
    columns: list[str] | None = None,
    method: str = "auto",
    values: dict | None = None,
) -> DataFrame:
    """Nulls of numeric columns filled with mean, upper median or mode; nothing else changes.

    Columns keep their type, except that a whole-number column with nulls becomes double when its
    mean is not whole; a decimal's mean is rounded to its scale. ``values`` are fill values fitted
    before (``fit_fills``). Any other strategy leaves the table as it is.
    """
    columns = numeric_columns(df) if columns is None else columns
    values = fit_fills(df, columns, strategy, method) if values is None else values
    new = {}
    for c, value in values.items():
        kind = df.schema[c].dataType
        if isinstance(kind, T.IntegralType) and value % 1:
            kind, value = T.DoubleType(), float(value)
        new[c] = F.coalesce(col(c).cast(kind), F.lit(value).cast(kind))
    return df.select(*_replaced(df, new)) if new else df


def outlier_bounds(df: DataFrame, columns: list[str], method: str = "auto") -> DataFrame:
    """One row: ``lo_{i}``, ``hi_{i}`` from interpolated quartiles, ``any_outlier`` over all columns."""
    at = keyed(columns, df.columns)
    ends = wide_agg(df, [m for c, i in at.items() for m in (F.min(number(c)).alias(f"min_{i}"), F.max(number(c)).alias(f"max_{i}"))])
    row = beside([order_stats(df, columns, LINEAR_QUARTILES, method), ends])
    bounds, outside = [], F.lit(False)
    for i in at.values():
        low, high = fences((F.col(f"q1_{i}"), F.col(f"q3_{i}")))
        bounds += [low.alias(f"lo_{i}"), high.alias(f"hi_{i}")]
        outside = outside | F.coalesce((F.col(f"min_{i}") < low) | (F.col(f"max_{i}") > high), F.lit(False))
    return row.select(*bounds, outside.alias("any_outlier"))


def fit_bounds(df: DataFrame, columns: list[str], method: str = "auto", extent: dict | None = None) -> dict:
    """Fences of each column, counted from its base, and whether any value lies outside."""
    bases = (fit_extent(df, columns) if extent is None else extent)["bases"]
    row = fit(outlier_bounds(_above(df, bases), columns, method))
    fences_ = {c: (row[f"lo_{i}"], row[f"hi_{i}"]) for c, i in keyed(columns, df.columns).items()}
    return {"bases": bases, "fences": fences_, "any_outlier": row["any_outlier"]}


def inside(df: DataFrame, name: str, bounds: dict) -> Column:
    """True for a value within its fences, null for a null."""
    low, high = bounds["fences"][name]
    return above(df, name, bounds["bases"]).between(F.lit(low), F.lit(high))


def survives(df: DataFrame, bounds: dict) -> Column:
    """True for the rows that ``null_outliers`` keeps: with any outlier, those that still hold a value."""
    if not bounds["any_outlier"]:
        return F.lit(True)
    fenced = bounds["fences"]
    cells = [F.when(inside(df, c, bounds) if c in fenced else col(c).isNotNull(), True) for c in df.columns]
    return F.coalesce(*cells, F.lit(False))


def null_outliers(
    df: DataFrame,
    outlier_method: str = "iqr",
    columns: list[str] | None = None,
    method: str = "auto",
    bounds: dict | None = None,
) -> DataFrame:
    """Values outside the fences become null, the others stay as they are; when any did, rows of nulls only are dropped.

    ``bounds`` are fences fitted before (``fit_bounds``).
    """
    columns = numeric_columns(df) if columns is None else columns
    if outlier_method != "iqr" or not columns:
        return df
    bounds = fit_bounds(df, columns, method) if bounds is None else bounds
    kept = df.where(survives(df, bounds))
    return kept.select(*_replaced(df, {c: F.when(inside(df, c, bounds), col(c)) for c in columns}))


def with_tallies(df: DataFrame, bounds: dict | None, dedup: bool, copies: str, outside: str) -> DataFrame:
    """Rows with the values outside their fences nulled, equal ones as one where asked for.

    Column ``copies`` tells how many rows of ``df`` a row stands for, ``outside`` how many of their values were
    nulled. Rows of nulls only are not dropped (``holds_value``), so what was removed and why can
    be counted from the result alone.
    """
    fenced = bounds["fences"] if bounds else {}
    cut = sum((F.when(~inside(df, c, bounds), 1).otherwise(0) for c in fenced), F.lit(0)).cast("bigint")
    cells = _replaced(df, {c: F.when(inside(df, c, bounds), col(c)) for c in fenced})
    every = df.select(*cells, F.lit(1).cast("bigint").alias(copies), cut.alias(outside))
    if not dedup:
        return every
    sums = [F.sum(col(c)).alias(c) for c in (copies, outside)]
    return every.groupBy(*[col(c) for c in df.columns]).agg(*sums)


def holds_value(columns: list[str]) -> Column:
    """True for a row in which any of the columns is not null."""
    return F.coalesce(*[F.when(col(c).isNotNull(), True) for c in columns], F.lit(False))


def drop_empty_rows(df: DataFrame) -> DataFrame:
    """Without the rows in which every column is null."""
    return df.na.drop("all")


def drop_duplicates(df: DataFrame) -> DataFrame:
    """One of each equal row; nulls are equal."""
    return df.dropDuplicates()


def trim_strings(df: DataFrame) -> DataFrame:
    return df.select(*_replaced(df, {c: trim_spaces(col(c)) for c in string_columns(df)}))


def text_shares(df: DataFrame) -> DataFrame:
    """One row: ``share_{i}``, the share of rows whose text is longer than two, per string column."""
    at = keyed(string_columns(df), df.columns)
    return wide_agg(df, [F.avg(F.when(F.length(col(c)) > 2, 1.0).otherwise(0.0)).alias(f"share_{i}") for c, i in at.items()])


def text_columns(df: DataFrame) -> DataFrame:
    """(column, share, is_text) for every string column, over all rows."""
    at = keyed(string_columns(df), df.columns)
    share = lambda i: F.round(F.coalesce(F.col(f"share_{i}"), F.lit(0.0)), 4)
    return to_long(
        text_shares(df),
        [
            {"column": F.lit(c), "share": share(i), "is_text": F.coalesce(F.col(f"share_{i}") > TEXT_SHARE, F.lit(False))}
            for c, i in at.items()
        ],
    )


def text_column_names(df: DataFrame) -> list[str]:
    """Names of the text columns; runs one aggregate and fetches its single row."""
    at = keyed(string_columns(df), df.columns)
    if not at:
        return []
    shares = text_shares(df).first()
    return [c for c, i in at.items() if (shares[f"share_{i}"] or 0.0) > TEXT_SHARE]


def text_row_key(columns: list[str]) -> Column:
    """'a|b|…' over the comparison keys of the columns, null counting as empty text."""
    return F.concat_ws("|", *[F.coalesce(text_key(col(c)), F.lit("")) for c in columns])


def near_text_dedup(
    df: DataFrame, columns: list[str] | None = None, order_by: list[Column] | None = None, row_key: str | None = None
) -> DataFrame:
    """First row per comparison key of the text columns.

    With no ``columns`` the text columns are found by their content; a table without any stays
    as it is. Rows are grouped by the SHA-256 of the key. With ``row_key``, a column that no two rows
    share, the first row is the one of its least value, only keys are grouped and the rows follow
    by a semi-join; without it whole rows go through the grouping.
    """
    columns = text_column_names(df) if columns is None else columns
    if not columns:
        return df
    key = F.sha2(text_row_key(columns), 256)
    if row_key is not None:
        first = df.groupBy(key.alias("_key")).agg(F.min(col(row_key)).alias("_first"))
        return df.join(first, col(row_key).eqNullSafe(F.col("_first")), "left_semi")
    with_key = df.withColumn("_key", key)
    return pick_rows(with_key, ["_key"], order_by).drop("_key")


def semantic_forms(df: DataFrame) -> dict:
    """{column: Column -> Column} for the phone, email and date text columns, by name."""
    forms = {"phone": phone_digits, "email": email_text, "date": date_text}
    found = {c: next((h for h in forms if hints.has_hint(c, hints.NAME_HINTS[h])), None) for c in string_columns(df)}
    return {c: forms[h] for c, h in found.items() if h}


def normalize_semantic(df: DataFrame) -> DataFrame:
    """Phones, emails and dates in text columns of that name brought to one form."""
    return df.select(*_replaced(df, {c: form(col(c)) for c, form in semantic_forms(df).items()}))
