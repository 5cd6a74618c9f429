"""Profiles of a table: type labels, nulls, value classes, outliers, duplicates, frequencies."""

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.functions import hints
from tablewright.functions.text import matches, parse_date, value_class
from tablewright.operators.frames import (
    beside,
    chunked,
    col,
    keyed,
    number,
    numeric_columns,
    percent,
    string_columns,
    text,
    to_long,
    union,
    wide_agg,
)
from tablewright.operators.order_stats import MEDIAN, QUARTILES, SUMMARY, fences, order_stats

# name of a fractional type and of a column without values, per kind of report
_LABELS = {
    "ingest": ("float", "null"), "clean": ("float", "null"), "bronze": ("float", "null"),
    "analyze": ("number", "null"), "govern": ("number", "unknown"),
}
LONG_TEXT = 64  # bytes
PREFIX = 32  # characters
VALUE_CLASSES = ["integer", "float", "boolean", "string"]


def declared_label(field: T.StructField, variant: str = "clean") -> str:
    """Label of the declared type; dates are text everywhere but on landing."""
    kind = field.dataType
    if isinstance(kind, T.BooleanType):
        return "boolean"
    if isinstance(kind, T.IntegralType):
        return "integer"
    if isinstance(kind, T.NumericType):
        return _LABELS[variant][0]
    if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)) and variant in ("ingest", "bronze"):
        return "datetime"
    return "string"


def label_of(df: DataFrame, name: str, non_null: Column, variant: str = "clean") -> Column:
    empty = _LABELS[variant][1]
    return F.when(non_null == 0, empty).otherwise(declared_label(df.schema[name], variant))


def row_counts(df: DataFrame, extra: list[Column] | None = None, classes: list[str] | None = None) -> DataFrame:
    """One row: ``rows``, ``filled_{i}`` (non-null cells per column) and any extra measures.

    For the text columns in ``classes`` there is also ``{class}_{i}``, the cells per value class;
    all of it is one pass over the table.
    """
    filled = [F.count(col(c)).alias(f"filled_{i}") for i, c in enumerate(df.columns)]
    at = keyed(classes or [], df.columns)
    # the class of a cell is worked out once, then counted four times
    kinds = df.select(*[col(c) for c in df.columns], *[value_class(col(c)).alias(f"_kind_{i}") for c, i in at.items()])
    per_class = [F.expr(f"count_if(_kind_{i} = '{k}') AS {k}_{i}") for i in at.values() for k in VALUE_CLASSES]
    return wide_agg(kinds if at else df, [F.count(F.lit(1)).alias("rows"), *filled, *per_class, *(extra or [])])


def _nulls(i: int) -> Column:
    return F.col("rows") - F.col(f"filled_{i}")


def dtype_labels(df: DataFrame, variant: str = "ingest", order_by: list[Column] | None = None) -> DataFrame:
    """Type label per column. On ingest a text column whose first value is a date is 'datetime';
    first is by ``order_by``, or the lowest value where no order is given."""
    row, labels = _labelled(df, variant, order_by)
    return to_long(row, [{"column": F.lit(c), "dtype": labels[c]} for c in df.columns])


def _labelled(df, variant, order_by=None):
    """Row counts, and the label of each column as an expression over them."""
    dated = string_columns(df) if variant == "ingest" else []
    order = [o.alias(f"o{k}") for k, o in enumerate(order_by or [])]
    extra = []
    for c in dated:
        first = F.min(F.when(col(c).isNotNull(), F.struct(*order, col(c).alias("v"))))["v"]
        extra.append(parse_date(first).isNotNull().alias(f"date_{df.columns.index(c)}"))
    labels = {}
    for i, c in enumerate(df.columns):
        labels[c] = label_of(df, c, F.col(f"filled_{i}"), variant)
        if c in dated:
            labels[c] = F.when(F.coalesce(F.col(f"date_{i}"), F.lit(False)), "datetime").otherwise(labels[c])
    return row_counts(df, extra), labels


def source_profile(df: DataFrame, order_by: list[Column] | None = None) -> DataFrame:
    """Column, type label, rows, nulls and null share of a source, all rows counted in one pass."""
    row, labels = _labelled(df, "ingest", order_by)
    return to_long(
        row,
        [
            {
                "column": F.lit(c),
                "dtype": labels[c],
                "rows": F.col("rows"),
                "nulls": _nulls(i),
                "null_pct": percent(_nulls(i), F.col("rows")),
            }
            for i, c in enumerate(df.columns)
        ],
    )


def class_mix(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Cells per value class of each text column, and how many classes the column mixes."""
    columns = columns or string_columns(df)
    at = keyed(columns, df.columns)
    records = []
    for c, i in at.items():
        used = sum((F.when(F.col(f"{k}_{i}") > 0, 1).otherwise(0) for k in VALUE_CLASSES), F.lit(0))
        records += [
            {"column": F.lit(c), "label": F.lit(k), "n": F.col(f"{k}_{i}"), "classes": used.cast("bigint")}
            for k in VALUE_CLASSES
        ]
    return to_long(row_counts(df, classes=columns), records)


def outlier_counts(df: DataFrame, columns: list[str] | None = None, method: str = "auto") -> DataFrame:
    """One row: ``outliers_{i}``, values strictly outside the nearest-rank quartile fences."""
    columns = numeric_columns(df) if columns is None else columns
    at = keyed(columns, df.columns)
    if not columns:
        return df.sparkSession.range(1).select(F.lit(0).alias("no_numbers"))
    quartiles = order_stats(df, columns, QUARTILES, method)
    values = df.select(*[number(c).alias(f"x{i}") for c, i in at.items()]).crossJoin(F.broadcast(quartiles))
    measures = []
    for i in at.values():
        low, high = fences((F.col(f"q1_{i}"), F.col(f"q3_{i}")))
        outside = (F.col(f"x{i}") < low) | (F.col(f"x{i}") > high)
        measures.append(F.count_if(outside).alias(f"outliers_{i}"))
    return wide_agg(values, measures)


def compact(c: Column) -> Column:
    """A text for counting only: long ones stand as their SHA-256, so a shuffle carries no long texts."""
    return F.when(F.octet_length(c) > LONG_TEXT, F.concat(F.lit("\0sha256:"), F.sha2(c, 256))).otherwise(c)


def duplicate_count(df: DataFrame) -> DataFrame:
    """One row: ``duplicates``, rows beyond the first of each equal row (nulls are equal)."""
    texts = set(string_columns(df))
    keys = [(compact(col(c)) if c in texts else col(c)).alias(f"k{i}") for i, c in enumerate(df.columns)]
    copies = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_copies"))
    return copies.agg(F.coalesce(F.sum(F.col("_copies") - 1), F.lit(0)).cast("bigint").alias("duplicates"))


def _counting_type(kind: T.DataType) -> str:
    """Type under which a column's values are counted: native for whole and double numbers, else text."""
    if isinstance(kind, T.IntegralType):
        return "bigint"
    return "double" if isinstance(kind, T.DoubleType) else "string"


def key_counts(df: DataFrame, columns: list[str]) -> list[DataFrame]:
    """(slot, values, n): how often each value occurs, all types of a chunk of columns in one pass.

    A cell stands in the one of the value columns that has its counting type. Counted inside each
    map task first, so a frequent value crosses the shuffle once per task. Long texts are counted by
    their digest.
    """
    at = keyed(columns, df.columns)
    parts = []
    for names in chunked(columns):
        kinds = {c: _counting_type(df.schema[c].dataType) for c in names}
        present = sorted(set(kinds.values()))
        cells = []
        for c in names:
            value = compact(text(c)) if kinds[c] == "string" else col(c).cast(kinds[c])
            cells += [F.lit(at[c]), *(value if k == kinds[c] else F.lit(None).cast(k) for k in present)]
        values = [f"value_{k}" for k in present]
        rows = df.select(F.stack(F.lit(len(names)), *cells).alias("slot", *values)).where(reduce(Column.__or__, [F.col(v).isNotNull() for v in values]))
        parts.append(rows.groupBy("slot", *values).agg(F.count(F.lit(1)).alias("n")))
    return parts


def distinct_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row: ``distinct_{i}`` non-null values and ``copies_{i}`` repeated ones of each column."""
    slots = keyed(columns, df.columns).values()
    if not columns:
        return df.sparkSession.range(1).select(F.lit(0).alias("no_values"))
    count = [F.count(F.lit(1)).alias("d"), F.sum(F.col("n") - 1).alias("c")]
    per_slot = union([part.groupBy("slot").agg(*count) for part in key_counts(df, columns)])
    return per_slot.agg(
        *[
            F.expr(f"coalesce(max(CASE WHEN slot = {i} THEN {m} END), 0) AS {name}_{i}")
            for i in slots
            for name, m in (("distinct", "d"), ("copies", "c"))
        ]
    )


def lowest_values(df: DataFrame, n: int) -> DataFrame:
    """(slot, values): the ``n`` lowest distinct values of each column as text, joined by ' | '.

    First the lowest short prefixes are found, then only cells with one of those are compared
    whole; the rank limit works inside each map task too, so few rows reach the last one.
    """
    columns = df.columns
    pairs = [e for i, c in enumerate(columns) for e in (F.lit(i), text(c))]
    cells = df.select(F.stack(F.lit(len(columns)), *pairs).alias("slot", "value")).where("value IS NOT NULL")
    cells = cells.withColumn("head", F.left("value", F.lit(PREFIX)))

    def lowest(distinct, by):
        rank = F.row_number().over(Window.partitionBy("slot").orderBy(by))
        return distinct.withColumn("_rank", rank).where(F.col("_rank") <= n).drop("_rank")

    heads = lowest(cells.select("slot", "head").distinct(), "head")
    few = cells.join(F.broadcast(heads), ["slot", "head"], "left_semi")  # n rows per column
    picked = lowest(few.select("slot", "value").distinct(), "value")
    return picked.groupBy("slot").agg(F.concat_ws(" | ", F.array_sort(F.collect_list("value"))).alias("samples"))


def clean_profile(df: DataFrame, method: str = "auto") -> DataFrame:
    """Per column: label, nulls, outliers; and the table's rows, columns and duplicate rows."""
    numbers = numeric_columns(df)
    row = beside([row_counts(df), outlier_counts(df, numbers, method), duplicate_count(df)])
    return to_long(
        row,
        [
            {
                "column": F.lit(c),
                "dtype": label_of(df, c, F.col(f"filled_{i}")),
                "rows": F.col("rows"),
                "columns": F.lit(len(df.columns)).cast("bigint"),
                "nulls": _nulls(i),
                "outliers": F.col(f"outliers_{i}") if c in numbers else F.lit(0).cast("bigint"),
                "duplicates": F.col("duplicates"),
            }
            for i, c in enumerate(df.columns)
        ],
    )


def format_rule(name: str) -> str | None:
    """Whole-value pattern a column promises by its name, if any."""
    if hints.has_hint(name, hints.ACCURACY_ID):
        return hints.ID_CARD_WHOLE
    if hints.has_hint(name, hints.NAME_HINTS["phone"]):
        return hints.PHONE_WHOLE
    if hints.has_hint(name, hints.NAME_HINTS["email"]):
        return hints.EMAIL_WHOLE
    return None


def column_profile(df: DataFrame, method: str = "auto") -> DataFrame:
    """The full profile: label, rows, nulls, share of nulls, distinct, outliers, format violations."""
    numbers = numeric_columns(df)
    rules = {c: format_rule(c) for c in string_columns(df)}
    broken = [
        F.count_if(~matches(col(c), rule)).alias(f"broken_{df.columns.index(c)}") for c, rule in rules.items() if rule
    ]
    row = beside([row_counts(df, broken), distinct_counts(df, df.columns), outlier_counts(df, numbers, method)])
    zero = F.lit(0).cast("bigint")
    return to_long(
        row,
        [
            {
                "column": F.lit(c),
                "dtype": label_of(df, c, F.col(f"filled_{i}")),
                "rows": F.col("rows"),
                "nulls": _nulls(i),
                "null_pct": percent(_nulls(i), F.col("rows")),
                "distinct": F.col(f"distinct_{i}"),
                "outliers": F.col(f"outliers_{i}") if c in numbers else zero,
                "format_violations": F.col(f"broken_{i}") if rules.get(c) else zero,
            }
            for i, c in enumerate(df.columns)
        ],
    )


def summary(df: DataFrame, method: str = "auto") -> DataFrame:
    """Per column: filled cells and null share; min, max, mean, median of numbers, distinct of the rest."""
    numbers = numeric_columns(df)
    others = [c for c in df.columns if c not in numbers]
    at = keyed(numbers, df.columns)
    spread = [m for c, i in at.items() for m in _spread(number(c), i)]
    row = beside([row_counts(df, spread), order_stats(df, numbers, MEDIAN, method), distinct_counts(df, others)])
    none = F.lit(None).cast("double")
    records = []
    for i, c in enumerate(df.columns):
        numeric = c in at
        records.append(
            {
                "column": F.lit(c),
                "dtype": label_of(df, c, F.col(f"filled_{i}"), "analyze"),
                "rows": F.col("rows"),
                "non_null": F.col(f"filled_{i}"),
                "null_pct": percent(_nulls(i), F.col("rows")),
                "min": F.col(f"min_{i}") if numeric else none,
                "max": F.col(f"max_{i}") if numeric else none,
                "mean": F.round(F.col(f"mean_{i}"), 2) if numeric else none,
                "median": F.col(f"p50_{i}") if numeric else none,
                "distinct": F.lit(None).cast("bigint") if numeric else F.col(f"distinct_{i}"),
            }
        )
    return to_long(row, records)


def _spread(x: Column, i: int) -> list[Column]:
    return [F.min(x).alias(f"min_{i}"), F.max(x).alias(f"max_{i}"), F.avg(x).alias(f"mean_{i}")]


def numeric_distribution(df: DataFrame, columns: list[str] | None = None, method: str = "auto") -> DataFrame:
    """Min, quartiles, max and mean of numeric columns."""
    columns = numeric_columns(df) if columns is None else columns
    at = keyed(columns, df.columns)
    spread = wide_agg(df, [m for c, i in at.items() for m in _spread(number(c), i)])
    row = beside([spread, order_stats(df, columns, SUMMARY, method)])
    return to_long(
        row,
        [
            {
                "column": F.lit(c),
                **{k: F.col(f"{k}_{i}") for k in ("min", "p25", "p50", "p75", "max")},
                "mean": F.round(F.col(f"mean_{i}"), 2),
            }
            for c, i in at.items()
        ],
    )


def distribution(df: DataFrame, column: str, n: int = 20) -> DataFrame:
    """The ``n`` most frequent values of a column as text, with its filled and distinct counts."""
    counts = df.groupBy(text(column).alias("value")).agg(F.count(F.lit(1)).alias("n")).where("value IS NOT NULL")
    totals = counts.agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("distinct"))
    top = counts.orderBy(F.desc("n"), "value").limit(n)
    return top.crossJoin(F.broadcast(totals))


def top_n(df: DataFrame, column: str, n: int = 10) -> DataFrame:
    return distribution(df, column, n)
