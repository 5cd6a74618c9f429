"""Quality: six dimension scores, maturity level, repair tiers, observability snapshot."""

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.functions import hints
from tablewright.functions.text import matches, parse_date
from tablewright.operators.frames import beside, col, numeric_columns, percent, score, string_columns, text, to_long
from tablewright.operators.profile import (
    VALUE_CLASSES,
    column_profile,
    duplicate_count,
    outlier_counts,
    row_counts,
)

DIMENSIONS = list(hints.QUALITY_WEIGHTS)


def date_value(df: DataFrame, name: str) -> Column | None:
    """Date of a date-like column; None for a column whose type cannot hold one."""
    kind = df.schema[name].dataType
    if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return col(name).cast("date")
    if isinstance(kind, T.StringType):
        return parse_date(col(name))
    return None


def first_date_column(df: DataFrame, words: list[str]) -> str | None:
    return next((c for c in df.columns if hints.has_hint(c, words) and date_value(df, c) is not None), None)


def recent_share(df: DataFrame, words: list[str], as_of: str, strict: bool = False) -> list[Column]:
    """Measures ``recent`` and ``dated``; a null or unreadable date counts as old."""
    name = first_date_column(df, words)
    if name is None:
        return [F.lit(None).cast("bigint").alias("recent")]
    age = F.date_diff(F.lit(as_of).cast("date"), date_value(df, name))
    fresh = age < 365 if strict else age <= 365
    return [F.count_if(F.coalesce(fresh, F.lit(False))).alias("recent")]


def _valid_cells(df: DataFrame) -> tuple[list[Column], int]:
    """Counts of well-formed cells in phone and email columns, and the number of such columns."""
    out = []
    for c in df.columns:
        for hint, pattern in (("phone", hints.PHONE_WHOLE), ("email", hints.EMAIL_WHOLE)):
            if hints.has_hint(c, hints.NAME_HINTS[hint]):
                out.append(F.count_if(F.coalesce(matches(text(c), pattern), F.lit(False))))
                break
    return out, len(out)


def one_class_columns(df: DataFrame, columns: list[str]) -> Column:
    """How many of the text columns hold values of at most one class (over ``row_counts``)."""
    total = F.lit(0)
    for c in columns:
        i = df.columns.index(c)
        used = sum((F.when(F.col(f"{k}_{i}") > 0, 1).otherwise(0) for k in VALUE_CLASSES), F.lit(0))
        total = total + F.when(used <= 1, 1).otherwise(0)
    return total


def score_row(df: DataFrame, as_of: str, method: str = "auto") -> DataFrame:
    """One row with a column per dimension (0 to 100, one decimal; null over an empty table)."""
    valid, checked = _valid_cells(df)
    extra = recent_share(df, hints.NAME_HINTS["date"], as_of)
    extra += [v.alias(f"valid_{k}") for k, v in enumerate(valid)]
    strings = string_columns(df)
    numbers = numeric_columns(df)
    row = beside([row_counts(df, extra, strings), outlier_counts(df, numbers, method), duplicate_count(df)])
    width = len(df.columns)
    rows = F.col("rows")
    cells = rows * width
    filled = sum((F.col(f"filled_{i}") for i in range(width)), F.lit(0))
    outliers = sum((F.col(f"outliers_{df.columns.index(c)}") for c in numbers), F.lit(0))
    uniform = F.lit(width - len(strings)) + one_class_columns(df, strings)
    dated = first_date_column(df, hints.NAME_HINTS["date"]) is not None
    good = sum((F.col(f"valid_{k}") for k in range(checked)), F.lit(0))
    full = F.lit(100.0)
    return row.select(
        score(cells - filled, cells).alias("completeness"),
        score(outliers, cells).alias("accuracy"),
        percent(uniform, F.lit(width)).alias("consistency"),
        (percent(F.col("recent"), rows) if dated else full).alias("timeliness"),
        score(F.col("duplicates"), rows).alias("uniqueness"),
        (percent(good, rows * checked) if checked else full).alias("validity"),
    )


def overall(scores: dict[str, Column]) -> Column:
    return sum((scores[k] * w for k, w in hints.QUALITY_WEIGHTS.items()), F.lit(0.0))


def maturity_level(value: Column) -> Column:
    out = F.lit(hints.MATURITY_FLOOR)
    for limit, label in reversed(hints.MATURITY_LEVELS):
        out = F.when(value >= limit, label).otherwise(out)
    return out


def quality_scores(df: DataFrame, as_of: str, method: str = "auto") -> DataFrame:
    """(metric, score, level): six dimensions and the weighted overall score with its level."""
    row = score_row(df, as_of, method)
    total = overall({k: F.col(k) for k in DIMENSIONS})
    records = [{"metric": F.lit(k), "score": F.col(k), "level": F.lit(None).cast("string")} for k in DIMENSIONS]
    records.append({"metric": F.lit("overall"), "score": F.round(total, 1), "level": maturity_level(total)})
    return to_long(row, records)


def below_threshold(scores: DataFrame, thresholds: dict[str, float] | None = None) -> DataFrame:
    """Scores under their limit."""
    limits = thresholds or hints.QUALITY_THRESHOLDS
    limit = F.create_map(*[F.lit(x) for kv in limits.items() for x in kv])
    return scores.withColumn("threshold", F.try_element_at(limit, "metric")).where("score < threshold")


def repair_tiers(df: DataFrame, method: str = "auto") -> DataFrame:
    """(column, issue, severity, n, pct, action): who repairs what — auto, rule or manual."""
    watched = [c for c in df.columns if hints.has_hint(c, hints.FORMAT_COLUMNS)]
    pct = F.try_divide(F.col("nulls") * 100.0, F.col("rows"))
    null_fill, outliers, violation = hints.REPAIR_ISSUES
    auto, rule, manual = hints.REPAIR_TIERS
    by_mode, by_median, by_rule, many_nulls, clip, integrity = hints.REPAIR_ACTIONS
    fill = F.when(F.col("column").isin(hints.MODE_FILLED_COLUMNS), by_mode).otherwise(by_median)
    null_action = F.when(pct < 10, fill).when(pct < 30, by_rule).otherwise(many_nulls)
    none = F.lit(None).cast("double")
    found = [
        (null_fill, F.when(pct < 10, auto).when(pct < 30, rule).otherwise(manual), F.col("nulls"), F.col("null_pct"), null_action),
        (outliers, F.lit(rule), F.col("outliers"), none, F.lit(clip)),
        (
            violation,
            F.lit(manual),
            F.when(F.col("column").isin(watched), F.col("format_violations")).otherwise(F.lit(0)),
            none,
            F.lit(integrity),
        ),
    ]
    issues = F.array(
        *[
            F.struct(F.lit(issue).alias("issue"), severity.alias("severity"), n.alias("n"), share.alias("pct"), action.alias("action"))
            for issue, severity, n, share, action in found
        ]
    )
    return column_profile(df, method).select("column", F.inline(issues)).where("n > 0")


def schema_hash(columns: list[str]) -> str:
    """First 8 hex digits of the SHA-256 of the sorted, comma-joined column names."""
    return hashlib.sha256(",".join(sorted(columns)).encode()).hexdigest()[:8]


def snapshot(before: DataFrame, after: DataFrame, source: str, at: str) -> DataFrame:
    """One row per run: rows, change in rows, schema hash and health of the cleaned table."""
    counts = beside(
        [before.agg(F.count(F.lit(1)).alias("rows_before")), after.agg(F.count(F.lit(1)).alias("rows"))]
    )
    return snapshot_row(counts, after.columns, source, at)


def snapshot_row(counts: DataFrame, columns: list[str], source: str, at: str) -> DataFrame:
    """As ``snapshot``, from one row with the counts ``rows_before`` and ``rows``."""
    return counts.select(
        F.lit(at).cast("timestamp").alias("ts"),
        F.lit(source).alias("source"),
        "rows",
        (F.col("rows") - F.col("rows_before")).alias("delta"),
        F.lit(schema_hash(columns)).alias("schema_hash"),
        F.lit(len(columns)).cast("bigint").alias("columns"),
        F.when(F.col("rows") > 0, "healthy").otherwise("empty").alias("health"),
    )
