"""Standardisation: industry, field classes, sensitivity grades, format checks, alignment score."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.functions import hints
from tablewright.functions.text import digits_of
from tablewright.operators.frames import beside, col, percent, string_columns, text, to_long, wide_agg
from tablewright.operators.profile import row_counts
from tablewright.operators.quality import date_value, maturity_level


def industry_scores(df: DataFrame, industries: dict[str, list[str]] | None = None) -> DataFrame:
    """(position, industry, hits): keywords of each industry seen in column names or text cells."""
    table = industries or hints.INDUSTRIES
    names = " ".join(df.columns).lower()
    cells = F.lower(F.concat_ws(" ", *[col(c) for c in string_columns(df)]))
    words = df.select(cells.alias("words"))
    found = {}
    for k, (industry, keywords) in enumerate(table.items()):
        for m, word in enumerate(keywords):
            found[f"w_{k}_{m}"] = F.lit(True) if word in names else F.bool_or(F.col("words").contains(word))
    row = wide_agg(words, [v.alias(name) for name, v in found.items()])
    records = []
    for k, (industry, keywords) in enumerate(table.items()):
        hits = sum((F.coalesce(F.col(f"w_{k}_{m}"), F.lit(False)).cast("bigint") for m in range(len(keywords))), F.lit(0).cast("bigint"))
        records.append({"position": F.lit(k), "industry": F.lit(industry), "hits": hits})
    return to_long(row, records)


def industry(
    df: DataFrame,
    hint: str = "",
    industries: dict[str, list[str]] | None = None,
    standards: dict[str, str] | None = None,
) -> DataFrame:
    """One row (industry, hits, standard): most keywords wins, first listed on ties, none is general."""
    if hint:
        best = row_counts(df).select(F.lit(hint).alias("industry"), F.lit(None).cast("bigint").alias("hits"))
    else:
        scores = industry_scores(df, industries)
        top = scores.agg(F.max(F.struct("hits", (-F.col("position")).alias("p"), "industry")).alias("top"))
        best = top.select(
            F.when(F.col("top.hits") > 0, F.col("top.industry")).otherwise(hints.GENERAL_INDUSTRY).alias("industry"),
            F.col("top.hits").alias("hits"),
        )
    return best.withColumn("standard", standard_of(F.col("industry"), standards))


def standard_of(industry_name: Column, standards: dict[str, str] | None = None) -> Column:
    table = F.create_map(*[F.lit(x) for kv in (standards or hints.INDUSTRY_STANDARDS).items() for x in kv])
    return F.coalesce(F.try_element_at(table, industry_name), F.lit(hints.GENERAL_STANDARD))


def field_class(name: Column) -> Column:
    """Class of a field by its name, for a column that holds field names."""
    out = F.lit(hints.OTHER_CLASS)
    for label, words in reversed(hints.FIELD_CLASSES.items()):
        out = F.when(F.lower(name).rlike("|".join(words)), label).otherwise(out)
    return out


def field_classes(df: DataFrame) -> DataFrame:
    """(column, label, n): class of every column of the table, with its filled cells."""
    return to_long(
        row_counts(df),
        [
            {"column": F.lit(c), "label": F.lit(_class_of(c)), "n": F.col(f"filled_{i}")}
            for i, c in enumerate(df.columns)
        ],
    )


def _class_of(name: str) -> str:
    return hints.first_label(name, hints.FIELD_CLASSES, hints.OTHER_CLASS)


def field_grades(df: DataFrame) -> DataFrame:
    """(column, label, rule): core, important or general; core also by id numbers in the cells."""
    strings = string_columns(df)
    seen = {c: F.bool_or(col(c).rlike(hints.ID_CARD_START)) for c in strings}
    row = wide_agg(df, [F.lit(0).alias("_"), *[v.alias(f"id_{df.columns.index(c)}") for c, v in seen.items()]])
    records = []
    for i, c in enumerate(df.columns):
        by_name = F.lit(hints.IMPORTANT if hints.has_hint(c, hints.IMPORTANT_HINTS) else hints.GENERAL)
        rule = F.lit("column_name" if hints.has_hint(c, hints.IMPORTANT_HINTS) else "default")
        if hints.has_hint(c, hints.CORE_HINTS):
            by_name, rule = F.lit(hints.CORE), F.lit("column_name")
        elif c in strings:
            by_value = F.coalesce(F.col(f"id_{i}"), F.lit(False))
            by_name = F.when(by_value, hints.CORE).otherwise(by_name)
            rule = F.when(by_value, "value").otherwise(rule)
        records.append({"column": F.lit(c), "label": by_name, "rule": rule})
    return to_long(row, records)


def table_grade(df: DataFrame) -> DataFrame:
    """(label, n, is_table_grade) per grade; the highest grade in use is the table's."""
    counts = field_grades(df).agg(
        *[F.count_if(F.col("label") == g).alias(f"n_{k}") for k, g in enumerate((hints.CORE, hints.IMPORTANT, hints.GENERAL))]
    )
    core, important = F.col("n_0") > 0, F.col("n_1") > 0
    return to_long(
        counts,
        [
            {"label": F.lit(hints.CORE), "n": F.col("n_0"), "is_table_grade": core},
            {"label": F.lit(hints.IMPORTANT), "n": F.col("n_1"), "is_table_grade": ~core & important},
            {"label": F.lit(hints.GENERAL), "n": F.col("n_2"), "is_table_grade": ~core & ~important},
        ],
    )


def _format_checks(df: DataFrame) -> dict[str, tuple[str, Column, str]]:
    checks = {}
    for c in df.columns:
        if hints.has_hint(c, hints.DATE_FORMAT_HINTS):
            date = date_value(df, c)
            bad = (text(c) != "") if date is None else date.isNull() & (text(c) != "")
            checks[c] = ("date_format", bad, hints.DATE_FORMAT_ADVICE)
        elif hints.has_hint(c, hints.PHONE_FORMAT_HINTS):
            bad = (text(c) != "") & ~digits_of(text(c)).rlike(r"^1\p{Nd}{10}\z")
            checks[c] = ("phone_format", bad, hints.PHONE_FORMAT_ADVICE)
    return checks


def format_issues(df: DataFrame) -> DataFrame:
    """(column, issue, severity, n, pct, action): unreadable dates and malformed phones per column."""
    checks = _format_checks(df)
    if not checks:
        return df.sparkSession.createDataFrame(
            [], "column string, issue string, severity string, n bigint, pct double, action string"
        )
    counts = [F.count_if(bad).alias(f"bad_{df.columns.index(c)}") for c, (_, bad, _) in checks.items()]
    row = wide_agg(df, [F.count(F.lit(1)).alias("rows"), *counts])
    records = []
    for c, (issue, _, advice) in checks.items():
        n = F.col(f"bad_{df.columns.index(c)}")
        pct = percent(n, F.col("rows"))
        records.append(
            {"column": F.lit(c), "issue": F.lit(issue), "severity": F.lit("warning"), "n": n, "pct": pct, "action": F.lit(advice)}
        )
    return to_long(row, records).where("n > 0")


def alignment_score(df: DataFrame) -> DataFrame:
    """One row (score, level, notes): 100 less 5 per format issue, with notes on coverage and core fields."""
    issues = format_issues(df).agg(F.count(F.lit(1)).alias("issues"))
    core = field_grades(df).agg(F.count_if(F.col("label") == hints.CORE).alias("core"))
    classified = sum(1 for c in df.columns if _class_of(c) != hints.OTHER_CLASS)
    coverage = classified / len(df.columns) * 100 if df.columns else 100.0
    coverage_note = F.lit(hints.COVERAGE_NOTE.format(f"{coverage:.0f}") if coverage < 80 else None).cast("string")
    value = F.greatest(F.lit(0), F.least(F.lit(100), 100 - 5 * F.col("issues"))).cast("double")
    notes = F.concat_ws(
        "; ",
        coverage_note,
        F.when(F.col("issues") > 0, F.concat(F.col("issues").cast("string"), F.lit(hints.FORMAT_ISSUES_NOTE))),
        F.when(F.col("core") > 0, hints.CORE_FIELD_NOTE),
    )
    return beside([issues, core]).select(value.alias("score"), maturity_level(value).alias("level"), notes.alias("notes"))
