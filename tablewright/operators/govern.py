"""Governance: catalogue, tags, glossary, asset score, contracts, sensitivity, audit."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.functions import hints
from tablewright.functions.text import is_blank, matches
from tablewright.operators.frames import beside, numeric_columns, percent, string_columns, text, to_long, wide_agg
from tablewright.operators.profile import distinct_counts, duplicate_count, label_of, lowest_values, row_counts
from tablewright.operators.quality import first_date_column, one_class_columns, recent_share

ASSET_DIMENSIONS = ["completeness", "accuracy", "uniqueness", "consistency", "freshness", "compliance", "documentation"]


def auto_tags(df: DataFrame, name: str) -> list[str]:
    tags = [tag for tag, words in hints.TAG_HINTS.items() if hints.has_hint(name, words)]
    return tags + (["numeric"] if name in numeric_columns(df) else [])


def tags(df: DataFrame) -> DataFrame:
    """(column, label, n): one row per tag of a column, with the column's filled cells."""
    records = [
        {"column": F.lit(c), "label": F.lit(t), "n": F.col(f"filled_{i}")}
        for i, c in enumerate(df.columns)
        for t in auto_tags(df, c)
        if t != "numeric"
    ]
    # a column without a single value is not tagged numeric
    numeric = [
        {"column": F.lit(c), "label": F.lit("numeric"), "n": F.col(f"filled_{df.columns.index(c)}")}
        for c in numeric_columns(df)
    ]
    long = to_long(row_counts(df), records + numeric)
    return long.where((F.col("label") != "numeric") | (F.col("n") > 0))


def catalog(df: DataFrame, samples: int = 5) -> DataFrame:
    """Per field: display name, type, nullable, null share, distinct values, lowest samples, tags."""
    columns = df.columns
    base = to_long(
        beside([row_counts(df), distinct_counts(df, columns)]),
        [
            {
                "slot": F.lit(i),
                "column": F.lit(c),
                "display_name": F.lit(hints.STANDARD_NAMES.get(c, c)),
                "dtype": label_of(df, c, F.col(f"filled_{i}"), "govern"),
                "nullable": F.col(f"filled_{i}") < F.col("rows"),
                "null_pct": percent(F.col("rows") - F.col(f"filled_{i}"), F.col("rows")),
                "distinct": F.col(f"distinct_{i}"),
                "tags": F.lit(",".join(auto_tags(df, c))),
            }
            for i, c in enumerate(columns)
        ],
    )
    return base.join(F.broadcast(lowest_values(df, samples)), "slot", "left").drop("slot")  # one row per column


def glossary(df: DataFrame, names: dict[str, str] | None = None) -> DataFrame:
    """(technical_name, business_name, status, coverage_pct, n): columns with a standard name."""
    table = names or hints.STANDARD_NAMES
    mapped = [c for c in df.columns if table.get(c, c) != c]
    coverage = F.round(F.lit(len(mapped) / max(len(df.columns), 1) * 100), 1)
    return to_long(
        row_counts(df),
        [
            {
                "technical_name": F.lit(c),
                "business_name": F.lit(table.get(c, c)),
                "status": F.lit("mapped" if c in mapped else "unmapped"),
                "coverage_pct": coverage,
                "n": F.col(f"filled_{i}"),
            }
            for i, c in enumerate(df.columns)
        ],
    )


def _format_columns(df: DataFrame, rules: list[tuple[list[str], str]]) -> dict[str, str]:
    """{column: whole-value pattern} by the first rule whose hint words occur in the name."""
    found = {c: next((p for words, p in rules if hints.has_hint(c, words)), None) for c in df.columns}
    return {c: p for c, p in found.items() if p}


def _accuracy_columns(df):
    return _format_columns(
        df,
        [
            (hints.ACCURACY_PHONE, hints.PHONE_WHOLE),
            (hints.ACCURACY_EMAIL, hints.EMAIL_WHOLE),
            (hints.ACCURACY_ID, hints.ID_CARD_WHOLE),
        ],
    )


def _compliance_columns(df):
    return _format_columns(
        df, [(hints.COMPLIANCE_PHONE, hints.PHONE_WHOLE), (hints.COMPLIANCE_EMAIL, hints.EMAIL_WHOLE)]
    )


def asset_row(df: DataFrame, as_of: str, names: dict[str, str] | None = None) -> DataFrame:
    """One row with the seven asset dimensions, unrounded."""
    accuracy, compliance = _accuracy_columns(df), _compliance_columns(df)
    at = {c: i for i, c in enumerate(df.columns)}
    extra = recent_share(df, hints.FRESHNESS_HINTS, as_of, strict=True)
    extra += [F.count_if(matches(text(c), p)).alias(f"good_{at[c]}") for c, p in accuracy.items()]
    extra += [F.count_if(matches(text(c), p)).alias(f"compliant_{at[c]}") for c, p in compliance.items()]
    strings = string_columns(df)
    frames = [row_counts(df, extra, strings), duplicate_count(df)]
    rows, width = F.col("rows"), len(df.columns)
    filled = sum((F.col(f"filled_{i}") for i in range(width)), F.lit(0))
    share = lambda part, whole: F.try_divide(part.cast("double"), whole.cast("double")) * 100
    worst = F.lit(100.0)
    for c in accuracy:
        worst = F.least(worst, share(F.col(f"good_{at[c]}"), F.col(f"filled_{at[c]}")))
    checked = sum((F.col(f"filled_{at[c]}") for c in compliance), F.lit(0))
    good = sum((F.col(f"compliant_{at[c]}") for c in compliance), F.lit(0))
    dated = first_date_column(df, hints.FRESHNESS_HINTS) is not None
    table = names or hints.STANDARD_NAMES
    documented = sum(1 for c in df.columns if c in table)
    return beside(frames).select(
        share(filled, rows * width).alias("completeness"),
        worst.alias("accuracy"),
        share(rows - F.col("duplicates"), rows).alias("uniqueness"),
        share(F.lit(width - len(strings)) + one_class_columns(df, strings), F.lit(width)).alias("consistency"),
        (share(F.col("recent"), rows) if dated else F.lit(100.0)).alias("freshness"),
        F.coalesce(share(good, checked), F.lit(100.0)).alias("compliance"),
        share(F.lit(documented), F.lit(width)).alias("documentation"),
    )


def asset_grade(value: Column) -> Column:
    out = F.lit(hints.ASSET_FLOOR)
    for limit, label in reversed(hints.ASSET_GRADES):
        out = F.when(value >= limit, label).otherwise(out)
    return out


def asset_score(df: DataFrame, as_of: str, names: dict[str, str] | None = None) -> DataFrame:
    """(metric, score, grade): seven dimensions and their plain mean with its grade."""
    total = sum((F.col(k) for k in ASSET_DIMENSIONS), F.lit(0.0)) / len(ASSET_DIMENSIONS)
    records = [{"metric": F.lit(k), "score": F.round(F.col(k), 1), "grade": F.lit(None).cast("string")} for k in ASSET_DIMENSIONS]
    records.append({"metric": F.lit("overall"), "score": F.round(total, 1), "grade": asset_grade(total)})
    return to_long(asset_row(df, as_of, names), records)


def contract_rules(df: DataFrame) -> list[tuple[str, str, str]]:
    """(column, rule, severity) that the column names promise."""
    rules = []
    for c in df.columns:
        if "id" in c.lower():
            rules.append((c, "unique", "error"))
        if hints.has_hint(c, hints.COMPLIANCE_PHONE):
            rules.append((c, hints.CONTRACT_PHONE_RULE, "warn"))
    return rules


def contract(df: DataFrame) -> DataFrame:
    """(column, dtype, nullable, rule, severity): fields and the rules they carry."""
    rules = contract_rules(df)
    records = []
    for i, c in enumerate(df.columns):
        own = [(r, s) for name, r, s in rules if name == c] or [(None, None)]
        for rule, severity in own:
            records.append(
                {
                    "column": F.lit(c),
                    "dtype": label_of(df, c, F.col(f"filled_{i}"), "govern"),
                    "nullable": F.col(f"filled_{i}") < F.col("rows"),
                    "rule": F.lit(rule).cast("string"),
                    "severity": F.lit(severity).cast("string"),
                }
            )
    return to_long(row_counts(df), records)


def check_contract(df: DataFrame) -> DataFrame:
    """(column, rule, severity, n, valid): violations per rule; ``valid`` is the table's verdict on errors."""
    rules = contract_rules(df)
    unique = [c for c, rule, _ in rules if rule == "unique"]
    broken = [
        F.count_if(~matches(text(c), hints.PHONE_WHOLE)).alias(f"broken_{df.columns.index(c)}")
        for c, rule, _ in rules
        if rule != "unique"
    ]
    frames = [row_counts(df, broken), distinct_counts(df, unique)]
    records = []
    valid = F.lit(True)
    for c in unique:
        valid = valid & (F.col(f"copies_{df.columns.index(c)}") == 0)
    for c, rule, severity in rules:
        n = F.col(("copies_" if rule == "unique" else "broken_") + str(df.columns.index(c)))
        records.append({"column": F.lit(c), "rule": F.lit(rule), "severity": F.lit(severity), "n": n, "valid": valid})
    if not records:
        return df.sparkSession.createDataFrame([], "column string, rule string, severity string, n bigint, valid boolean")
    return to_long(beside(frames), records)


def sensitivity(df: DataFrame) -> DataFrame:
    """(column, label, rule): high or medium risk by content, else by name, else safe."""
    patterns = [
        ("high_risk", hints.ID_CARD, hints.ID_CARD_INSIDE),
        ("medium_risk", hints.PHONE, hints.MOBILE_INSIDE),
        ("medium_risk", hints.EMAIL, hints.EMAIL_INSIDE),
    ]
    seen = [
        F.bool_or(matches(text(c), p)).alias(f"p{k}_{i}")
        for i, c in enumerate(df.columns)
        for k, (_, _, p) in enumerate(patterns)
    ]
    records = []
    for i, c in enumerate(df.columns):
        label, rule = F.lit("safe"), F.lit(None).cast("string")
        if hints.has_hint(c, hints.SENSITIVE_HIGH):
            label, rule = F.lit("high_risk"), F.lit("name_inference")
        elif hints.has_hint(c, hints.SENSITIVE_MEDIUM):
            label, rule = F.lit("medium_risk"), F.lit("name_inference")
        for k, (risk, kind, _) in reversed(list(enumerate(patterns))):
            hit = F.coalesce(F.col(f"p{k}_{i}"), F.lit(False))
            label, rule = F.when(hit, risk).otherwise(label), F.when(hit, kind).otherwise(rule)
        records.append({"column": F.lit(c), "label": label, "rule": rule})
    return to_long(wide_agg(df, seen), records)


def audit_verdict(df: DataFrame, limit: float = 0.2) -> DataFrame:
    """(columns, issues, passed) in one row: a table passes when ``audit`` finds nothing."""
    issues = F.count(F.lit(1))
    return audit(df, limit).agg(F.lit(len(df.columns)).alias("columns"), issues.alias("issues"), (issues == 0).alias("passed"))


def audit(df: DataFrame, limit: float = 0.2) -> DataFrame:
    """(column, issue, severity, n, pct): columns with more than ``limit`` null or blank cells."""
    empty = [
        F.count_if(F.coalesce(is_blank(text(c)), F.lit(True))).alias(f"empty_{i}") for i, c in enumerate(df.columns)
    ]
    row = wide_agg(df, [F.count(F.lit(1)).alias("rows"), *empty])
    records = [
        {
            "column": F.lit(c),
            "issue": F.lit("high_null_rate"),
            "severity": F.lit("warning"),
            "n": F.col(f"empty_{i}"),
            "pct": percent(F.col(f"empty_{i}"), F.col("rows")),
            "_share": F.try_divide(F.col(f"empty_{i}"), F.col("rows")),
        }
        for i, c in enumerate(df.columns)
    ]
    return to_long(row, records).where(F.col("_share") > limit).drop("_share")
