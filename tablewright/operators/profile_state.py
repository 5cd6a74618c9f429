"""A profile as mergeable state: the state of two parts put together is the state of the whole.

State has one row per column and one row whose ``column`` is null, which stands for the table and
whose ``filled`` is its number of rows. A part that lacks a column so adds to that column's nulls.
Counts, extremes and value classes are exact; distinct values and quartiles come from sketches of
bounded size (HyperLogLog with 4,096 registers: standard error 1.6 %; KLL with k = 800: rank
error below 0.5 % of the values).
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.functions.text import parse_date
from tablewright.operators.frames import col, number, numeric_columns, percent, string_columns, text, to_long
from tablewright.operators.profile import VALUE_CLASSES, declared_label, row_counts

HLL_BITS = 12
KLL_K = 800
SHOWN = 64  # characters kept of the lowest and highest text

_TYPES = {
    "column": "string", "seen": "struct<part:string,place:int>", "dtype": "string", "label": "string", "filled": "bigint",
    "lo": "double", "hi": "double", "lowest": "string", "highest": "string", "longest": "bigint",
    **dict.fromkeys(VALUE_CLASSES, "bigint"), "distinct": "binary", "quantiles": "binary",
}
STATE_SCHEMA = ", ".join(f"`{name}` {kind}" for name, kind in _TYPES.items())


def profile_state(df: DataFrame, part: str = "") -> DataFrame:
    """State of a table, read once; ``part`` names it and orders the columns of merged states.

    A table without rows has a state too. Numbers are compared as doubles and NaN is the highest;
    it is in no quartile. Columns of other types have counts, extremes of their text and distinct values.
    """
    numbers, texts = set(numeric_columns(df)), set(string_columns(df))
    measures = []
    for i, c in enumerate(df.columns):
        # an empty text is a value too, which the sketch of texts would pass over: sketch its hash
        value = text(c) if c not in numbers else number(c).cast("string")
        measures.append(F.hll_sketch_agg(F.when(col(c).isNotNull(), F.xxhash64(value)), F.lit(HLL_BITS)).alias(f"distinct_{i}"))
        if c in numbers:
            measures += [F.min(number(c)).alias(f"lo_{i}"), F.max(number(c)).alias(f"hi_{i}")]
            measures.append(F.kll_sketch_agg_double(F.nanvl(number(c), F.lit(None)), F.lit(KLL_K)).alias(f"quantiles_{i}"))
        else:
            start = F.left(text(c), F.lit(SHOWN))
            measures += [F.min(start).alias(f"lowest_{i}"), F.max(start).alias(f"highest_{i}")]
            measures.append(F.max(F.char_length(text(c)).cast("bigint")).alias(f"longest_{i}"))
    row = row_counts(df, measures, classes=[c for c in df.columns if c in texts])
    return to_long(row, [_table_record(part), *[_column_record(df.schema[c], i, c in numbers, part) for i, c in enumerate(df.columns)]])


def _record(given: dict[str, Column]) -> dict[str, Column]:
    return {name: given.get(name, F.lit(None)).cast(kind) for name, kind in _TYPES.items()}


def _seen(part: str, place: int) -> Column:
    return F.struct(F.lit(part).alias("part"), F.lit(place).alias("place"))


def _table_record(part):
    return _record({"filled": F.col("rows"), "seen": _seen(part, -1)})


def _column_record(field, i, is_number, part):
    own = ["lo", "hi", "quantiles"] if is_number else ["lowest", "highest", "longest"]
    if isinstance(field.dataType, T.StringType):
        own = own + VALUE_CLASSES
    given = {name: F.col(f"{name}_{i}") for name in ["filled", "distinct", *own]}
    given |= {"column": F.lit(field.name), "seen": _seen(part, i), "dtype": F.lit(field.dataType.simpleString())}
    return _record(given | {"label": F.lit(declared_label(field, "ingest"))})


def merged_state(states: DataFrame) -> DataFrame:
    """State of all parts together, from the rows of their states.

    A column whose type differs between parts is an error that names it. Parts may be merged in any order
    and in several steps: exact fields come out the same, sketches within their error.
    """
    total = lambda c: F.sum(c).alias(c)
    merged = states.groupBy("column").agg(
        F.min("seen").alias("seen"),
        F.min("dtype").alias("dtype"),
        F.max("dtype").alias("_other"),
        F.min("label").alias("label"),
        total("filled"),
        F.min("lo").alias("lo"), F.max("hi").alias("hi"),
        F.min("lowest").alias("lowest"), F.max("highest").alias("highest"), F.max("longest").alias("longest"),
        *[total(k) for k in VALUE_CLASSES],
        F.hll_union_agg("distinct").alias("distinct"),
        F.kll_merge_agg_double("quantiles").alias("quantiles"),
    )
    clash = F.raise_error(F.concat(F.lit("column "), "column", F.lit(" is "), "dtype", F.lit(" in one part and "), "_other", F.lit(" in another")))
    dtype = F.when(F.col("dtype") != F.col("_other"), clash.cast("string")).otherwise(F.col("dtype"))
    return merged.withColumn("dtype", dtype).select(*_TYPES)


def state_profile(state: DataFrame) -> DataFrame:
    """One row per column of a (merged) state, as ``source_profile`` gives it and beyond.

    column, dtype (label; a text column whose lowest value is a date is 'datetime'), rows, nulls, null_pct, lo and hi
    of numbers, lowest and highest text (its first 64 characters), longest, cells per value class, and the estimates
    distinct_estimate, q1, median and q3. ``place`` numbers the columns in first-seen order.
    """
    rows = state.where("column IS NULL").agg(F.coalesce(F.max("filled"), F.lit(0).cast("bigint")).alias("rows"))
    columns = state.where("column IS NOT NULL")
    dated = (F.col("label") == "string") & (F.length("lowest") < SHOWN) & parse_date(F.col("lowest")).isNotNull()
    label = F.when(F.col("filled") == 0, "null").when(dated & (F.col("dtype") == "string"), "datetime").otherwise(F.col("label"))
    # an empty sketch has no quantiles to ask for
    asked = F.when(F.kll_sketch_get_n_double("quantiles") > 0, F.col("quantiles"))
    quantile = lambda q: F.kll_sketch_get_quantile_double(asked, F.lit(q))
    # one row per column of a table: few, so that a plain number over them is cheap
    places = columns.groupBy().agg(F.array_sort(F.collect_list("seen")).alias("_order"))
    return columns.crossJoin(F.broadcast(rows)).crossJoin(F.broadcast(places)).select(
        "column",
        F.array_position("_order", F.col("seen")).alias("place"),
        label.alias("dtype"),
        "rows",
        (F.col("rows") - F.col("filled")).alias("nulls"),
        percent(F.col("rows") - F.col("filled"), F.col("rows")).alias("null_pct"),
        "lo", "hi", "lowest", "highest", "longest", *VALUE_CLASSES,
        F.coalesce(F.hll_sketch_estimate("distinct"), F.lit(0).cast("bigint")).alias("distinct_estimate"),
        quantile(0.25).alias("q1"), quantile(0.5).alias("median"), quantile(0.75).alias("q3"),
    )
