"""Masking of personal data: detection by column name, five strategies, a log of what changed."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablewright.functions import hints
from tablewright.functions.masking import masked
from tablewright.functions.text import is_blank
from tablewright.operators.frames import col, string_columns, text, to_long, wide_agg
from tablewright.operators.joins import attach
from tablewright.session import checkpointed

BROADCAST_BYTES = 32 * 1024 * 1024  # a measured size


def personal_kinds(df: DataFrame, overrides: dict[str, str | None] | None = None) -> dict[str, str]:
    """{column: kind} by name hints, first kind wins; ``overrides`` add, change or (None) drop columns.

    Only string columns are found by name: an id-like number is masked when an override asks for it.
    """
    found = {c: hints.first_label(c, hints.PERSONAL_HINTS) for c in string_columns(df)}
    return {c: k for c, k in {**found, **(overrides or {})}.items() if k}


def personal_columns(df: DataFrame, overrides: dict[str, str | None] | None = None) -> DataFrame:
    """(column, label, rule, n): personal-data columns with the number of cells to protect."""
    kinds = personal_kinds(df, overrides)
    cells = wide_agg(
        df,
        [F.lit(0).alias("_"), *[F.count_if(~is_blank(text(c))).alias(f"n_{df.columns.index(c)}") for c in kinds]],
    )
    records = [
        {"column": F.lit(c), "label": F.lit(k), "rule": F.lit("column_name"), "n": F.col(f"n_{df.columns.index(c)}")}
        for c, k in kinds.items()
    ]
    if not records:
        return df.sparkSession.createDataFrame([], "column string, label string, rule string, n bigint")
    return to_long(cells, records)


def desensitize(
    df: DataFrame,
    strategy: str = "mask",
    salt: str | None = None,
    overrides: dict[str, str | None] | None = None,
    row_key: str | None = None,
) -> DataFrame:
    """The table with its personal-data columns masked; masked columns are strings.

    ``row_key``, a column that no two rows share, spares tokens of a large dictionary a written copy
    of the table; it must not be masked itself.
    """
    kinds = personal_kinds(df, overrides)
    if strategy == "token":
        return tokenize(df, kinds, row_key=row_key)
    return df.select(
        *[masked(text(c), kinds[c], strategy, salt).alias(c) if c in kinds else col(c) for c in df.columns]
    )


def token_dictionary(df: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """(kind, value, token): one token per distinct kind and value, numbered in (kind, value) order.

    The sorted dictionary is written to the shared folder; a row's number is its place in its
    partition plus the sizes of the partitions before it, so no task ever sees all of it.
    """
    pairs = [e for c, k in kinds.items() for e in (F.lit(k), text(c))]
    values = df.select(F.stack(F.lit(len(kinds)), *pairs).alias("kind", "value"))
    values = values.where(F.col("value").isNotNull() & ~is_blank(F.col("value"))).distinct()
    ordered = checkpointed(values.orderBy("kind", "value"))
    # monotonically_increasing_id = partition number << 33 + place in the partition
    placed = ordered.withColumn("_id", F.monotonically_increasing_id())
    placed = placed.withColumn("_part", F.shiftright("_id", 33)).withColumn("_place", F.col("_id").bitwiseAND(2**33 - 1))
    sizes = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_size"))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    starts = sizes.select("_part", F.coalesce(F.sum("_size").over(earlier), F.lit(0)).alias("_start"))
    return placed.join(F.broadcast(starts), "_part").select(
        "kind",
        "value",
        F.format_string(
            "%s_%04d", F.upper(F.substring("kind", 1, 4)), F.col("_start") + F.col("_place") + F.lit(1)
        ).alias("token"),
    )


def tokenize(
    df: DataFrame, kinds: dict[str, str], broadcast_bytes: int = BROADCAST_BYTES, row_key: str | None = None
) -> DataFrame:
    """Each personal value replaced by its token; equal values of a kind share one token.

    A dictionary whose measured size is small is broadcast, once per column. A larger one meets
    all cells of all columns in one join, after which the cells go back to their rows by
    ``row_key``, a column that no two rows share and none lacks. Without one the table is written
    once, so that a row number can stand in.
    """
    if not kinds:
        return df
    tokens = token_dictionary(df, kinds)
    size = tokens.agg(F.sum(F.octet_length("value") + F.octet_length("token") + 64)).first()[0] or 0
    if size <= broadcast_bytes:
        return _tokens_by_broadcast(df, kinds, tokens)
    return _tokens_by_cells(df, kinds, tokens, row_key)


def _tokens_by_broadcast(df, kinds, tokens):
    out = df
    for i, (c, kind) in enumerate(kinds.items()):
        lookup = tokens.where(F.col("kind") == kind).select(F.col("value").alias(f"_v{i}"), F.col("token").alias(f"_t{i}"))
        out = out.join(F.broadcast(lookup), text(c) == F.col(f"_v{i}"), "left")
    return out.select(*_with_tokens(df, kinds))


def _with_tokens(df, kinds):
    replaced = {c: F.coalesce(F.col(f"_t{i}"), text(c)).alias(c) for i, c in enumerate(kinds)}
    return [replaced.get(c, col(c)) for c in df.columns]


def _tokens_by_cells(df, kinds, tokens, row_key):
    if row_key is None:
        # the row ids must not change between the two uses of the table, so it is written once
        rows = checkpointed(df.withColumn("_row", F.monotonically_increasing_id()))
    else:
        rows = df.withColumn("_row", col(row_key))
    key = lambda kind, value: F.concat(kind, F.lit("\0"), value)
    pairs = [e for i, (c, kind) in enumerate(kinds.items()) for e in (F.lit(i), key(F.lit(kind), text(c)))]
    cells = rows.select("_row", F.stack(F.lit(len(kinds)), *pairs).alias("_slot", "_cell")).where("_cell IS NOT NULL")
    lookup = tokens.select(key(F.col("kind"), F.col("value")).alias("_cell"), "token")
    found = attach(cells, lookup, "_cell")
    by_row = found.groupBy("_row").agg(
        *[F.max(F.when(F.col("_slot") == i, F.col("token"))).alias(f"_t{i}") for i in range(len(kinds))]
    )
    return rows.join(by_row, "_row", "left").select(*_with_tokens(df, kinds))


def mask_log(
    df: DataFrame,
    strategy: str = "mask",
    salt: str | None = None,
    overrides: dict[str, str | None] | None = None,
) -> DataFrame:
    """(op, column, detail, n): cells changed per column, and the totals over all columns."""
    kinds = personal_kinds(df, overrides)
    measures = []
    for c, kind in kinds.items():
        before = text(c)
        if strategy == "token":  # every non-blank value gets a token
            changed = ~is_blank(before)
        else:
            changed = ~masked(before, kind, strategy, salt).eqNullSafe(before)
        measures.append(F.count_if(changed).alias(f"n_{df.columns.index(c)}"))
    counts = wide_agg(df, [F.lit(0).cast("bigint").alias("_none"), *measures])
    n = {c: F.col(f"n_{df.columns.index(c)}") for c in kinds}
    records = [
        {"op": F.lit("desensitize"), "column": F.lit(c), "detail": F.lit(f"{kind}:{strategy}"), "n": n[c]}
        for c, kind in kinds.items()
    ]
    records += [
        {"op": F.lit("desensitize"), "column": F.lit("*"), "detail": F.lit("detected"), "n": F.lit(len(kinds)).cast("bigint")},
        {"op": F.lit("desensitize"), "column": F.lit("*"), "detail": F.lit("masked"), "n": sum(n.values(), F.col("_none"))},
    ]
    return to_long(counts, records)
