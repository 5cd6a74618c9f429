"""Whole chains: full clean with its report, ingest of a source, integration into silver."""

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.functions.text import trim_spaces
from tablewright.operators import clean as ops
from tablewright.operators.frames import beside, col, fresh_names, numeric_columns, percent, string_columns, to_long
from tablewright.operators.integrate import integrate
from tablewright.operators.lineage import table_edges
from tablewright.operators.mask import desensitize, mask_log
from tablewright.operators.profile import source_profile
from tablewright.operators.quality import quality_scores, repair_tiers, snapshot_row
from tablewright.session import checkpointed
from tablewright.sources import layers
from tablewright.sources.files import read_source, reader_for


@dataclass
class CleanOptions:
    missing_strategy: str = "fill_median"
    outlier_method: str = "iqr"
    dedup: bool = True
    normalize: bool = True
    semantic: bool = False
    desensitize: str | None = None
    salt: str | None = None
    overrides: dict = field(default_factory=dict)
    text_columns: list[str] | None = None
    order_by: list[Column] | None = None
    method: str = "auto"
    # write each costly stage to the shared folder, so that later statistics do not recompute it
    write_stages: bool = False
    # a column that no two rows share and none lacks: it is neither filled nor bounded, and only it
    # is grouped for near-text duplicates and tokens; the least one of equal texts stays
    row_key: str | None = None


class Stages:
    """The table after each stage of a clean; the last one is unmasked.

    The two statistics the chain rests on, fill values and fences, are fitted once: each is one
    row, fetched when the chain is built, so no later stage computes it again. The rows carry how
    many rows of the input they stand for, so that the report needs the cleaned rows alone; with
    ``shared`` those are written once for all who read them.
    """

    def __init__(self, df: DataFrame, options: CleanOptions | None = None, shared: bool = False):
        o = self.options = options or CleanOptions()
        keep = checkpointed if o.write_stages else (lambda d: d)
        share = checkpointed if shared else keep
        numbers = [c for c in numeric_columns(df) if c != o.row_key]
        self.input = df
        extent = ops.fit_extent(df, numbers) if numbers else None
        self.nulls = extent["nulls"] if numbers else {}
        self.fills = ops.fit_fills(df, numbers, o.missing_strategy, o.method, extent)
        self.filled = keep(ops.fill_missing(df, o.missing_strategy, numbers, o.method, self.fills))
        self.bounds = None
        if o.outlier_method == "iqr" and numbers:
            self.bounds = ops.fit_bounds(self.filled, numbers, o.method, extent)
        self.copies, self.outside = fresh_names(["copies", "outside"], df.columns)
        self.tallied = share(ops.with_tallies(self.filled, self.bounds, o.dedup, self.copies, self.outside))
        # what was bounded and holds nothing any more goes
        self.stays = ops.holds_value(df.columns) if self.bounds and self.bounds["any_outlier"] else F.lit(True)
        self.distinct = self.tallied.where(self.stays).drop(self.copies, self.outside)
        self.trimmed = ops.trim_strings(self.distinct) if o.normalize else self.distinct
        self.near_distinct = self.last = self.trimmed
        if o.semantic:
            self.near_distinct = share(ops.near_text_dedup(self.trimmed, o.text_columns, o.order_by, o.row_key))
            self.last = ops.normalize_semantic(self.near_distinct)

    def input_rows(self) -> Column:
        """Rows of the input, as an aggregate over ``tallied``."""
        return F.coalesce(F.sum(col(self.copies)), F.lit(0))


def clean(df: DataFrame, options: CleanOptions | None = None) -> DataFrame:
    """Fill, bound, de-duplicate, trim; on demand near-text duplicates, normalisation, masking."""
    return _masked(Stages(df, options))


def _masked(s: Stages) -> DataFrame:
    o = s.options
    return desensitize(s.last, o.desensitize, o.salt, o.overrides, o.row_key) if o.desensitize else s.last


def _normalized_cells(before: DataFrame) -> Column:
    """Cells that normalisation changes."""
    forms = {c: form(col(c)) for c, form in ops.semantic_forms(before).items()}
    return sum((F.count_if(new != col(c)) for c, new in forms.items()), F.lit(0))


def clean_report(df: DataFrame, options: CleanOptions | None = None) -> DataFrame:
    """(op, column, detail, n, pct): rows before, after and removed, cells or rows per operation."""
    return _report(Stages(df, options))


def _report(s: Stages) -> DataFrame:
    o = s.options
    filled = sum(s.nulls[c] for c in s.fills)
    total = lambda c, where=F.lit(True): F.coalesce(F.sum(F.when(where, col(c))), F.lit(0))
    texts = string_columns(s.distinct) if o.normalize else []
    trims = sum((F.count_if(s.stays & (trim_spaces(col(c)) != col(c))) for c in texts), F.lit(0))
    # a row tells how many it stands for, so one pass over the last rows counts those of every stage
    frames = [
        s.tallied.agg(
            s.input_rows().alias("before"),
            total(s.outside).alias("outliers"),
            total(s.copies, s.stays).alias("bounded"),
            F.count_if(s.stays).alias("distinct"),
            trims.alias("trimmed"),
        )
    ]
    after = F.col("distinct")
    if o.semantic:
        frames.append(s.near_distinct.agg(F.count(F.lit(1)).alias("near"), _normalized_cells(s.near_distinct).alias("normalized")))
        after = F.col("near")
    removed = F.col("before") - after
    entries = [
        ("rows_before", "", F.col("before")),
        ("rows_after", "", after),
        ("rows_removed", "", removed),
        ("fill_missing", o.missing_strategy, F.lit(filled)),
    ]
    if s.bounds:
        entries.append(("remove_outliers", "iqr", F.col("outliers")))
    if o.dedup:
        entries.append(("dedup", "", F.col("bounded") - F.col("distinct")))
    if o.normalize:
        entries.append(("normalize_strings", "", F.col("trimmed")))
    if o.semantic:
        entries.append(("semantic_dedup", "text_key", F.col("distinct") - F.col("near")))
        entries.append(("semantic_normalize", "rule_based", F.col("normalized")))
    report = to_long(
        beside(frames),
        [
            {
                "op": F.lit(op),
                "column": F.lit("*"),
                "detail": F.lit(detail),
                "n": value.cast("bigint"),
                "pct": percent(removed, F.col("before")) if op == "rows_removed" else F.lit(None).cast("double"),
            }
            for op, detail, value in entries
        ],
    )
    if not o.desensitize:
        return report
    masks = mask_log(s.last, o.desensitize, o.salt, o.overrides).withColumn("pct", F.lit(None).cast("double"))
    return report.unionByName(masks)


def clean_and_assess(df: DataFrame, source: str, as_of: str, options: CleanOptions | None = None) -> dict[str, DataFrame]:
    """Cleaned table with its report, scores, repair tiers and snapshot.

    Scores look at the cleaned, unmasked table, tiers at the input. The cleaned rows are written
    once to the shared folder; data, report, scores and snapshot all read that.
    """
    s = Stages(df, options, shared=True)
    rows = beside([s.tallied.agg(s.input_rows().alias("rows_before")), s.last.agg(F.count(F.lit(1)).alias("rows"))])
    return {
        "data": _masked(s),
        "report": _report(s),
        "scores": quality_scores(s.last, as_of, s.options.method),
        "tiers": repair_tiers(df, s.options.method),
        "snapshot": snapshot_row(rows, s.last.columns, source, as_of),
    }


def _edge(spark: SparkSession, pairs: list[tuple[str, str]], operation: str) -> DataFrame:
    rows = spark.createDataFrame([(s, t, operation) for s, t in pairs], "source string, target string, operation string")
    return table_edges(rows.withColumn("ts", F.current_timestamp()))


def ingest(
    spark: SparkSession, path: str, base: str, source: str | None = None, kind: str | None = None, ingest_date: str | None = None
) -> dict[str, DataFrame]:
    """Read a source, profile it and land all its rows in bronze; gives profile, receipt and edge."""
    df = read_source(spark, path, kind)
    name = source or source_name_of(path)
    found = source_profile(df)
    types = {f"type.{r['column']}": r["dtype"] for r in found.collect()}
    receipt = layers.bronze_append(df, base, name, ingest_date, {"source_path": path, "source_kind": kind or reader_for(path), **types})
    return {
        "profile": found,
        "receipt": receipt,
        "edges": _edge(spark, [(path, f"bronze:{name}")], "ingest"),
    }


def source_name_of(path: str) -> str:
    """File stem in lower case, blanks and '-' as '_'."""
    stem = path.rstrip("/").rsplit("/", 1)[-1]
    stem = stem.rsplit(".", 1)[0] if "." in stem.lstrip(".") else stem
    return stem.replace(" ", "_").replace("-", "_").lower()


def integrate_to_silver(
    spark: SparkSession,
    base: str,
    sources: list[str],
    domain: str,
    table: str,
    strategy: str = "union",
    join_key: str = "",
    dedup_keys: list[str] | None = None,
    order_by: list[Column] | None = None,
    how: str = "inner",
    row_key: str | None = None,
) -> dict[str, DataFrame]:
    """Merge the newest data of bronze sources into a silver table; gives receipt and edges."""
    frames = {name: layers.read_latest(spark, base, name) for name in sources}
    merged = integrate(frames, strategy, join_key, dedup_keys, order_by, how, row_key)
    receipt = layers.silver_write(merged, base, domain, table)
    edges = _edge(spark, [(f"bronze:{s}", f"silver:{domain}/{table}") for s in sources], "integrate")
    return {"receipt": receipt, "edges": edges}
