"""Stored pages, URLs and JSON payloads turned into rows."""

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.functions import hints, html
from tablewright.functions.text import variant_sql_type
from tablewright.operators.frames import col


PORTION, PORTION_PAGES = 1 << 20, 256  # bytes and pages whose results are in Python at once


def _parsed(parse: Callable, kind: pa.DataType):
    """A function on batches of pages that parses a portion at a time, however large the batches are; a longer page is a portion of its own."""

    def of_pages(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for pages in batches:
            sizes = np.cumsum(pa.compute.binary_length(pages).fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64)
            first = 0
            while first < len(pages):
                most = (sizes[first - 1] if first else 0) + PORTION
                last = min(max(first + 1, int(np.searchsorted(sizes, most, side="right"))), first + PORTION_PAGES)
                yield pa.array([parse(page.as_py()) for page in pages[first:last]], kind)
                first = last

    return of_pages


def spread(df: DataFrame) -> DataFrame:
    """The rows in even tasks. Parsing a page takes far longer than reading it, and few tasks may read a compressed file."""
    return df.hint("rebalance")


def _lines(page: Column) -> Column:
    kind = pa.list_(pa.string())
    lines = _parsed(html.text_lines, kind)

    @F.arrow_udf("array<string>")
    def lines_of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        return lines(batches)

    return lines_of(page)


def _exploded(df: DataFrame, keep: list[str], array: str, at: str, value: str) -> DataFrame:
    """One row per element. An inner explode would filter for arrays with elements below the column that holds them, so that every page is parsed twice."""
    return df.select(*[col(c) for c in keep], F.posexplode_outer(array).alias(at, value)).where(col(at).isNotNull())


def text_lines(df: DataFrame, page: str = "html", keep: list[str] | None = None) -> DataFrame:
    """One row per text line of each page: kept columns, ``line`` (from 0) and ``content``.

    The parser runs on portions of Arrow batches and returns the lines only; the explode stays in the JVM.
    """
    keep = [c for c in df.columns if c != page] if keep is None else keep
    lines = df.select(*[col(c) for c in keep], _lines(col(page)).alias("_lines"))
    return _exploded(lines, keep, "_lines", "line", "content")


def extract_rows(df: DataFrame, rules: list[dict], page: str = "html", keep: list[str] | None = None) -> DataFrame:
    """Rows cut out of each page by rules ``{name, selector, attr, container}``.

    With a ``container`` on the first rule there is one row per container with the first match of
    each rule; without, matches are aligned by position and short columns padded with ''. Rows
    without any value are dropped.
    """
    keep = [c for c in df.columns if c != page] if keep is None else keep

    parsed = _parsed(lambda p: html.extract(p, rules), pa.list_(pa.list_(pa.string())))

    @F.arrow_udf("array<array<string>>")
    def rows_of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        return parsed(batches)

    rows = df.select(*[col(c) for c in keep], rows_of(col(page)).alias("_rows"))
    rows = _exploded(rows, keep, "_rows", "row", "_row")
    return rows.select(
        *[col(c) for c in keep], "row", *[F.col("_row")[i].alias(r["name"]) for i, r in enumerate(rules)]
    )


def paged_urls(df: DataFrame, url: str = "url", param: str = "page", start: Column | int = 1, end: Column | int = 1):
    """One row per page number: ``{param}`` replaced in the URL, else appended as a query part."""
    start, end = (F.lit(v) if isinstance(v, int) else v for v in (start, end))
    numbered = df.withColumn("_page", F.explode(F.filter(F.sequence(start, F.greatest(start, end)), lambda n: n <= end)))
    number = F.col("_page").cast("string")
    slot = "{" + param + "}"
    address = col(url)
    return numbered.withColumn(
        "page_url",
        F.when(address.contains(slot), F.replace(address, F.lit(slot), number)).otherwise(
            F.concat(address, F.when(address.contains("?"), "&").otherwise("?"), F.lit(param + "="), number)
        ),
    ).withColumnRenamed("_page", "page_number")


def payload_items(payload: Column) -> Column:
    """Records of a JSON payload as raw texts: the list itself, the list under a known key, or the object."""
    listed = F.from_json(payload, T.StructType([T.StructField(k, T.ArrayType(T.StringType())) for k in hints.LIST_KEYS]))
    top = F.when(F.ltrim(payload).startswith("["), F.from_json(payload, "array<string>"))
    return F.coalesce(top, *[listed[k] for k in hints.LIST_KEYS], F.array(payload))


def payload_rows(
    df: DataFrame,
    payload: str,
    fields: list[str] | None = None,
    positional: int | None = None,
    keep: list[str] | None = None,
) -> DataFrame:
    """One row per record of each payload.

    By default a record is the map column ``record`` (key to text; a bare value has the key
    'value'). ``fields`` picks named keys as columns, ``positional=n`` gives ``field_0 … field_{n-1}``
    by the order of the keys in the text.
    """
    keep = [c for c in df.columns if c != payload] if keep is None else keep
    items = df.select(*[col(c) for c in keep], F.posexplode(payload_items(col(payload))).alias("row", "_item"))
    record = F.when(F.ltrim("_item").startswith("{"), F.from_json("_item", "map<string,string>")).otherwise(
        F.create_map(F.lit("value"), F.col("_item"))
    )
    rows = items.select(*[col(c) for c in keep], "row", record.alias("record")).where("record IS NOT NULL")
    if fields is not None:
        return rows.select(*[col(c) for c in keep], "row", *[F.try_element_at("record", F.lit(f)).alias(f) for f in fields])
    if positional is not None:
        values = F.map_values("record")
        return rows.select(*[col(c) for c in keep], "row", *[F.get(values, i).alias(f"field_{i}") for i in range(positional)])
    return rows


def payload_records(df: DataFrame, payload: str, keep: list[str] | None = None) -> DataFrame:
    """One row per record of each payload, ``record`` being a struct of all keys that any record has.

    Every payload is parsed once, as a variant. Types are those that hold all values of a key over
    the whole table: whole numbers, doubles, booleans, nested records and lists; text where they
    differ. A key that a record lacks is null, as is a value that does not fit. A bare value has the
    key 'value'. A payload that is null or no JSON gives no row, nor does a null in a list. One
    aggregate finds the types before the rows are read; keys that differ in case only raise an error.
    """
    keep = [c for c in df.columns if c != payload] if keep is None else keep
    parsed, listed = F.try_parse_json(col(payload)), "array<variant>"
    lists = [F.try_variant_get("_parsed", f"$.{k}", listed) for k in hints.LIST_KEYS]
    items = F.coalesce(F.try_variant_get("_parsed", "$", listed), *lists, F.array("_parsed"))
    whole = df.select(*[col(c) for c in keep], parsed.alias("_parsed")).where("_parsed IS NOT NULL")
    rows = whole.select(*[col(c) for c in keep], F.posexplode(items).alias("row", "_item"))
    bare = ~F.schema_of_variant("_item").startswith("OBJECT<")
    boxed = F.parse_json(F.concat(F.lit('{"value":'), F.to_json("_item"), F.lit("}")))
    rows = rows.where("NOT is_variant_null(_item)").withColumn("_item", F.when(bare, boxed).otherwise(F.col("_item")))
    shape = rows.agg(F.schema_of_variant_agg("_item").alias("shape")).first()["shape"]
    kind = variant_sql_type(shape) if shape.startswith("OBJECT<") and shape != "OBJECT<>" else "struct<value:string>"
    names = [f.name.lower() for f in T._parse_datatype_string(kind)]
    if len(set(names)) < len(names):
        raise ValueError(f"keys differ in case only: {sorted({n for n in names if names.count(n) > 1})}")
    return rows.select(*[col(c) for c in keep], "row", F.try_variant_get("_item", "$", kind).alias("record"))


def crawl_tally(df: DataFrame, page: str = "html") -> DataFrame:
    """One row: pages, pages with content, pages without, text lines."""
    counts = df.select(F.size(_lines(F.coalesce(col(page), F.lit("")))).alias("lines"))
    return counts.agg(
        F.count(F.lit(1)).alias("total_pages"),
        F.count_if(F.col("lines") > 0).alias("pages_ok"),
        F.count_if(F.col("lines") == 0).alias("pages_fail"),
        F.coalesce(F.sum("lines"), F.lit(0)).cast("bigint").alias("total_rows"),
    )
