"""Exact order statistics of many columns at once: quartiles, medians, percentiles.

Values are counted per bucket, the running counts say which bucket holds a wanted rank, and that
bucket is split further until one value is left.

* ``buckets``  a bucket is a value rounded to 12 bits; two more rounds over the few buckets that
  hold a wanted rank narrow it down to one double. This is the default at every size.
* ``brackets`` a first read sketches every column without moving a row (one KLL sketch a column); each
  wanted rank then lies in a narrow bracket of values, but for the rare sketch that errs by more than half a
  percent. The second read counts: a million parts of each bracket and the gaps between them. A part with one
  value settles the rank; only ranks not settled yet, or that lie in a gap, are read for again (up to three
  times). Columns of up to 50,000 values are one bracket of single values. On request: it saves the third
  read of columns with many close values and pays with the sketch.
* ``values``   a bucket is one value, so a single round is enough, over a table as long as the
  distinct values of a column. Only on request, for columns known to have few.

The table of a round has a bounded length under the first two, whatever the data, and what is broadcast
is one row per column and rank.

All give the same numbers. Spark's own ``percentile`` is not used: it keeps all distinct values
of a column in one task's memory.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.operators.frames import beside, chunked, keyed, number, to_long, union, wide_agg

# name -> (numerator, denominator, interpolate)
QUARTILES = {"q1": (1, 4, False), "q3": (3, 4, False)}
MEDIAN = {"p50": (1, 2, False)}
SUMMARY = {"p25": (1, 4, False), "p50": (1, 2, False), "p75": (3, 4, False)}
LINEAR_QUARTILES = {"q1": (1, 4, True), "q3": (3, 4, True)}

_SPLIT = float(2**22)      # equal-width parts of a bucket in rounds two and three
_ROUNDING = float(2**41 + 1)  # keeps the first 12 bits of a double's 53
_BRACKET = float(2**20)    # equal-width parts of a bracket
_KLL_K = 4000              # size of a column's sketch: ranks within 0.15 % of the values, 99 times in 100
_MARGIN = 0.005            # half a bracket's width, as a share of the values
_EXACT_BELOW = 50_000      # values of a column that are counted one by one


def order_stats(df: DataFrame, columns: list[str], stats: dict, method: str = "auto") -> DataFrame:
    """One row with ``{stat}_{i}`` for the i-th column of ``df`` and each stat.

    A nearest-rank stat (a, b, False) is ``sorted[n * a // b]``; an interpolated one
    (a, b, True) sits at position ``(n - 1) * a / b`` between its two neighbours.
    The input is read twice at least, so it must give the same values each time.
    """
    if method == "auto":
        method = "buckets"
    if method not in ("values", "buckets", "brackets"):
        raise ValueError(f"unknown method {method!r}")
    if not columns:
        return df.sparkSession.range(1).select(F.lit(None).cast("double").alias("no_columns"))
    slots = keyed(columns, df.columns)
    return beside([_ranked(df, part, stats, slots, method) for part in chunked(columns)])


def _cells(df, columns, slots):
    """(column position, value) for every non-null cell."""
    pairs = [e for c in columns for e in (F.lit(slots[c]), number(c))]
    return df.select(F.stack(F.lit(len(columns)), *pairs).alias("slot", "x")).where("x IS NOT NULL")


def _coarse(x: Column) -> Column:
    """x rounded to 12 significant bits: order-preserving, about 2,000 steps per factor of two."""

    def rounded(y):
        scaled = y * F.lit(_ROUNDING)
        return scaled - (scaled - y)

    huge = F.abs(x) >= F.lit(1e290)  # scaled down first, so that nothing overflows
    return F.when(F.abs(x).isin(float("inf")) | F.isnan(x), x).when(huge, rounded(x * F.lit(2.0**-64)) * F.lit(2.0**64)).otherwise(rounded(x))


def _wanted(stats) -> str:
    """Structs (stat, rank) for a column of ``total`` values; an interpolated stat asks for two."""
    out = []
    for name, (a, b, linear) in stats.items():
        if linear:
            low = f"CAST(floor((total - 1) * {a} / {b}) AS BIGINT)"
            out.append(f"named_struct('stat', '{name}_lo', 'rank', {low})")
            out.append(f"named_struct('stat', '{name}_hi', 'rank', least({low} + 1, total - 1))")
        else:
            out.append(f"named_struct('stat', '{name}', 'rank', CAST(floor(total * {a} / {b}) AS BIGINT))")
    return ", ".join(out)


def _before(keys: str) -> str:
    """How many values lie in the earlier buckets of the same key."""
    rows = "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
    return f"coalesce(sum(n) OVER (PARTITION BY {keys} ORDER BY bucket {rows}), 0) AS before"


_HOLDS_RANK = "rank >= before AND rank < before + n"
_TARGET = ("slot", "stat", "total", "rank - before AS rank", "lo", "hi")


def _bucket_measures():
    return F.count("*").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi")


def _bracketed(df, columns, stats, slots):
    """(slot, bucket, n, lo, hi): counts of the gaps between a column's brackets and of the parts of the brackets.

    A bucket is a struct (gap or bracket, part of it); structs sort like the values in them. What a
    column's sketch says is one row, broadcast.
    """
    shares = sorted({a / b for a, b, _ in stats.values()})
    brackets = [(max(s - _MARGIN, 0.0), min(s + _MARGIN, 1.0)) for s in shares]
    named = {c: f"x_{slots[c]}" for c in columns}
    values = df.select(*[number(c).alias(x) for c, x in named.items()])
    measures = []
    for x in named.values():
        finite = F.when(F.abs(x) < float("inf"), F.col(x))
        measures += [F.kll_sketch_agg_double(finite, F.lit(_KLL_K)).alias(f"s_{x}"), F.count(x).alias(f"n_{x}")]
        measures += [F.min(finite).alias(f"lo_{x}"), F.max(finite).alias(f"hi_{x}")]
    known, records = wide_agg(values, measures), []
    for c, x in named.items():
        few = F.col(f"n_{x}") <= _EXACT_BELOW
        record = {"of": F.lit(slots[c]), "few": few}
        for k, pair in enumerate(brackets):
            for end, q in zip(("lo", "hi"), pair):
                # an empty sketch has no quantiles to ask for
                value = F.when(~few & F.col(f"lo_{x}").isNotNull(), F.kll_sketch_get_quantile_double(f"s_{x}", F.lit(q)))
                record[f"{end}_{k}"] = F.when(few, F.col(f"{end}_{x}")).otherwise(value)
        records.append(record)
    # one row per column; one column's brackets at a time keep the generated code small
    cells = _cells(df, columns, slots).join(F.broadcast(to_long(known, records)), F.col("slot") == F.col("of"))
    place, part = F.lit(2 * len(shares)), F.lit(0.0)
    for k in reversed(range(len(shares))):
        x, lo, hi = F.col("x"), F.col(f"lo_{k}"), F.col(f"hi_{k}")
        width = F.floor(F.coalesce(F.try_divide(x - lo, hi - lo), F.lit(0.0)) * _BRACKET).cast("double")
        part = F.when(x < lo, 0.0).when(x <= hi, F.when(F.col("few"), x).otherwise(width)).otherwise(part)
        place = F.when(x < lo, 2 * k).when(x <= hi, 2 * k + 1).otherwise(place)
    cut = cells.select("slot", "x", place.alias("place"), part.alias("part"))
    counted = cut.groupBy("slot", "place", "part").agg(*_bucket_measures())
    return counted.select("slot", F.struct("place", "part").alias("bucket"), "n", "lo", "hi")


def _ranked(df, columns, stats, slots, method):
    cells = _cells(df, columns, slots)
    if method == "brackets":
        buckets = _bracketed(df, columns, stats, slots)
    else:
        bucket = F.col("x") if method == "values" else _coarse(F.col("x"))
        buckets = cells.groupBy("slot", bucket.alias("bucket")).agg(*_bucket_measures())
    buckets = buckets.selectExpr(
        "slot", "lo", "hi", "n", _before("slot"), "sum(n) OVER (PARTITION BY slot) AS total"
    )
    targets = buckets.selectExpr("slot", "total", "before", "n", "lo", "hi", f"inline(array({_wanted(stats)}))")
    targets = targets.where(_HOLDS_RANK).selectExpr(*_TARGET)
    if method != "values":
        settled = []
        for rounding in [False] * 2 if method == "buckets" else [True, False, False]:
            settled.append(targets.where("lo = hi"))  # one value left: no further round for it
            targets = _narrowed(cells, targets.where("lo < hi"), rounding)
        targets = union([*settled, targets])
    measures = []
    for c in columns:
        i = slots[c]
        pick = lambda stat, i=i: f"max(CASE WHEN slot = {i} AND stat = '{stat}' THEN lo END)"
        for name, (a, b, linear) in stats.items():
            value = pick(name)
            if linear:
                low, high = pick(name + "_lo"), pick(name + "_hi")
                at = f"((max(CASE WHEN slot = {i} THEN total END) - 1) * {a} / {b})"
                value = f"{low} + ({at} - floor({at})) * ({high} - {low})"
            measures.append(F.expr(f"{value} AS {name}_{i}"))
    return targets.agg(*measures)


def _narrowed(cells: DataFrame, targets: DataFrame, rounding: bool = False) -> DataFrame:
    """Each target's range cut to the part that holds its rank.

    Parts are of equal width; with ``rounding``, ranges that span more than a factor of two are parted
    by rounded values instead.
    """
    inside = cells.join(
        F.broadcast(targets.withColumnRenamed("slot", "t_slot")),  # one row per column and stat
        (F.col("slot") == F.col("t_slot")) & F.col("x").between(F.col("lo"), F.col("hi")),
    )
    part = F.floor((F.col("x") - F.col("lo")) / (F.col("hi") - F.col("lo")) * _SPLIT).cast("bigint")
    if rounding:
        least, most = F.least(F.abs("lo"), F.abs("hi")), F.greatest(F.abs("lo"), F.abs("hi"))
        even = (F.signum("lo") == F.signum("hi")) & (most <= 2 * least) & (most < float("inf"))
        part = F.when(even, part.cast("double")).otherwise(_coarse(F.col("x")))
    keys = ["slot", "stat", "total", "rank"]
    parts = inside.groupBy(*keys, part.alias("bucket")).agg(*_bucket_measures())
    located = parts.selectExpr(*keys, "n", "lo", "hi", _before("slot, stat"))
    return located.where(_HOLDS_RANK).selectExpr(*_TARGET)


def modes(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row with ``mode_{i}``: the most frequent value of each column, the lowest on ties."""
    slots = keyed(columns, df.columns)
    counts = _cells(df, columns, slots).groupBy("slot", "x").count()
    best = counts.groupBy("slot").agg(F.max(F.struct(F.col("count"), (-F.col("x")).alias("neg"))).alias("best"))
    return best.agg(
        *[
            F.max(F.when(F.col("slot") == i, -F.col("best.neg") + F.lit(0.0))).alias(f"mode_{i}")
            for i in slots.values()
        ]
    )


def fences(row_columns: tuple[Column, Column]) -> tuple[Column, Column]:
    """Lower and upper fence at 1.5 times the quartile distance."""
    q1, q3 = row_columns
    return q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1)
