"""Named steps run one after the other, and a check of what a step asks of its input."""

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.operators.frames import col, to_long, wide_agg

Step = Callable[[DataFrame], DataFrame]


class ChainError(RuntimeError):
    """A step failed or is unknown; names the step and those done before it."""

    def __init__(self, step: str, done: list[str], reason: str):
        super().__init__(f"chain stopped at {step!r} after {done}: {reason}")
        self.step, self.done = step, done


def run_chain(df: DataFrame, names: list[str], steps: dict[str, Step]) -> DataFrame:
    """Feed the table through the named steps; stops at the first one that fails."""
    done: list[str] = []
    for name in names:
        if name not in steps:
            raise ChainError(name, done, "unknown step")
        try:
            df = df.transform(steps[name])
        except Exception as e:
            raise ChainError(name, done, str(e)) from e
        done.append(name)
    return df


# JSON type of a field -> Spark type its values must convert to
_JSON_TYPES = {"string": "string", "integer": "bigint", "number": "double", "boolean": "boolean"}


def input_violations(df: DataFrame, schema: dict) -> DataFrame:
    """(column, issue, n): required fields that are missing or null, values of another type.

    ``schema`` is ``{"properties": {field: {"type": t}}, "required": [fields]}``.
    """
    required = schema.get("required", [])
    properties = schema.get("properties", {})
    checks = {}
    for field in dict.fromkeys([*properties, *required]):
        if field not in df.columns:
            if field in required:
                checks[(field, "missing")] = F.count(F.lit(1))
            continue
        if field in required:
            checks[(field, "null")] = F.count_if(col(field).isNull())
        kind = properties.get(field, {}).get("type", "string")
        actual = df.schema[field].dataType.typeName()
        if kind in ("array", "object"):
            wrong = col(field).isNotNull() if actual not in {"array": ("array",), "object": ("map", "struct")}[kind] else F.lit(False)
        elif kind == "integer" and actual == "string":
            # a whole number only: a cast to bigint would also take '1.5'
            wrong = col(field).isNotNull() & ~col(field).rlike(r"^\s*[+-]?\d+\s*$")
        else:
            wrong = col(field).isNotNull() & col(field).try_cast(_JSON_TYPES.get(kind, "string")).isNull()
        checks[(field, f"not {kind}")] = F.count_if(wrong)
    row = wide_agg(df, [F.lit(0).alias("_"), *[m.alias(f"n_{i}") for i, m in enumerate(checks.values())]])
    if not checks:
        return df.sparkSession.createDataFrame([], "column string, issue string, n bigint")
    records = [
        {"column": F.lit(f), "issue": F.lit(issue), "n": F.col(f"n_{i}")} for i, (f, issue) in enumerate(checks)
    ]
    return to_long(row, records).where("n > 0")
