"""JSON objects as fields: nested names joined by dots, arrays as repeated values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MAX_DEPTH, STRING_CHARS = 10, 64


def _leaves(kind: T.DataType, value: Column, name: str, separator: str, depth: int, most: int) -> list[tuple[str, Column, T.DataType]]:
    """(name, array of values, their type) of each leaf."""
    if depth > most:
        return []
    if isinstance(kind, T.StructType):
        out = []
        for f in kind.fields:
            own = F.transform(value, lambda v: v[f.name])  # noqa: B023
            out += _leaves(f.dataType, own, f"{name}{separator}{f.name}" if name else f.name, separator, depth + 1, most)
        return out
    if isinstance(kind, T.ArrayType):
        return _leaves(kind.elementType, F.flatten(F.filter(value, lambda v: v.isNotNull())), name, separator, depth + 1, most)
    return [(name, F.array_compact(value), kind)]


def flatten(docs: DataFrame, column: str, separator: str = ".", max_depth: int = MAX_DEPTH) -> DataFrame:
    """docs with, instead of a struct column, an array column for each leaf of it:
    numbers as double, booleans as "true" or "false". Nulls have no value; what
    lies deeper than max_depth is left out."""
    kind = docs.schema[column].dataType
    out = []
    for name, values, leaf in _leaves(kind, F.array(F.col(column)), "", separator, 0, max_depth):
        numeric = isinstance(leaf, T.NumericType)
        out.append(values.cast("array<double>" if numeric else "array<string>").alias(name))
    return docs.select(*(c for c in docs.columns if c != column), *out)


def parse(docs: DataFrame, column: str, schema: str | T.StructType, **options) -> DataFrame:
    """docs with a column of JSON texts parsed by a schema and flattened; texts that aren't JSON have no values."""
    parsed = docs.withColumn(column, F.from_json(column, schema, {"mode": "PERMISSIVE"}))
    return flatten(parsed, column, **options)


def field_kind(values: Column, most: int = STRING_CHARS) -> Column:
    """Of string values whether they're exact strings ("string") or, one being longer than most characters, "text"."""
    return F.when(F.exists(values, lambda v: F.length(v) > most), "text").otherwise("string")


def read_json(spark, path: str, **options) -> DataFrame:
    """A file or folder of JSON lines, flattened, with nothing else."""
    raw = spark.read.json(path)
    return flatten(raw.select(F.struct(*raw.columns).alias("x")), "x", **options)
