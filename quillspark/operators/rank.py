"""What is done with hits: ordering, facets, statistics, histograms, collapse."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.compile import DOC, SCORE, top

__all__ = ["top", "sort_by", "facets", "stats", "histogram", "aggregate", "collapse", "stored", "pages"]


def stored(hits: DataFrame, docs: DataFrame, *fields: str) -> DataFrame:
    """hits with fields of their documents."""
    return hits.join(docs.select(DOC, *fields), DOC)


def _is_array(docs: DataFrame, field: str) -> bool:
    return docs.schema[field].dataType.typeName() == "array"


def sort_by(hits: DataFrame, docs: DataFrame, field: str, n: int, descending: bool = False) -> DataFrame:
    """The n first hits by a field ("score" and "doc_id" too), ties by doc_id. A
    missing number counts as 0, a missing string as ''; an array by its least value."""
    if field in (SCORE, DOC):
        key: Column = F.round(SCORE, 6) if field == SCORE else F.col(DOC)
        x = hits.withColumn("sort_key", key)
    else:
        x = stored(hits, docs.withColumn("sort_key", F.array_min(field) if _is_array(docs, field) else F.col(field)), "sort_key")
        kind = x.schema["sort_key"].dataType.typeName()
        x = x.withColumn("sort_key", F.coalesce("sort_key", F.lit("" if kind == "string" else 0)))
    return x.orderBy(F.desc("sort_key") if descending else F.asc("sort_key"), DOC).limit(n)


def facets(hits: DataFrame, docs: DataFrame, *fields: str) -> DataFrame:
    """(field, value, count) over all hits, in one pass; empty and null values don't count, each of an array's does."""
    def named(f: str) -> Column:
        values = F.array_distinct(F.col(f).cast("array<string>")) if _is_array(docs, f) else F.array(F.col(f).cast("string"))
        return F.transform(values, lambda v: F.struct(F.lit(f).alias("field"), v.alias("value")))

    values = [named(f) for f in fields]
    x = stored(hits.select(DOC), docs.select(DOC, F.concat(*(F.coalesce(v, F.array().cast("array<struct<field:string,value:string>>")) for v in values)).alias("v")), "v")
    x = x.select(F.inline("v")).where("value is not null and value <> ''")
    return x.groupBy("field", "value").agg(F.count("*").alias("count"))


def _values(hits: DataFrame, docs: DataFrame, field: str) -> DataFrame:
    x = stored(hits.select(DOC), docs, field).select(F.explode(field).alias("v") if _is_array(docs, field) else F.col(field).alias("v"))
    return x.select(F.col("v").cast("double").alias("v")).where("v is not null")


def stats(hits: DataFrame, docs: DataFrame, *fields: str) -> DataFrame:
    """(field, count, min, max, sum, avg) over all values of all hits; zeros if there are none."""
    x = stored(hits.select(DOC), docs, *fields)
    if not any(_is_array(docs, f) for f in fields):
        aggs = [F.struct(F.lit(f).alias("field"), F.count(F.col(f).cast("double")).alias("count"), *(F.coalesce(g(F.col(f).cast("double")), F.lit(0.0)).alias(n) for n, g in (("min", F.min), ("max", F.max), ("sum", F.sum), ("avg", F.avg)))) for f in fields]
        return x.agg(F.array(*aggs).alias("x")).select(F.inline("x"))
    out = None
    for f in fields:
        one = _values(hits, docs, f).agg(F.lit(f).alias("field"), F.count("v").alias("count"), *(F.coalesce(g("v"), F.lit(0.0)).alias(n) for n, g in (("min", F.min), ("max", F.max), ("sum", F.sum), ("avg", F.avg))))
        one = one.select("field", "count", "min", "max", "sum", "avg")
        out = one if out is None else out.union(one)
    return out


def histogram(hits: DataFrame, docs: DataFrame, field: str, interval: float) -> DataFrame:
    """(low, high, count) of buckets of a width (10 if it isn't positive) from
    below the least value to above the largest, empty ones too; no rows without values."""
    i = float(interval) if interval > 0 else 10.0
    v = _values(hits, docs, field)
    least, most = F.min("b"), F.max("b")
    counted = v.groupBy(F.floor(F.col("v") / i).cast("bigint").alias("b")).agg(F.count("*").alias("count"), F.max("v").alias("top"))
    edge = F.ceil((F.max("top") - F.min("b") * i) / i).cast("bigint") + least
    ends = counted.agg(least.alias("least"), F.greatest(edge, most).alias("edge")).where("least is not null")
    every = ends.select(F.explode(F.sequence("least", "edge")).alias("b"))
    return every.join(counted.select("b", "count"), "b", "left").select((F.col("b") * i).alias("low"), ((F.col("b") + 1) * i).alias("high"), F.coalesce("count", F.lit(0)).alias("count"))


def aggregate(hits: DataFrame, docs: DataFrame, requests: dict[str, tuple[str, float | None]]) -> dict[str, DataFrame]:
    """By name a table for each request (field, interval): a histogram, or stats without an interval."""
    return {name: stats(hits, docs, f) if i is None else histogram(hits, docs, f, i) for name, (f, i) in requests.items()}


def collapse(hits: DataFrame, docs: DataFrame, field: str, best: bool = True) -> DataFrame:
    """The best (or worst) hit of each value of a field, with the value as key and
    the group's size; a missing value is "__null__", an array counts by its least.
    One aggregation, no window: a large group isn't sorted."""
    key = F.array_min(field) if _is_array(docs, field) else F.col(field)
    x = stored(hits, docs.withColumn("key", F.coalesce(key.cast("string"), F.lit("__null__"))), "key")
    r = F.round(SCORE, 6)
    rank = F.struct((-r if best else r).alias("o"), F.col(DOC).alias("d"), F.col(SCORE).alias("s"))
    return x.groupBy("key").agg(F.min(rank).alias("x"), F.count("*").alias("group_size")).select(F.col("x.d").alias(DOC), F.col("x.s").alias(SCORE), "key", "group_size")


def pages(hits: DataFrame, size: int):
    """Lists of at most `size` hits in ranked order, fetched partition by partition."""
    page: list = []
    for row in hits.orderBy(F.desc(F.round(SCORE, 6)), DOC).toLocalIterator():
        page.append(row)
        if len(page) == size:
            yield page
            page = []
    if page:
        yield page
