"""Sets of documents as bitmaps: (bucket, bits), a row for each 32768 ids that has one.

Made with a partial aggregation on each task, so that what is shuffled is bits and
not ids; sets meet in a join or an aggregation by bucket.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BITS = 32768


def of(docs: DataFrame) -> DataFrame:
    """The set of the doc_ids of docs; nulls and repeats don't count."""
    x = docs.where("doc_id is not null").select(F.bitmap_bucket_number("doc_id").alias("bucket"), F.bitmap_bit_position("doc_id").alias("at"))
    return x.groupBy("bucket").agg(F.bitmap_construct_agg("at").alias("bits"))


def either(a: DataFrame, b: DataFrame) -> DataFrame:
    """The union of two sets."""
    return a.unionByName(b).groupBy("bucket").agg(F.bitmap_or_agg("bits").alias("bits"))


def both(a: DataFrame, b: DataFrame) -> DataFrame:
    """The intersection of two sets."""
    x = a.unionByName(b).groupBy("bucket").agg(F.bitmap_and_agg("bits").alias("bits"), F.count("*").alias("n"))
    return x.where("n = 2 and bitmap_count(bits) > 0").select("bucket", "bits")


def minus(a: DataFrame, b: DataFrame) -> DataFrame:
    """What is in the first set and not in the second."""
    x = members(a).join(members(b), "doc_id", "left_anti")
    return of(x)


def count(a: DataFrame) -> DataFrame:
    """(n): how many documents are in a set."""
    return a.agg(F.coalesce(F.sum(F.bitmap_count("bits")), F.lit(0)).alias("n"))


def members(a: DataFrame) -> DataFrame:
    """(doc_id) of a set."""
    x = a.select("bucket", F.posexplode(F.split(F.regexp_replace(F.hex("bits"), "(..)", "$1 "), " ")).alias("byte", "h")).where("h <> '' and h <> '00'")
    x = x.select("bucket", "byte", F.conv("h", 16, 10).cast("int").alias("v"), F.explode(F.sequence(F.lit(0), F.lit(7))).alias("bit"))
    x = x.where(F.expr("shiftright(v, bit)").bitwiseAND(1) == 1)
    at = F.col("byte") * 8 + F.col("bit")
    return x.select(F.when(F.col("bucket") > 0, (F.col("bucket") - 1) * BITS + at + 1).otherwise(F.col("bucket") * BITS - at).alias("doc_id"))
