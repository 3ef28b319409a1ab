"""Corpus pipeline: quality, near duplicates, decontamination, mixing, token output.

Every stage reads what its predecessor wrote, as a whole, and drops or orders
documents by its operator's decisions; all but the last keep the columns of
documents. Nulls, empty texts, repeated rows and clashing columns are handled as
the operators' docstrings say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.llm import decontam, mixing, ngram_join, quality_zstd, token_output
from quillspark.llm.common import materialize, settle, sized_broadcast, small_batches, written
from quillspark.session import ship


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression classifier doesn't reject. It's fitted on the labelled ones among docs."""
    labels = ship(spark).read.parquet(f"{sf_dir}/labels.parquet")
    return quality_zstd.classify(docs, labels).where("keep").select(*docs.columns)


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, that with the least doc_id, and all without any."""
    ship(spark)
    return ngram_join.drop_near_duplicates(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of benchmark."""
    with small_batches(spark):
        return decontam.decontaminate(docs, ship(spark).read.parquet(f"{sf_dir}/benchmark.parquet"))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents range-sorted by training position; those of a source that's asked for more than it has come again."""
    ship(spark)
    return mixing.mix(docs).select(*docs.columns)


def token_id_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token table (doc_id, source, lang, n_tokens, tokens, position) in training
    order. position: the row's place in that order, from 0, as a reader of several
    files doesn't keep theirs."""
    ship(spark)
    with small_batches(spark):
        return token_output.token_output(in_written_order(docs), sort=("position",), also=("position",)).orderBy("position")


def in_written_order(docs: DataFrame) -> DataFrame:
    """(doc_id, source, lang, text, position): position is a row's place, from 0, in
    the order that docs was written in. Spark reads large files first; part
    numbers and rows in a file tell the order. What isn't just read is written first."""
    if docs._jdf.queryExecution().analyzed().getClass().getSimpleName() != "LogicalRelation":
        docs = materialize(docs)
    x = docs.select("doc_id", "source", "lang", "text", F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("at"))
    part = F.regexp_extract(F.element_at(F.split("file", "/"), -1), r"^part-(\d+)", 1)
    before = Window.orderBy(F.expr("length(part)"), "part", "file").rowsBetween(Window.unboundedPreceding, -1)
    starts = x.groupBy("file").agg(F.count("*").alias("n")).withColumn("part", part)  # a row for each file
    starts = starts.select("file", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    return x.join(sized_broadcast(materialize(starts)), "file").select("doc_id", "source", "lang", "text", (F.col("start") + F.col("at")).alias("position"))


STAGES = [
    ("quality classifier", quality_classifier),
    ("n-gram Jaccard join", ngram_jaccard_join),
    ("benchmark decontamination", benchmark_decontamination),
    ("mixing sources to target weights", source_mixing),
    ("token-ID / binary output", token_id_output),
]
#: SQL can't express the first stage; tests/llm holds run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents in order, each result written as Parquet and
    read again, when the stage's input and its own tables go; rows in training order."""
    docs, since = spark.read.parquet(f"{sf_dir}/documents.parquet"), written()
    for _, stage in STAGES:
        docs = settle(stage(spark, docs, sf_dir), since)
    return docs.orderBy("position")
