"""The registered queries of the training-data operators, each over its whole
table with production parameters, and DuckDB SQL where SQL can express one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import decontam, html_tree, line_dedup, mixing, ngram_join, perplexity, quality_zstd, token_count, token_output, url_lm


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document in training order, as often as its source's weight asks; odd rows as in mixing.mix."""
    return mixing.mix(_table(spark, sf_dir, "documents"))


def op2_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The content of every page, by a model of the pages that mark theirs; odd rows as in html_tree.extract."""
    return html_tree.extract_pages(_table(spark, sf_dir, "pages"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its score and whether it stays, without its text; odd rows as in quality_zstd.score."""
    docs = _table(spark, sf_dir, "documents")
    return quality_zstd.classify(docs, _table(spark, sf_dir, "labels")).drop("text")


def op4_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The token table of all documents, written and read; odd rows as in token_output.encode."""
    return token_output.token_output(_table(spark, sf_dir, "documents"))


def op5_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its class of near duplicates and its links; odd rows as in ngram_join.near_duplicates."""
    return ngram_join.near_duplicates(_table(spark, sf_dir, "documents"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document and benchmark item that match; odd rows as in decontam.matches."""
    return decontam.matches(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's number of tokens; odd rows as in token_count.token_counts."""
    return token_count.token_counts(_table(spark, sf_dir, "documents"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's bitmap of lines to keep; odd rows as in line_dedup.keep_bitmaps."""
    return line_dedup.keep_bitmaps(_table(spark, sf_dir, "documents"))


def op9_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's URL with its score and whether it stays; odd rows as in url_lm.score."""
    return url_lm.filter_urls(_table(spark, sf_dir, "pages"))


def op10_perplexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's perplexity, its band and whether it stays; odd rows as in perplexity.perplexity_bands."""
    return perplexity.perplexity_bands(_table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_mixing, op2_html, op3_quality, op4_token_output, op5_ngram_jaccard, op6_decontamination, op7_token_counts, op8_line_dedup, op9_urls, op10_perplexity)}
SQL = {"op1_mixing": mixing.SQL, "op5_ngram_jaccard": ngram_join.SQL, "op6_decontamination": decontam.SQL}
