"""Many queries in one job: a table of queries meets the postings in a join."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .index import Index

#: Terms of a batch that are pushed down to the scan of postings.
FEW = 2000


def query_terms(index: Index, field: str, queries: DataFrame) -> DataFrame:
    """(query_id, term, boost) of a table of texts (query_id, text), analysed like the
    field; a word that a text repeats counts as often."""
    x = queries.select("query_id", F.explode(index.analysers[field](F.col("text"))).alias("term"))
    return x.groupBy("query_id", "term").agg(F.count("*").cast("double").alias("boost"))


def search_terms(index: Index, field: str, queries: DataFrame, n: int | None = 10) -> DataFrame:
    """(query_id, doc_id, score[, rank]) of the n best documents for each query, all
    for n=None; a query is its rows (query_id, term, boost), of which any may match.
    The cost is the postings of the queries' terms, whatever the number of queries."""
    known = queries.join(index.vocabulary(field).select("term", "df"), "term")
    postings, wanted = index.of_field(field), queries.select("term").distinct().limit(FEW + 1).collect()
    if len(wanted) <= FEW:  # few enough to say in the scan, which then skips row groups; else the join alone finds them
        postings = index.of_field(field, F.col("term").isin([r.term for r in wanted]))
    score = index.similarity(F.col("tf"), F.col("dl"), index.avgdl.get(field, 1.0), index.n_docs, F.col("df")) * F.col("boost")
    x = postings.select("term", "doc_id", "tf", "dl").join(known, "term").select("query_id", "doc_id", score.alias("score"))
    x = x.groupBy("query_id", "doc_id").agg(F.sum("score").alias("score"))
    if n is None:
        return x
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 6)), "doc_id"))
    return x.withColumn("rank", rank).where(F.col("rank") <= n)
