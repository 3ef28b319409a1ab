"""Snippets of stored text around a query's terms, and score explanations."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions.analysis import Analyser
from ..functions.offsets import forms, pattern_of
from ..functions.similarity import idf
from ..functions.vectors import cosine
from ..plans import query as Q
from .index import Index

_WORD = re.compile(r"[^\W_]+")


def snippet(text: str | None, terms: Iterable[str], most: int = 200, before: str = "<b>", after: str = "</b>", normal: Callable[[str], str] = str.lower, word=_WORD) -> str:
    """The window of most characters that has most of the terms, the first of equals,
    terms marked, "..." where it's cut. Without terms the text's beginning; of null ''.
    normal takes a word, a match of the pattern, to its term."""
    text, terms = text or "", {normal(t) for t in terms}
    hits = [m.span() for m in word.finditer(text) if normal(m[0]) in terms] if terms else []
    if not terms or not word.search(text):
        return text if len(text) <= most else text[:most] + "..."
    lo, hi, best, first = 0, min(len(text), most), 0, 0
    for s, _ in hits:
        start = max(0, s - most // 4)
        end = min(len(text), start + most)
        while first < len(hits) and hits[first][0] < start:
            first += 1  # starts only grow
        n, k = 0, first
        while k < len(hits) and hits[k][1] <= end:
            n, k = n + 1, k + 1
        if n > best:
            lo, hi, best = start, end, n
    part = text[lo:hi]
    marked = word.sub(lambda m: before + m[0] + after if normal(m[0]) in terms else m[0], part)
    return "..." * (lo > 0) + marked + "..." * (hi < len(text))


def highlight(docs: DataFrame, field: str, analyser: Analyser, terms: Iterable[str], most: int = 200, before: str = "<b>", after: str = "</b>") -> DataFrame:
    """docs with the field's snippet as a column of that name. Words are marked where
    the analyser takes them to one of the terms, whatever their spelling: stemmed and
    folded words too. docs is read twice, first for these spellings."""
    wanted, word = forms(docs, field, analyser, sorted(terms)), pattern_of(analyser)

    @F.arrow_udf(StringType())
    def run(texts: pa.Array) -> pa.Array:
        return pa.array([snippet(t, wanted, most, before, after, lambda x: x, word) for t in texts.to_pylist()], pa.string())

    return docs.withColumn("snippet", run(F.col(field)))


def explain(index: Index, query: Q.Term) -> DataFrame:
    """(doc_id, score, idf, tf, dl, avgdl, boost) of each document that a term query matches."""
    t = F.col("term") == query.term
    x = index.of_field(query.field, t).join(F.broadcast(index.vocabulary(query.field, t).drop("cf")), "term")  # one row
    avgdl = index.avgdl.get(query.field, 1.0)
    score = index.similarity(F.col("tf"), F.col("dl"), avgdl, index.n_docs, F.col("df")) * query.boost
    return x.select("doc_id", score.alias("score"), idf(index.n_docs, F.col("df")).alias("idf"), "tf", "dl", F.lit(float(avgdl)).alias("avgdl"), F.lit(float(query.boost)).alias("boost"))


def explain_vector(index: Index, query: Q.Vector) -> DataFrame:
    """(doc_id, cosine, strategy) of each document; the search is always exact."""
    aim = F.array(*(F.lit(float(v)) for v in query.vector))
    how = "exact scan" if query.filter is None else "exact scan of what passes the filter"
    return index.docs.select("doc_id", cosine(F.col(query.field), aim).alias("cosine"), F.lit(how).alias("strategy"))
