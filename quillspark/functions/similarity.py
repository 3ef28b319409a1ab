"""Scores of a term in a document, as columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: (tf, dl, avgdl, n_docs, df) -> score; avgdl and n_docs are numbers of the whole index.
Similarity = Callable[[Column, Column, float, int, Column], Column]
K1, B = 1.2, 0.75


def idf(n_docs: int, df: Column) -> Column:
    return F.log(F.lit(1.0) + (F.lit(float(n_docs)) - df + 0.5) / (df + 0.5))


def bm25(tf: Column, dl: Column, avgdl: float, n_docs: int, df: Column) -> Column:
    norm = F.lit(K1 * (1 - B)) + F.lit(K1 * B) * dl / F.lit(float(avgdl) or 1.0)
    return idf(n_docs, df) * (tf * (K1 + 1)) / (tf + norm)


def tf_idf(tf: Column, dl: Column, avgdl: float, n_docs: int, df: Column) -> Column:
    return F.sqrt(tf.cast("double")) * (1 + F.log(F.lit(float(n_docs)) / (df + 1))) / F.sqrt(F.greatest(dl, F.lit(1)).cast("double"))
