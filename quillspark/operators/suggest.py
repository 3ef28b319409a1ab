"""Spelling suggestions and completions from the index's vocabulary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .index import Index


def trigrams(text: str) -> list[str]:
    return sorted({text[i : i + 3] for i in range(len(text) - 2)})


def _shared(term: Column, grams: list[str]) -> Column:
    """How often the term holds each of the trigrams, in sum (places, not kinds)."""
    places = F.sequence(F.lit(1), F.greatest(F.length(term) - 2, F.lit(1)))
    return F.size(F.filter(places, lambda i: F.substring(term, i, F.lit(3)).isin(grams)))


def did_you_mean(index: Index, field: str, word: str, max_edits: int = 2, n: int = 5) -> DataFrame:
    """(term, distance, df, score) of the n best other terms within max_edits, by
    df / (1 + distance). Of a word of three letters or more only terms are tried that
    share enough trigrams with it: all of its but three for each edit, one at least."""
    t, grams = F.col("term"), trigrams(word)
    near = (t != word) & F.length(t).between(len(word) - max_edits, len(word) + max_edits)
    d = F.levenshtein(t, F.lit(word), max_edits)
    if grams:
        near = near & (_shared(t, grams) >= max(1, len(grams) - 3 * max_edits))
    x = index.vocabulary(field, near & (d >= 0)).select("term", d.cast("int").alias("distance"), "df")
    return x.withColumn("score", F.col("df") / (F.col("distance") + 1.0)).orderBy(F.desc("score"), "term").limit(n)


def did_you_mean_all(index: Index, field: str, words: DataFrame, max_edits: int = 2, n: int = 5) -> DataFrame:
    """did_you_mean for a table of words (word): (word, term, distance, df, score).
    Words meet terms that share a trigram, so that the join is on equal keys."""
    from pyspark.sql import Window

    def split(df: DataFrame, c: str) -> DataFrame:
        g = F.transform(F.sequence(F.lit(1), F.length(c) - 2), lambda i: F.substring(F.col(c), i, F.lit(3)))
        return df.where(F.length(c) >= 3).withColumn("g", F.explode(F.array_distinct(g) if c == "word" else g))

    w = split(words.select("word").distinct(), "word").withColumn("kinds", F.count("*").over(Window.partitionBy("word")))
    t = split(index.vocabulary(field).select("term", "df"), "term")
    met = w.join(t, "g").where(F.abs(F.length("word") - F.length("term")) <= max_edits)
    x = met.groupBy("word", "term").agg(F.first("df").alias("df"), F.first("kinds").alias("kinds"), F.count("*").alias("c"))
    d = F.levenshtein(F.col("word"), F.col("term"), max_edits)
    x = x.where((F.col("word") != F.col("term")) & (F.col("c") >= F.greatest(F.lit(1), F.col("kinds") - 3 * max_edits))).withColumn("distance", d.cast("int")).where("distance >= 0")
    x = x.withColumn("score", F.col("df") / (F.col("distance") + 1.0))
    best = F.row_number().over(Window.partitionBy("word").orderBy(F.desc("score"), "term"))
    return x.withColumn("r", best).where(F.col("r") <= n).select("word", "term", "distance", "df", "score")


def complete(index: Index, field: str, prefix: str, n: int = 10) -> DataFrame:
    """(term, df) of the n most frequent terms with a prefix."""
    return index.vocabulary(field, F.col("term").startswith(prefix)).select("term", "df").orderBy(F.desc("df"), "term").limit(n)
