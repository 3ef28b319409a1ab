"""From a query tree to a DataFrame of (doc_id, score).

Every node gives each matching document once. Term-like nodes read the postings
with a predicate on field and term; combinators are unions and one aggregation by
doc_id, or semi and anti joins; Catalyst and AQE choose how to join. With
need_score=False a node gives the same documents, and whatever only its score
needs isn't read.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import METRES_A_DEGREE, haversine
from ..functions.vectors import cosine
from ..operators.index import Index
from . import query as Q

DOC, SCORE = "doc_id", "score"


def _score_of(index: Index, field: str) -> Column:
    return index.similarity(F.col("tf"), F.col("dl"), index.avgdl.get(field, 1.0), index.n_docs, F.col("df"))


def _constant(hits: DataFrame, score: float) -> DataFrame:
    return hits.select(DOC, F.lit(float(score)).alias(SCORE))


def _none(index: Index) -> DataFrame:
    return _constant(index.docs.where(F.lit(False)), 0.0)


def _expanded(index: Index, field: str, condition: Column, boost: float, need_score: bool, vocabulary: DataFrame | None = None, weight: Column | None = None) -> DataFrame:
    """Documents with a term that meets the condition; scores of their terms add up."""
    p = index.of_field(field, condition)
    if not need_score and vocabulary is None:
        return _constant(p.select(DOC).distinct(), boost)
    v = vocabulary if vocabulary is not None else index.vocabulary(field, condition)
    s = _score_of(index, field) * boost
    x = p.join(v.drop("cf"), "term").select(DOC, (s if weight is None else s * weight).alias(SCORE))
    return x.groupBy(DOC).agg(F.sum(SCORE).alias(SCORE))


def wildcard_pattern(pattern: str) -> str:
    return "^" + "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in pattern) + "$"


def _wildcard(pattern: str) -> Column:
    head = re.split(r"[*?]", pattern)[0]
    match = F.col("term").rlike("(?s)" + wildcard_pattern(pattern))
    return F.col("term").startswith(head) & match if head else match  # the prefix prunes row groups


def _term_range(q: Q.TermRange) -> Column:
    t, out = F.col("term"), F.lit(True)
    if q.low is not None:
        out = out & (t >= q.low if q.include_low else t > q.low)
    if q.high is not None:
        out = out & (t <= q.high if q.include_high else t < q.high)
    return out


def _terms(index: Index, clauses: list[tuple[Q.Term, Q.Occur]], boost: float, need_score: bool) -> DataFrame:
    """A Bool whose clauses are terms of one field: one read, one aggregation."""
    field = clauses[0][0].field
    words = sorted({q.term for q, _ in clauses})
    p = index.of_field(field, F.col("term").isin(words))
    if need_score:
        p = p.join(F.broadcast(index.vocabulary(field, F.col("term").isin(words)).drop("cf")), "term")  # a row for each word of the query
    is_ = lambda q: F.col("term") == q.term
    of = lambda occur: [q for q, o in clauses if o is occur]
    score = F.lit(0.0)
    for q in of(Q.Occur.MUST) + of(Q.Occur.SHOULD):
        score = score + F.when(is_(q), _score_of(index, field) * q.boost if need_score else F.lit(1.0)).otherwise(0.0)
    must, should, never = ({q.term for q in of(o)} for o in (Q.Occur.MUST, Q.Occur.SHOULD, Q.Occur.MUST_NOT))
    if not must and not should:
        return _none(index)
    has = lambda ts: F.count(F.when(F.col("term").isin(sorted(ts)), 1))
    x = p.groupBy(DOC).agg(F.sum(score).alias(SCORE), (has(must) if must else F.lit(0)).alias("m"), (has(should) if should else F.lit(0)).alias("s"), (has(never) if never else F.lit(0)).alias("n"))
    ok = (F.col("m") == len(must)) if must else F.col("s") > 0
    return x.where(ok & (F.col("n") == 0)).select(DOC, (F.col(SCORE) * boost).alias(SCORE))


def _bool(index: Index, q: Q.Bool, need_score: bool) -> DataFrame:
    clauses = list(q.clauses)
    if not any(o is not Q.Occur.MUST_NOT for _, o in clauses):
        return _none(index)
    if all(isinstance(c, Q.Term) for c, _ in clauses) and len({c.field for c, _ in clauses}) == 1:
        return _terms(index, clauses, q.boost, need_score)
    must = [c for c, o in clauses if o is Q.Occur.MUST]
    parts = []
    for c, o in clauses:
        h = compile(c, index, need_score and o is not Q.Occur.MUST_NOT)
        if not need_score and must and o is Q.Occur.SHOULD:
            continue
        parts.append(h.select(DOC, (F.lit(0.0) if o is Q.Occur.MUST_NOT else F.col(SCORE)).alias(SCORE), F.lit(int(o is Q.Occur.MUST)).alias("m"), F.lit(int(o is Q.Occur.SHOULD)).alias("s"), F.lit(int(o is Q.Occur.MUST_NOT)).alias("n")))
    x = reduce(DataFrame.union, parts).groupBy(DOC).agg(*(F.sum(c).alias(c) for c in (SCORE, "m", "s", "n")))
    ok = (F.col("m") == len(must)) if must else F.col("s") > 0
    score = F.when(F.col(SCORE) == 0, 1.0).otherwise(F.col(SCORE)) * q.boost
    return x.where(ok & (F.col("n") == 0)).select(DOC, score.alias(SCORE))


def _places(index: Index, field: str, words: list[str]) -> DataFrame:
    """(doc_id, p0, p1, ...): the positions of each of the words, of documents that have them all."""
    distinct = sorted(set(words))
    p = index.of_field(field, F.col("term").isin(distinct))
    if len(distinct) == 1:
        return p.select(DOC, *(F.col("positions").alias(f"p{i}") for i in range(len(words))))
    x = p.groupBy(DOC).agg(F.count("*").alias("n"), *(F.max(F.when(F.col("term") == w, F.col("positions"))).alias(f"w{k}") for k, w in enumerate(distinct))).where(F.col("n") == len(distinct))
    return x.select(DOC, *(F.col(f"w{distinct.index(w)}").alias(f"p{i}") for i, w in enumerate(words)))


def _reached(places: Column, before: Column, near: Callable[[Column, Column], Column]) -> Column:
    """The places that are near one of those before, which are bound to a name so as to be made once."""
    return F.transform(F.array(before), lambda b: F.filter(places, lambda p: F.exists(b, lambda r: near(p, r))))[0]


def _phrase(index: Index, q: Q.Phrase) -> DataFrame:
    if not q.terms:
        return _none(index)
    x = _places(index, q.field, list(q.terms))
    ends = F.col("p0")  # where a chain of the words so far may end
    for i in range(1, len(q.terms)):
        here = F.col(f"p{i}")
        if q.slop == 0:
            ends = F.array_intersect(F.transform(ends, lambda p: p + 1), here)
        else:
            ends = _reached(here, ends, lambda p, r: p.between(r + (1 - q.slop), r + (1 + q.slop)))
    return _constant(x.where(F.size(ends) > 0), q.boost)


def starts(q: Q.Span, index: Index) -> DataFrame:
    """(doc_id, starts): where the spans of a span query begin; a nested SpanNear is one span from its first place."""
    if isinstance(q, Q.SpanTerm):
        return index.of_field(q.field, F.col("term") == q.term).select(DOC, F.col("positions").alias("starts"))
    if isinstance(q, Q.SpanOr):
        x = reduce(DataFrame.union, [starts(c, index) for c in q.clauses])
        return x.groupBy(DOC).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("starts")))).alias("starts"))
    if isinstance(q, Q.SpanNot):
        return starts(q.include, index).join(starts(q.exclude, index).select(DOC), DOC, "left_anti")
    if isinstance(q, Q.SpanNear):
        x = starts(q.clauses[0], index).withColumnRenamed("starts", "s0")
        for i, c in enumerate(q.clauses[1:], 1):
            x = x.join(starts(c, index).withColumnRenamed("starts", f"s{i}"), DOC)
        ends = F.col("s0")
        for i in range(1, len(q.clauses)):
            ends = _reached(F.col(f"s{i}"), ends, lambda p, r: (F.abs(p - r) <= q.slop + 1) & ((p > r) if q.in_order else F.lit(True)))
        least = F.array_min(F.concat(*(F.col(f"s{i}") for i in range(len(q.clauses)))))
        return x.where(F.size(ends) > 0).select(DOC, F.array(least).alias("starts"))
    raise TypeError(f"{type(q).__name__} has no spans")


def _number(index: Index, field: str) -> Column:
    """A document's number: of several the last, which is what a range is held to."""
    c = F.col(field)
    return F.element_at(c, -1).cast("double") if index.docs.schema[field].dataType.typeName() == "array" else c.cast("double")


def seed_terms(q: Q.MoreLikeThis, index: Index) -> DataFrame:
    """(field, term, df, w): the seed document's weightiest terms."""
    seed = index.postings.where((F.col(DOC) == q.doc_id) & F.col("field").isin(list(q.fields)) & (F.length("term") >= max(1, q.min_length)) & (F.col("tf") >= q.min_tf)).select("field", "term", "tf")
    w = F.col("tf") * F.log(F.lit(float(index.n_docs)) / (F.col("df") + 1))
    x = seed.join(index.terms.select("field", "term", "df"), ["field", "term"]).where(F.col("df").between(q.min_df, q.max_df))
    return x.select("field", "term", "df", w.alias("w")).orderBy(F.desc(F.round("w", 9)), "field", "term").limit(q.max_terms)


def _more_like_this(index: Index, q: Q.MoreLikeThis) -> DataFrame:
    chosen = seed_terms(q, index)
    best = F.max("w").over(Window.partitionBy())  # over max_terms rows at most
    boost = F.when(best > 0, F.col("w") / best).otherwise(1.0) if q.boost_by_score else F.lit(1.0)
    chosen = chosen.select("field", "term", "df", boost.alias("b"))
    x = index.postings.join(F.broadcast(chosen), ["field", "term"])
    score = F.lit(0.0)
    for f in q.fields:
        score = F.when(F.col("field") == f, _score_of(index, f)).otherwise(score)
    x = x.select(DOC, (score * F.col("b") * q.boost).alias(SCORE)).groupBy(DOC).agg(F.sum(SCORE).alias(SCORE))
    return x.where(F.col(DOC) != q.doc_id) if q.exclude_source else x


def top(hits: DataFrame, n: int) -> DataFrame:
    """The n best hits, by score, then doc_id. Scores within 1e-6 are ties."""
    return hits.orderBy(F.desc(F.round(SCORE, 6)), DOC).limit(n)


def _rrf(index: Index, q: Q.Rrf) -> DataFrame:
    if not q.queries:
        return _none(index)
    rank = F.row_number().over(Window.orderBy(F.desc(F.round(SCORE, 6)), DOC))  # over top rows
    parts = [top(compile(c, index), q.top).select(DOC, (F.lit(1.0) / (F.lit(q.k) + rank)).alias(SCORE)) for c in q.queries]
    return reduce(DataFrame.union, parts).groupBy(DOC).agg((F.sum(SCORE) * q.boost).alias(SCORE))


def compile(q: Q.Query, index: Index, need_score: bool = True) -> DataFrame:
    """(doc_id, score) of the documents that match a query."""
    q = Q.rewrite(q)
    t = F.col("term")
    match q:
        case Q.Term():
            p = index.of_field(q.field, t == q.term)
            if not need_score:
                return _constant(p, q.boost)
            p = p.join(F.broadcast(index.vocabulary(q.field, t == q.term).drop("cf")), "term")  # one row
            return p.select(DOC, (_score_of(index, q.field) * q.boost).alias(SCORE))
        case Q.Bool():
            return _bool(index, q, need_score)
        case Q.Phrase():
            return _phrase(index, q)
        case Q.Prefix():
            return _expanded(index, q.field, t.startswith(q.prefix), q.boost, need_score)
        case Q.Wildcard():
            return _expanded(index, q.field, _wildcard(q.pattern), q.boost, need_score)
        case Q.Regexp():
            return _expanded(index, q.field, t.rlike(("(?i)" if q.ignore_case else "") + q.pattern), q.boost, need_score)
        case Q.TermRange():
            return _expanded(index, q.field, _term_range(q), q.boost, need_score)
        case Q.Fuzzy():
            d = F.levenshtein(t, F.lit(q.term), q.max_edits)
            near = F.length("term").between(len(q.term) - q.max_edits, len(q.term) + q.max_edits) & (d >= 0)
            v = index.vocabulary(q.field, near).withColumn("d", d).orderBy("d", "term").limit(q.max_expansions)
            return _expanded(index, q.field, near, q.boost, need_score, v, F.lit(1.0) - F.col("d") / float(q.max_edits + 1))
        case Q.Range():
            return _constant(index.docs.where(_number(index, q.field).between(float(q.low), float(q.high))), q.boost)
        case Q.ConstantScore():
            return _constant(compile(q.inner, index, False), q.score * q.boost)
        case Q.DisMax():
            x = reduce(DataFrame.union, [compile(c, index, need_score) for c in q.queries]).groupBy(DOC).agg(F.max(SCORE).alias("x"), F.sum(SCORE).alias("s"))
            return x.select(DOC, ((F.col("x") + (F.col("s") - F.col("x")) * q.tie) * q.boost).alias(SCORE))
        case Q.FunctionScore():
            x = compile(q.inner, index, need_score).join(index.docs.select(DOC, _number(index, q.field).alias("v")), DOC)
            s, v = F.col(SCORE), F.col("v")
            made = {"multiply": s * v, "replace": v, "sum": s + v, "max": F.greatest(s, v)}[q.mode]
            return x.select(DOC, (F.when(v.isNull(), s).otherwise(made) * q.boost).alias(SCORE))
        case Q.Vector():
            docs = index.docs
            if q.filter is not None:
                docs = docs.join(compile(q.filter, index, False), DOC, "left_semi")
            aim = F.array(*(F.lit(float(v)) for v in q.vector))
            return top(docs.select(DOC, (cosine(F.col(q.field), aim) * q.boost).alias(SCORE)), q.top_k)
        case Q.GeoBox():
            lat, lon = F.col(f"{q.field}_lat"), F.col(f"{q.field}_lon")
            return _constant(index.docs.where(lat.between(q.min_lat, q.max_lat) & lon.between(q.min_lon, q.max_lon)), q.boost)
        case Q.GeoDistance():
            lat, lon = F.col(f"{q.field}_lat"), F.col(f"{q.field}_lon")
            d = q.metres / METRES_A_DEGREE
            box = lat.between(q.lat - d * 1.01, q.lat + d * 1.01)  # what a scan can skip by; the distance decides
            return _constant(index.docs.where(box & (haversine(F.lit(float(q.lat)), F.lit(float(q.lon)), lat, lon) <= q.metres)), q.boost)
        case Q.Span():
            return _constant(starts(q, index).where(F.size("starts") > 0), q.boost)
        case Q.BlockJoin():
            blocks = index.docs.select(DOC, "block_id", "is_parent")
            matched = compile(q.child, index, False).join(blocks.where(~F.col("is_parent")), DOC).select("block_id")
            return _constant(blocks.where("is_parent").join(matched, "block_id", "left_semi"), q.boost)
        case Q.MoreLikeThis():
            return _more_like_this(index, q)
        case Q.Rrf():
            return _rrf(index, q)
    raise TypeError(f"{type(q).__name__} can't be run")
