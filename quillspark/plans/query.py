"""The query tree: immutable, comparable, hashable."""

from __future__ import annotations

import enum
from dataclasses import dataclass, replace


class Occur(enum.Enum):
    MUST = "+"
    SHOULD = ""
    MUST_NOT = "-"


class Query:
    boost: float

    def boosted(self, boost: float) -> Query:
        return replace(self, boost=boost)

    def __and__(self, other: Query) -> Bool:
        return Bool(((self, Occur.MUST), (other, Occur.MUST)))

    def __or__(self, other: Query) -> Bool:
        return Bool(((self, Occur.SHOULD), (other, Occur.SHOULD)))

    def __sub__(self, other: Query) -> Bool:
        return Bool(((self, Occur.MUST), (other, Occur.MUST_NOT)))


@dataclass(frozen=True)
class Term(Query):
    field: str
    term: str
    boost: float = 1.0


@dataclass(frozen=True)
class Bool(Query):
    """Every MUST clause holds, no MUST_NOT does, and without a MUST some SHOULD does; scores add up."""

    clauses: tuple[tuple[Query, Occur], ...] = ()
    boost: float = 1.0

    @staticmethod
    def of(must: list[Query] = (), should: list[Query] = (), must_not: list[Query] = (), boost: float = 1.0) -> Bool:
        return Bool(tuple([(q, Occur.MUST) for q in must] + [(q, Occur.SHOULD) for q in should] + [(q, Occur.MUST_NOT) for q in must_not]), boost)

    def add(self, query: Query, occur: Occur) -> Bool:
        return replace(self, clauses=(*self.clauses, (query, occur)))


@dataclass(frozen=True)
class Phrase(Query):
    """Terms one after the other, each at most slop places off where it should stand after its predecessor."""

    field: str
    terms: tuple[str, ...]
    slop: int = 0
    boost: float = 1.0


@dataclass(frozen=True)
class Prefix(Query):
    field: str
    prefix: str
    boost: float = 1.0


@dataclass(frozen=True)
class Wildcard(Query):
    """* stands for any characters, ? for one."""

    field: str
    pattern: str
    boost: float = 1.0


@dataclass(frozen=True)
class Fuzzy(Query):
    field: str
    term: str
    max_edits: int = 2
    max_expansions: int = 64
    boost: float = 1.0


@dataclass(frozen=True)
class Regexp(Query):
    """Terms in which the pattern is found anywhere."""

    field: str
    pattern: str
    ignore_case: bool = False
    boost: float = 1.0


@dataclass(frozen=True)
class TermRange(Query):
    field: str
    low: str | None = None
    high: str | None = None
    include_low: bool = True
    include_high: bool = True
    boost: float = 1.0


@dataclass(frozen=True)
class Range(Query):
    field: str
    low: float
    high: float
    boost: float = 1.0


@dataclass(frozen=True)
class ConstantScore(Query):
    inner: Query
    score: float = 1.0
    boost: float = 1.0


@dataclass(frozen=True)
class DisMax(Query):
    """The best score, and tie times the others."""

    queries: tuple[Query, ...]
    tie: float = 0.0
    boost: float = 1.0


@dataclass(frozen=True)
class FunctionScore(Query):
    """A score and a number of the document: mode is multiply, replace, sum or max. Without the number the score stays."""

    inner: Query
    field: str
    mode: str = "multiply"
    boost: float = 1.0


@dataclass(frozen=True)
class Vector(Query):
    """The top_k documents by cosine, among those that pass the filter."""

    field: str
    vector: tuple[float, ...]
    top_k: int = 10
    filter: Query | None = None
    boost: float = 1.0


@dataclass(frozen=True)
class GeoBox(Query):
    field: str
    min_lat: float
    max_lat: float
    min_lon: float
    max_lon: float
    boost: float = 1.0


@dataclass(frozen=True)
class GeoDistance(Query):
    field: str
    lat: float
    lon: float
    metres: float
    boost: float = 1.0


class Span(Query):
    """A query that has places in a document."""


@dataclass(frozen=True)
class SpanTerm(Span):
    field: str
    term: str
    boost: float = 1.0


@dataclass(frozen=True)
class SpanNear(Span):
    clauses: tuple[Span, ...]
    slop: int = 0
    in_order: bool = True
    boost: float = 1.0


@dataclass(frozen=True)
class SpanOr(Span):
    clauses: tuple[Span, ...]
    boost: float = 1.0


@dataclass(frozen=True)
class SpanNot(Span):
    """Documents of include that hold no span of exclude."""

    include: Span
    exclude: Span
    boost: float = 1.0


@dataclass(frozen=True)
class BlockJoin(Query):
    """Parents of matching children."""

    child: Query
    boost: float = 1.0


@dataclass(frozen=True)
class MoreLikeThis(Query):
    doc_id: int
    fields: tuple[str, ...]
    min_tf: int = 1
    min_df: int = 1
    max_df: int = (1 << 31) - 1
    max_terms: int = 25
    min_length: int = 3
    boost_by_score: bool = True
    exclude_source: bool = False
    boost: float = 1.0


@dataclass(frozen=True)
class Rrf(Query):
    """Sum over the queries of 1 / (k + rank), each cut at its best top."""

    queries: tuple[Query, ...]
    k: int = 60
    top: int = 10
    boost: float = 1.0

    def add(self, query: Query) -> Rrf:
        return replace(self, queries=(*self.queries, query))


def rewrite(q: Query) -> Query:
    """The same query in its cheapest form: a wildcard with only a last * is a
    prefix, one without any a term, and a lone unboosted SHOULD stands for itself."""
    if isinstance(q, Wildcard):
        head = q.pattern[:-1]
        if q.pattern.endswith("*") and "*" not in head and "?" not in head:
            return Prefix(q.field, head, q.boost)
        if "*" not in q.pattern and "?" not in q.pattern:
            return Term(q.field, q.pattern, q.boost)
    if isinstance(q, Bool):
        q = replace(q, clauses=tuple((rewrite(c), o) for c, o in q.clauses))
        if len(q.clauses) == 1 and q.clauses[0][1] is not Occur.MUST_NOT and q.boost == 1.0:
            return q.clauses[0][0]
    if isinstance(q, DisMax | Rrf):
        q = replace(q, queries=tuple(map(rewrite, q.queries)))
    if isinstance(q, ConstantScore | FunctionScore):
        q = replace(q, inner=rewrite(q.inner))
    return q


def terms_of(q: Query) -> set[str]:
    """The lower-cased terms to highlight."""
    if isinstance(q, Term | SpanTerm):
        return {q.term.lower()}
    if isinstance(q, Prefix):
        return {q.prefix.lower()}
    if isinstance(q, Phrase):
        return {t.lower() for t in q.terms}
    if isinstance(q, Bool):
        return set().union(*(terms_of(c) for c, o in q.clauses if o is not Occur.MUST_NOT))
    return set()
