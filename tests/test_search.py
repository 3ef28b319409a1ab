import math

import pytest
from pyspark.sql import functions as F

from quillspark.functions.analysis import standard_analyser, whitespace_analyser
from quillspark.operators import index as I
from quillspark.operators import rank as R
from quillspark.operators import suggest as S
from quillspark.plans import query as Q
from quillspark.plans.compile import compile, top
from quillspark.plans.parse import QueryParseError, parse
from quillspark.searcher import Cache, Options, Record, Searcher

ROWS = [
    (1, "the quick brown fox", "a", 10.0, ["x", "y"], 51.5, -0.1),
    (2, "brown quick fox jumps", "a", 25.0, ["x"], 48.9, 2.35),
    (3, "lazy dog sleeps dog", "b", 50.0, [], 40.7, -74.0),
    (4, "word wordy wordless", None, None, None, None, None),
    (5, None, "", 75.0, ["y", "y"], 35.7, 139.7),
    (6, "", "b", 100.0, ["z"], -33.9, 151.2),
    (7, "quick quick the quick fox", "c", 50.0, ["x"], 51.5, -0.2),
]


@pytest.fixture(scope="module")
def ix(spark):
    docs = spark.createDataFrame(ROWS, "doc_id bigint, body string, kind string, price double, tags array<string>, home_lat double, home_lon double")
    return I.build(docs, ("body",), ("kind", "tags"))


def ids(ix, q):
    return sorted(r.doc_id for r in compile(q, ix).collect())


def T(w, b=1.0):
    return Q.Term("body", w, b)


def P(*w, slop=0):
    return Q.Phrase("body", w, slop)


def ST(w):
    return Q.SpanTerm("body", w)


@pytest.mark.parametrize(
    ("query", "expected"),
    [
        (T("quick"), [1, 2, 7]),
        (T("none"), []),
        (T("quick") & T("brown"), [1, 2]),
        (T("quick") | T("dog"), [1, 2, 3, 7]),
        (T("quick") - T("brown"), [7]),
        (Q.Bool.of(must_not=[T("quick")]), []),
        (Q.Bool(), []),
        (Q.Bool.of([T("quick"), Q.Range("price", 0, 20)], [], [Q.Term("kind", "c")]), [1]),
        (Q.Bool.of([P("quick", "fox")], [T("brown")]), [2, 7]),
        (P("quick", "brown"), [1]),
        (P("quick", "fox"), [2, 7]),
        (P("quick", "quick", "quick"), [7]),
        (P("fox", "quick", slop=2), [2, 7]),
        (P("dog", "dog", slop=1), [3]),
        (Q.Prefix("body", "word"), [4]),
        (Q.Wildcard("body", "w?rd*y"), [4]),
        (Q.Wildcard("body", "*"), [1, 2, 3, 4, 7]),
        (Q.Fuzzy("body", "quik", 1), [1, 2, 7]),
        (Q.Fuzzy("body", "foxes", 2), [1, 2, 7]),
        (Q.Regexp("body", "o[gx]$"), [1, 2, 3, 7]),
        (Q.Regexp("body", "^QUI", True), [1, 2, 7]),
        (Q.TermRange("body", "dog", "fox", False, True), [1, 2, 7]),
        (Q.TermRange("body", high="brown"), [1, 2]),
        (Q.Range("price", 25, 50), [2, 3, 7]),
        (Q.ConstantScore(T("fox"), 2.0), [1, 2, 7]),
        (Q.DisMax((T("fox"), T("dog"))), [1, 2, 3, 7]),
        (Q.FunctionScore(T("word"), "price"), [4]),
        (Q.GeoBox("home", 45, 55, -1, 3), [1, 2, 7]),
        (Q.GeoDistance("home", 51.5, -0.12, 20_000), [1, 7]),
        (Q.SpanNear((ST("brown"), ST("fox")), 1), [1, 2]),
        (Q.SpanNear((ST("fox"), ST("brown")), 1), []),
        (Q.SpanNear((ST("fox"), ST("brown")), 1, False), [1, 2]),
        (Q.SpanOr((ST("dog"), ST("word"))), [3, 4]),
        (Q.SpanNot(ST("quick"), ST("brown")), [7]),
        (Q.SpanNear((Q.SpanOr((ST("quick"), ST("brown"))), ST("fox")), 0), [1, 2, 7]),
        (Q.Term("kind", "b"), [3, 6]),
        (Q.Term("tags", "y"), [1, 5]),
        (Q.Rrf((T("fox"), T("dog"))), [1, 2, 3, 7]),
        (Q.Rrf(()), []),
        (Q.MoreLikeThis(1, ("body",)), [1, 2, 7]),
        (Q.MoreLikeThis(1, ("body",), exclude_source=True), [2, 7]),
        (Q.MoreLikeThis(99, ("body",)), []),
    ],
)
def test_matches(ix, query, expected):
    assert ids(ix, query) == expected
    assert sorted(r.doc_id for r in compile(query, ix, need_score=False).collect()) == expected


def test_bm25_and_boost(ix):
    got = {r.doc_id: r.score for r in compile(T("quick", 2.0), ix).collect()}
    lengths = {1: 3, 2: 4, 3: 4, 4: 3, 5: 0, 6: 0, 7: 4}
    avg = sum(lengths.values()) / 7
    idf = math.log(1 + (7 - 3 + 0.5) / 3.5)
    for d, tf in ((1, 1), (2, 1), (7, 3)):
        assert got[d] == pytest.approx(2 * idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * lengths[d] / avg)))


def test_scores_of_combinators(ix):
    score = lambda q: {r.doc_id: r.score for r in compile(q, ix).collect()}
    a, b = score(T("quick")), score(T("brown"))
    assert score(T("quick") & T("brown"))[1] == pytest.approx(a[1] + b[1])
    assert score(Q.DisMax((T("quick"), T("brown")), 0.5))[1] == pytest.approx(max(a[1], b[1]) + 0.5 * min(a[1], b[1]))
    assert score(Q.FunctionScore(T("quick"), "price", "sum"))[2] == pytest.approx(a[2] + 25)
    assert score(Q.Bool.of([Q.ConstantScore(T("fox"), 0.0), Q.Range("price", 0, 20, 0.0)]))[1] == 1.0
    assert score(Q.Rrf((T("fox"), T("dog"))))[3] == pytest.approx(1 / 61)
    assert score(Q.Fuzzy("body", "quickk", 2))[1] == pytest.approx(a[1] * (1 - 1 / 3))


def test_index_equals_its_parts(spark, ix):
    """Statistics don't depend on partitioning."""
    again = I.build(ix.docs.repartition(7), ("body",), ("kind", "tags"))
    q = Q.Bool.of(should=[T("quick"), Q.Prefix("body", "w")])
    rows = lambda x: sorted((r.doc_id, round(r.score, 9)) for r in compile(q, x).collect())
    assert rows(ix) == rows(again)
    assert ix.stats.where("field = 'body'").first().n_docs == 7


def test_empty_table(spark):
    e = I.build(spark.createDataFrame([], "doc_id bigint, body string"), ("body",))
    assert compile(T("a"), e).collect() == [] and compile(T("a") & T("b"), e).collect() == []


def test_vectors(spark):
    docs = spark.createDataFrame([(1, [1.0, 0.0], "a"), (2, [0.6, 0.8], "b"), (3, [0.0, 0.0], "b"), (4, None, "b"), (5, [1.0], "a")], "doc_id bigint, v array<float>, k string")
    e = I.build(docs, (), ("k",))
    got = [(r.doc_id, round(r.score, 5)) for r in top(compile(Q.Vector("v", (1.0, 0.0), 5), e), 5).collect()]
    assert got == [(1, 1.0), (2, 0.6), (3, 0.0), (4, 0.0), (5, 0.0)]
    assert ids(e, Q.Vector("v", (1.0, 0.0), 1, Q.Term("k", "b"))) == [2]


def test_block_join(spark):
    rows = [(b * 4 + i, b, i == 3, "hit" if (b % 3 == 0 and i < 2) else "miss hit" if i == 3 else "miss") for b in range(30) for i in range(4)]
    e = I.build(spark.createDataFrame(rows, "doc_id bigint, block_id bigint, is_parent boolean, body string"), ("body",))
    assert ids(e, Q.BlockJoin(T("hit"))) == [b * 4 + 3 for b in range(0, 30, 3)]


def test_ranking(ix):
    hits = compile(Q.Wildcard("body", "*"), ix)
    assert [r.doc_id for r in R.sort_by(hits, ix.docs, "price", 9).collect()] == [4, 1, 2, 3, 7]
    assert [r.doc_id for r in R.sort_by(hits, ix.docs, "kind", 2, True).collect()] == [7, 3]
    assert [r.doc_id for r in R.sort_by(hits, ix.docs, "tags", 2).collect()] == [3, 4]
    f = {(r.field, r.value): r["count"] for r in R.facets(hits, ix.docs, "kind", "tags").collect()}
    assert f == {("kind", "a"): 2, ("kind", "b"): 1, ("kind", "c"): 1, ("tags", "x"): 3, ("tags", "y"): 1}
    s = R.stats(hits, ix.docs, "price").first()
    assert (s["count"], s["min"], s["max"], s["sum"], s["avg"]) == (4, 10.0, 50.0, 135.0, 33.75)
    none = compile(T("none"), ix)
    assert tuple(R.stats(none, ix.docs, "price").first())[1:] == (0, 0.0, 0.0, 0.0, 0.0)
    assert R.histogram(none, ix.docs, "price", 10).collect() == []
    h = [(r.low, r["count"]) for r in R.histogram(hits, ix.docs, "price", 15).orderBy("low").collect()]
    assert h == [(0.0, 1), (15.0, 1), (30.0, 0), (45.0, 2), (60.0, 0)]
    c = {r.key: (r.doc_id, r.group_size) for r in R.collapse(compile(T("quick"), ix), ix.docs, "kind").collect()}
    assert c["a"] == (1, 2) and c["c"][0] == 7
    assert R.collapse(compile(T("word"), ix), ix.docs, "kind").first().key == "__null__"
    assert [len(p) for p in R.pages(hits, 2)] == [2, 2, 1]


def test_suggestions(spark, ix):
    assert [r.term for r in S.did_you_mean(ix, "body", "quikc").collect()] == ["quick"]
    assert [r.term for r in S.complete(ix, "body", "word").collect()] == ["word", "wordless", "wordy"]
    many = S.did_you_mean_all(ix, "body", spark.createDataFrame([("quikc",), ("dogg",)], "word string")).collect()
    assert {(r.word, r.term) for r in many} == {("quikc", "quick"), ("dogg", "dog")}
    one = {(r.term, r.distance, r.df) for r in S.did_you_mean(ix, "body", "wordl").collect()}
    assert one == {(r.term, r.distance, r.df) for r in S.did_you_mean_all(ix, "body", spark.createDataFrame([("wordl",)], "word string")).collect()}


ANALYSE = lambda s: [w for w in s.lower().split() if w != "the"]


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("Fox", Q.Term("f", "fox")),
        ("", Q.Bool()),
        ("the", Q.Bool()),
        ("a b", Q.Bool.of(should=[Q.Term("f", "a"), Q.Term("f", "b")])),
        ("+a -b c", Q.Bool(((Q.Term("f", "a"), Q.Occur.MUST), (Q.Term("f", "b"), Q.Occur.MUST_NOT), (Q.Term("f", "c"), Q.Occur.SHOULD)))),
        ("t:Fox^2", Q.Term("t", "fox", 2.0)),
        ('"a b"~3^.5', Q.Phrase("f", ("a", "b"), 3, 0.5)),
        ('t:"a b"', Q.Phrase("t", ("a", "b"))),
        ("Pre*", Q.Prefix("f", "Pre")),
        ("p?e*", Q.Wildcard("f", "p?e*")),
        ("fox~", Q.Fuzzy("f", "fox", 2)),
        ("fox~1", Q.Fuzzy("f", "fox", 1)),
        ("+(a b)^2", Q.Bool(((Q.Bool.of(should=[Q.Term("f", "a"), Q.Term("f", "b")], boost=2.0), Q.Occur.MUST),))),
        ("well-known", Q.Term("f", "well-known")),
    ],
)
def test_parse(text, expected):
    assert parse(text, "f", ANALYSE) == expected


@pytest.mark.parametrize("text", ['"open', "(a", "a)", "t:", "a +", "t:(a b)", "^2"])
def test_parse_errors(text):
    with pytest.raises(QueryParseError):
        parse(text, "f", ANALYSE)
    assert isinstance(parse(text, "f", ANALYSE, lenient=True), Q.Query)


def test_searcher(ix):
    log = []
    s = Searcher(ix, "body", Cache(2), Record(slow_ms=0, log=log.append))
    r = s.search("+quick -jumps", 1)
    assert [h.doc_id for h in r.hits] == [7] and r.total == 2 and not r.partial
    assert s.search("+quick -jumps", 1) is r and s.cache.hits == 1
    assert s.record.counts["searches"] == 2 and len(log) == 2
    assert s.search(T("quick"), 5, Options(max_bytes=16)).partial
    with pytest.raises(ValueError):
        s.search(T("quick"), 5, Options(max_bytes=1))
    cut = s.search(T("fox"), 5, Options(cancelled=lambda: True))
    assert cut.partial or cut.total == 3
    for w in ("a", "b", "c"):
        s.search(T(w), 1)
    assert len(s.cache._kept) == 2


def test_analysers_by_field(spark):
    docs = spark.createDataFrame([(1, "The-End x", "The-End x")], "doc_id bigint, a string, b string")
    e = I.build(docs, {"a": standard_analyser(), "b": whitespace_analyser})
    assert ids(e, Q.Term("a", "end")) == [1] and ids(e, Q.Term("b", "The-End")) == [1] and ids(e, Q.Term("b", "end")) == []


def test_plan_prunes(ix):
    plan = ix.of_field("body", F.col("term") == "fox").select("doc_id")._jdf.queryExecution().toString()
    assert "EqualTo(term,fox)" in plan and "ReadSchema: struct<term:string,doc_id:bigint>" in plan


def test_postings_in_pieces(monkeypatch):
    """A batch's postings come in pieces of bounded size, the same as at once."""
    import pyarrow as pa

    toks = [["a", "b", "a"], None, [], ["c"] * 50, ["b"], ["a", "c"] * 3]
    batch = pa.record_batch([pa.array(range(len(toks)), pa.int64()), pa.array(["f"] * len(toks)), pa.array(toks, pa.list_(pa.string()))], ["doc_id", "field", "toks"])
    rows = lambda made: sorted(str(r) for b in made for r in b.to_pylist())
    whole = rows(I._posting_lists(iter([batch])))
    monkeypatch.setattr(I, "PIECE", 7)
    made = list(I._posting_lists(iter([batch])))
    assert rows(made) == whole and len(whole) == 6
    assert len(made) > 1 and all(len(b) == 1 or sum(r["tf"] for r in b.to_pylist()) <= 7 for b in made)


def test_arrow_batches_are_bounded_by_bytes(spark):
    """Long rows come to Python few at a time; all of them come."""
    def sizes(batches):
        import pyarrow as pa

        for b in batches:
            yield pa.record_batch([pa.array([b.num_rows])], ["n"])

    long = spark.range(0, 400, 1, 1).select(F.repeat(F.lit("words "), 10000).alias("s"))
    got = [r.n for r in long.mapInArrow(sizes, "n bigint").collect()]
    assert sum(got) == 400 and max(got) < 120
