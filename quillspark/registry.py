"""Registered queries: each operator over whole tables, with DuckDB SQL that gives the same rows.

Indexes are built once for each session and folder, and shared by the queries.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import analysis as A
from .functions.offsets import spans
from .functions.similarity import tf_idf
from .functions.stem import stem_sql
from .functions.stopwords import STOP_WORDS
from .operators import batch as B
from .operators import highlight as H
from .operators import index as I
from .operators import rank as R
from .operators import suggest as S
from .plans import query as Q
from .plans.compile import compile, top
from .plans.parse import parse
from .session import spread

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
_open: dict[tuple[str, str, str], I.Index] = {}


def register(name: str, query: Query, sql: str | None = None) -> None:
    QUERIES[name] = query
    if sql is not None:
        SQL[name] = sql


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _docs(spark: SparkSession, sf_dir: str, kind: str) -> tuple[DataFrame, tuple[str, ...], tuple[str, ...]]:
    """The documents of an index, and its text and exact fields."""
    if kind == "documents":
        return table(spark, sf_dir, "documents"), ("text",), ("lang", "source")
    if kind == "conversations":
        c = table(spark, sf_dir, "conversations")
        return c.select((F.col("conv_id") * 100 + F.col("turn")).alias("doc_id"), "text", "role", F.col("conv_id").alias("block_id"), (F.col("turn") == 0).alias("is_parent")), ("text",), ("role",)
    if kind == "part":
        p = table(spark, sf_dir, "part")
        return p.select(F.col("p_partkey").alias("doc_id"), "p_name", "p_brand", "p_type", "p_size", "p_retailprice"), ("p_name",), ("p_brand",)
    if kind == "embeddings":
        return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding", "label"), (), ("label",)
    if kind == "customer":
        c = table(spark, sf_dir, "customer")
        return c.select(F.col("c_custkey").alias("doc_id"), (F.pmod(F.col("c_custkey") * 37, F.lit(1800)) / 10.0 - 90).alias("home_lat"), (F.pmod(F.col("c_custkey") * 91, F.lit(3600)) / 10.0 - 180).alias("home_lon")), (), ("c_mktsegment",)
    raise ValueError(kind)


def index(spark: SparkSession, sf_dir: str, kind: str = "documents") -> I.Index:
    """The index of a table, built at its first use in a session."""
    key = (spark.sparkContext.applicationId, sf_dir, kind)
    if key not in _open:
        docs, text, exact = _docs(spark, sf_dir, kind)
        if kind == "customer":  # no terms: the documents are all there is
            _open[key] = I.Index(docs, None, None, docs.count(), {})
        else:
            _open[key] = I.build(docs, text, exact)
    return _open[key]


def _hits(df: DataFrame) -> DataFrame:
    return df.select("doc_id", F.round("score", 6).alias("score"))


# --- SQL of the index

_STOP = ", ".join(f"'{w}'" for w in sorted(STOP_WORDS["en"]))
_WORDS = r"[\p{L}\p{Nd}]+"


def _tokens(text: str = "text") -> str:
    return f"list_filter(regexp_extract_all(lower({text}), '{_WORDS}'), lambda x: x not in ({_STOP}))"


def _with(table_: str = "documents", doc: str = "doc_id", text: str = "text") -> str:
    return f"""with t as (select {doc} as doc_id, {_tokens(text)} as toks from {table_}),
pos as (select doc_id, len(toks) as dl, unnest(toks) as term, unnest(range(len(toks))) as p from t),
post as (select term, doc_id, count(*)::double as tf, any_value(dl)::double as dl from pos group by term, doc_id),
terms as (select term, count(*)::double as df, sum(tf) as cf from post group by term),
n as (select count(*)::double as n, avg(coalesce(len(toks), 0))::double as a from t),
bm as (select post.*, df, ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / a)) as s from post join terms using (term), n)
"""


_IDX = _with()


#: A term with a byte for each character, as DuckDB's distance counts bytes.
_ASCII = "translate(term, 'ßäçèéêíñóöüáàâîôûëïúìòù', 'ABCDEFGHIJKLMNOPQRSTUVW')"


def search(name: str, query: Q.Query, sql: str, kind: str = "documents") -> None:
    """Registers a query with all its hits; sql gives (doc_id, score) after the index's tables."""
    register(name, lambda spark, d: _hits(compile(query, index(spark, d, kind))), f"{_IDX}select doc_id::bigint as doc_id, round(score, 6)::double as score from ({sql})")


def _sum(where: str, weight: str = "s") -> str:
    return f"select doc_id, sum({weight}) as score from bm where {where} group by doc_id"


T = lambda w, b=1.0: Q.Term("text", w, b)

search("q_term_bm25", T("der"), _sum("term = 'der'"))
search("q_term_boosted", T("thing", 2.5), _sum("term = 'thing'", "2.5 * s"))
search("q_bool_must_should_not", Q.Bool.of([T("thing")], [T("ering"), T("thtion")], [T("attion")]), "select doc_id, sum(case when term <> 'attion' then s end) as score from bm where term in ('thing', 'ering', 'thtion', 'attion') group by doc_id having bool_or(term = 'thing') and not bool_or(term = 'attion')")
search("q_bool_should", Q.Bool.of(should=[T("thing"), T("ering", 2.0)]), "select doc_id, sum(case when term = 'ering' then 2 * s else s end) as score from bm where term in ('thing', 'ering') group by doc_id")
search("q_bool_only_must_not", Q.Bool.of(must_not=[T("thing")]), "select doc_id, 0.0 as score from t where false")
search(
    "q_bool_nested",
    Q.Bool.of([Q.Bool.of(should=[T("thing"), T("ering")]), Q.Range("n_chars", 500, 4000)], [Q.Prefix("text", "thor")], [Q.Term("lang", "fr")]),
    "select x.doc_id, x.s + 1 + coalesce(y.s, 0) as score from (select doc_id, sum(s) as s from bm where term in ('thing', 'ering') group by doc_id) x join documents d on x.doc_id = d.doc_id and n_chars between 500 and 4000 and lang <> 'fr' left join (select doc_id, sum(s) as s from bm where term like 'thor%' group by doc_id) y on x.doc_id = y.doc_id",
)
_PAIR = "select distinct a.doc_id from pos a join pos b on a.doc_id = b.doc_id and a.term = '{0}' and b.term = '{1}' and {2}"
search("q_phrase", Q.Phrase("text", ("thanedble", "anea")), f"select doc_id, 1.0 as score from ({_PAIR.format('thanedble', 'anea', 'b.p = a.p + 1')})")
search("q_phrase_repeated", Q.Phrase("text", ("der", "der")), f"select doc_id, 1.0 as score from ({_PAIR.format('der', 'der', 'b.p = a.p + 1')})")
search("q_phrase_three", Q.Phrase("text", ("attion", "thanedble", "anea")), "select distinct a.doc_id, 1.0 as score from pos a join pos b on a.doc_id = b.doc_id and b.p = a.p + 1 join pos c on a.doc_id = c.doc_id and c.p = a.p + 2 where a.term = 'attion' and b.term = 'thanedble' and c.term = 'anea'")
search("q_phrase_slop", Q.Phrase("text", ("thing", "ering"), 4, 2.0), f"select doc_id, 2.0 as score from ({_PAIR.format('thing', 'ering', 'b.p between a.p - 3 and a.p + 5')})")
search("q_phrase_slop_three", Q.Phrase("text", ("der", "und", "die"), 3), "select distinct a.doc_id, 1.0 as score from pos a join pos b on a.doc_id = b.doc_id and b.p between a.p - 2 and a.p + 4 join pos c on a.doc_id = c.doc_id and c.p between b.p - 2 and b.p + 4 where a.term = 'der' and b.term = 'und' and c.term = 'die'")
search("q_prefix", Q.Prefix("text", "tho"), _sum("term like 'tho%'"))
search("q_wildcard", Q.Wildcard("text", "th*b?e"), _sum("term like 'th%b_e'"))
search("q_wildcard_trailing", Q.Wildcard("text", "ere*"), _sum("term like 'ere%'"))
search("q_fuzzy", Q.Fuzzy("text", "onble"), f"select doc_id, sum(s * (1 - d / 3.0)) as score from bm join (select term, levenshtein({_ASCII}, 'onble') as d from terms where levenshtein({_ASCII}, 'onble') <= 2 order by d, term limit 64) using (term) group by doc_id")
search("q_fuzzy_one_edit", Q.Fuzzy("text", "thing", 1, 10), f"select doc_id, sum(s * (1 - d / 2.0)) as score from bm join (select term, levenshtein({_ASCII}, 'thing') as d from terms where levenshtein({_ASCII}, 'thing') <= 1 order by d, term limit 10) using (term) group by doc_id")
search("q_regexp", Q.Regexp("text", "^tho.*on$"), _sum("regexp_matches(term, '^tho.*on$')"))
search("q_regexp_unanchored", Q.Regexp("text", "QU[AE]", True), _sum("regexp_matches(term, '(?i)QU[AE]')"))
search("q_term_range", Q.TermRange("text", "thor", "thos", True, False), _sum("term >= 'thor' and term < 'thos'"))
search("q_term_range_open", Q.TermRange("text", low="zu", include_low=False), _sum("term > 'zu'"))
search("q_exact_string", Q.Term("source", "src3"), "select doc_id, ln(1 + (n - df + 0.5) / (df + 0.5)) * 2.2 / 2.2 as score from documents, n, (select count(*)::double as df from documents where source = 'src3') where source = 'src3'")
search("q_range", Q.Range("n_chars", 1000, 2000), "select doc_id, 1.0 as score from documents where n_chars between 1000 and 2000")
search("q_constant", Q.ConstantScore(T("thing"), 3.0, 0.5), "select doc_id, 1.5 as score from post where term = 'thing'")
search("q_dismax", Q.DisMax((T("thing"), T("ering"), T("thtion")), 0.3), "select doc_id, max(s) + 0.3 * (sum(s) - max(s)) as score from bm where term in ('thing', 'ering', 'thtion') group by doc_id")
for _mode, _expr in {"multiply": "s * v", "replace": "v", "sum": "s + v", "max": "greatest(s, v)"}.items():
    search(f"q_function_score_{_mode}", Q.FunctionScore(T("thing"), "n_chars", _mode), f"select bm.doc_id, {_expr} as score from bm join (select doc_id, n_chars::double as v from documents) using (doc_id) where term = 'thing'")
_S = lambda w: Q.SpanTerm("text", w)
search("q_span_term", _S("thing"), "select doc_id, 1.0 as score from post where term = 'thing'")
search("q_span_near_ordered", Q.SpanNear((_S("thing"), _S("ering")), 8), f"select doc_id, 1.0 as score from ({_PAIR.format('thing', 'ering', 'b.p > a.p and b.p <= a.p + 9')})")
search("q_span_near_unordered", Q.SpanNear((_S("thing"), _S("ering")), 8, False), f"select doc_id, 1.0 as score from ({_PAIR.format('thing', 'ering', 'abs(b.p - a.p) <= 9')})")
search("q_span_or", Q.SpanOr((_S("thing"), _S("ering"))), "select distinct doc_id, 1.0 as score from post where term in ('thing', 'ering')")
search("q_span_not", Q.SpanNot(_S("thing"), _S("ering")), "select doc_id, 1.0 as score from post where term = 'thing' and doc_id not in (select doc_id from post where term = 'ering')")
search(
    "q_span_nested",
    Q.SpanNear((Q.SpanNear((_S("der"), _S("und")), 12, False), Q.SpanOr((_S("die"), _S("das")))), 20, False),
    "select distinct x.doc_id, 1.0 as score from (select doc_id, min(p) as p from pos where term in ('der', 'und') and doc_id in (select a.doc_id from pos a join pos b on a.doc_id = b.doc_id and a.term = 'der' and b.term = 'und' and abs(b.p - a.p) <= 13) group by doc_id) x join pos y on x.doc_id = y.doc_id and y.term in ('die', 'das') and abs(y.p - x.p) <= 21",
)
_MLT = "mlt as (select post.term, tf * ln(n / (df + 1)) as w from post join terms using (term), n where doc_id = {0} and length(post.term) >= 3 order by round(w, 9) desc, term limit 25), seed as (select term, case when max(w) over () > 0 then w / max(w) over () else 1 end as b from mlt)"
register("q_more_like_this", lambda spark, d: _hits(compile(Q.MoreLikeThis(6, ("text",)), index(spark, d))), f"{_IDX}, {_MLT.format(6)} select doc_id::bigint as doc_id, round(sum(s * b), 6)::double as score from bm join seed using (term) group by doc_id")
register("q_more_like_this_others", lambda spark, d: _hits(top(compile(Q.MoreLikeThis(17, ("text",), exclude_source=True, boost_by_score=False), index(spark, d)), 10)), f"{_IDX}, {_MLT.format(17)} select doc_id::bigint as doc_id, round(sum(s), 6)::double as score from bm join seed using (term) where doc_id <> 17 group by doc_id order by score desc, doc_id limit 10")
_TOP = "(select doc_id, row_number() over (order by round(sum(s), 6) desc, doc_id) as r from bm where {0} group by doc_id qualify r <= 20)"
search("q_rrf", Q.Rrf((T("thing"), T("ering"), Q.Prefix("text", "tho")), 60, 20), f"select doc_id, sum(1.0::double / (60 + r)) as score from ({' union all '.join(f'select * from {_TOP.format(w)}' for w in ('term = ' + repr('thing'), 'term = ' + repr('ering'), 'term like ' + repr('tho%')))}) group by doc_id")
register("q_term_tfidf", lambda spark, d: _hits(compile(T("der"), index(spark, d).with_similarity(tf_idf))), f"{_IDX}select doc_id::bigint as doc_id, round(sqrt(tf) * (1 + ln(n / (df + 1))) / sqrt(dl), 6)::double as score from bm, n where term = 'der'")
_PARSED = '+th* thing ering~1 -attion "die der"~2^3 (tho* source:src3)'
register(
    "q_query_string",
    lambda spark, d: _hits(compile(parse(_PARSED, "text", lambda s: index(spark, d).analysers["text"].words(spark, s)), index(spark, d))),
    f"""{_IDX}, a as (select doc_id, sum(s) + coalesce(sum(s) filter (where term = 'thing'), 0) as s from bm where term like 'th%' group by doc_id),
b as (select doc_id, sum(s * (1 - d / 2.0)) as s from bm join (select term, levenshtein({_ASCII}, 'ering') as d from terms where levenshtein({_ASCII}, 'ering') <= 1 order by d, term limit 64) using (term) group by doc_id),
c as ({_PAIR.format('die', 'der', 'b.p between a.p - 1 and a.p + 3')}),
e as (select doc_id, sum(s) as s from bm where term like 'tho%' group by doc_id),
f as (select doc_id, ln(1 + (n - df + 0.5) / (df + 0.5)) as s from documents, n, (select count(*)::double as df from documents where source = 'src3') where source = 'src3')
select a.doc_id::bigint as doc_id, round(a.s + coalesce(b.s, 0) + case when c.doc_id is not null then 3 else 0 end + coalesce(e.s, 0) + coalesce(f.s, 0), 6)::double as score
from a left join b using (doc_id) left join c using (doc_id) left join e using (doc_id) left join f using (doc_id) where doc_id not in (select doc_id from post where term = 'attion')""",
)



def _batch(spark: SparkSession, d: str, n: int | None) -> DataFrame:
    ix = index(spark, d)
    queries = B.query_terms(ix, "text", table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text"))
    return B.search_terms(ix, "text", queries, n).withColumn("score", F.round("score", 6))


_BATCH = f"{_IDX}, q as (select item_id as query_id, term, count(*) as boost from (select item_id, unnest({_tokens()}) as term from benchmark) group by all), x as (select query_id, doc_id, sum(boost * s) as score from bm join q using (term) group by all)"
register("q_batch_top", lambda spark, d: _batch(spark, d, 10), f"{_BATCH} select query_id, doc_id, round(score, 6)::double as score, row_number() over (partition by query_id order by round(score, 6) desc, doc_id)::int as rank from x qualify rank <= 10")
register("q_batch_all", lambda spark, d: _batch(spark, d, None), f"{_BATCH} select query_id, doc_id, round(score, 6)::double as score from x")

# --- vectors, places, blocks


def _vector(spark: SparkSession, d: str, vec: int, **options) -> Q.Vector:
    v = table(spark, d, "embeddings").where(F.col("vec_id") == vec).select("embedding").first()[0]
    return Q.Vector("embedding", tuple(v), **options)


_COS = "round(list_cosine_similarity(e.embedding::double[], q.embedding::double[]), 6)::double as score from embeddings e, (select embedding from embeddings where vec_id = {0}) q"
register("q_knn", lambda spark, d: _hits(compile(_vector(spark, d, 7, top_k=10), index(spark, d, "embeddings"))), f"select vec_id::bigint as doc_id, {_COS.format(7)} order by score desc, doc_id limit 10")
register("q_knn_filtered", lambda spark, d: _hits(compile(_vector(spark, d, 7, top_k=20, filter=Q.Term("label", "3")), index(spark, d, "embeddings"))), f"select vec_id::bigint as doc_id, {_COS.format(7)} where label = 3 order by score desc, doc_id limit 20")
register("x_explain_vector", lambda spark, d: H.explain_vector(index(spark, d, "embeddings"), _vector(spark, d, 7)).select("doc_id", F.round("cosine", 6).alias("cosine"), "strategy"), f"select vec_id::bigint as doc_id, {_COS.format(7).replace('as score', 'as cosine')}".replace("as cosine from", "as cosine, 'exact scan' as strategy from"))
_GEO = "(select c_custkey as doc_id, (c_custkey * 37 % 1800) / 10.0::double - 90 as lat, (c_custkey * 91 % 3600) / 10.0::double - 180 as lon from customer)"
register("q_geo_box", lambda spark, d: _hits(compile(Q.GeoBox("home", -10.0, 45.0, -30.0, 60.0), index(spark, d, "customer"))), f"select doc_id::bigint as doc_id, 1.0::double as score from {_GEO} where lat between -10 and 45 and lon between -30 and 60")
register(
    "q_geo_distance",
    lambda spark, d: _hits(compile(Q.GeoDistance("home", 51.5, -0.12, 3_000_000.0), index(spark, d, "customer"))),
    f"""select doc_id::bigint as doc_id, 1.0::double as score from (select *, pow(sin(radians(lat - 51.5) / 2), 2) + cos(radians(51.5)) * cos(radians(lat)) * pow(sin(radians(lon + 0.12) / 2), 2) as h from {_GEO}) where 2 * 6371000.0 * atan2(sqrt(h), sqrt(1 - h)) <= 3000000""",
)
register("q_block_join", lambda spark, d: _hits(compile(Q.BlockJoin(T("thing")), index(spark, d, "conversations"))), f"select distinct conv_id * 100 as doc_id, 1.0::double as score from conversations where turn > 0 and list_contains({_tokens()}, 'thing') and conv_id in (select conv_id from conversations where turn = 0)")

# --- ranking

_DER = f"{_IDX}, h as (select doc_id, s as score from bm where term = 'der')"
_DER_ = lambda spark, d: compile(T("der"), index(spark, d))
_documents = lambda spark, d: table(spark, d, "documents")
register("r_top", lambda spark, d: R.stored(_hits(top(_DER_(spark, d), 25)), _documents(spark, d), "lang", "n_chars"), f"{_DER} select h.doc_id, round(score, 6)::double as score, lang, n_chars from h join documents using (doc_id) order by 2 desc, 1 limit 25")
register("r_sort_number", lambda spark, d: _hits(R.sort_by(_DER_(spark, d), _documents(spark, d), "n_chars", 20, True)), f"{_DER} select h.doc_id, round(score, 6)::double as score from h join documents using (doc_id) order by n_chars desc, doc_id limit 20")
register("r_sort_string", lambda spark, d: _hits(R.sort_by(_DER_(spark, d), _documents(spark, d), "source", 20)), f"{_DER} select h.doc_id, round(score, 6)::double as score from h join documents using (doc_id) order by source, doc_id limit 20")
register("r_sort_score", lambda spark, d: _hits(R.sort_by(_DER_(spark, d), _documents(spark, d), "score", 20)), f"{_DER} select doc_id, round(score, 6)::double as score from h order by round(score, 6), doc_id limit 20")
register("r_sort_doc_id", lambda spark, d: _hits(R.sort_by(_DER_(spark, d), _documents(spark, d), "doc_id", 20, True)), f"{_DER} select doc_id, round(score, 6)::double as score from h order by doc_id desc limit 20")
register("r_facets", lambda spark, d: R.facets(_DER_(spark, d), _documents(spark, d), "lang", "source"), f"{_DER}, x as (select unnest([{{'field': 'lang', 'value': lang}}, {{'field': 'source', 'value': source}}]) as v from h join documents using (doc_id)) select v.field as field, v.value as value, count(*) as count from x group by all")
_parts = lambda spark, d: compile(Q.Prefix("p_name", "b"), index(spark, d, "part"))
_part = lambda spark, d: index(spark, d, "part").docs
_PARTS = "with h as (select * from part where len(list_filter(regexp_extract_all(lower(p_name), '[\\p{L}\\p{Nd}]+'), lambda x: x like 'b%')) > 0)"
register("r_facets_multi", lambda spark, d: R.facets(_parts(spark, d), _part(spark, d).withColumn("word", F.split("p_name", " ")), "word", "p_brand"), f"{_PARTS}, x as (select 'word' as field, unnest(list_distinct(string_split(p_name, ' '))) as value from h union all select 'p_brand', p_brand from h) select field, value, count(*) as count from x group by all")
register("r_stats", lambda spark, d: R.stats(_parts(spark, d), _part(spark, d), "p_retailprice", "p_size").select("field", "count", "min", "max", F.round("sum", 4).alias("sum"), F.round("avg", 6).alias("avg")), f"{_PARTS} select 'p_retailprice' as field, count(*) as count, min(p_retailprice) as min, max(p_retailprice) as max, round(sum(p_retailprice), 4) as sum, round(avg(p_retailprice), 6) as avg from h union all select 'p_size', count(*), min(p_size)::double, max(p_size)::double, round(sum(p_size)::double, 4), round(avg(p_size)::double, 6) from h")
_orders = lambda spark, d: table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("doc_id")).agg(F.collect_list("l_quantity").alias("q"))
register("r_stats_multi", lambda spark, d: R.stats(_orders(spark, d).select("doc_id"), _orders(spark, d), "q"), "select 'q' as field, count(*) as count, min(l_quantity) as min, max(l_quantity) as max, sum(l_quantity) as sum, avg(l_quantity) as avg from lineitem")
register("r_histogram", lambda spark, d: R.histogram(_DER_(spark, d), _documents(spark, d), "n_chars", 250.0), f"{_DER}, v as (select n_chars::double as v from h join documents using (doc_id)), e as (select floor(min(v) / 250)::bigint as lo, greatest(1, ceil((max(v) - floor(min(v) / 250) * 250) / 250)::bigint + 1) as k from v), b as (select lo + unnest(range(k)) as b from e) select (b.b * 250)::double as low, ((b.b + 1) * 250)::double as high, count(v.v) as count from b left join v on floor(v.v / 250)::bigint = b.b group by b.b")
register("r_collapse", lambda spark, d: R.collapse(_DER_(spark, d), _documents(spark, d), "source").select("doc_id", F.round("score", 6).alias("score"), "key", "group_size"), f"{_DER} select h.doc_id, round(score, 6)::double as score, source as key, count(*) over (partition by source) as group_size from h join documents using (doc_id) qualify row_number() over (partition by source order by round(score, 6) desc, doc_id) = 1")
register("r_collapse_worst", lambda spark, d: R.collapse(_DER_(spark, d), _documents(spark, d), "lang", False).select("doc_id", F.round("score", 6).alias("score"), "key", "group_size"), f"{_DER} select h.doc_id, round(score, 6)::double as score, lang as key, count(*) over (partition by lang) as group_size from h join documents using (doc_id) qualify row_number() over (partition by lang order by round(score, 6), doc_id) = 1")


def _several(spark: SparkSession, d: str) -> DataFrame:
    made = R.aggregate(_DER_(spark, d), _documents(spark, d), {"length": ("n_chars", None), "spread": ("n_chars", 1000.0)})
    return made["length"].select(F.lit("length").alias("name"), F.col("min").alias("low"), F.col("max").alias("high"), "count").union(made["spread"].select(F.lit("spread"), "low", "high", "count"))


register("r_aggregations", _several, f"{_DER}, v as (select n_chars::double as v from h join documents using (doc_id)), e as (select floor(min(v) / 1000)::bigint as lo, greatest(1, ceil((max(v) - floor(min(v) / 1000) * 1000) / 1000)::bigint + 1) as k from v), b as (select lo + unnest(range(k)) as b from e) select 'length' as name, min(v) as low, max(v) as high, count(*) as count from v union all select 'spread', (b.b * 1000)::double, ((b.b + 1) * 1000)::double, count(v.v) from b left join v on floor(v.v / 1000)::bigint = b.b group by b.b")
register("x_explain", lambda spark, d: H.explain(index(spark, d), T("der", 2.0)).select("doc_id", *(F.round(c, 6).alias(c) for c in ("score", "idf")), F.col("tf").cast("bigint").alias("tf"), F.col("dl").cast("bigint").alias("dl"), F.round("avgdl", 6).alias("avgdl"), "boost"), f"{_IDX}select doc_id, round(2 * s, 6)::double as score, round(ln(1 + (n - df + 0.5) / (df + 0.5)), 6)::double as idf, tf::bigint as tf, dl::bigint as dl, round(a, 6)::double as avgdl, 2.0::double as boost from bm, n where term = 'der'")
register("x_count", lambda spark, d: _DER_(spark, d).agg(F.count("*").alias("n")), f"{_DER} select count(*) as n from h")
_SNIPPETS = f"""with x as (select doc_id, regexp_extract_all(text, '{_WORDS}') as toks, string_split_regex(text, '{_WORDS}') as seps from documents where text ilike '%thing%'),
y as (select doc_id, unnest(range(len(toks))) as k, unnest(toks) as tok, unnest(seps[1:len(toks)]) as sep from x),
h as (select doc_id, e - n as s, e from (select doc_id, lower(tok) as term, sum(length(tok) + length(sep)) over (partition by doc_id order by k) as e, length(tok) as n from y) where term = 'thing'),
w as (select doc_id, text, s, greatest(0, s - 50)::bigint as lo, least(length(text), greatest(0, s - 50) + 200)::bigint as hi from h join documents using (doc_id)),
c as (select w.doc_id, any_value(text) as text, w.s, lo, hi, count(*) as n from w join h on w.doc_id = h.doc_id and h.s >= lo and h.e <= hi group by w.doc_id, w.s, lo, hi qualify row_number() over (partition by w.doc_id order by count(*) desc, w.s) = 1),
p as (select doc_id, lo, hi < length(text) as cut, substring(text, lo + 1, hi - lo) as part from c),
m as (select *, regexp_extract_all(part, '{_WORDS}') as toks, string_split_regex(part, '{_WORDS}') as seps from p)
select doc_id, (case when lo > 0 then '...' else '' end) || array_to_string(list_transform(toks, lambda t, i: seps[i] || case when lower(t) = 'thing' then '<b>' || t || '</b>' else t end), '') || seps[len(seps)] || (case when cut then '...' else '' end) as snippet from m"""
register("x_highlight", lambda spark, d: H.highlight(R.stored(compile(T("thing"), index(spark, d)), _documents(spark, d), "text"), "text", A.standard_analyser(), Q.terms_of(T("thing"))).select("doc_id", "snippet"), _SNIPPETS)
register(
    "x_offsets",
    lambda spark, d: spans(table(spark, d, "documents"), "doc_id", "text", A.standard_analyser()).groupBy("doc_id").agg(F.count("*").alias("n"), F.sum("start").alias("starts"), F.sum("end").alias("ends"), F.md5(F.array_join(F.sort_array(F.collect_list(F.concat_ws("-", F.lpad(F.col("start").cast("string"), 8, "0"), "term"))), "|")).alias("digest")),
    f"""with x as (select doc_id, regexp_extract_all(text, '{_WORDS}') as toks, string_split_regex(text, '{_WORDS}') as seps from documents),
y as (select doc_id, unnest(range(len(toks))) as k, unnest(toks) as tok, unnest(seps[1:len(toks)]) as sep from x),
z as (select doc_id, k, lower(tok) as term, sum(length(tok) + length(sep)) over (partition by doc_id order by k) as e, length(tok) as n from y),
w as (select doc_id, term, e - n as s, e from z where term not in ({_STOP}))
select doc_id, count(*) as n, sum(s)::bigint as starts, sum(e)::bigint as ends, md5(string_agg(lpad(s::bigint::varchar, 8, '0') || '-' || term, '|' order by lpad(s::bigint::varchar, 8, '0') || '-' || term)) as digest from w group by doc_id""",
)
_TRI = "list_distinct(list_transform(range(1, length('onble') - 1), lambda i: substring('onble', i, 3)))"
register(
    "s_did_you_mean",
    lambda spark, d: S.did_you_mean(index(spark, d), "text", "onble", 2, 10),
    f"{_IDX}select term, levenshtein({_ASCII}, 'onble')::int as distance, df::bigint as df, df / (1.0::double + levenshtein({_ASCII}, 'onble')) as score from terms where term <> 'onble' and abs(length(term) - 5) <= 2 and levenshtein({_ASCII}, 'onble') <= 2 and len(list_filter(range(1, length(term) - 1), lambda i: list_contains({_TRI}, substring(term, i, 3)))) >= 1 order by score desc, term limit 10",
)
_GRAMS = "list_transform(range(1, length({0}) - 1), lambda i: substring({0}, i, 3))"
register(
    "s_did_you_mean_batch",
    lambda spark, d: S.did_you_mean_all(index(spark, d), "text", table(spark, d, "benchmark").select(F.explode(A.standard_analyser()(F.col("text"))).alias("word")), 2, 5),
    f"""{_IDX}, w as (select distinct unnest({_tokens()}) as word from benchmark), wg as (select word, unnest(list_distinct({_GRAMS.format('word')})) as g from w where length(word) >= 3),
k as (select word, count(*) as kinds from wg group by word), tg as (select term, df, unnest({_GRAMS.format('term')}) as g from terms where length(term) >= 3),
m as (select word, term, any_value(df) as df, count(*) as c from wg join tg using (g) where abs(length(word) - length(term)) <= 2 and word <> term group by word, term),
l as (select m.*, kinds, levenshtein({_ASCII}, {_ASCII.replace('term', 'word')}) as d from m join k using (word) where c >= greatest(1, kinds - 6))
select word, term, d::int as distance, df::bigint as df, df / (1.0::double + d) as score from l where d <= 2 qualify row_number() over (partition by word order by df / (1.0::double + d) desc, term) <= 5""",
)
register("s_complete", lambda spark, d: S.complete(index(spark, d), "text", "tho", 15), f"{_IDX}select term, df::bigint as df from terms where term like 'tho%' order by df desc, term limit 15")
register("i_postings", lambda spark, d: index(spark, d).of_field("text").groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"), F.sum(F.aggregate("positions", F.lit(0).cast("bigint"), lambda a, x: a + x)).alias("places")), f"{_IDX}select term, count(distinct doc_id) as df, count(*) as cf, sum(p)::bigint as places from pos group by term")
register("i_stats", lambda spark, d: index(spark, d).stats.select("field", "n_docs", F.round("avgdl", 6).alias("avgdl")), f"{_IDX}select 'text' as field, n::bigint as n_docs, round(a, 6)::double as avgdl from n")

# --- analysis


def _digest(toks: Column) -> list[Column]:
    return [F.size(toks).alias("n_tokens"), F.md5(F.array_join(toks, "|")).alias("digest")]


def analysis(name: str, analyser: A.Analyser, sql: str | None, of: str = "documents", key: str = "doc_id", text: str = "text") -> None:
    """Registers an analysis of a whole column: the number of tokens and a digest of them all."""
    register(name, lambda spark, d: spread(table(spark, d, of), key).select(key, analyser(F.col(text)).alias("toks")).select(key, *_digest(F.col("toks"))), None if sql is None else f"select {key}, len(toks)::int as n_tokens, md5(array_to_string(toks, '|')) as digest from (select {key}, {sql} as toks from {of})")


_RAW, _LOW = f"regexp_extract_all(text, '{_WORDS}')", f"list_transform(regexp_extract_all(text, '{_WORDS}'), lambda x: lower(x))"
_SPACED = r"regexp_extract_all(text, '[^\s\p{Z}\x{85}\x{0B}\x{1C}-\x{1F}]+')"
analysis("a_standard_tokeniser", A.Analyser(A.standard), _RAW)
analysis("a_whitespace_tokeniser", A.Analyser(A.whitespace), _SPACED)
analysis("a_letter_tokeniser", A.Analyser(A.letters), r"regexp_extract_all(text, '\p{L}+')")
analysis("a_keyword_tokeniser", A.Analyser(A.keyword), "case when text = '' then [] else [text] end")
analysis("a_ngram_tokeniser", A.Analyser(A.ngrams(2, 3)), "flatten(list_transform(range(1, length(text)), lambda i: list_transform(range(2, least(3, length(text) - i + 1) + 1), lambda k: array_to_string(string_split(p_type, '')[i:i + k - 1], ''))))".replace("text", "p_type"), "part", "p_partkey", "p_type")
analysis("a_edge_ngram_tokeniser", A.Analyser(A.edge_ngrams(2, 4)), r"flatten(list_transform(list_filter(string_split_regex(text, '[ \t\r\n]+'), lambda t: length(t) >= 2), lambda t: list_transform(range(2, least(4, length(t)) + 1), lambda k: substring(t, 1, k))))")
_CJK_WORDS = f"regexp_extract_all(regexp_replace(text, '([{A._CJK}]+)', ' \\1 ', 'g'), '{_WORDS}')"
_CJK = f"flatten(list_transform({_CJK_WORDS}, lambda t: case when regexp_full_match(t, '[{A._CJK}]{{2,}}') then list_transform(range(1, length(t)), lambda i: substring(t, i, 2)) else [t] end))"
analysis("a_cjk_bigram_tokeniser", A.Analyser(A.cjk_bigrams), _CJK)
analysis("a_lowercase", A.Analyser(A.standard, (A.lowercase,)), _LOW)
analysis("a_stop", A.standard_analyser(), f"list_filter({_LOW}, lambda x: x not in ({_STOP}))")
analysis("a_stop_extended", A.standard_analyser(STOP_WORDS["en_extended"]), f"list_filter({_LOW}, lambda x: x not in ({', '.join(repr(w) for w in sorted(STOP_WORDS['en_extended']))}))")
analysis("a_length", A.Analyser(A.standard, (A.length_between(3, 6),)), f"list_filter({_RAW}, lambda x: length(x) between 3 and 6)")
analysis("a_truncate", A.Analyser(A.standard, (A.truncate(4),)), f"list_transform({_RAW}, lambda x: substring(x, 1, 4))")
analysis("a_unique", A.Analyser(A.standard, (A.lowercase, A.unique)), f"list_filter({_LOW}, lambda x, i: list_position({_LOW}, x) = i)".replace(_LOW, "toks_").join(["(select ", f" from (select {_LOW} as toks_))"]))
analysis("a_elision", A.Analyser(A.whitespace, (A.elision(),)), f"list_transform({_SPACED}, lambda x: regexp_replace(x, '(?i)^(?:jusqu|lorsqu|puisqu|quoiqu|qu|c|d|j|l|m|n|s|t)[''’](.)', '\\1'))")
analysis("a_reverse", A.Analyser(A.standard, (A.reverse,)), f"list_transform({_RAW}, lambda x: reverse(x))")
analysis("a_decimal_digits", A.Analyser(A.standard, (A.decimal_digits,)), f"list_transform({_RAW}, lambda x: translate(x, '٠١٢٣٤٥٦٧٨٩', '0123456789'))")
analysis("a_shingles", A.Analyser(A.standard, (A.shingles(2, 3),)), "list_concat(ws, flatten(list_transform(range(1, greatest(len(ws), 1)), lambda i: list_transform(range(2, least(3, len(ws) - i + 1) + 1), lambda k: array_to_string(ws[i:i + k - 1], ' ')))))", "documents")
SQL["a_shingles"] = SQL["a_shingles"].replace("from documents", f"from (select doc_id, {_RAW} as ws from documents)")
_CUT = "regexp_replace(t, '[^\\p{L}\\p{Nd}]+', chr(1), 'g')"
for _a, _b in (("(\\p{Nd})", "(\\p{L})"), ("(\\p{L})", "(\\p{Nd})"), ("(\\p{Ll})", "(\\p{Lu})"), ("(\\p{Lu})", "(\\p{Lu}\\p{Ll})")):
    _CUT = f"regexp_replace({_CUT}, '{_a}{_b}', '\\1' || chr(1) || '\\2', 'g')"
_DELIMITED = f"flatten(list_transform(list_transform({_SPACED}, lambda t: {{'t': t, 'p': list_filter(string_split({_CUT}, chr(1)), lambda x: x <> '')}}), lambda s: list_concat([s.t], s.p, case when len(list_filter(s.p, lambda x: not regexp_matches(x, '^\\p{{Nd}}'))) > 1 then [array_to_string(list_filter(s.p, lambda x: not regexp_matches(x, '^\\p{{Nd}}')), '')] else [] end, case when len(list_filter(s.p, lambda x: regexp_matches(x, '^\\p{{Nd}}'))) > 1 then [array_to_string(list_filter(s.p, lambda x: regexp_matches(x, '^\\p{{Nd}}')), '')] else [] end)))"
analysis("a_word_delimiter", A.Analyser(A.whitespace, (A.word_delimiter(preserve=True, join_words=True, join_numbers=True),)), _DELIMITED)
analysis("a_synonyms", A.standard_analyser().then(A.synonym_graph({"thing": ["object"], "thing ing": ["pair"]})), "flatten(list_transform(toks, lambda x, i: case when x = 'ing' and i > 1 and toks[i - 1] = 'thing' then [x, 'pair'] when x = 'thing' and not (i < len(toks) and toks[i + 1] = 'ing') then [x, 'object'] else [x] end))")
SQL["a_synonyms"] = SQL["a_synonyms"].replace("from documents", f"from (select doc_id, {_tokens()} as toks from documents)")
analysis("a_keyword_marker", A.Analyser(A.standard, (A.lowercase, A.keyword_marker(lambda t: A.stem(t, "fr"), ["elle", "mentre"]))), f"list_transform({_LOW}, lambda x: case when x in ('elle', 'mentre') then x else {stem_sql('x', 'fr')} end)")
analysis("a_accent_folding", A.Analyser(A.standard, (A.lowercase, A.accent_folding)), f"list_transform({_LOW}, lambda x: strip_accents(x))")
analysis("a_html_strip", A.Analyser(A.whitespace, char_filters=(A.html_strip,)), r"regexp_extract_all(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '&\w+;', ' ', 'g'), '[^\s\p{Z}\x{85}\x{0B}\x{1C}-\x{1F}]+')", "pages", "page_id", "html")
analysis("a_mapping", A.Analyser(A.standard, char_filters=(A.mapping({"th": "z", "ß": "ss"}),)), f"regexp_extract_all(replace(replace(text, 'th', 'z'), 'ß', 'ss'), '{_WORDS}')")
analysis("a_pattern_replace", A.Analyser(A.standard, char_filters=(A.pattern_replace("([aeiou])n", "$1-"),)), f"regexp_extract_all(regexp_replace(text, '([aeiou])n', '\\1-', 'g'), '{_WORDS}')")
analysis("a_budget", A.Analyser(A.standard, (A.budget(100),)), f"({_RAW})[1:100]")
analysis("a_stemmed_analyser", A.stemmed_analyser(), None)
analysis("a_simple_analyser", A.simple_analyser, r"list_transform(regexp_extract_all(text, '\p{L}+'), lambda x: lower(x))")
for _code in ("fr", "de", "es", "it", "pt", "nl", "ru", "ar"):
    _own = ", ".join("'" + w.replace("'", "''") + "'" for w in sorted(STOP_WORDS[_code]))
    analysis(f"a_language_{_code}", A.language_analyser(_code), f"list_transform(list_filter({_LOW}, lambda x: x not in ({_own})), lambda x: {stem_sql('x', _code)})")
analysis("a_language_en", A.language_analyser("en"), None)
for _code in ("zh", "ja", "ko"):
    _own = ", ".join("'" + w.replace("'", "''") + "'" for w in sorted(STOP_WORDS[_code])) or "''"
    analysis(f"a_language_{_code}", A.language_analyser(_code), f"list_filter(list_transform({_CJK}, lambda x: lower(x)), lambda x: x not in ({_own}))")
register("a_by_language", lambda spark, d: table(spark, d, "documents").select("doc_id", A.by_language(F.col("text"), F.col("lang")).alias("toks")).select("doc_id", *_digest(F.col("toks"))))
