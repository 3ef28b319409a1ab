"""Registered queries of sources, the store and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import analysis as A
from .functions import bitmaps
from .functions.geo import decode, encode, haversine
from .functions.vectors import normalise, squared_norm
from .operators import rank as R
from .plans import query as Q
from .plans.compile import compile
from .registry import register, table
from .session import shared_folder
from .sources import json_fields
from .sources.schema import Field, Schema
from .sources.store import Store, sealed
from .streaming.ingest import Manager, ingest, read_documents, running_terms, windowed_facets

_PART = "p_partkey::bigint as doc_id, p_name, p_brand, p_size, p_retailprice"


def _parts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select(F.col("p_partkey").alias("doc_id"), "p_name", "p_brand", "p_size", "p_retailprice")


def _store(spark: SparkSession, **options) -> Store:
    return Store(spark, shared_folder(spark), {"p_name": A.standard_analyser()}, ("p_brand",), **options)


def _two(spark: SparkSession, d: str, **options) -> tuple[Store, DataFrame]:
    """A store with the parts up to size 25, and the others."""
    s, p = _store(spark, **options), _parts(spark, d)
    s.add(p.where("p_size <= 25"))
    return s, p.where("p_size > 25")


def _hits(s: Store, word: str, version: int | None = None) -> DataFrame:
    return compile(Q.Term("p_name", word), s.index(version)).select("doc_id", F.round("score", 6).alias("score"))


_BLUE = "list_contains(string_split(p_name, ' '), 'blue')"


def _scores(where: str) -> str:
    """DuckDB SQL of the scores of 'blue' over the parts that a condition leaves."""
    return f"""with t as (select p_partkey::bigint as doc_id, list_filter(regexp_extract_all(lower(p_name), '[\\p{{L}}\\p{{Nd}}]+'), lambda x: x <> 'the') as toks from part where {where}),
n as (select count(*)::double as n, avg(len(toks))::double as a, count(*) filter (where list_contains(toks, 'blue'))::double as df from t),
h as (select doc_id, len(toks)::double as dl, len(list_filter(toks, lambda x: x = 'blue'))::double as tf from t where list_contains(toks, 'blue'))
select doc_id, round(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / a)), 6)::double as score from h, n"""


def _add(spark: SparkSession, d: str) -> DataFrame:
    s, more = _two(spark, d)
    s.add(more)
    return _hits(s, "blue")


def _delete(spark: SparkSession, d: str) -> DataFrame:
    s, more = _two(spark, d)
    s.add(more)
    s.delete(Q.Range("p_size", 10, 20))
    return _hits(s, "blue")


def _update(spark: SparkSession, d: str) -> DataFrame:
    s, more = _two(spark, d)
    s.update("p_name", "blue", more)
    return s.docs()


def _snapshot(spark: SparkSession, d: str) -> DataFrame:
    s, more = _two(spark, d)
    s.add(more)
    v = s.snapshot("before")
    s.delete(Q.Term("p_name", "blue"))
    return _hits(s, "blue", v)


def _compact(spark: SparkSession, d: str) -> DataFrame:
    s, more = _two(spark, d, sort=("p_brand", "doc_id"))
    s.add(more)
    s.compact(3)
    return _hits(s, "blue")


def _whole(spark: SparkSession, d: str) -> Store:
    s, more = _two(spark, d)
    s.add(more)
    return s


def _restore(spark: SparkSession, d: str) -> DataFrame:
    s, other = _whole(spark, d), _store(spark)
    s.delete(Q.Range("p_size", 10, 20))
    other.restore(s.backup(shared_folder(spark)))
    return _hits(other, "blue")


def _check(spark: SparkSession, d: str) -> DataFrame:
    """What a check says of a sound store, and once a file of postings that are wrong lies among its own."""
    s = _whole(spark, d)
    sound = s.check()
    at = f"{s.root}/{s.manifest(s.latest())['segments'][0]['name']}/postings"
    wrong = spark.createDataFrame([("p_name", "zzz", -1, 3, [5, 2], 2)], "field string, term string, doc_id bigint, tf int, positions array<int>, dl int")
    wrong.write.mode("append").partitionBy("field").parquet(at)
    rows = [("sound", c) for c, _ in sound] + [("damaged", c) for c, _ in s.check()]
    return spark.createDataFrame(rows, "store string, code string")


def _manager(spark: SparkSession, d: str) -> DataFrame:
    s, more = _two(spark, d, keep=5)
    m = Manager(s)
    s.add(more)
    m.refresh()
    with m.lease() as index:
        return compile(Q.Term("p_name", "blue"), index).select("doc_id", F.round("score", 6).alias("score"))


def _uncommitted(spark: SparkSession, d: str) -> DataFrame:
    s, more = _two(spark, d)
    return compile(Q.Term("p_name", "blue"), s.uncommitted(more)).select("doc_id", F.round("score", 6).alias("score"))


def _migrate(spark: SparkSession, d: str) -> DataFrame:
    """A commit of format 1, tables beside its manifest, brought to the present one."""
    s = _store(spark)
    at = s._at(1)
    _parts(spark, d).write.parquet(f"{at}/docs")
    s.files.write(f"{at}/manifest.json", sealed({"format": 1, "version": 1, "schema": _parts(spark, d)._jdf.schema().toDDL()}))
    s.migrate()
    return _hits(s, "blue")


def _upsert(spark: SparkSession, d: str) -> DataFrame:
    s = _whole(spark, d)
    s.upsert(_parts(spark, d).where("p_size > 25").withColumn("p_name", F.concat(F.lit("new "), "p_name")))
    return s.docs().select("doc_id", "p_name")


def _stream(spark: SparkSession, d: str) -> DataFrame:
    s = _store(spark)
    inbox = shared_folder(spark)
    _parts(spark, d).repartition(3, "doc_id").write.parquet(inbox)
    schema = "doc_id bigint, p_name string, p_brand string, p_size int, p_retailprice double"
    ingest(read_documents(spark, inbox, schema, 2), s, shared_folder(spark)).awaitTermination()
    return _hits(s, "blue")


def _last_state(stream: DataFrame) -> DataFrame:
    """The complete result of a streaming aggregation, as its last batch left it."""
    spark, at = stream.sparkSession, shared_folder(stream.sparkSession)
    w = stream.writeStream.outputMode("complete").foreachBatch(lambda b, n: b.write.mode("overwrite").parquet(at))
    w.option("checkpointLocation", shared_folder(spark)).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(at)


def _set(spark: SparkSession, d: str, condition) -> DataFrame:
    return bitmaps.of(table(spark, d, "customer").where(condition).select(F.col("c_custkey").alias("doc_id")))


def _read(spark: SparkSession, d: str, name: str) -> DataFrame:
    inbox, t = shared_folder(spark), table(spark, d, name)
    t = t.select(*(F.col(c).cast("timestamp").alias(c) if kind == "timestamp_ntz" else c for c, kind in t.dtypes))
    t.write.parquet(inbox)
    return spark.readStream.schema(t.schema).parquet(inbox)


def _running(spark: SparkSession, d: str) -> DataFrame:
    toks = _read(spark, d, "conversations").select(F.concat_ws("-", "conv_id", "turn").alias("doc_id"), A.standard_analyser()(F.col("text")).alias("toks"))
    return _last_state(running_terms(toks)).select("term", "df", "cf")


register("s_json", lambda spark, d: json_fields.parse(table(spark, d, "events").select("event_id", "props"), "props", "k int").select("event_id", F.get("k", F.lit(0)).alias("k")), "select event_id, json_extract(props, '$.k')::double as k from events")
register("s_stored_fields", lambda spark, d: R.stored(compile(Q.Range("p_size", 5, 9), _whole(spark, d).index()), _parts(spark, d), "p_name", "p_brand").select("doc_id", "p_name", "p_brand"), "select p_partkey::bigint as doc_id, p_name, p_brand from part where p_size between 5 and 9")
register("s_schema_violations", lambda spark, d: Schema((Field("lang", "string", True), Field("source", "string", True), Field("text", "text", True))).violations(table(spark, d, "documents").withColumn("source", F.when(F.col("source") != "src3", F.col("source")))).select("doc_id", F.array_join("missing", ",").alias("missing")), "select doc_id, 'source' as missing from documents where source = 'src3'")
register("l_add", _add, _scores("true"))
register("l_delete", _delete, _scores("p_size not between 10 and 20"))
register("l_update", _update, f"select {_PART} from part where p_size <= 25 and not {_BLUE} union all select {_PART} from part where p_size > 25")
register("l_snapshot", _snapshot, _scores("true"))
register("l_compact", _compact, _scores("true"))
register("l_backup_restore", _restore, _scores("p_size not between 10 and 20"))
_CODES = "file-unknown posting-orphan posting-frequency posting-order posting-place length length-total term-frequency term-occurrences".split()
register("l_check", _check, " union all ".join(f"select 'damaged' as store, '{c}' as code" for c in _CODES))
register("l_size", lambda spark, d: _whole(spark, d).size().select("part", (F.col("files") > 0).alias("some")).where("some"), " union all ".join(f"select '{p}' as part, true as some" for p in ("docs", "manifest.json", "postings", "terms")))
register("l_uncommitted", _uncommitted, _scores("true"))
register("l_migrate", _migrate, _scores("true"))
register("n_upsert", _upsert, "select p_partkey::bigint as doc_id, case when p_size > 25 then 'new ' || p_name else p_name end as p_name from part")
register("n_manager", _manager, _scores("true"))
register("n_ingest", _stream, _scores("true"))
register("n_running_terms", _running, "select term, count(distinct doc) as df, count(*) as cf from (select conv_id || '-' || turn as doc, unnest(list_filter(regexp_extract_all(lower(text), '[\\p{L}\\p{Nd}]+'), lambda x: x not in (" + ", ".join(f"'{w}'" for w in sorted(A.STOP_WORDS["en"])) + "))) as term from conversations) group by term")
register(
    "n_windowed_facets",
    lambda spark, d: _last_state(windowed_facets(_read(spark, d, "events"), "event_type")).select(F.date_format("start", "yyyy-MM-dd HH:mm").alias("start"), "value", "count"),
    "select strftime(time_bucket(interval '1 hour', ts), '%Y-%m-%d %H:%M') as start, event_type as value, count(*) as count from events group by all",
)
register(
    "h_bitmaps",
    lambda spark, d: bitmaps.members(bitmaps.minus(bitmaps.both(_set(spark, d, F.col("c_acctbal") > 0), _set(spark, d, F.col("c_nationkey") < 12)), _set(spark, d, F.col("c_mktsegment") == "BUILDING"))),
    "select c_custkey as doc_id from customer where c_acctbal > 0 and c_nationkey < 12 and c_mktsegment <> 'BUILDING'",
)
register("h_bitmap_count", lambda spark, d: bitmaps.count(bitmaps.either(_set(spark, d, F.col("c_acctbal") > 0), _set(spark, d, F.col("c_nationkey") < 12))), "select count(*) as n from customer where c_acctbal > 0 or c_nationkey < 12")
register("h_norms", lambda spark, d: table(spark, d, "embeddings").select("vec_id", F.round(squared_norm(F.col("embedding")), 6).alias("squared"), F.round(squared_norm(normalise(F.col("embedding"))), 4).alias("unit")), "select vec_id, round(list_inner_product(embedding::double[], embedding::double[]), 6)::double as squared, 1.0::double as unit from embeddings")
register("h_haversine", lambda spark, d: table(spark, d, "customer").select("c_custkey", F.round(haversine(F.lit(51.5), F.lit(-0.12), F.pmod(F.col("c_custkey") * 37, F.lit(1800)) / 10.0 - 90, F.pmod(F.col("c_custkey") * 91, F.lit(3600)) / 10.0 - 180), 3).alias("metres")), "select c_custkey, round(2 * 6371000.0 * atan2(sqrt(h), sqrt(1 - h)), 3)::double as metres from (select c_custkey, pow(sin(radians(lat - 51.5) / 2), 2) + cos(radians(51.5)) * cos(radians(lat)) * pow(sin(radians(lon + 0.12) / 2), 2) as h from (select c_custkey, (c_custkey * 37 % 1800) / 10.0::double - 90 as lat, (c_custkey * 91 % 3600) / 10.0::double - 180 as lon from customer))")
register("h_geo_codes", lambda spark, d: table(spark, d, "customer").select("c_custkey", F.round(decode(encode(F.pmod(F.col("c_custkey") * 37, F.lit(1800)) / 10.0 - 90, 90.0), 90.0), 5).alias("lat"), F.round(decode(encode(F.pmod(F.col("c_custkey") * 91, F.lit(3600)) / 10.0 - 180, 180.0), 180.0), 5).alias("lon")), "select c_custkey, round((c_custkey * 37 % 1800) / 10.0::double - 90, 5)::double as lat, round((c_custkey * 91 % 3600) / 10.0::double - 180, 5)::double as lon from customer")
register(
    "h_crc32",
    lambda spark, d: table(spark, d, "documents").select("doc_id", F.crc32(F.col("text").cast("binary")).alias("crc")),
    """with t as (select list_transform(range(256), lambda i: list_reduce(list_prepend(i::bigint, range(8)), lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end)) as tab),
b as (select doc_id, list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda h: (strpos('0123456789ABCDEF', h[1]) - 1) * 16 + strpos('0123456789ABCDEF', h[2]) - 1) as bytes from documents)
select doc_id, xor(list_reduce(list_prepend(4294967295, bytes), lambda c, x: xor(c >> 8, tab[(xor(c, x) & 255) + 1])), 4294967295)::bigint as crc from b, t""",
)
