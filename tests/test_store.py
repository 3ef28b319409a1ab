import json

import pytest

from quillspark.functions.analysis import standard_analyser
from quillspark.plans import query as Q
from quillspark.plans.compile import compile
from quillspark.sources import json_fields
from quillspark.sources.schema import Field, Schema, SchemaError
from quillspark.sources.store import Store, StoreError
from quillspark.streaming.ingest import Manager, ingest, read_documents, running_terms, windowed_facets

SCHEMA = "doc_id bigint, body string, kind string"


@pytest.fixture
def store(spark, tmp_path):
    return Store(spark, str(tmp_path / "store"), {"body": standard_analyser()}, ("kind",), keep=2)


def docs(spark, *rows):
    return spark.createDataFrame([(i, b, k) for i, b, k in rows], SCHEMA)


def found(store, word, version=None):
    return sorted(r.doc_id for r in compile(Q.Term("body", word), store.index(version)).collect())


def test_life(spark, store, tmp_path):
    with pytest.raises(StoreError):
        store.latest()
    v1 = store.add(docs(spark, (1, "red fox", "a"), (2, "red dog", "b")))
    assert found(store, "red") == [1, 2]
    assert store.snapshot("mine") == v1
    v2 = store.add(docs(spark, (3, "blue fox", "a")))
    v3 = store.delete(Q.Term("kind", "b"))
    assert found(store, "red") == [1] and found(store, "red", v1) == [1, 2]
    assert store.versions() == [v1, v2, v3]
    store.update("body", "blue", docs(spark, (3, "green fox blue", "c")))
    assert found(store, "green") == [3] and v2 not in store.versions()
    before = store.index()
    v5 = store.compact(1)
    assert store.index().n_docs == before.n_docs == 2 and store.check(v5) == []
    store.release("mine")
    store.vacuum()
    assert v1 not in store.versions()
    with pytest.raises(StoreError):
        store.commit(docs(spark, (1, "a", "a"), (1, "b", "b")))
    saved = store.backup(str(tmp_path / "copy"))
    other = Store(spark, str(tmp_path / "other"), {"body": standard_analyser()}, ("kind",))
    other.restore(saved)
    assert found(other, "fox") == [1, 3] and other.inspect()[0]["note"] == "restore"
    assert {r.part for r in store.size().collect()} >= {"docs", "postings", "terms"}


def test_recovery(spark, store, tmp_path):
    v1 = store.add(docs(spark, (1, "red fox", "a")))
    v2 = store.add(docs(spark, (2, "red dog", "b")))
    path = tmp_path / "store" / f"v-{v2:08d}" / "manifest.json"
    for crc in path.parent.glob(".manifest.json*.crc"):
        crc.unlink()
    good = path.read_text()
    for torn in ("", good[: len(good) // 2], good.replace("crc32", "crc33"), json.dumps(json.loads(good) | {"crc32": 1})):
        path.write_text(torn)
        assert store.latest() == v1 and found(store, "red") == [1]
    path.unlink()
    assert store.rollback() == [v2] and store.add(docs(spark, (5, "x", "b"))) == v2
    data = next((tmp_path / "store" / store.manifest(v2)["segments"][-1]["name"] / "docs").glob("*.parquet"))
    data.unlink()
    assert store.check(v2)[0][0] == "file-missing"
    with pytest.raises(StoreError):
        store.backup(str(tmp_path / "bad"), v2)


def test_check_finds_what_is_wrong(spark, store):
    v = store.add(docs(spark, (1, "red fox", "a")))
    at, ix = f"{store.root}/{store.manifest(v)['segments'][0]['name']}", store.index(v)
    extra = ix.postings.where("term = 'red'").selectExpr("term", "99L as doc_id", "7 as tf", "positions", "dl", "field")
    extra.write.mode("append").partitionBy("field").parquet(f"{at}/postings")
    assert {c for c, _ in store.check(v)} == {"file-unknown", "posting-orphan", "posting-frequency", "length", "length-total", "term-frequency", "term-occurrences"}
    assert {c for c, _ in store.check(v, deep=False)} == {"file-unknown"}


def damaged(path):
    """A byte in the middle of a file is another, its length the same."""
    raw = bytearray(path.read_bytes())
    raw[len(raw) // 2] ^= 0xFF
    path.write_bytes(bytes(raw))
    for crc in path.parent.glob(f".{path.name}.crc"):
        crc.unlink()


def test_altered_bytes_are_found(spark, store, tmp_path):
    store.add(docs(spark, (1, "red fox", "a")))
    saved = store.backup(str(tmp_path / "copy"))
    damaged(next((tmp_path / "copy").glob("s-*/docs/*.parquet")))
    other = Store(spark, str(tmp_path / "other"), store.text, store.exact)
    with pytest.raises(StoreError, match="altered"):
        other.restore(saved)
    damaged(next((tmp_path / "store").glob("s-*/postings/*/*.parquet")))
    assert [c for c, _ in store.check()] == ["file-checksum"] and store.check(deep=False) == []
    with pytest.raises(StoreError, match="altered"):
        store.backup(str(tmp_path / "again"))


def test_adding_writes_what_is_added(spark, tmp_path):
    """A commit of one document in a hundred writes about a hundredth of the bytes; deletes and rewrites come out as a whole index would."""
    s = Store(spark, str(tmp_path / "s"), {"body": standard_analyser()}, ("kind",), keep=10)
    s.add(docs(spark, *((i, " ".join(f"w{(i * k) % 977}" for k in range(1, 200)), "a") for i in range(2000))))
    before = sum(n for n, _ in s.manifest(s.latest())["files"].values())
    old = set(s.manifest(s.latest())["files"])
    s.add(docs(spark, *((i, " ".join(f"w{(i * k) % 977}" for k in range(1, 200)), "b") for i in range(2000, 2020))))
    s.delete(Q.Term("kind", "b"))
    m = s.manifest(s.latest())
    assert old <= set(m["files"]) and sum(n for f, (n, _) in m["files"].items() if f not in old) < 0.15 * before  # with the footers of small files
    s.upsert(docs(spark, (3, "w1 w2 new", "c"), (5000, "new w3", "c")))
    s.update("body", "w3", docs(spark, (6000, "w3", "d")))
    ix = s.index()
    whole = Store(spark, str(tmp_path / "whole"), s.text, s.exact)
    whole.commit(s.docs())
    other = whole.index()
    assert (ix.n_docs, ix.avgdl) == (other.n_docs, other.avgdl) and s.check() == [] and len(m["segments"]) == 2
    rows = lambda df: sorted(map(repr, df.collect()))
    assert rows(ix.terms.select("field", "term", "df", "cf")) == rows(other.terms.select("field", "term", "df", "cf"))
    assert rows(compile(Q.Term("body", "w1"), ix)) == rows(compile(Q.Term("body", "w1"), other))
    s.compact(2)
    assert rows(s.index().terms.select("field", "term", "df", "cf")) == rows(other.terms.select("field", "term", "df", "cf")) and s.check() == []
    with pytest.raises(StoreError, match="repeat"):
        s.add(docs(spark, (3, "again", "a")))
    with pytest.raises(StoreError, match="another type"):
        s.add(spark.createDataFrame([(9000, 5)], "doc_id bigint, body int"))


def test_policies_and_views(spark, store, tmp_path):
    s = store.with_policy(lambda found: [v for v, note in found if note == "add"])
    s.add(docs(spark, (1, "red fox", "a")))
    s.delete(Q.Term("kind", "zz"))
    s.upsert(docs(spark, (1, "red cat", "a")))
    assert [m["note"] for m in s.inspect()] == ["add", "upsert"]  # the newest stays too
    view = s.uncommitted(docs(spark, (2, "blue cat", "b")))
    assert view.n_docs == 2 and sorted(r.doc_id for r in compile(Q.Term("body", "cat"), view).collect()) == [1, 2]
    assert found(s, "cat") == [1]
    assert all(x["readable"] for x in s.compat())


def test_blocks(spark, store):
    kids = spark.createDataFrame([(1, 1, "hit"), (2, 1, "miss"), (4, 2, "miss")], "doc_id bigint, block_id bigint, body string")
    heads = spark.createDataFrame([(3, 1, "p"), (5, 2, "p")], "doc_id bigint, block_id bigint, body string")
    s = Store(spark, store.root, store.text)
    s.add_blocks(kids, heads)
    assert [r.doc_id for r in compile(Q.BlockJoin(Q.Term("body", "hit")), s.index()).collect()] == [3]
    with pytest.raises(StoreError):
        s.add_blocks(kids.limit(0), heads)


def test_stream_and_manager(spark, store, tmp_path):
    into = str(tmp_path / "in")
    docs(spark, (1, "red fox", "a"), (2, "red dog", "b")).write.parquet(into)
    run = lambda: ingest(read_documents(spark, into, SCHEMA, 1), store, str(tmp_path / "cp")).awaitTermination()
    run()
    m = Manager(store)
    first = m.version
    with m.lease() as old:
        docs(spark, (2, "blue dog", "b"), (3, "red cat", "c")).write.mode("append").parquet(into)
        run()
        store.compact(1)
        assert m.refresh() in (True, False) and m.version > first
        assert old.n_docs == 2 and sorted(r.doc_id for r in compile(Q.Term("body", "red"), old).collect()) == [1, 2]
    assert found(store, "red") == [1, 3] and not m.refresh()
    m.store = Store(spark, str(tmp_path / "none"), {})
    assert not m.refresh() and m.failures == 1
    m.close()


def test_running_tables(spark, tmp_path):
    spark.createDataFrame([(1, ["a", "b", "a"]), (2, ["a"])], "doc_id bigint, toks array<string>").write.parquet(str(tmp_path / "t"))
    s = spark.readStream.schema("doc_id bigint, toks array<string>").parquet(str(tmp_path / "t"))
    q = running_terms(s).writeStream.format("memory").queryName("running").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert {(r.term, r.df, r.cf) for r in spark.table("running").collect()} == {("a", 2, 3), ("b", 1, 1)}
    spark.sql("select timestamp'2024-01-01 00:10:00' as ts, 'x' as k union all select timestamp'2024-01-01 01:10:00', 'y'").write.parquet(str(tmp_path / "e"))
    e = spark.readStream.schema("ts timestamp, k string").parquet(str(tmp_path / "e"))
    q = windowed_facets(e, "k").writeStream.format("memory").queryName("facets").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert {(r.value, r["count"]) for r in spark.table("facets").collect()} == {("x", 1), ("y", 1)}


def test_schema(spark):
    d = docs(spark, (1, "a", None), (2, None, "b"))
    assert Schema((Field("body"), Field("kind", "string"))).validate(d).count() == 2
    with pytest.raises(SchemaError, match="document 2 lacks body"):
        Schema((Field("body", required=True),)).validate(d)
    with pytest.raises(SchemaError, match="isn't declared"):
        Schema((Field("body"),), strict=True).validate(d)
    with pytest.raises(SchemaError, match="not numeric"):
        Schema((Field("body", "numeric"),)).validate(d)
    with pytest.raises(SchemaError, match="price is missing"):
        Schema((Field("price", "numeric", True),)).validate(d)
    with pytest.raises(ValueError):
        Field("a\x00")


def test_json(spark, tmp_path):
    d = spark.createDataFrame([(1, '{"a": {"b": 1, "c": [true, false]}, "d": [{"e": "x"}, {"e": null}, {"e": "y"}]}'), (2, "oops"), (3, None)], "doc_id bigint, j string")
    rows = json_fields.parse(d, "j", "a struct<b: int, c: array<boolean>>, d array<struct<e: string>>").orderBy("doc_id").collect()
    assert rows[0]["a.b"] == [1.0] and rows[0]["a.c"] == ["true", "false"] and rows[0]["d.e"] == ["x", "y"]
    assert not rows[1]["a.b"] and not rows[2]["d.e"]
    (tmp_path / "x.json").write_text('{"p": {"q": "v"}, "n": 2}\n')
    r = json_fields.read_json(spark, str(tmp_path / "x.json")).first()
    assert r["p.q"] == ["v"] and r["n"] == [2.0]
