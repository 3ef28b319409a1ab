import json
import threading
import urllib.error
import urllib.request

from quillspark.functions import bitmaps
from quillspark.functions.analysis import standard_analyser
from quillspark.functions.offsets import spans, unique_at_place
from quillspark.service import serve


def test_collections(spark, tmp_path):
    server = serve(spark, str(tmp_path))
    threading.Thread(target=server.serve_forever, daemon=True).start()

    def ask(method, path, body=None):
        r = urllib.request.Request(f"http://127.0.0.1:{server.server_port}{path}", json.dumps(body).encode() if body is not None else None, method=method)
        try:
            with urllib.request.urlopen(r) as x:
                return x.status, json.loads(x.read())
        except urllib.error.HTTPError as e:
            return e.code, json.loads(e.read())

    try:
        assert ask("GET", "/collections") == (200, [])
        assert ask("POST", "/collections/pets/documents", [{"doc_id": 1, "text": "red fox"}, {"doc_id": 2, "text": "red dog dog"}])[0] == 200
        ask("POST", "/collections/pets/documents", [{"doc_id": 1, "text": "blue fox"}, {"doc_id": 3, "text": None}])
        assert ask("GET", "/collections") == (200, [{"name": "pets", "documents": 3}])
        code, got = ask("GET", "/collections/pets/search?q=red+fox&n=5")
        assert code == 200 and got["total"] == 2 and {h["doc_id"] for h in got["hits"]} == {1, 2}
        assert ask("GET", "/collections/pets/search?q=foks")[1]["suggestions"] == {"foks": []}
        assert "fox" in ask("GET", "/collections/pets/search?q=foxx")[1]["suggestions"]["foxx"]
        ask("DELETE", "/collections/pets/documents/2")
        assert ask("GET", "/collections/pets/search?q=dog")[1]["total"] == 0
        assert ask("GET", "/collections/none/search?q=x")[0] == 404 and ask("GET", "/x")[0] == 404
        assert ask("GET", "/collections/..%2Fa/search?q=x")[0] == 400 and ask("POST", "/collections/pets/documents", {"a": 1})[0] == 400
        assert ask("DELETE", "/collections/pets") == (200, None) and ask("GET", "/collections") == (200, [])
    finally:
        server.shutdown()


def test_bitmaps(spark):
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "doc_id bigint")
    get = lambda s: sorted(r.doc_id for r in bitmaps.members(s).collect())
    some = [0, 1, 2, 7, 8, 32767, 32768, 32769, 10**12, 10**12 + 1]
    a, b = bitmaps.of(ids(*some, 1, None)), bitmaps.of(ids(2, 8, 9, 32768, 10**12))
    assert get(a) == some and bitmaps.count(a).first().n == len(some)
    assert get(bitmaps.both(a, b)) == [2, 8, 32768, 10**12]
    assert get(bitmaps.either(a, b)) == sorted({*some, 9}) and get(bitmaps.minus(a, b)) == [0, 1, 7, 32767, 32769, 10**12 + 1]
    assert get(bitmaps.of(ids())) == [] and bitmaps.count(bitmaps.of(ids())).first().n == 0


def test_unique_at_place(spark):
    docs = spark.createDataFrame([(1, "red red fox")], "doc_id int, text string")
    found = spans(docs, "doc_id", "text", standard_analyser())
    assert unique_at_place(found.union(found), "doc_id").count() == 3
