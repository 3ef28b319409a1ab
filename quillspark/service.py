"""Collections over HTTP: a store for each name below a folder, JSON in and out.

    GET    /collections                      the names, with their documents
    DELETE /collections/NAME                 drops one
    POST   /collections/NAME/documents       [{"doc_id": 1, "text": ...}, ...] put in, in the place of those with their ids
    DELETE /collections/NAME/documents/ID    takes one away
    GET    /collections/NAME/search?q=&n=    the best hits, how many there are, suggestions if there is none

For a few users beside a session; each request is a Spark job or several.
"""

from __future__ import annotations

import json
import re
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, unquote, urlsplit

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .functions.analysis import standard_analyser
from .operators.rank import stored
from .operators.suggest import did_you_mean
from .plans.compile import top
from .searcher import Searcher
from .sources.store import Files, Store, StoreError

SCHEMA = "doc_id bigint, text string"


class Collections:
    """What the routes do."""

    def __init__(self, spark: SparkSession, root: str, field: str = "text"):
        self.spark, self.root, self.field = spark, root.rstrip("/"), field

    def store(self, name: str) -> Store:
        if not re.fullmatch(r"[\w-]{1,64}", name):
            raise ValueError("a name is letters, digits, - and _")
        return Store(self.spark, f"{self.root}/{name}", {self.field: standard_analyser()})

    def names(self) -> list[dict]:
        found = ((n, self.store(n)) for n in Files(self.spark, self.root).names(self.root))
        return [{"name": n, "documents": s.manifest(v[-1])["n_docs"]} for n, s in found if (v := s.versions())]

    def drop(self, name: str) -> None:
        self.store(name).files.remove(f"{self.root}/{name}")

    def put(self, name: str, rows: list[dict]) -> int:
        made = self.spark.createDataFrame([(int(r["doc_id"]), r.get(self.field)) for r in rows], SCHEMA.replace("text", self.field, 1))
        return self.store(name).upsert(made)

    def take(self, name: str, doc_id: int) -> int:
        return self.store(name).remove(self.spark.createDataFrame([(doc_id,)], "doc_id bigint"))

    def search(self, name: str, text: str, n: int = 10) -> dict:
        ix = self.store(name).index()
        hits = Searcher(ix, self.field).hits(text)
        rows = stored(top(hits, n), ix.docs, self.field).orderBy(F.desc("score"), "doc_id").collect()
        out = {"total": hits.count() if len(rows) == n else len(rows), "hits": [r.asDict() for r in rows]}
        if not rows:
            out["suggestions"] = {w: [r.term for r in did_you_mean(ix, self.field, w, 2, 5).collect()] for w in re.findall(r"\w+", text.lower())}
        return out


def serve(spark: SparkSession, root: str, port: int = 0) -> ThreadingHTTPServer:
    """A server that isn't started yet (serve_forever does); port 0 takes a free one. On this machine only."""
    of = Collections(spark, root)

    class Handler(BaseHTTPRequestHandler):
        def _answer(self) -> None:
            url = urlsplit(self.path)
            path, ask = [unquote(x) for x in url.path.strip("/").split("/")], parse_qs(url.query)
            try:
                match [self.command, *path]:
                    case ["GET", "collections"]:
                        got = of.names()
                    case ["DELETE", "collections", name]:
                        got = of.drop(name)
                    case ["POST", "collections", name, "documents"]:
                        got = {"version": of.put(name, json.loads(self.rfile.read(int(self.headers.get("Content-Length", 0)))))}
                    case ["DELETE", "collections", name, "documents", doc_id]:
                        got = {"version": of.take(name, int(doc_id))}
                    case ["GET", "collections", name, "search"]:
                        got = of.search(name, ask.get("q", [""])[0], int(ask.get("n", ["10"])[0]))
                    case _:
                        return self._send(404, {"error": "no such route"})
                self._send(200, got)
            except StoreError as e:
                self._send(404, {"error": str(e)})
            except (ValueError, KeyError, TypeError) as e:
                self._send(400, {"error": str(e)})

        def _send(self, code: int, body) -> None:
            raw = json.dumps(body).encode()
            self.send_response(code)
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(raw)))
            self.end_headers()
            self.wfile.write(raw)

        do_GET = do_POST = do_DELETE = _answer

        def log_message(self, *_) -> None:
            pass

    return ThreadingHTTPServer(("127.0.0.1", port), Handler)
