"""Near-real-time search: streams into a store, readers that follow it."""

from __future__ import annotations

import threading
from collections.abc import Callable
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from ..operators.index import Index
from ..sources.store import Store, StoreError


def read_documents(spark: SparkSession, path: str, schema: str, max_files: int = 100) -> DataFrame:
    """A stream of the Parquet files that appear in a folder, at most so many at a time."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(path)


def ingest(documents: DataFrame, store: Store, checkpoint: str, **trigger) -> StreamingQuery:
    """Adds a stream's documents to a store, a segment and a commit for each batch, in the place
    of those with their doc_ids; so a batch that runs again after a failure changes
    nothing. Of a batch's rows with one doc_id the greatest stays, by its columns in
    order, whatever order they come in."""

    def publish(batch: DataFrame, number: int) -> None:
        rest = [c for c in batch.columns if c != "doc_id"]
        batch = batch.where("doc_id is not null").groupBy("doc_id").agg(F.max(F.struct(*rest)).alias("row")).select("doc_id", "row.*").select(*batch.columns)
        if not batch.isEmpty():
            store.upsert(batch, f"batch {number}")

    w = documents.writeStream.foreachBatch(publish).option("checkpointLocation", checkpoint)
    return w.trigger(**(trigger or {"availableNow": True})).start()


def running_terms(tokens: DataFrame) -> DataFrame:
    """(term, df, cf) of a stream of (doc_id, toks), a row for each document, kept up
    incrementally (update mode). Exact: of a document's tokens, sorted, the first of each term counts for df."""
    x = tokens.select("doc_id", F.sort_array("toks").alias("toks")).select("toks", F.posexplode("toks").alias("at", "term"))
    first = (F.col("at") == 0) | (F.get("toks", F.col("at") - 1) != F.col("term"))
    return x.groupBy("term").agg(F.sum(first.cast("bigint")).alias("df"), F.count("*").alias("cf"))


def windowed_facets(events: DataFrame, field: str, width: str = "1 hour", late: str = "2 hours", time: str = "ts") -> DataFrame:
    """(start, end, value, count) of a field in windows of event time; rows later than `late` are dropped.
    This goes beyond the search library that the engine follows."""
    x = events.withWatermark(time, late).groupBy(F.window(time, width).alias("w"), F.col(field).alias("value")).agg(F.count("*").alias("count"))
    return x.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "value", "count")


class Manager:
    """The newest index of a store for many readers. refresh() looks for a newer
    commit; a failure leaves the old one in place and is counted. Commits in use are pinned."""

    def __init__(self, store: Store, on_failure: Callable[[Exception], None] | None = None):
        self.store, self.on_failure = store, on_failure
        self.failures = self.refreshes = 0
        self._lock, self._stop = threading.Lock(), threading.Event()
        self._users: dict[int, int] = {}
        self._name = f"manager-{id(self)}"
        self._version, self._index = self._open()

    def _open(self) -> tuple[int, Index]:
        v = self.store.latest()
        return v, self.store.index(v)

    @property
    def version(self) -> int:
        return self._version

    def refresh(self) -> bool:
        """Whether there was a newer commit with other documents."""
        try:
            if self.store.latest() == self._version:
                return False
            v, index = self._open()
            same = self.store.manifest(v)["note"] == "compact"
        except Exception as e:
            self.failures += 1
            if self.on_failure:
                self.on_failure(e)
            return False
        with self._lock:
            self._version, self._index = v, index
            self.refreshes += 1
        return not same

    @contextmanager
    def lease(self):
        """The index as it is now, for the length of a with block."""
        with self._lock:
            v, index = self._version, self._index
            self._users[v] = self._users.get(v, 0) + 1
            if self._users[v] == 1:
                self.store.files.write(f"{self.store.root}/pins/{v:08d}-{self._name}-{v}", "{}")
        try:
            yield index
        finally:
            with self._lock:
                self._users[v] -= 1
                if not self._users[v]:
                    self.store.files.remove(f"{self.store.root}/pins/{v:08d}-{self._name}-{v}")

    def follow(self, seconds: float = 1.0) -> threading.Thread:
        """Refreshes in the background until close()."""

        def loop() -> None:
            while not self._stop.wait(seconds):
                self.refresh()

        t = threading.Thread(target=loop, daemon=True)
        t.start()
        return t

    def close(self) -> None:
        self._stop.set()


__all__ = ["Manager", "StoreError", "ingest", "read_documents", "running_terms", "windowed_facets"]
