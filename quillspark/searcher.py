"""A searcher: query strings or trees to ranked rows, under limits, with a cache and a record."""

from __future__ import annotations

import json
import threading
import time
import uuid
from collections import Counter, OrderedDict, deque
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Row

from .operators.index import Index
from .plans.compile import compile, top
from .plans.parse import parse
from .plans.query import Query


@dataclass(frozen=True)
class Options:
    """timeout in seconds; most result bytes; cancelled: asked from time to time."""

    timeout: float | None = None
    max_bytes: int | None = None
    cancelled: Callable[[], bool] | None = None


@dataclass(frozen=True)
class Result:
    """The best hits, how many there are in all, and whether the search was cut short."""

    hits: list[Row]
    total: int
    partial: bool = False


class Cache:
    """The last results by query, size and index; results of another index don't count."""

    def __init__(self, most: int = 1000):
        self.most, self.hits, self.misses = most, 0, 0
        self._kept: OrderedDict = OrderedDict()
        self._lock = threading.Lock()

    def get(self, key) -> Result | None:
        with self._lock:
            if key in self._kept:
                self._kept.move_to_end(key)
                self.hits += 1
                return self._kept[key]
            self.misses += 1
            return None

    def put(self, key, value: Result) -> None:
        with self._lock:
            self._kept[key] = value
            self._kept.move_to_end(key)
            while len(self._kept) > self.most:
                self._kept.popitem(last=False)

    def clear(self) -> None:
        with self._lock:
            self._kept.clear()


@dataclass
class Record:
    """Counts, the last searches, and a log of slow ones (JSON lines). listener is told of each search."""

    slow_ms: float | None = None
    log: Callable[[str], None] | None = None
    listener: Callable[[dict], None] | None = None
    counts: Counter = field(default_factory=Counter)
    recent: deque = field(default_factory=lambda: deque(maxlen=1000))

    def add(self, query: Query, ms: float, total: int, cached: bool) -> None:
        event = {"query": repr(query), "kind": type(query).__name__, "ms": round(ms, 3), "total": total, "cached": cached}
        self.counts["searches"] += 1
        self.counts["cached"] += cached
        self.counts[f"kind:{event['kind']}"] += 1
        self.counts["ms"] += ms
        self.recent.append(event)
        if self.listener:
            self.listener(dict(event))
        if self.slow_ms is not None and ms >= self.slow_ms:
            self.counts["slow"] += 1
            if self.log:
                self.log(json.dumps(event | {"at": time.time()}))


class Searcher:
    """Searches of one index."""

    def __init__(self, index: Index, field_: str, cache: Cache | None = None, record: Record | None = None):
        self.index, self.field, self.cache, self.record = index, field_, cache, record or Record()
        self._words: dict[str, list[str]] = {}

    def analyse(self, text: str) -> list[str]:
        if text not in self._words:
            self._words[text] = self.index.analysers[self.field].words(self.index.spark, text)
        return self._words[text]

    def query(self, text: str, lenient: bool = False) -> Query:
        return parse(text, self.field, self.analyse, lenient)

    def hits(self, query: Query | str, need_score: bool = True) -> DataFrame:
        """All hits, not yet run."""
        return compile(self.query(query) if isinstance(query, str) else query, self.index, need_score)

    def search(self, query: Query | str, n: int = 10, options: Options = Options()) -> Result:
        """The n best hits and the number of all. What exceeds the options is
        cancelled and returned as partial, without hits if none were there yet."""
        began = time.time()
        query = self.query(query) if isinstance(query, str) else query
        key = (query, n, self.index.token)
        if self.cache and (found := self.cache.get(key)):
            self.record.add(query, (time.time() - began) * 1000, found.total, True)
            return found
        df = self.hits(query)
        rows, total, partial = self._run(df, n, options)
        result = Result(rows, total, partial)
        if self.cache and not partial:
            self.cache.put(key, result)
        self.record.add(query, (time.time() - began) * 1000, total, False)
        return result

    def _run(self, df: DataFrame, n: int, options: Options) -> tuple[list[Row], int, bool]:
        sc, tag = self.index.spark.sparkContext, f"search-{uuid.uuid4().hex}"
        row_bytes = 16
        if options.max_bytes is not None:
            if options.max_bytes < row_bytes:
                raise ValueError("the byte budget is too small for one hit")
            n_most = min(n, options.max_bytes // row_bytes)
        else:
            n_most = n
        done, cut = threading.Event(), threading.Event()
        limit = None if options.timeout is None else time.time() + options.timeout

        def watch() -> None:
            while not done.wait(0.05):
                if (limit and time.time() > limit) or (options.cancelled and options.cancelled()):
                    cut.set()
                    sc.cancelJobsWithTag(tag)

        if limit or options.cancelled:
            threading.Thread(target=watch, daemon=True).start()
        rows: list[Row] = []
        sc.addJobTag(tag)
        try:
            rows = top(df, n_most).collect()
            total = df.count() if len(rows) == n_most else len(rows)
            return rows, total, n_most < min(n, total)
        except Exception:
            if cut.is_set():
                return rows, len(rows), True
            raise
        finally:
            done.set()
            sc.removeJobTag(tag)
