"""Token-ID output: Parquet list columns made for selective reads.

Texts are encoded with a byte-level BPE vocabulary in Arrow batches; the ids go
out as an Arrow list without a Python object for each. The Parquet writer is
Spark's, under its commit protocol, so lost executors and speculative copies
leave no partial files. The column of ids is dictionary encoded by default, or
delta encoded (DELTA_BINARY_PACKED, version 2 pages); row groups and pages have
set sizes, and parquet-mr writes column and offset indexes. Files are sorted by
the metadata a reader selects on, so that min/max indexes of row groups and pages
let it skip: a read of metadata touches no ids, and a read of some ids only their
pages.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import _written, list_array, pick, shared_dir

CACHE = 300_000
ROW_GROUP_BYTES, PAGE_BYTES, PAGE_ROWS = 32 << 20, 256 << 10, 1000


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


class Encoder(dict):
    """Space-led word to the bytes of its int32 ids, filled as asked up to a bound.

    The splitting pattern takes at most one space before a word, so a text
    without doubled or trailing spaces splits at spaces with the same result;
    other texts are encoded as a whole."""

    def __init__(self, path: str, cache: int = CACHE):
        super().__init__()
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encode = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.cache = cache

    def __missing__(self, word: str) -> bytes:
        ids = np.array(self.encode(word), np.int32).tobytes()
        if len(self) < self.cache:
            self[word] = ids
        return ids

    def ids(self, text: str | None) -> bytes:
        if not text:
            return b""
        if "  " in text or text[-1] == " ":
            return np.array(self.encode(text), np.int32).tobytes()
        first, *rest = text.split(" ")
        head = np.array(self.encode(first), np.int32).tobytes() if first else b""
        return head + b"".join([self[" " + w] for w in rest])


_encoders: dict[tuple[str, int], Encoder] = {}


def encoder(path: str, cache: int = CACHE) -> Encoder:
    """This worker's encoder of a vocabulary file."""
    if (path, cache) not in _encoders:
        _encoders[path, cache] = Encoder(path, cache)
    return _encoders[path, cache]


def encode(docs: DataFrame, vocabulary: str | None = None, also: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, source, lang, n_tokens, tokens) and the columns also: the ids of each row's text.

    A null or empty text has no tokens (an empty list, never null); null metadata
    stay null; repeated rows repeat; an empty table gives none. Other columns
    aren't read."""
    path = vocabulary or default_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = encoder(path).ids
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                raw = [ids(t) for t in part.column(3).to_pylist()]
                size = np.array([len(r) // 4 for r in raw], np.int64)
                tokens = list_array(np.frombuffer(b"".join(raw), np.int32), np.r_[0, np.cumsum(size)], pa.int32())
                yield pa.record_batch([part.column(0), part.column(1), part.column(2), pa.array(size.astype(np.int32)), tokens, *part.columns[4:]], ["doc_id", "source", "lang", "n_tokens", "tokens", *also])

    types = "".join(f", {c} {docs.schema[c].dataType.simpleString()}" for c in also)
    return pick(docs, "doc_id", "source", "lang", "text", *also).mapInArrow(run, f"doc_id bigint, source string, lang string, n_tokens int, tokens array<int>{types}")


def write_tokens(tokens: DataFrame, path: str, encoding: str = "dictionary", sort: tuple[str, ...] = ("source", "lang", "doc_id"), row_group_bytes: int = ROW_GROUP_BYTES, page_bytes: int = PAGE_BYTES, page_rows: int = PAGE_ROWS) -> None:
    """Writes tokens, each file sorted by `sort` (no shuffle; in the order they come
    if it's empty), with the encoding of
    the ids, the row-group and the page sizes as given."""
    if encoding not in ("dictionary", "delta"):
        raise ValueError(f"encoding is dictionary or delta, not {encoding}")
    options = {
        "compression": "zstd",
        "parquet.writer.version": "PARQUET_2_0",
        "parquet.enable.dictionary": "true",
        "parquet.enable.dictionary#tokens.list.element": str(encoding == "dictionary").lower(),
        "parquet.block.size": str(row_group_bytes),
        "parquet.page.size": str(page_bytes),
        "parquet.page.row.count.limit": str(page_rows),
    }
    (tokens.sortWithinPartitions(*sort) if sort else tokens).write.options(**options).parquet(path)


def read_metadata(tokens: DataFrame) -> DataFrame:
    """The metadata alone; the scan leaves the pages of the ids unread."""
    return tokens.select("doc_id", "source", "lang", "n_tokens")


def token_output(docs: DataFrame, vocabulary: str | None = None, encoding: str = "dictionary", sort: tuple[str, ...] = ("source", "lang", "doc_id"), also: tuple[str, ...] = ()) -> DataFrame:
    """The token table of docs, written to the shared folder and read from there."""
    spark = docs.sparkSession
    path, made = shared_dir(spark), encode(docs, vocabulary, also)
    write_tokens(made, path, encoding, sort)
    _written.append((spark, path))
    return spark.read.schema(made.schema).parquet(path)


def decode_ids(ids: list[int], vocabulary: str | None = None) -> str:
    """The text of ids."""
    return encoder(vocabulary or default_vocabulary()).encode.__self__.decode(ids)
