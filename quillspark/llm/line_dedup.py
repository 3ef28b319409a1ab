"""Line dedup across documents, as compressed keep bitmaps.

A pass over the texts hashes each line that isn't blank, ends trimmed, to 128
bits. Within an Arrow batch only a hash's first occurrence goes on, the others
are known to be repeats; so a line that every document has costs one row a batch.
The hashes are range-partitioned with document and position as secondary sort,
and one stream over each partition tells the first occurrence from the rest.
Texts are never shuffled, and the result has bitmaps instead of them.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize, pick

_PER_ROW = "doc_id bigint, digest bigint, n_lines int, seen array<binary>, at array<int>, repeats array<int>"


def pack(keep: np.ndarray) -> bytes:
    """Bitmap of keep: a byte 0 if all are kept, else 1 and the bits or 2 and their deflated form, whichever is shorter."""
    if keep.all():
        return b"\0"
    bits = np.packbits(keep, bitorder="little").tobytes()
    small = zlib.compress(bits, 9)
    return b"\1" + bits if len(bits) <= len(small) else b"\2" + small


def unpack(packed: bytes, n: int) -> np.ndarray:
    """The n booleans of a bitmap."""
    if packed[0] == 0:
        return np.ones(n, bool)
    bits = packed[1:] if packed[0] == 1 else zlib.decompress(packed[1:])
    return np.unpackbits(np.frombuffer(bits, np.uint8), count=n, bitorder="little").astype(bool)


def _digest(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass")) - (1 << 63)


def _lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        order = sorted(range(len(ids)), key=lambda k: (ids[k] is not None, ids[k] or 0, _digest(texts[k] or "")))
        seen: dict[bytes, None] = {}
        rows, last = [], None
        for k in order:
            text = texts[k] or ""
            key = (ids[k], _digest(text))
            if key == last:
                continue  # the same document again
            last = key
            lines = text.split("\n") if text else []
            new, at, repeats = [], [], []
            for i, line in enumerate(lines):
                line = line.strip()
                if line:
                    h = xxhash.xxh3_128_digest(line.encode("utf-8", "surrogatepass"))
                    if h in seen:
                        repeats.append(i)
                    else:
                        seen[h] = None
                        new.append(h)
                        at.append(i)
            rows.append((*key, len(lines), new, at, repeats))
        types = [pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.binary()), pa.list_(pa.int32()), pa.list_(pa.int32())]
        if rows:
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), types)], ["doc_id", "digest", "n_lines", "seen", "at", "repeats"])


def _later(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by hash, document, position: all but each hash's first. Rows that repeat the first are the first."""
    last = first = None
    for batch in batches:
        if not batch.num_rows:
            continue
        h = np.frombuffer(b"".join(batch.column(0).to_pylist()), "V16")
        known = np.asarray(batch.column(1).is_valid())
        at = np.stack([known, *(np.asarray(pc.fill_null(batch.column(c), 0)).astype(np.int64) for c in (1, 2, 3))], 1)
        new = np.r_[last is None or h[0] != last, h[1:] != h[:-1]]
        group = np.cumsum(new)
        heads = np.concatenate([at[:1] if first is None else first[None], at[new]])[group]
        yield batch.take(pa.array(np.flatnonzero((at != heads).any(1)))).select([1, 2, 3])
        last, first = h[-1], heads[-1]


def _bitmaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n, drops = batch.column(2).to_pylist(), batch.column(3).to_pylist()
        kept, packed = [], []
        for size, drop in zip(n, drops):
            keep = np.ones(size, bool)
            keep[drop or []] = False
            kept.append(int(keep.sum()))
            packed.append(pack(keep))
        yield pa.record_batch([batch.column(0), batch.column(1), batch.column(2), pa.array(kept, pa.int32()), pa.array(packed, pa.binary())], ["doc_id", "digest", "n_lines", "n_kept", "keep"])


def keep_bitmaps(docs: DataFrame) -> DataFrame:
    """(doc_id, digest, n_lines, n_kept, keep): for each document which of its
    lines (split at newlines) to keep: the first occurrence of each line over all
    documents, by doc_id, digest of the text and position, and every blank line.

    Lines are compared with their ends trimmed. A document is a doc_id with a
    text: rows that repeat both give one row; two texts under one doc_id two,
    ordered by their digests. A null doc_id comes before all others. A null or
    empty text has no lines. An empty table gives no rows; other columns aren't
    read."""
    rows = materialize(pick(docs, "doc_id", "text").mapInArrow(_lines, _PER_ROW))
    found = rows.select("doc_id", "digest", F.explode(F.arrays_zip("seen", "at")).alias("x")).select(F.col("x.seen").alias("hash"), "doc_id", "digest", F.col("x.at").alias("line"))
    later = found.repartitionByRange("hash").sortWithinPartitions("hash", "doc_id", "digest", "line").mapInArrow(_later, "doc_id bigint, digest bigint, line int")
    drops = later.groupBy("doc_id", "digest").agg(F.collect_list("line").alias("later"))
    one = rows.groupBy("doc_id", "digest").agg(F.max("n_lines").alias("n_lines"), F.flatten(F.collect_list("repeats")).alias("repeats"))
    d = drops.select(F.col("doc_id").alias("d"), F.col("digest").alias("g"), "later")
    none: Column = F.array().cast("array<int>")
    joined = one.join(d, one.doc_id.eqNullSafe(d.d) & (one.digest == d.g), "left").select("doc_id", "digest", "n_lines", F.array_union("repeats", F.coalesce("later", none)).alias("drops"))
    return joined.mapInArrow(_bitmaps, "doc_id bigint, digest bigint, n_lines int, n_kept int, keep binary")


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """docs with the lines that bitmaps keep; a document whose lines all go has an
    empty text, a null text stays null, and so does a row that no bitmap is of. Rows
    that repeat are cut alike; other columns are kept whatever their names."""

    @F.arrow_udf(T.StringType())
    def cut(text: pa.Array, keep: pa.Array) -> pa.Array:
        out = []
        for t, k in zip(text.to_pylist(), keep.to_pylist()):
            if t and k is not None:
                lines = t.split("\n")
                t = "\n".join(x for x, y in zip(lines, unpack(k, len(lines))) if y)
            out.append(t)
        return pa.array(out, pa.string())

    @F.arrow_udf(T.LongType())
    def digest(text: pa.Array) -> pa.Array:
        return pa.array([_digest(t or "") for t in text.to_pylist()], pa.int64())

    b = bitmaps.select(F.col("doc_id").alias("d"), F.col("digest").alias("g"), F.col("keep").alias("k"))
    x = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), digest(F.col("text")).alias("t"))
    x = x.join(b, F.col("row.doc_id").eqNullSafe(F.col("d")) & (F.col("t") == F.col("g")), "left")
    return x.withColumn("row", F.col("row").withField("text", cut(F.col("row.text"), F.col("k")))).select("row.*")
