"""What the training-data operators share: the shared folder, checked
broadcasts, and vectorised hashing of Arrow text batches."""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import shared_folder as shared_dir

#: Text handled at once by the numpy kernels; bounds their temporaries.
SLICE_BYTES = 1 << 20
#: A side is broadcast only if the bytes of its rows, as measured, stay under this.
BROADCAST_BYTES = 64 << 20
#: Bytes of an Arrow batch that goes to Python, under small_batches().
BATCH_BYTES = 4 << 20

_written: list[tuple[SparkSession, str]] = []


def materialize(df: DataFrame, **options: str) -> DataFrame:
    """df written as Parquet in the shared folder and read again: lineage ends
    here and a lost executor costs no recomputation. Removed at exit."""
    spark = df.sparkSession
    path = shared_dir(spark)
    df.write.options(**({"compression": "zstd"} | options)).parquet(path)
    _written.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession, path: str) -> None:
    """Removes a written table."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


@contextmanager
def small_batches(spark: SparkSession, most: int = BATCH_BYTES) -> Iterator[None]:
    """Queries run meanwhile pass Arrow batches of at most so many bytes, or one row, to
    Python. By default it's a number of rows, whatever their length."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    had = spark.conf.get(key, None)
    spark.conf.set(key, str(most))
    try:
        yield
    finally:
        if had is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, had)


def written() -> int:
    """How many tables have been written, to be told to settle()."""
    return len(_written)


def settle(df: DataFrame, since: int) -> DataFrame:
    """df written and read again, and the tables written before it since then removed."""
    out = materialize(df)
    for spark, path in _written[since:-1]:
        release(spark, path)
    del _written[since:-1]
    return out


@atexit.register
def _cleanup() -> None:
    for spark, path in _written:
        try:
            release(spark, path)
        except Exception:  # the session may have gone, with its gateway
            return


def _width(c: Column, kind: T.DataType) -> Column:
    """About the bytes of a value on the heap."""
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(c), F.lit(0)).cast("bigint") + 16
    if isinstance(kind, T.StructType):
        return sum((_width(c[f.name], f.dataType) for f in kind.fields), F.lit(16).cast("bigint"))
    if isinstance(kind, T.ArrayType):
        if isinstance(kind.elementType, (T.NumericType, T.BooleanType)):
            return F.coalesce(F.array_size(c), F.lit(0)).cast("bigint") * 8 + 24
        return F.coalesce(F.aggregate(c, F.lit(24).cast("bigint"), lambda t, x: t + _width(x, kind.elementType)), F.lit(24))
    return F.lit(8).cast("bigint")


def heap_bytes(df: DataFrame) -> int:
    """The bytes of all rows of df, measured."""
    return df.agg(F.coalesce(F.sum(_width(F.struct(*(F.col(f"`{c}`") for c in df.columns)), df.schema)), F.lit(0))).first()[0]


def sized_broadcast(df: DataFrame) -> DataFrame:
    """df with a broadcast hint if its rows, which are measured here, are few bytes;
    else unhinted, so that the join shuffles. Pass a materialised df."""
    return F.broadcast(df) if heap_bytes(df) <= BROADCAST_BYTES else df


def drop_rows(docs: DataFrame, rows: DataFrame, how: str = "left_anti") -> DataFrame:
    """docs without the rows (doc_id, h), h being xxhash64 of the text; with how
    left_semi these alone. rows is materialised. Null ids meet nothing."""
    at, h = f"id_{uuid.uuid4().hex}", f"h_{uuid.uuid4().hex}"
    r = sized_broadcast(rows.select(F.col("doc_id").alias(at), F.col("h").alias(h)))
    return docs.join(r, (docs["doc_id"] == F.col(at)) & (F.xxhash64(docs["text"]) == F.col(h)), how)


def bounded_sample(df: DataFrame, by: list[str], most: int, key: Column) -> DataFrame:
    """About `most` rows of each group, all of a smaller one, by a hash of key; no
    shuffle of the rows. by: columns of few values, whose counts are broadcast."""
    n = df.groupBy(*by).agg(F.count("*").alias("__n"))
    x = df.withColumn("__h", F.shiftrightunsigned(F.xxhash64(key, F.lit(7)), 11) / F.lit(float(1 << 53)))
    keys = [F.col(c).alias(f"__{c}") for c in by]
    on = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in by]
    return x.join(F.broadcast(n.select(*keys, "__n")), on).where(F.col("__h") * F.col("__n") < most).select(*df.columns)


def pick(docs: DataFrame, *names: str) -> DataFrame:
    """Just these columns, so that extra ones can't clash with an operator's."""
    return docs.select(*(F.col(n) for n in names))


# --- Arrow text kernels


def text_buffers(col: pa.Array, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(UTF-8 bytes, offsets of n+1 rows); a null counts as empty."""
    col = pc.fill_null(col.cast(pa.large_string()), "")
    if lower:
        col = pc.utf8_lower(col)
    _, offsets, data = col.buffers()
    offs = np.frombuffer(offsets, np.int64)[col.offset : col.offset + len(col) + 1]
    buf = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return buf, offs


def slices(buf: np.ndarray, offs: np.ndarray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets from 0) of at most so many bytes, or one row."""
    n, i = len(offs) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + most, "right")) - 1)
        yield i, j, buf[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
        i = j


_P = np.uint64(0x9E3779B97F4A7C15 | 1)
_PI = np.uint64(pow(int(_P), -1, 1 << 64))
_pow: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    have = _pow.get("p")
    if have is None or len(have) < n:
        size = 1 << max(20, int(n).bit_length())
        for k, base in (("p", _P), ("i", _PI)):
            a = np.full(size, base, np.uint64)
            a[0] = 1
            _pow[k] = np.multiply.accumulate(a)
    return _pow["p"], _pow["i"]


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of 64-bit hashes."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


_WORD = np.zeros(256, bool)
_WORD[np.r_[48:58, 65:91, 97:123, 128:256]] = True


def words(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, first word of each row and the end).

    A word is a maximal run of ASCII letters and digits or non-ASCII
    characters; it never crosses a row."""
    n = len(buf)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(offs), np.int64)
    inside = _WORD[buf]
    cut = np.zeros(n + 1, bool)
    cut[offs] = True
    before = np.empty(n, bool)
    before[0], before[1:] = False, inside[:-1]
    start = np.flatnonzero(inside & (~before | cut[:-1]))
    after = np.empty(n, bool)
    after[-1], after[:-1] = False, inside[1:]
    end = np.flatnonzero(inside & (~after | cut[1:])) + 1
    p, inv = _powers(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * p[:n], out=total[1:])
    h = mix((total[end] - total[start]) * inv[start] + (end - start).astype(np.uint64))
    return h, np.searchsorted(start, offs)


def grams(h: np.ndarray, first: np.ndarray, n: int) -> list[np.ndarray]:
    """The sorted distinct hashes of each row's word n-grams; of a row with
    fewer words, one hash of all of them; none of an empty row."""
    k = len(h) - n + 1
    g = h[:0]
    if k > 0:
        g = h[:k].copy()
        for i in range(1, n):
            g = mix(g * np.uint64(0x100000001B3)) + h[i : i + k]
        g = mix(g)
    out = []
    for s, e in zip(first[:-1].tolist(), first[1:].tolist()):
        if e - s >= n:
            out.append(np.unique(g[s : e - n + 1]))
        elif e > s:
            x = h[s : s + 1].copy()
            for i in range(s + 1, e):
                x = mix(x * np.uint64(0x100000001B3)) + h[i : i + 1]
            out.append(mix(x ^ np.uint64(e - s)))
        else:
            out.append(h[:0])
    return out


def list_array(values: np.ndarray, offsets: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, kind))
