"""The inverted index: Parquet tables of postings, terms and lengths beside the documents.

    docs      (doc_id, source columns)            stored fields and doc values
    postings  (field, term, doc_id, tf, positions, dl)
    terms     (field, term, df, cf)
    stats     (field, n_docs, sum_len, avgdl)

Analysis runs once. A document's postings are made where its row is read (no
shuffle); one exchange by term puts them in files sorted by field and term, whose row
groups a query's term predicate prunes. A term is in one file, but for those that
would fill a task by themselves: they're salted by document, by their frequency among
the first documents. A field's lengths are the sums of its terms' frequencies.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.analysis import Analyser, standard_analyser
from ..functions.similarity import Similarity, bm25
from ..functions.terms import pieces
from ..session import shared_folder, spread

#: Postings of a term that one task takes; documents that tell which terms have more.
TASK_ROWS, LOOK = 1 << 20, 10_000
#: Tokens whose postings are made at once, or those of one document.
PIECE = 1 << 17
POSTINGS = "field string, term string, doc_id bigint, tf int, positions array<int>, dl int"
TERMS = "field string, term string, df bigint, cf bigint"


def _posting_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        size = np.asarray(pc.fill_null(pc.list_value_length(batch.column(2)), 0)).astype(np.int64)
        for i, n in pieces(size, PIECE):
            yield _postings_of_piece(batch.slice(i, n), size[i : i + n])


def _postings_of_piece(batch: pa.RecordBatch, size: np.ndarray) -> pa.RecordBatch:
    """The postings of some documents; size: tokens of each."""
    ids, fields, toks = batch.columns
    first = np.r_[0, np.cumsum(size)]
    d = pa.array(toks.flatten()).dictionary_encode()
    row = np.repeat(np.arange(len(size)), size)
    code = np.asarray(d.indices).astype(np.int64)
    key = row * max(1, len(d.dictionary)) + code
    order = np.argsort(key, kind="stable")
    cut = np.flatnonzero(np.r_[True, np.diff(key[order]) != 0]) if len(key) else np.zeros(0, np.int64)
    ends = np.r_[cut, len(key)]
    place = (np.arange(len(key)) - first[row])[order].astype(np.int32)
    owner = row[order[cut]]
    positions = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(place)) if len(cut) else pa.array([], pa.list_(pa.int32()))
    return pa.record_batch([fields.take(pa.array(owner)), d.dictionary.take(pa.array(code[order[cut]])), ids.take(pa.array(owner)), pa.array(np.diff(ends).astype(np.int32)), positions, pa.array(size[owner].astype(np.int32))], schema=_SCHEMA)


_SCHEMA = pa.schema([("field", pa.string()), ("term", pa.string()), ("doc_id", pa.int64()), ("tf", pa.int32()), ("positions", pa.list_(pa.int32())), ("dl", pa.int32())])


@dataclass(frozen=True)
class Index:
    """docs and the tables made of them. n_docs and avgdl are known on the driver: a number, and one for each field."""

    docs: DataFrame
    postings: DataFrame
    terms: DataFrame
    n_docs: int
    avgdl: dict[str, float]
    analysers: dict[str, Analyser] = field(default_factory=dict)
    similarity: Similarity = bm25
    #: Tells this index from all others, also from those that have gone.
    token: str = field(default_factory=lambda: uuid.uuid4().hex, compare=False)

    @property
    def spark(self) -> SparkSession:
        return self.docs.sparkSession

    @property
    def stats(self) -> DataFrame:
        rows = [(f, self.n_docs, a * self.n_docs, a) for f, a in sorted(self.avgdl.items())]
        return self.spark.createDataFrame(rows, "field string, n_docs bigint, sum_len double, avgdl double")

    def of_field(self, name: str, condition: Callable[[Column], Column] | Column | None = None) -> DataFrame:
        """The postings of a field whose term meets the condition."""
        p = self.postings.where(F.col("field") == name)
        return p if condition is None else p.where(condition if isinstance(condition, Column) else condition(F.col("term")))

    def vocabulary(self, name: str, condition: Column | None = None) -> DataFrame:
        """(term, df, cf) of a field."""
        t = self.terms.where(F.col("field") == name)
        return (t if condition is None else t.where(condition)).select("term", "df", "cf")

    def with_similarity(self, similarity: Similarity) -> Index:
        return replace(self, similarity=similarity, token=uuid.uuid4().hex)


def analysed(docs: DataFrame, text: dict[str, Analyser]) -> DataFrame:
    """(doc_id, field, toks), a row for each document and text field."""
    one = lambda f, a: F.struct(F.lit(f).alias("field"), a(F.col(f)).alias("toks"))
    x = docs.select("doc_id", F.explode(F.array(*(one(f, a) for f, a in text.items()))).alias("x"))
    return x.select("doc_id", "x.field", "x.toks")


def postings_of(docs: DataFrame, text: dict[str, Analyser], exact: tuple[str, ...] = ()) -> DataFrame:
    """Postings, with a length row for each document and text field. An exact
    field's value is one term without positions, of length 1, each of an array's values once."""
    made = analysed(docs, text).mapInArrow(_posting_lists, POSTINGS) if text else None
    for f in exact:
        many = docs.schema[f].dataType.typeName() == "array"
        values = F.explode(F.array_distinct(F.col(f))) if many else F.col(f)
        x = docs.select("doc_id", values.alias("term")).select("doc_id", F.col("term").cast("string").alias("term")).where("term is not null and term <> ''")
        x = x.select(F.lit(f).alias("field"), "term", "doc_id", F.lit(1).alias("tf"), F.array().cast("array<int>").alias("positions"), F.lit(1).alias("dl"))
        made = x if made is None else made.union(x)
    return made


def salts(docs: DataFrame, text: dict[str, Analyser], exact: tuple[str, ...], n_docs: int) -> DataFrame | None:
    """(field, term, salts) of the terms that are likely to have more than TASK_ROWS
    postings; None if there are none. They change where rows go, not what they are."""
    if n_docs <= TASK_ROWS:
        return None
    some = docs.limit(LOOK)
    seen = postings_of(some, text, exact).groupBy("field", "term").agg((F.count("*") * (n_docs / LOOK)).alias("n")).where(F.col("n") > TASK_ROWS)
    rows = seen.select("field", "term", F.ceil(F.col("n") / TASK_ROWS).cast("int").alias("salts")).collect()  # TASK_ROWS / n_docs of the documents hold each, so they're few
    return docs.sparkSession.createDataFrame(rows, "field string, term string, salts int") if rows else None


def write_postings(docs: DataFrame, text: dict[str, Analyser], exact: tuple[str, ...], path: str, n_docs: int) -> DataFrame:
    """Writes the postings and terms of docs below path; (field, sum_len) of the text fields is returned."""
    spark = docs.sparkSession
    p = postings_of(spread(docs), text, exact)
    hot = salts(docs, text, exact, n_docs)
    if hot is None:
        p = p.repartition("field", "term")
    else:
        p = p.join(F.broadcast(hot), ["field", "term"], "left")
        p = p.repartition("field", "term", F.pmod(F.xxhash64("doc_id"), F.coalesce("salts", F.lit(1)))).drop("salts")
    p.sortWithinPartitions("field", "term", "doc_id").write.partitionBy("field").option("compression", "zstd").option("parquet.block.size", str(16 << 20)).parquet(f"{path}/postings")
    t = spark.read.schema(POSTINGS).parquet(f"{path}/postings").groupBy("field", "term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))
    t.sortWithinPartitions("field", "term").write.partitionBy("field").parquet(f"{path}/terms")
    t = spark.read.schema(TERMS).parquet(f"{path}/terms")
    return t.where(F.col("field").isin(*text)).groupBy("field").agg(F.sum("cf").alias("sum_len"))


def build(docs: DataFrame, text: dict[str, Analyser] | tuple[str, ...], exact: tuple[str, ...] = (), path: str | None = None) -> Index:
    """Indexes docs (doc_id and other columns) and opens the result; path: where
    the tables go, else a folder that all executors share. A null text has length
    0; rows without a doc_id aren't indexed."""
    if not isinstance(text, dict):
        text = {f: standard_analyser() for f in text}
    path = path or shared_folder(docs.sparkSession)
    docs = docs.where("doc_id is not null")
    n = docs.count()
    lengths = {r.field: r.sum_len for r in write_postings(docs, text, exact, path, n).collect()}  # a row for each field
    return open_index(docs, path, text, n, lengths)


def open_index(docs: DataFrame, path: str, text: dict[str, Analyser], n_docs: int, lengths: dict[str, int]) -> Index:
    """The index whose tables are at path; lengths: tokens of each text field."""
    spark = docs.sparkSession
    p = spark.read.schema(POSTINGS).parquet(f"{path}/postings")
    t = spark.read.schema(TERMS).parquet(f"{path}/terms")
    return Index(docs, p, t, n_docs, averages(text, n_docs, lengths), text)


def averages(text: dict[str, Analyser], n_docs: int, lengths: dict[str, int]) -> dict[str, float]:
    """The mean length of each text field; none of no documents."""
    return {f: lengths.get(f, 0) / n_docs for f in text} if n_docs else {}
