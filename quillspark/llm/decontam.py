"""Benchmark decontamination over a distributed positional inverted index.

Training texts are read once; for each slice of them the index stores, by term of
the test vocabulary, postings of (document, position). Document
frequencies come from the index. A test item is cut into blocks so short that any
match leaves one of them as it is. Of each block the rarest term's postings,
shifted by its offset, give the places where the item could start; those of the
second rarest, shifted likewise, must agree. A slice's row of the index has all of an
item's words in its documents, so there, without texts, an exact phrase of `WINDOW` words
or more is told from a passage most of whose words are near.

Items are taken in parts of at most `PART_BYTES` of terms and anchors, which go to all
executors; a benchmark of several parts is a pass over the texts for each.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop_rows, list_array, materialize, pick, slices, text_buffers, words

#: Words of an exact phrase; the least words of an item; shift and share of words of a proximity match.
WINDOW, LEAST_WORDS, SLOP, SHARE = 8, 5, 3, 0.8
PART_BYTES = 64 << 20
#: Bytes of a word of an item and of an anchor on the executors.
_WORD_BYTES, _ANCHOR_BYTES = 16, 40


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        h, first = words(*text_buffers(batch.column(1)))
        yield pa.record_batch([batch.column(0), list_array(h.view(np.int64), first, pa.int64())], ["item_id", "terms"])


_INDEX = "terms bigint, n_docs bigint, ends int, docs int, positions int, ids bigint, hashes bigint"
INDEX = ", ".join("{} array<{}>".format(*c.split()) for c in _INDEX.split(", "))


def _indexer(vocabulary):
    """A row for each slice of texts: its terms in order, in how many documents each
    is, where its postings end, the postings (docs, positions), docs being places in
    the last columns, the rows' ids and hashes of their texts: two texts under one id
    stay apart. vocabulary: a broadcast sorted array."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = vocabulary.value
        for batch in batches:
            ids, hashes = np.asarray(batch.column(0)), np.asarray(batch.column(1))
            buf, offs = text_buffers(batch.column(2))
            for i, j, part, at in slices(buf, offs):
                h, first = words(part, at)
                h = h.view(np.int64)
                where = np.minimum(np.searchsorted(known, h), len(known) - 1)
                hit = np.flatnonzero(known[where] == h)
                if not len(hit):
                    continue
                row = np.searchsorted(first, hit, "right") - 1
                t = h[hit]
                order = np.argsort(t, kind="stable")
                t, row, place = t[order], row[order], (hit - first[row]).astype(np.int32)[order]
                start = np.flatnonzero(np.r_[True, t[1:] != t[:-1]])
                fresh = np.r_[True, (row[1:] != row[:-1]) | (t[1:] != t[:-1])]
                columns = [t[start], np.add.reduceat(fresh, start).astype(np.int64), np.r_[start[1:], len(t)].astype(np.int32), row.astype(np.int32), place, ids[i:j], hashes[i:j]]
                types = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64()]
                yield pa.record_batch([list_array(c, np.array([0, len(c)]), k) for c, k in zip(columns, types)], [c.split()[0] for c in _INDEX.split(", ")])

    return run


def build_index(docs: DataFrame, test_terms: DataFrame) -> DataFrame:
    """The positional index of docs (see INDEX), a row for each slice of texts, for
    the terms of test_terms (term), which are broadcast. Rows with a null doc_id have none."""
    known = docs.sparkSession.sparkContext.broadcast(np.array(sorted(r[0] for r in test_terms.collect()), np.int64))
    x = docs.where("doc_id is not null" if len(known.value) else "false").select("doc_id", F.xxhash64("text").alias("h"), "text")
    return materialize(x.mapInArrow(_indexer(known), INDEX))


def block_size(m: Column, share: float, window: int) -> Column:
    """The most words, 4 at most, in blocks of which an item of m words has more
    than words that may differ, and of which a phrase of window words holds a whole
    one; so that a match leaves some block as it is."""
    differ = F.floor((1 - share) * m + 1e-9)
    fits = lambda n: (F.floor(m / n) > differ) & F.lit(2 * n - 1 <= window)
    return F.when(fits(4), 4).when(fits(3), 3).when(fits(2), 2).otherwise(1)


def rarest_terms(items: DataFrame, index: DataFrame, share: float = SHARE, window: int = WINDOW) -> DataFrame:
    """(item, o1, t1, o2, t2): for each block of an item's words the offset and
    hash of its two rarest terms, twice the same of a block of one word. Blocks with a
    term that the index lacks stand nowhere."""
    df = index.select(F.inline(F.arrays_zip("terms", "n_docs"))).groupBy(F.col("terms").alias("term")).agg(F.sum("n_docs").alias("df"))
    at = items.withColumn("size", block_size(F.col("m"), share, window)).select("item", "m", "size", F.posexplode("terms").alias("offset", "term")).join(df, "term")
    x = at.withColumn("block", F.floor(F.col("offset") / F.col("size"))).where(F.col("block") < F.floor(F.col("m") / F.col("size")))
    two = F.slice(F.array_sort(F.collect_list(F.struct("df", "offset", "term"))), 1, 2).alias("two")
    x = x.groupBy("item", "block", "size").agg(two, F.count("*").alias("n")).where(F.col("n") == F.col("size"))
    x = x.select("item", F.get("two", F.lit(0)).alias("a"), F.element_at("two", -1).alias("b"))
    return x.select("item", F.col("a.offset").alias("o1"), F.col("a.term").alias("t1"), F.col("b.offset").alias("o2"), F.col("b.term").alias("t2"))


_FOUND = "doc_id bigint, h bigint, item bigint, kind string, position int, n_words int"


def _intersector(shared, window: int, slop: int, share: float):
    """Rows of the index to matches (see _FOUND): where both lists of an anchor, shifted
    by their offsets, agree, the item is held against the document. A document is in
    one row, so no exchange is needed; nor are texts: the row has all of an item's words in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, (item, o1, t1, o2, t2) = shared.value
        for batch in batches:
            for k in range(batch.num_rows):
                terms, ends, docs, places, ids, hashes = (np.asarray(batch.column(c)[k].values) for c in (0, 2, 3, 4, 5, 6))
                key = (docs.astype(np.int64) << 32) + places  # shifted alike, as starts are above -2^31
                key0 = key
                key = key[np.lexsort((key, np.searchsorted(ends, np.arange(len(key)), "right")))]  # each list in order
                at = [np.minimum(np.searchsorted(terms, t), len(terms) - 1) for t in (t1, t2)]
                first = np.r_[0, ends[:-1]]
                found = []
                for a in np.flatnonzero((terms[at[0]] == t1) & (terms[at[1]] == t2)).tolist():
                    x, y = (key[first[j] : ends[j]] - o for j, o in ((at[0][a], o1[a]), (at[1][a], o2[a])))
                    if len(x) > len(y):
                        x, y = y, x
                    w = np.searchsorted(y, x)
                    both = x[y[np.minimum(w, len(y) - 1)] == x]
                    if len(both):
                        found.append((np.full(len(both), item[a]), both))
                if found:
                    items, both = map(np.concatenate, zip(*found))
                    home = (both + (1 << 31)) >> 32
                    yield from _decided(known, window, slop, share, terms, ends, key0, ids, hashes, items, home, both)

    return run


def _decided(known, window, slop, share, terms, ends, key, ids, hashes, items, home, both) -> Iterator[pa.RecordBatch]:
    """The matches among candidate starts, on documents rebuilt from a row of the index."""
    word = terms[np.searchsorted(ends, np.arange(len(key)), "right")]
    order = np.argsort(key, kind="stable")
    key, word = key[order], word[order]
    starts = both - (home << 32)
    rank = np.lexsort((items, home))
    home, items, starts = home[rank], items[rank], starts[rank]
    cut = np.flatnonzero(np.r_[True, (home[1:] != home[:-1]) | (items[1:] != items[:-1])])
    out, last, doc = [], None, None
    for a, b in zip(cut.tolist(), np.r_[cut[1:], len(home)].tolist()):
        if home[a] != last:
            last = home[a]
            lo, hi = np.searchsorted(key, [last << 32, (last + 1) << 32])
            at = key[lo:hi] - (last << 32)
            doc = np.full(int(at[-1]) + 1, _NO_WORD, np.int64)
            doc[at] = word[lo:hi]
        best = judge(doc, known[int(items[a])], starts[a:b].tolist(), window, slop, share)
        if best:
            out.append((int(ids[last]), int(hashes[last]), int(items[a]), *best))
    if out:
        types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.int32()]
        yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out), types)], [c.split()[0] for c in _FOUND.split(", ")])


#: Stands for words that no item has; a word's hash is this with chance 2^-64.
_NO_WORD = -(1 << 63)


def judge(doc: np.ndarray, item: np.ndarray, starts: list[int], window: int, slop: int, share: float) -> tuple[str, int, int] | None:
    """(kind, position, words) of the best match of an item in a document, given
    the places where it may start: the longest exact phrase if it has min(window,
    length) words, else the most words near, if they're the share."""
    m, phrase, near = len(item), (0, 0), (0, 0)
    for s in sorted(set(starts)):
        lo, hi = max(0, -s), min(m, len(doc) - s)
        if hi > lo:
            same = np.r_[False, doc[s + lo : s + hi] == item[lo:hi], False]
            edge = np.flatnonzero(same[1:] != same[:-1])
            run = edge[1::2] - edge[::2]
            if len(run):
                b = int(run.argmax())
                phrase = max(phrase, (int(run[b]), -(s + lo + int(edge[2 * b]))))
        around = doc[max(0, s - slop) : max(0, s + m + slop)]
        a, b = (dict(zip(*(x.tolist() for x in np.unique(y, return_counts=True)))) for y in (around, item))
        near = max(near, (sum(min(n, a.get(t, 0)) for t, n in b.items()), -max(0, s)))
    if phrase[0] >= min(window, m):
        return "phrase", -phrase[1], phrase[0]
    if near[0] >= share * m:
        return "proximity", -near[1], near[0]
    return None


def _found(docs: DataFrame, benchmark: DataFrame, window: int, least_words: int, slop: int, share: float, part_bytes: int) -> DataFrame:
    """(doc_id, h, item_id, kind, position, n_words) of every text and item that match; h is the text's hash."""
    if window < 1 or least_words < 1 or slop < 0 or not 0 < share <= 1:
        raise ValueError("window and least_words are at least 1, slop at least 0, share above 0 and at most 1")
    spark = docs.sparkSession
    items = pick(benchmark, "item_id", "text").where("item_id is not null").mapInArrow(_tokens, "item_id bigint, terms array<bigint>")
    items = items.withColumn("m", F.size("terms")).where(F.col("m") >= least_words).distinct()
    items = materialize(items.withColumn("item", F.monotonically_increasing_id()))
    total = items.agg(F.coalesce(F.sum("m"), F.lit(0))).first()[0] * (_WORD_BYTES + _ANCHOR_BYTES)  # an anchor a word at most
    parts, made = 1 + total // part_bytes, []
    for k in range(parts):
        own = items.where(F.pmod(F.xxhash64("item"), F.lit(parts)) == k)
        index = build_index(docs, own.select(F.explode("terms").alias("term")).distinct())
        got = rarest_terms(own, index, share, window).toArrow()
        known = {r.item: np.array(r.terms, np.int64) for r in own.select("item", "terms").collect()}
        shared = spark.sparkContext.broadcast((known, [np.asarray(got[c]) for c in ("item", "o1", "t1", "o2", "t2")]))
        made.append(index.mapInArrow(_intersector(shared, window, slop, share), _FOUND))
    found = reduce(DataFrame.union, made)
    return found.join(F.broadcast(items.select("item", "item_id")) if parts == 1 else items.select("item", "item_id"), "item").drop("item")


def matches(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, least_words: int = LEAST_WORDS, slop: int = SLOP, share: float = SHARE, part_bytes: int = PART_BYTES) -> DataFrame:
    """(doc_id, item_id, kind, position, n_words): every document that holds a
    benchmark item: kind phrase if `window` of its words (all of a shorter item)
    stand there in a row, with the longest such run's word position and length;
    kind proximity if `share` of its words stand within its length, give or take
    `slop`, of a place where a block of it (its two rarest words, at least) stands;
    with no more than 1 - share of its words changed, dropped or put in, one does.

    Words are runs of letters and digits, lower-cased. Items of fewer than
    least_words words, and null items, match nothing; neither do rows with a null
    doc_id or text. Repeated rows give one match; of one doc_id or item_id with several
    texts the best. Empty tables give no rows; other columns aren't read.
    window, least_words, slop and share out of range raise a ValueError."""
    found = _found(docs, benchmark, window, least_words, slop, share, part_bytes)
    best = F.min(F.struct("kind", (-F.col("n_words")).alias("n"), "position")).alias("best")
    return found.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "best.kind", "best.position", (-F.col("best.n")).alias("n_words"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, least_words: int = LEAST_WORDS, slop: int = SLOP, share: float = SHARE, part_bytes: int = PART_BYTES) -> DataFrame:
    """docs without the texts that hold a benchmark item. Rows are told by doc_id and
    text: another text under the same doc_id stays, and so do rows with a null doc_id
    or text. Empty tables change nothing; other columns are kept as they are."""
    found = _found(docs, benchmark, window, least_words, slop, share, part_bytes)
    return drop_rows(docs, materialize(found.select("doc_id", "h").distinct()))


_SQL_WORDS = "regexp_extract_all(lower(text), '[0-9a-z\\x{80}-\\x{10FFFF}]+')"
#: Matches by the definition: starts from each block's two rarest words, runs as islands of equal words, shares as multisets in a window.
SQL = f"""
with docs as (select doc_id, {_SQL_WORDS} as ws from documents where doc_id is not null and text is not null),
d as (select doc_id, unnest(ws) as w, unnest(range(len(ws))) as p from docs),
items as (select distinct item_id, ws, len(ws) as m, floor({1 - SHARE:.10f} * len(ws) + 1e-9) as differ from (select item_id, {_SQL_WORDS} as ws from benchmark where item_id is not null and text is not null) where len(ws) >= {LEAST_WORDS}),
sized as (select *, case when m // 4 > differ then 4 when m // 3 > differ then 3 when m // 2 > differ then 2 else 1 end as size from items),
it as (select item_id, m, size, unnest(ws) as w, unnest(range(m)) as o from sized),
df as (select w, count(distinct doc_id) as df from d where w in (select w from it) group by w),
placed as (select item_id, size, o, w, o // size as block, df from it join df using (w) where o // size < m // size),
ranked as (select *, row_number() over (partition by item_id, block order by df, o) as r, count(*) over (partition by item_id, block) as n from placed),
anchors as (select a.item_id, a.o as o1, a.w as w1, coalesce(b.o, a.o) as o2, coalesce(b.w, a.w) as w2 from ranked a left join ranked b on a.item_id = b.item_id and a.block = b.block and b.r = 2 where a.r = 1 and a.n = a.size),
starts as (select distinct x.doc_id, item_id, x.p - o1 as s from anchors join d x on x.w = w1 join d y on y.doc_id = x.doc_id and y.w = w2 and y.p = x.p - o1 + o2),
equal_ as (select doc_id, item_id, s, o, o - row_number() over (partition by doc_id, item_id, s order by o) as island from starts join it using (item_id) join d using (doc_id) where d.p = s + o and d.w = it.w),
runs as (select doc_id, item_id, s + min(o) as p, count(*) as n from equal_ group by doc_id, item_id, s, island),
phrase as (select doc_id, item_id, max({{'n': n, 'q': -p}}) as best from runs group by doc_id, item_id),
want as (select item_id, w, count(*) as c from it group by item_id, w),
have as (select doc_id, item_id, s, w, count(*) as c from starts join items using (item_id) join d using (doc_id) where p >= s - {SLOP} and p < s + m + {SLOP} group by all),
near as (select doc_id, item_id, s, sum(least(h.c, want.c))::bigint as n from have h join want using (item_id, w) group by doc_id, item_id, s),
closest as (select doc_id, item_id, max({{'n': n, 'q': -greatest(0, s)}}) as best from near group by doc_id, item_id)
select doc_id, item_id, case when phrase.best.n >= least({WINDOW}, m) then 'phrase' else 'proximity' end as kind,
  (case when phrase.best.n >= least({WINDOW}, m) then -phrase.best.q else -closest.best.q end)::int as position,
  (case when phrase.best.n >= least({WINDOW}, m) then phrase.best.n else closest.best.n end)::int as n_words
from closest join items using (item_id) left join phrase using (doc_id, item_id)
where phrase.best.n >= least({WINDOW}, m) or closest.best.n >= {SHARE} * m"""
