"""Quality rules: n-gram perplexity under a modified Kneser-Ney model.

Spark counts the character n-grams of every document by language (numpy counts
each slice, the shuffle sums). Lower orders have the usual continuation counts,
or plain counts after the start of a text; three discounts for each language and
order come from the counts of counts; orders are interpolated down to a uniform
distribution over the language's characters. The model is stored as arrays sorted
by n-gram hash, with a directory over the leading bits, in shards of about
`SHARD_BYTES` by language and the character before the last: all that a character's
probability rests on is in one shard. Each shard goes to all executors for a pass over
the texts, and the passes' sums are added; one shard is the same plan.

No text is scored by its own counts: texts fall into two halves by hash, copies
into the same, and each half is scored by the other's model. What a text repeats
of itself is counted by a cache: given its context, a character is drawn from an
urn of CACHE parts of the model and one of each character that followed before.
Of each language the documents' log-perplexities give a median, a spread, and how
the spread grows in short texts; a document outside that band is rejected.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, mix, pick, sized_broadcast, slices, text_buffers

ORDER = 5
#: Half-width of the band in robust standard deviations; characters of a text that the spread is measured on.
WIDTH, LEAST_CHARS = 4.0, 200
#: Weight of the model against what a text repeats of itself, in occurrences.
CACHE = 10.0
#: Bytes of a shard of the model, about; and of one entry.
SHARD_BYTES, _ENTRY = 128 << 20, 12
BOS = "\x02"
#: Text handled at once where n-grams are counted, and where they're scored beside a shard.
_COUNT_BYTES, _SCORE_BYTES = 3 << 20, 1 << 20
#: Entries of a table of ranks, beyond which codes are sorted; counts that a task holds.
_TABLE, _HELD = 1 << 25, 1 << 20


def _characters(part: np.ndarray, at: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(code points with order-1 marks before each row, places of the real ones, first of them in each row)."""
    text = np.frombuffer(part.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    ends = np.r_[0, np.cumsum((part & 0xC0) != 0x80)][at]
    pad = order - 1
    row = np.repeat(np.arange(len(ends) - 1), np.diff(ends))
    place = np.arange(len(text)) + pad * (row + 1)
    out = np.full(len(text) + pad * (len(ends) - 1), ord(BOS), np.uint32)
    out[place] = np.where((text == 0) | (text == ord(BOS)), 0xFFFD, text)
    return out, place, ends


def _dense(code: np.ndarray, size: int) -> tuple[np.ndarray, int]:
    """Codes below size as ranks among those that occur, and how many do."""
    if size <= _TABLE:
        seen = np.zeros(size, bool)
        seen[code] = True
        kinds = np.flatnonzero(seen)
        rank = np.empty(size, np.int32)
        rank[kinds] = np.arange(len(kinds), dtype=np.int32)
        return rank[code], len(kinds)
    kinds, rank = np.unique(code, return_inverse=True)
    return rank.astype(np.int32), len(kinds)


def _ranks(chars: np.ndarray, place: np.ndarray, base: np.ndarray, order: int) -> tuple[np.ndarray, int, np.ndarray, int]:
    """Of each place the rank of its n-gram among those of the slice, how many there are, and
    the same of the context before it. base: small numbers that keep languages apart.
    Built up a character at a time, without a hash or a sort."""
    symbol, width = _dense(chars, 0x110000)
    rank, kinds = base.astype(np.int32), int(base.max()) + 1
    before = rank, kinds
    for n in range(order):
        before = rank, kinds
        last = rank if n == 0 else np.r_[rank[:1], rank[:-1]]
        if kinds * width > _TABLE:
            last = last.astype(np.int64)
        rank, kinds = _dense(last * width + symbol, kinds * width)
    return rank[place], kinds, before[0][place - 1], before[1]


def _spread(chars: np.ndarray, ends: np.ndarray, values: np.ndarray, order: int) -> np.ndarray:
    """A row's value at each of its characters and marks."""
    return np.repeat(values, np.diff(ends) + order - 1)


def _counter(order: int):
    """Rows (lang, text) to counts (lang, gram, n) of a task, or of a part of it with many n-grams."""

    def merged(parts: list[tuple]) -> tuple:
        key, lang, grams, n = (np.concatenate(x) for x in zip(*parts))
        key, first, inverse = np.unique(key, return_index=True, return_inverse=True)
        return key, lang[first], grams[first], np.bincount(inverse, n, len(key)).astype(np.int64)

    def out(part: tuple, names: list[str]) -> pa.RecordBatch:
        _, lang, grams, n = part
        text = np.ascontiguousarray(grams).view(f"<U{order}").ravel()
        return pa.record_batch([pa.array(names, pa.string()).take(pa.array(lang)), pa.array(text.tolist(), pa.string()), pa.array(n)], ["lang", "gram", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names: dict[str, int] = {}
        held: list[tuple] = []
        for batch in batches:
            lang = batch.column(0).to_pylist()
            buf, offs = text_buffers(batch.column(1), lower=False)
            for i, j, part, at in slices(buf, offs, _COUNT_BYTES):
                chars, place, ends = _characters(part, at, order)
                if not len(place):
                    continue
                own = np.array([names.setdefault(x, len(names)) for x in lang[i:j]], np.int64)
                rank, kinds, _, _ = _ranks(chars, place, _spread(chars, ends, own, order), order)
                some = np.empty(kinds, np.int64)
                some[rank] = np.arange(len(place))
                n = np.bincount(rank, minlength=kinds)
                some, n = some[n > 0], n[n > 0]
                which = np.repeat(own, np.diff(ends))[some]
                key = gram_hash(chars, place[some], order, mix(which.astype(np.uint64) + np.uint64(1)))
                held.append((key, which, chars[place[some][:, None] + np.arange(1 - order, 1)], n))
                if sum(len(x[0]) for x in held) > _HELD:
                    held = [merged(held)]
                    if len(held[0][0]) > _HELD // 2:
                        yield out(held.pop(), list(names))
        if held:
            yield out(merged(held), list(names))

    return run


def gram_hash(chars: np.ndarray, place: np.ndarray, n: int, seed: np.ndarray | np.uint64) -> np.ndarray:
    """Hash of the n characters up to each place, under a language's seed."""
    h = np.zeros(len(place), np.uint64) + seed
    for k in range(n):
        h = (h ^ chars[place - (n - 1 - k)].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return mix(h)


def seed_of(lang: str) -> np.uint64:
    import xxhash

    return np.uint64(xxhash.xxh3_64_intdigest(lang.encode()))


def top_counts(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """(lang, gram, n) of all documents; a null language counts as ''."""
    x = docs.select(F.coalesce("lang", F.lit("")).alias("lang"), "text")
    return x.mapInArrow(_counter(order), "lang string, gram string, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def _discount(c: Column) -> Column:
    return F.when(c == 1, F.col("d1")).when(c == 2, F.col("d2")).otherwise(F.col("d3"))


def kneser_ney(top: DataFrame, order: int = ORDER) -> DataFrame:
    """(lang, size, gram, p, g) for the n-grams of all orders: p the interpolated
    probability of the last character after the others, g the weight that the
    gram, as a context, gives to the next lower order (1 if it's none)."""
    tables = {order: top.select("lang", "gram", F.col("n").alias("raw"), F.col("n").alias("c"))}
    for n in range(order - 1, 0, -1):
        up = tables[n + 1]
        t = up.groupBy("lang", F.substring("gram", 2, n).alias("gram")).agg(F.sum("raw").alias("raw"), F.count("*").alias("types"))
        tables[n] = materialize(t.select("lang", "gram", "raw", F.when(F.substring("gram", 1, 1) == BOS, F.col("raw")).otherwise(F.col("types")).alias("c")))
    probability, weights = None, {}
    for n in range(1, order + 1):
        t = tables[n]
        k = [F.sum((F.col("c") == i).cast("double")) for i in (1, 2, 3, 4)]
        d = t.groupBy("lang").agg(*(x.alias(f"t{i}") for i, x in enumerate(k, 1))).withColumn("y", F.try_divide(F.col("t1"), F.col("t1") + 2 * F.col("t2")))
        usable = (F.col("t1") > 0) & (F.col("t2") > 0) & (F.col("t3") > 0) & (F.col("t4") > 0)
        for i, plain in ((1, 0.5), (2, 1.0), (3, 1.5)):
            value = F.lit(float(i)) - (i + 1) * F.col("y") * F.try_divide(F.col(f"t{i + 1}"), F.col(f"t{i}"))
            d = d.withColumn(f"d{i}", F.when(usable & (value > 0) & (value < i), value).otherwise(F.lit(plain)))
        d = materialize(d.select("lang", "d1", "d2", "d3"))
        x = t.join(sized_broadcast(d), "lang").withColumn("context", F.substring("gram", 1, n - 1) if n > 1 else F.lit(""))
        context = x.groupBy("lang", "context").agg(F.sum("c").alias("total"), F.sum(_discount(F.col("c"))).alias("freed"), F.count("*").alias("kinds"))
        context = context.withColumn("g", F.col("freed") / F.col("total"))
        x = x.join(context, ["lang", "context"]).withColumn("lower", F.substring("gram", 2, n - 1) if n > 1 else F.lit(""))
        own = (F.col("c") - _discount(F.col("c"))) / F.col("total")
        if n == 1:
            p = x.withColumn("p", own + F.col("g") / (F.col("kinds") + 1))  # one more for characters not seen
        else:
            below = probability.select("lang", F.col("gram").alias("lower"), F.col("p").alias("q"))
            p = x.join(below, ["lang", "lower"]).withColumn("p", own + F.col("g") * F.col("q"))
        probability = materialize(p.select("lang", "gram", "p"))
        weights[n - 1] = materialize(context.select("lang", F.col("context").alias("gram"), "g", "kinds"))
        tables[f"p{n}"] = probability
    parts = []
    for n in range(order + 1):
        have = tables[f"p{n}"] if n else None
        if n == 0:
            x = weights[0].select("lang", F.lit(0).alias("size"), "gram", (1 / (F.col("kinds") + 1)).alias("p"), "g")
        elif n == order:
            x = have.select("lang", F.lit(n).alias("size"), "gram", "p", F.lit(1.0).alias("g"))
        else:  # contexts that are never a gram, as they end in marks, have a weight only
            x = have.join(weights[n].select("lang", "gram", "g"), ["lang", "gram"], "full").select("lang", F.lit(n).alias("size"), "gram", "p", F.coalesce("g", F.lit(1.0)).alias("g"))
        parts.append(x)
    model = parts[0]
    for x in parts[1:]:
        model = model.union(x)
    return model


@dataclass
class Arrays:
    """One order's n-grams: sorted hashes, a number of each, and where each leading-bits bucket starts."""

    keys: np.ndarray
    values: np.ndarray
    starts: np.ndarray
    shift: int

    @classmethod
    def of(cls, keys: np.ndarray, values: np.ndarray) -> Arrays:
        o = np.argsort(keys)
        keys = keys[o]
        bits = max(1, min(22, int(len(keys)).bit_length()))
        starts = np.searchsorted(keys, np.arange(1 << bits, dtype=np.uint64) << np.uint64(64 - bits)).astype(np.int32)
        return cls(keys, values[o], starts, 64 - bits)

    def find(self, h: np.ndarray) -> np.ndarray:
        """Index of each hash, or -1."""
        if not len(self.keys):
            return np.full(len(h), -1, np.int64)
        last = len(self.keys) - 1
        at = np.minimum(self.starts[(h >> np.uint64(self.shift)).astype(np.int64)], last).astype(np.int64)
        todo = np.flatnonzero(self.keys[at] < h)
        while len(todo):
            at[todo] += 1
            todo = todo[at[todo] <= last]
            todo = todo[self.keys[at[todo]] < h[todo]]
        at[at > last] = last
        return np.where(self.keys[at] == h, at, -1)


@dataclass
class Shard:
    """By order the log p of n-grams, and the log weights of contexts."""

    p: list[Arrays]
    g: list[Arrays]


_HASHED = "shard int, context boolean, size int, key bigint, value float"


def _hasher(order: int, shards: int):
    """Rows (lang, size, gram, p, g) to entries (see _HASHED): an n-gram is in the
    shard of its last character but one, a context in that of its last; shorter ones are in all (-1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang, size = batch.column(0).dictionary_encode(), np.asarray(batch.column(1)).astype(np.int64)
            seeds = np.array([seed_of(x) for x in lang.dictionary.to_pylist()], np.uint64)[np.asarray(lang.indices)]
            chars = np.frombuffer("".join(batch.column(2).to_pylist()).encode("utf-32-le", "surrogatepass"), np.uint32)
            ends = np.cumsum(size)
            keys = np.empty(len(size), np.uint64)
            for n in np.unique(size).tolist():
                own = size == n
                keys[own] = gram_hash(chars, ends[own] - 1, n, seeds[own])
            for context, column in ((False, 3), (True, 4)):
                values = np.asarray(batch.column(column).fill_null(np.nan))
                least = 1 if context else 2  # characters that tell the shard
                own = np.flatnonzero(size < order if context else ~np.isnan(values))
                shard = np.full(len(own), -1, np.int32)
                long = size[own] >= least
                at = own[long]
                shard[long] = cell(chars, ends[at] - least, seeds[at], shards)
                with np.errstate(divide="ignore"):
                    logs = np.log(values[own]).astype(np.float32)
                yield pa.record_batch([pa.array(shard), pa.array(np.full(len(own), context)), pa.array(size[own].astype(np.int32)), pa.array(keys[own].view(np.int64)), pa.array(logs)], [c.split()[0] for c in _HASHED.split(", ")])

    return run


def cell(chars: np.ndarray, place: np.ndarray, seeds: np.ndarray, shards: int) -> np.ndarray:
    """The shard of texts whose last character but one stands at a place."""
    return (gram_hash(chars, place, 1, seeds) % np.uint64(shards)).astype(np.int32)


def hashed(model: DataFrame, order: int = ORDER, shard_bytes: int = SHARD_BYTES) -> tuple[DataFrame, int]:
    """(entries, shards): the model hashed on the executors, and into how many shards."""
    shards = 1 + 2 * _ENTRY * model.count() // shard_bytes
    return materialize(model.select("lang", "size", "gram", "p", "g").mapInArrow(_hasher(order, shards), _HASHED)), shards


def load_shard(entries: DataFrame, k: int, order: int = ORDER) -> Shard:
    """A shard's arrays, gathered on the driver to be broadcast; its size is bounded by SHARD_BYTES, about."""

    def gathered(context: bool, sizes: int) -> list[Arrays]:
        got = entries.where(F.col("shard").isin(-1, k) & (F.col("context") == context)).select("size", "key", "value").toArrow()
        size, key, value = (np.asarray(got[c]) for c in ("size", "key", "value"))
        del got
        return [Arrays.of(key[size == n].view(np.uint64), value[size == n]) for n in range(sizes)]

    return Shard(gathered(False, order + 1), gathered(True, order))


def log_probabilities(shard: Shard, chars: np.ndarray, place: np.ndarray, seeds: np.ndarray, order: int) -> np.ndarray:
    """log p of the character at each place, backing off where an n-gram is unknown."""
    out = np.zeros(len(place))
    todo = np.arange(len(place))
    for n in range(order, -1, -1):
        at = shard.p[n].find(gram_hash(chars, place[todo], n, seeds[todo]))
        hit = at >= 0
        out[todo[hit]] += shard.p[n].values[at[hit]]
        todo = todo[~hit]
        if not len(todo):
            break
        if n == 0:
            out[todo] += np.log(1e-7)  # a language that the model lacks
            break
        lower = shard.g[n - 1].find(gram_hash(chars, place[todo] - 1, n - 1, seeds[todo]))
        known = lower >= 0
        out[todo[known]] += shard.g[n - 1].values[lower[known]]
    return out


def _lgamma(x, log):
    """Log gamma of positive numbers, of an array or a column: Stirling's series eight places up."""
    y, product = x + 8.0, x
    for k in range(1, 8):
        product = product * (x + float(k))
    return (y - 0.5) * log(y) - y + 0.9189385332046727 + 1 / (12 * y) - 1 / (360 * y * y * y) - log(product)


def _runs(row: np.ndarray, rank: np.ndarray, kinds: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, rank, occurrences) of each row's distinct ranks."""
    bits = int(kinds).bit_length()
    small = not len(row) or int(row[-1] + 1) << bits < 1 << 31  # rows are in order
    key = np.sort(row.astype(np.int32 if small else np.int64) << bits | rank)
    start = np.flatnonzero(np.r_[len(key) > 0, key[1:] != key[:-1]][: len(key)])
    key = key[start]
    return key >> bits, key & ((1 << bits) - 1), np.diff(np.r_[start, len(row)])


_SUMS = "doc_id bigint, lang string, h bigint, once bigint, n bigint, t double, l1 double, l2 double"


def _scorer(shared, k: int, shards: int, order: int, cache: float):
    """Rows (doc_id, lang, h, text) to a shard's part of their sums (see _SUMS)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = shared.value
        seeds: dict[str, np.uint64] = {}
        for batch in batches:
            lang = batch.column(1).to_pylist()
            buf, offs = text_buffers(batch.column(3), lower=False)
            for i, j, part, at in slices(buf, offs, _SCORE_BYTES):
                chars, place, ends = _characters(part, at, order)
                for x in set(lang[i:j]) - seeds.keys():
                    seeds[x] = seed_of(x)
                n = np.diff(ends)
                names = {x: r for r, x in enumerate(sorted(set(lang[i:j])))}
                t = l1 = l2 = np.zeros(j - i)
                if len(place):
                    base = _spread(chars, ends, np.array([names[x] for x in lang[i:j]], np.int64), order)
                    rank, kinds, context, contexts = _ranks(chars, place, base, order)
                    row = np.repeat(np.arange(j - i), n)
                    some = np.zeros(kinds, np.int64)
                    some[rank] = np.arange(len(place))
                    own = np.array([seeds[x] for x in names], np.uint64)[base[place[some]]]
                    if shards > 1:
                        here = (cell(chars, place[some] - 1, own, shards) == k)[rank]
                        row, rank, context = row[here], rank[here], context[here]
                    found = log_probabilities(shard, chars, place[some], own, order)
                    at, g, times = _runs(row, rank, kinds)
                    lp = found[g]
                    l1, l2 = (np.bincount(at, times * v, j - i) for v in (lp, lp * lp))
                    t = l1
                    if cache:
                        drawn = np.log(cache) + lp
                        many = np.flatnonzero(times > 1)
                        a = np.exp(drawn[many])
                        drawn[many] = _lgamma(a + times[many], np.log) - _lgamma(a, np.log)
                        t = np.bincount(at, drawn, j - i)
                        at, _, times = _runs(row, context, contexts)
                        rising = np.r_[0.0, np.cumsum(np.log(cache + np.arange(times.max(initial=0))))]
                        t = t - np.bincount(at, rising[times], j - i)
                first = np.full(j - i, int(k == 0))
                columns = [*(batch.column(c).slice(i, j - i) for c in range(3)), *map(pa.array, (first, n * first, t, l1, l2))]
                yield pa.record_batch(columns, [c.split()[0] for c in _SUMS.split(", ")])

    return run


def score(docs: DataFrame, model: DataFrame, order: int = ORDER, cache: float = 0.0, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """(doc_id, lang, n_chars, log_p, squares) of each row of docs (doc_id, lang,
    text); squares: the sum of squares of the model's log p about the row's mean.
    cache: the model's weight against what the row repeats of itself; 0 is the model
    alone. model is materialised. Each shard is a pass over docs; rows that repeat
    doc_id, lang and text are told apart by their number only. A null language is the
    language '', a null or empty text has no characters and sums of 0."""
    entries, shards = hashed(model, order, shard_bytes)
    x = docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("lang"), F.xxhash64("text").alias("h"), "text")
    sums = None
    for k in range(shards):
        shared = docs.sparkSession.sparkContext.broadcast(load_shard(entries, k, order))
        part = materialize(x.mapInArrow(_scorer(shared, k, shards, order, cache), _SUMS))
        shared.destroy()
        sums = part if sums is None else sums.union(part)
    y = sums.groupBy("doc_id", "lang", "h").agg(*(F.sum(c).alias(c) for c in ("once", "n", "t", "l1", "l2")))
    per = lambda c: F.col(c) / F.col("once")
    y = y.select("doc_id", "lang", "once", per("n").cast("bigint").alias("n_chars"), per("t").alias("log_p"), (per("l2") - F.coalesce(F.try_divide(per("l1") * per("l1"), per("n")), F.lit(0.0))).alias("squares"))
    return y.withColumn("once", F.explode(F.sequence(F.lit(1), "once"))).drop("once")


def judge(scores: DataFrame, width: float = WIDTH, least_chars: int = LEAST_CHARS) -> DataFrame:
    """(doc_id, lang, n_chars, perplexity, lower, upper, keep) from scores.

    The variance of log-perplexities is measured on texts of least_chars and more,
    at their median length; what a shorter text has beyond it falls with length,
    at a rate measured on the texts below least_chars. It's never taken as less
    than that of as many independent characters: a language of a few texts has no
    spread to measure."""
    x = scores.withColumn("h", F.try_divide(-F.col("log_p"), F.col("n_chars"))).withColumn("v", F.greatest(F.lit(0.0), F.try_divide("squares", "n_chars")))
    of_long = lambda c: F.when(F.col("n_chars") >= least_chars, c)
    median = lambda c: F.percentile_approx(c, 0.5, 10000)
    mid = x.groupBy("lang").agg(F.coalesce(median(of_long(F.col("h"))), median(F.col("h"))).alias("mid"), F.coalesce(median(of_long(F.col("n_chars"))), F.lit(least_chars)).alias("usual"), F.avg("v").alias("tau"))
    off = x.join(sized_broadcast(materialize(mid)), "lang").withColumn("off", F.abs(F.col("h") - F.col("mid")))
    short = F.when(F.col("n_chars") < least_chars, F.col("off") * F.sqrt("n_chars"))
    spread = off.groupBy("lang").agg(F.coalesce(F.pow(1.4826 * median(of_long(F.col("off"))), 2), F.lit(0.0)).alias("var"), F.coalesce(F.pow(1.4826 * median(short), 2), F.lit(0.0)).alias("rate"))
    y = off.join(sized_broadcast(materialize(spread)), "lang")
    rate = F.greatest("rate", F.col("var") * F.col("usual"))
    more = rate * F.greatest(F.lit(0.0), F.try_divide(F.lit(1.0), F.col("n_chars")) - 1 / F.col("usual"))
    y = y.withColumn("half", width * F.sqrt(F.greatest(F.col("var") + more, F.try_divide("tau", "n_chars"))))
    bound = lambda sign: F.when(F.col("n_chars") > 0, F.exp(F.col("mid") + sign * F.col("half")))
    return y.select("doc_id", "lang", "n_chars", F.exp("h").alias("perplexity"), bound(-1).alias("lower"), bound(1).alias("upper"), F.coalesce(F.col("off") <= F.col("half"), F.lit(True)).alias("keep"))


def _halves(docs: DataFrame) -> DataFrame:
    """docs with the half that a text falls into, and its language with that half (own) and the other (other) as languages."""
    x = docs.withColumn("lang", F.coalesce("lang", F.lit(""))).withColumn("half", F.pmod(F.xxhash64("text"), F.lit(2)))
    key = lambda half: F.concat("lang", F.lit("\x1f"), half.cast("string"))
    return x.withColumn("own", key(F.col("half"))).withColumn("other", key(1 - F.col("half")))


def perplexity_bands(docs: DataFrame, order: int = ORDER, width: float = WIDTH, cache: float = CACHE, shard_bytes: int = SHARD_BYTES, **bands) -> DataFrame:
    """(doc_id, lang, n_chars, perplexity, lower, upper, keep): each document's
    perplexity per character under the model of its language's other half and
    the cache, the band it's held to, and whether it stays.

    A null language is the language ''. If the other half has no text of a
    language, its texts are scored by the model that they're counted in. A null or
    empty text has no perplexity and stays. Repeated rows repeat, and count as
    often; a null doc_id stays null. An empty table gives no rows. Other columns
    aren't read."""
    docs = _halves(pick(docs, "doc_id", "lang", "text"))
    top = materialize(top_counts(docs.select(F.col("own").alias("lang"), "text"), order))
    model = materialize(kneser_ney(top, order))
    known = materialize(model.where("size = 0").select(F.col("lang").alias("other"), F.lit(True).alias("known")))
    docs = docs.join(sized_broadcast(known), "other", "left").select("doc_id", F.when(F.col("known"), F.col("other")).otherwise(F.col("own")).alias("lang"), "text")
    scores = score(docs, model, order, cache, shard_bytes).withColumn("lang", F.regexp_replace("lang", "\x1f[01]$", ""))
    return judge(materialize(scores), width, **bands)
