"""Near duplicates: an n-gram Jaccard self-join over signature trees.

1. One pass over the texts gives each document's set of hashed word n-grams, a
   digest of the set and `bands` MinHash keys of two rows each. Equal sets are one
   *content* from here on: thousands of exact copies cost what one document costs.
2. The upper levels of the trees are keys: contents that share a band's key stand
   in one subtree, and of subtrees with the same members one is kept. A subtree of
   more than `BLOCK` contents is cut into blocks, each pair of blocks a task of its
   own, so a hot key is spread. Only the texts in subtrees are read again.
3. The lower levels are built in a task: leaves hold runs of contents ordered by
   size, nodes the OR of their bitmaps, the range of their sizes and the largest
   number of n-grams hidden by bitmap collisions. A dual traversal of two blocks
   drops every pair of nodes whose greatest possible overlap is too small for the
   threshold; what remains is verified on the exact sets.
4. A task returns the links counted for each content and a spanning forest of
   them, not the pairs, so that what it returns grows with the contents.

Trees alone can't choose the subtrees: unlike texts share enough n-grams for the OR
of a few hundred of them to meet any other's, so that their upper levels prune
nothing and cost N^2. The keys miss some pairs: at Jaccard j two contents meet with
probability 1 - (1 - j^2)^bands (0.997 at 0.5). They only make the bulk cheap; the rest
is found exactly:

5. Contents of one component of the links so far form a subtree of their own.
6. Contents of two components meet by prefixes of their sets in one order of all
   n-grams, rarest first. Of a pair at the threshold each one's first
   |x| - ceil(t|x|) + k n-grams hold k common ones at least; n-grams of later places
   than such a pair allows don't count. What a sample of the texts tells of
   frequencies only makes the order: any order finds the same pairs.

Verification is exact on 32-bit n-gram hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_rows, grams, materialize, mix, sized_broadcast, slices, small_batches, text_buffers, words
from .graph import components

N, THRESHOLD, BANDS, BLOCK = 3, 0.5, 20, 1024
#: Texts whose n-grams are counted to order n-grams; n-grams ordered by count; labels sent to tasks. They change cost only.
ORDER_TEXTS, ORDER_GRAMS, LABELS = 1 << 16, 1 << 20, 1 << 22
#: Prefix entries of a part, about; those that a task holds before it passes them on, and as many for each part; pairs made at once.
_ENTRIES, _HELD, _EACH, _PAIRS = 1 << 20, 1 << 18, 64, 1 << 20
_LEAF, _FAN = 16, 8
#: Bitmaps that are compared at once.
_BITMAP_BYTES = 4 << 20

_rng = np.random.default_rng(20240229)
_MUL = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_ADD = _rng.integers(0, 1 << 63, 256, dtype=np.uint64)


def _digest(s: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(s.tobytes())


def _band_keys(sets: list[np.ndarray], bands: int) -> np.ndarray:
    """MinHash keys, a row for each non-empty set."""
    flat = np.concatenate(sets)
    flat ^= flat >> np.uint64(31)
    at = np.r_[0, np.cumsum([len(s) for s in sets])[:-1]]
    keys = np.empty((len(sets), bands), np.uint64)
    for b in range(bands):
        m = [np.minimum.reduceat(flat * _MUL[i] + _ADD[i], at) for i in (2 * b, 2 * b + 1)]
        keys[:, b] = mix(m[0] * np.uint64(0x9E3779B97F4A7C15) + m[1] + np.uint64(b))
    return keys.view(np.int64)


def _cid(s: np.ndarray) -> int:
    return int.from_bytes(_digest(s)[:8], "little", signed=True)


def _sketcher(n: int, bands: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, offs = text_buffers(batch.column(2))
            for i, j, part, at in slices(buf, offs):
                sets = grams(*words(part, at), n)
                some = [s for s in sets if len(s)]
                keys = _band_keys(some, bands).ravel() if some else np.zeros(0, np.int64)
                size = np.array([len(s) for s in sets], np.int32)
                yield pa.record_batch(
                    [
                        batch.column(0).slice(i, j - i),
                        batch.column(1).slice(i, j - i),
                        pa.array([_digest(s) if len(s) else None for s in sets], pa.binary()),
                        pa.array([_cid(s) if len(s) else None for s in sets], pa.int64()),
                        pa.array(size),
                        pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum((size > 0) * bands)], pa.int32()), pa.array(keys)),
                    ],
                    ["doc_id", "h", "content", "cid", "size", "keys"],
                )

    return run


def sketches(docs: DataFrame, n: int = N, bands: int = BANDS) -> DataFrame:
    """(doc_id, h, content, cid, size, keys) of each row of docs with a doc_id: h is the text's
    64-bit hash; content the digest of its set, null if it has no word; cid its first 8 bytes."""
    x = docs.where("doc_id is not null").select("doc_id", F.xxhash64("text").alias("h"), "text")
    return x.mapInArrow(_sketcher(n, bands), "doc_id bigint, h bigint, content binary, cid bigint, size int, keys array<bigint>")


def _setter(n: int):
    """Rows (text, content, ...) with the set's n-grams in the text's place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, offs = text_buffers(batch.column(0))
            for i, j, part, at in slices(buf, offs):
                raw = [np.unique(s.astype(np.uint32)).tobytes() for s in grams(*words(part, at), n)]
                yield pa.record_batch([pa.array(raw, pa.binary()), *(c.slice(i, j - i) for c in batch.columns[1:])], ["grams", *batch.schema.names[1:]])

    return run


# --- signature tree


class Tree:
    """Levels of nodes over sets sorted by size; level 0 is the sets themselves."""

    def __init__(self, sets: list[np.ndarray], most: int):
        """most: the size that the bitmaps' width suits, alike for trees that meet."""
        size = np.array([len(s) for s in sets], np.int64)
        width = 1 << int(min(16, max(8, np.ceil(np.log2(4 * most)))))
        bits = np.zeros((len(sets), width // 64), np.uint64)
        for k, s in enumerate(sets):
            x = s.astype(np.uint64) * np.uint64(0x9E3779B1) & np.uint64(width - 1)
            np.bitwise_or.at(bits[k], (x >> np.uint64(6)).astype(np.int64), np.uint64(1) << (x & np.uint64(63)))
        hidden = size - np.bitwise_count(bits).sum(1)
        self.levels = [(bits, size, size, hidden)]
        self.fans = []
        while len(self.levels[-1][0]) > 1:
            bits, least, most, hidden = self.levels[-1]
            fan = _LEAF if len(self.levels) == 1 else _FAN
            at = np.arange(0, len(bits), fan)
            self.levels.append((np.bitwise_or.reduceat(bits, at), np.minimum.reduceat(least, at), np.maximum.reduceat(most, at), np.maximum.reduceat(hidden, at)))
            self.fans.append(fan)

    def survive(self, level: int, a: np.ndarray, other: Tree, at: int, b: np.ndarray, threshold: float) -> np.ndarray:
        """Whether nodes a, and nodes b of another tree, may hold a pair of at least the threshold."""
        bits, least, most, hidden = self.levels[level]
        bits2, least2, most2, hidden2 = other.levels[at]
        ok, some = np.empty(len(a), bool), max(1, _BITMAP_BYTES // (8 * bits.shape[1]))
        for s in range(0, len(a), some):
            x, y = a[s : s + some], b[s : s + some]
            common = np.bitwise_count(bits[x] & bits2[y]).sum(1).astype(np.int64) + np.minimum(hidden[x], hidden2[y])
            common = np.minimum(common, np.minimum(most[x], most2[y]))
            # of any two sets in reach: overlap >= t / (1 + t) * (sum of sizes); a smaller one of size >= t times the larger
            need = threshold / (1 + threshold) * (least[x] + least2[y])
            ok[s : s + some] = (common >= need - 1e-9) & (most[x] >= threshold * least2[y] - 1e-9) & (most2[y] >= threshold * least[x] - 1e-9)
        return ok


def _children(nodes: np.ndarray, fan: int, count: int) -> np.ndarray:
    kids = nodes[:, None] * fan + np.arange(fan)
    return np.where(kids < count, kids, -1)


def tree_pairs(one: Tree, two: Tree | None, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of a set of one and a set of two (without two: of one's, a < b) that the bounds can't rule out."""
    same = two is None
    two = one if same else two
    top = (len(one.levels) - 1, len(two.levels) - 1)
    stack = [(*top, np.zeros(1, np.int64), np.zeros(1, np.int64))]
    while stack:
        m, n, a, b = stack.pop()
        if same and not m and not n:
            a, b = a[a < b], b[a < b]
        ok = one.survive(m, a, two, n, b, threshold)
        a, b = a[ok], b[ok]
        if not m and not n:
            if len(a):
                yield a, b
            continue
        down = (m > 0 and m >= n, n > 0 and n >= m)  # the taller tree first, both if they're alike
        for s in range(0, len(a), 2048):
            x, y = a[s : s + 2048, None], b[s : s + 2048, None]
            if down[0]:
                x = _children(x[:, 0], one.fans[m - 1], len(one.levels[m - 1][0]))
            if down[1]:
                y = _children(y[:, 0], two.fans[n - 1], len(two.levels[n - 1][0]))
            u, v = np.broadcast_arrays(x[:, :, None], y[:, None, :])
            u, v = u.reshape(-1), v.reshape(-1)
            mask = (u >= 0) & (v >= 0)
            if same:
                mask &= u <= v  # of one pair of nodes, each pair of children once
            stack.append((m - down[0], n - down[1], u[mask], v[mask]))


def group_links(keys: np.ndarray, sets: list[np.ndarray], own: np.ndarray, copies: np.ndarray, band: int, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """(links, root) of a subtree's contents, or of two of its blocks (own tells
    which): the documents linked to each here, and the least place that its links lead
    to. A pair that also shares an earlier band's key belongs to that band's subtree."""
    size = np.array([len(s) for s in sets])
    order = np.argsort(size, kind="stable")
    sides = [order[own[order] == k] for k in np.unique(own)]
    trees = [Tree([sets[k] for k in x], int(size.max())) for x in sides]
    links, root = np.zeros(len(sets), np.int64), np.arange(len(sets))

    def top(k: int) -> int:
        while root[k] != k:
            root[k] = root[root[k]]
            k = root[k]
        return k

    for a, b in tree_pairs(trees[0], trees[1] if len(trees) > 1 else None, threshold):
        a, b = sides[0][a], sides[-1][b]
        first = ~(keys[a, :band] == keys[b, :band]).any(1)
        for i, j in zip(a[first].tolist(), b[first].tolist()):
            x, y = sets[i], sets[j]
            both = np.concatenate((x, y))
            both.sort(kind="stable")
            o = int((both[1:] == both[:-1]).sum())
            if o >= threshold * (len(both) - o):
                links[i] += copies[j]
                links[j] += copies[i]
                p, q = sorted((top(i), top(j)))
                root[q] = p
    return links, np.array([top(k) for k in range(len(sets))])


def _joiner(threshold: float):
    schema = pa.schema([("a", pa.binary()), ("b", pa.binary()), ("links", pa.int64())])

    def flush(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(parts)
        once = {c: k for k, c in enumerate(rows["content"].to_pylist())}  # a repeated row counts once
        rows = rows.take(pa.array(list(once.values()))).combine_chunks()
        n = rows.num_rows
        keys = np.asarray(rows["keys"].combine_chunks().flatten()).reshape(n, -1)
        content = rows["content"].to_pylist()
        sets = [np.frombuffer(x, np.uint32) for x in rows["grams"].to_pylist()]
        own = np.asarray(rows["own"])
        if len(np.unique(own)) < 1 + (rows["lo"][0].as_py() != rows["hi"][0].as_py()):
            return  # of two blocks one is empty
        links, root = group_links(keys, sets, own, np.asarray(rows["copies"]), rows["band"][0].as_py(), threshold)
        some = np.flatnonzero(links).tolist()
        if some:
            yield pa.record_batch([pa.array([content[k] for k in some]), pa.array([content[root[k]] for k in some]), pa.array(links[some])], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: list[pa.RecordBatch] = []
        last = None
        for batch in batches:
            ids = np.stack([np.asarray(batch.column(c)).astype(np.int64) for c in ("key", "band", "lo", "hi")], 1)
            cuts = np.r_[0, np.flatnonzero((ids[1:] != ids[:-1]).any(1)) + 1, len(ids)]
            for s, e in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                if e > s:
                    if group and tuple(ids[s]) != last:
                        yield from flush(group)
                        group = []
                    last = tuple(ids[s])
                    group.append(batch.slice(s, e - s))
        if group:
            yield from flush(group)

    return run


# --- the pairs that no key brings together


_ENTRY = np.dtype([("gram", "<u4"), ("cid", "<i8"), ("place", "<u2"), ("size", "<u2")])
_MANY = 65535  # a size that isn't told: no bound holds it back


def _by_part(parts: int, part: np.ndarray, rows: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows (part, bytes of its rows)."""
    o = np.argsort(part, kind="stable")
    rows, ends = rows[o], np.cumsum(np.bincount(part, minlength=parts))
    some = np.flatnonzero(np.diff(np.r_[0, ends]))
    starts = np.r_[0, ends][some]
    yield pa.record_batch([pa.array(some.astype(np.int32)), pa.array([rows[a:b].tobytes() for a, b in zip(starts.tolist(), ends[some].tolist())], pa.binary())], ["part", "rows"])


def _in_batches(pieces: Iterator[tuple[np.ndarray, np.ndarray]], parts: int) -> Iterator[pa.RecordBatch]:
    """_by_part() of pieces (part, rows), a few at once: what a task holds doesn't grow with its input."""
    held, n = [], 0
    for piece in pieces:
        held.append(piece)
        n += len(piece[0])
        if n >= max(_HELD, _EACH * parts):
            part, rows = (np.concatenate(x) for x in zip(*held))
            held, n = [], 0
            yield from _by_part(parts, part, rows)
    if n:
        yield from _by_part(parts, *(np.concatenate(x) for x in zip(*held)))


def _of_parts(make):
    """Batches in which a part's rows, as _by_part() makes them, come one after another: make(bytes) of each part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, []

        def whole() -> bytes:
            raw = b"".join(held)
            held.clear()
            return raw

        for batch in batches:
            for part, rows in zip(batch.column(0).to_pylist(), batch.column(1)):
                if part != last and held:
                    yield from make(whole())
                last = part
                held.append(rows.as_buffer())
        if held:
            yield from make(whole())

    return run


def _in_parts(rows: DataFrame, parts: int, make, schema: str) -> DataFrame:
    """A part is a task: hashed to tasks, several would come to one."""
    return rows.repartitionById(parts, "part").mapInArrow(_of_parts(make), schema)


def gram_order(docs: DataFrame, n: int, sizes: tuple[int, int], most: int = ORDER_TEXTS, grams_kept: int = ORDER_GRAMS) -> tuple[np.ndarray, np.ndarray]:
    """(sorted n-grams, class of frequency) of those that about `most` of the texts often hold. sizes: the texts and all their n-grams."""
    each = max(1, sizes[0] // most)
    parts = max(docs.sparkSession.sparkContext.defaultParallelism * 2, sizes[1] // each // _ENTRIES + 1)

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for batch in batches:
            buf, offs = text_buffers(batch.column(0))
            for _, _, part, at in slices(buf, offs):
                flat = [s for s in grams(*words(part, at), n) if len(s)]
                if flat:
                    g = np.concatenate(flat)
                    yield (g % np.uint64(parts)).astype(np.int32), g

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _in_batches(pieces(batches), parts)

    def count(raw: bytes) -> Iterator[pa.RecordBatch]:
        g, c = np.unique(np.frombuffer(raw, np.uint64), return_counts=True)
        yield pa.record_batch([pa.array(g[c > 1].view(np.int64)), pa.array(c[c > 1])], ["gram", "c"])

    h = F.xxhash64("text", F.lit(3))
    x = docs.where("text is not null").where(F.pmod(h, F.lit(each)) == 0).select("text").distinct()
    got = _in_parts(x.mapInArrow(take, "part int, rows binary"), parts, count, "gram bigint, c bigint")
    got = got.orderBy(F.desc("c"), "gram").limit(grams_kept).toArrow()
    key, c = np.asarray(got["gram"]).view(np.uint64), np.asarray(got["c"])
    o = np.argsort(key)
    return key[o], np.minimum(63, 1 + 2 * np.log2(np.maximum(c[o], 1))).astype(np.uint8)


def _least(size: np.ndarray) -> np.ndarray:
    """How many common n-grams the prefixes of a link hold, if the smaller set has this size."""
    return np.where(size == _MANY, 1, 1 + size // 16)


def prefixes(sets: list[np.ndarray], often: np.ndarray, kind: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """(n-grams, entries but for their n-gram) of the prefixes of sorted, non-empty sets."""
    size = np.array([len(s) for s in sets], np.int64)
    flat, row = np.concatenate(sets), np.repeat(np.arange(len(sets)), size)
    rank = np.zeros(len(flat), np.uint64)
    if len(often):
        at = np.minimum(np.searchsorted(often, flat), len(often) - 1)
        rank = np.where(often[at] == flat, kind[at], 0).astype(np.uint64)
    # alike in all sets: by class, then by n-gram, as a stable sort leaves the order of what it can't tell apart
    o = np.argsort(row.astype(np.uint64) << np.uint64(44) | rank << np.uint64(38) | flat >> np.uint64(26), kind="stable")
    start = np.cumsum(size) - size
    place = np.arange(len(flat)) - start[row]
    told = np.where(size < _MANY, size, _MANY)
    length = np.minimum(size, size - np.ceil(threshold * size - 1e-9).astype(np.int64) + 1 + size // 16)
    pick = np.flatnonzero(place < length[row])
    out = np.empty(len(pick), _ENTRY)
    cid = np.array([_cid(s) for s in sets], np.int64)
    owner = row[pick]
    out["cid"], out["size"], out["place"] = cid[owner], told[owner], np.minimum(place[pick], _MANY)
    return flat[o[pick]], out


def _prefixer(n: int, shared, threshold: float, parts: int):
    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        often, kind = shared.value
        for batch in batches:
            buf, offs = text_buffers(batch.column(0))
            for _, _, part, at in slices(buf, offs):
                sets = [s for s in grams(*words(part, at), n) if len(s)]
                if sets:
                    g, rows = prefixes(sets, often, kind, threshold)
                    rows["gram"] = (g >> np.uint64(32)).astype(np.uint32)
                    yield ((g & np.uint64(0xFFFFFFFF)) % np.uint64(parts)).astype(np.int32), rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _in_batches(pieces(batches), parts)

    return run


def meetings(x: np.ndarray, threshold: float, labels: tuple[np.ndarray, np.ndarray]) -> Iterator[tuple[np.ndarray, ...]]:
    """(a, b, n, least): pairs of contents with different labels among entries, a < b, how many
    n-grams they share that a link may, and how many a link must in all parts. A pair may come more than once."""
    x = x[np.argsort(x["gram"], kind="stable")]
    same = x["gram"][1:] == x["gram"][:-1]
    x = x[np.r_[False, same] | np.r_[same, False]]
    x = x[np.lexsort((x["cid"], x["gram"]))]
    x = x[np.r_[True, (x["gram"][1:] != x["gram"][:-1]) | (x["cid"][1:] != x["cid"][:-1])][: len(x)]]  # copies
    if not len(x):
        return
    ids, own = np.unique(x["cid"], return_inverse=True)
    label, (known, roots) = ids.copy(), labels
    if len(known):
        at = np.minimum(np.searchsorted(known, ids), len(known) - 1)
        label = np.where(known[at] == ids, roots[at], ids)
    label = np.unique(label, return_inverse=True)[1].astype(np.int32)[own]
    own, size, place = own.astype(np.int32), x["size"].astype(np.int32), x["place"].astype(np.int32)
    ends = np.r_[np.flatnonzero(x["gram"][1:] != x["gram"][:-1]) + 1, len(x)]
    later = np.repeat(ends, np.diff(np.r_[0, ends])) - 1 - np.arange(len(x))
    before, i = np.r_[0, np.cumsum(later)], 0
    while i < len(x):
        j = max(i + 1, int(np.searchsorted(before, before[i] + _PAIRS, "right")) - 1)
        a = np.repeat(np.arange(i, j, dtype=np.int32), later[i:j])
        b = np.arange(1, len(a) + 1) - np.repeat(before[i:j] - before[i], later[i:j])
        b += a
        ok = label[a] != label[b]
        a, b = a[ok], b[ok]
        least = np.minimum(_least(size[a]), _least(size[b]))
        need = np.ceil(threshold / (1 + threshold) * (size[a] + size[b]) - 1e-9)
        ok = np.minimum(size[a] - place[a], size[b] - place[b]) >= need - least + 1
        ok &= np.minimum(size[a], size[b]) >= threshold * np.maximum(size[a], size[b]) - 1e-9
        ok |= (size[a] == _MANY) | (size[b] == _MANY)
        pair, first, times = np.unique(own[a[ok]] * np.int64(len(ids)) + own[b[ok]], return_index=True, return_counts=True)
        if len(pair):
            yield ids[pair // len(ids)], ids[pair % len(ids)], times, least[ok][first]
        i = j


def _meeter(threshold: float, shared):
    def make(raw: bytes) -> Iterator[pa.RecordBatch]:
        for columns in meetings(np.frombuffer(raw, _ENTRY), threshold, shared.value):
            yield pa.record_batch([pa.array(c.astype(np.int64)) for c in columns], ["a", "b", "n", "least"])

    return make


def apart(docs: DataFrame, sizes: tuple[int, int], labels: DataFrame, threshold: float, n: int) -> DataFrame:
    """(a, b): pairs of contents, by cid, that may be links although their labels (cid, label) differ,
    no label being one of its own; every link is among them. sizes: the texts and all their n-grams."""
    sc, total = docs.sparkSession.sparkContext, sizes[1]
    order = sc.broadcast(gram_order(docs, n, sizes))
    few = labels.limit(LABELS + 1).count() <= LABELS
    known = (labels if few else labels.limit(0)).orderBy("cid").toArrow()
    told = sc.broadcast((np.asarray(known["cid"]).astype(np.int64), np.asarray(known["label"]).astype(np.int64)))
    parts = max(sc.defaultParallelism, int(total * (1 - threshold + 1 / 16)) // _ENTRIES + 1)
    entries = docs.where("text is not null").select("text").mapInArrow(_prefixer(n, order, threshold, parts), "part int, rows binary")
    pairs = _in_parts(entries, parts, _meeter(threshold, told), "a bigint, b bigint, n bigint, least bigint")
    pairs = pairs.groupBy("a", "b").agg(F.sum("n").alias("n"), F.min("least").alias("least")).where("n >= least").select("a", "b")
    for side in () if few else ("a", "b"):
        pairs = pairs.join(labels.select(F.col("cid").alias(side), F.col("label").alias(f"label_{side}")), side, "left")
    if not few:
        pairs = pairs.where("not coalesce(label_a = label_b, false)").select("a", "b")
    return materialize(pairs)


def _verify(docs: DataFrame, kinds: DataFrame, shared: DataFrame, threshold: float, n: int) -> DataFrame:
    """(a, b, links) of the contents in the subtrees shared (content, shared), as _joiner() finds them."""
    chosen = materialize(shared.join(kinds, "content").select(F.col("at.doc_id").alias("chosen_id"), F.col("at.h").alias("chosen_h"), "content", "keys", "copies", "shared"))
    x = docs.where("doc_id is not null").select("doc_id", F.xxhash64("text").alias("h"), "text")
    x = x.join(sized_broadcast(chosen), (F.col("doc_id") == F.col("chosen_id")) & (F.col("h") == F.col("chosen_h")))
    kept = "content binary, keys array<bigint>, copies bigint, shared array<struct<band:int,key:bigint,blocks:int>>"
    x = x.select("text", "content", "keys", "copies", "shared").mapInArrow(_setter(n), f"grams binary, {kept}")
    x = x.select("content", "keys", "grams", "copies", F.inline("shared")).withColumn("own", F.pmod(F.xxhash64("content", F.lit(2)), "blocks").cast("int"))
    x = x.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    x = x.select("key", "band", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "own", "content", "keys", "grams", "copies")
    group = ["key", "band", "lo", "hi"]
    return materialize(x.repartition(*group).sortWithinPartitions(*group).mapInArrow(_joiner(threshold), "a binary, b binary, links bigint"))


def _roots(found: DataFrame) -> DataFrame:
    """(content, root): the components of links found."""
    return components(found.select(F.hex("a").alias("a"), F.hex("b").alias("b"))).select(F.unhex("node").alias("content"), F.unhex("root").alias("root"))


def linked(docs: DataFrame, threshold: float = THRESHOLD, n: int = N, bands: int = BANDS, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """(rows, groups). rows: (doc_id, h, content), one for each doc_id and text.
    groups: (content, root, links, copies) of the contents of more than one document
    and of those with links: the least content of the group, the documents linked with it through
    other contents, and its own documents."""
    with small_batches(docs.sparkSession):
        return _linked(docs, threshold, n, bands, block)


def _linked(docs: DataFrame, threshold: float, n: int, bands: int, block: int) -> tuple[DataFrame, DataFrame]:
    sk = materialize(sketches(docs, n, bands))
    some = sk.where("content is not null")
    first = [F.first(c).alias(c) for c in ("cid", "size", "keys")]
    kinds = materialize(some.groupBy("content").agg(F.min(F.struct("doc_id", "h")).alias("at"), F.countDistinct("doc_id", "h").alias("copies"), *first))
    keyed = kinds.select("content", F.posexplode("keys").alias("band", "key"))
    members = [F.bit_xor(F.xxhash64("content", F.lit(k))).alias(f"s{k}") for k in (1, 2)]
    meet = keyed.groupBy("key", "band").agg(F.count("*").alias("c"), *members).where("c > 1")
    meet = meet.groupBy("c", "s1", "s2").agg(F.min(F.struct("band", "key")).alias("x")).select("x.key", "x.band", F.ceil(F.col("c") / block).cast("int").alias("blocks"))
    shared = keyed.join(meet, ["key", "band"]).groupBy("content").agg(F.collect_list(F.struct("band", "key", "blocks")).alias("shared"))
    met = _verify(docs, kinds, shared, threshold, n)
    # the rest: no pair with a key in common, as band is beyond all
    label = materialize(_roots(met).withColumn("label", F.xxhash64("root")))
    subtree = lambda key, blocks: F.struct(F.lit(bands).alias("band"), key.alias("key"), blocks.cast("int").alias("blocks"))
    count = label.groupBy("label").agg(F.count("*").alias("c"))
    inside = label.join(count, "label").select("content", subtree(F.col("label"), F.ceil(F.col("c") / block)).alias("x"))
    sizes = kinds.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    pairs = apart(docs.where("doc_id is not null"), tuple(sizes), materialize(label.join(kinds, "content").select("cid", "label")), threshold, n)
    pairs = pairs.select(F.explode(F.array("a", "b")).alias("cid"), subtree(F.xxhash64("a", "b"), F.lit(1)).alias("x"))
    outside = pairs.join(kinds.select("cid", "content"), "cid").select("content", "x")
    rest = _verify(docs, kinds, inside.union(outside).groupBy("content").agg(F.collect_list("x").alias("shared")), threshold, n)
    found = met.union(rest)
    roots = _roots(found)
    links = found.groupBy(F.col("a").alias("content")).agg(F.sum("links").alias("links"))
    copied = kinds.select("content", "copies").where("copies > 1")
    groups = links.join(roots, "content").join(copied, "content", "full")
    groups = groups.select("content", F.coalesce("root", "content").alias("root"), F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("copies", F.lit(1)).alias("copies"))
    return sk.select("doc_id", "h", "content"), materialize(groups)


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, n: int = N, bands: int = BANDS, block: int = BLOCK) -> DataFrame:
    """(doc_id, class_id, n_links), a row for each doc_id and text: n_links is the
    number of other documents whose sets have at least the threshold in common with its
    own, exact copies among them; the classes are the groups that links connect, and
    class_id is the least doc_id of the class, its own if it has no link.

    Rows with a null doc_id have none. A null text, or one without a word, has no
    link. A text of fewer than n words is one gram of all its words. Rows that
    repeat doc_id and text are one document; one doc_id with two texts is two, which
    may be of two classes. An empty table gives no rows. Other columns aren't read."""
    rows, groups = linked(docs, threshold, n, bands, block)
    rows = rows.distinct()
    x = rows.join(sized_broadcast(groups), "content", "left")
    # the few documents with links only
    least = x.where("root is not null").groupBy("root").agg(F.min("doc_id").alias("class_id"))
    x = x.join(sized_broadcast(materialize(least)), "root", "left")
    return x.select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce(F.col("links") + F.col("copies") - 1, F.lit(0)).cast("bigint").alias("n_links"))


def drop_near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, n: int = N, bands: int = BANDS, block: int = BLOCK) -> DataFrame:
    """docs without the near duplicates: of each class the document with the least
    doc_id (and hash of the text) stays, once. Rows without a doc_id or without a
    word stay; so do two texts under one doc_id, unless they're of one class: what
    goes is told by doc_id and text. Rows that repeat both are one document. An
    empty table gives no rows; other columns are kept as they are."""
    rows, groups = linked(docs, threshold, n, bands, block)
    x = rows.join(sized_broadcast(groups.select("content", "root")), "content")
    heads = materialize(x.groupBy("root").agg(F.min(F.struct("doc_id", "h")).alias("head")))
    gone = x.join(sized_broadcast(heads), "root").select("doc_id", "h", "head").where("struct(doc_id, h) <> head").select("doc_id", "h").distinct()
    kept = drop_rows(docs, materialize(gone))
    again = materialize(rows.where("content is not null").groupBy("doc_id", "h").count().where("count > 1").select("doc_id", "h"))
    if again.isEmpty():
        return kept
    h = F.xxhash64("text")
    twice = drop_rows(kept, again, "left_semi")
    return drop_rows(kept, again).unionByName(twice.dropDuplicates(["doc_id", "text"]))


#: Links by the definition: sets of word n-grams as strings, intersected in a join; classes by reachability.
SQL = f"""
with recursive w as (select doc_id, regexp_extract_all(lower(text), '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+') as ws from documents where doc_id is not null and text is not null),
g as (
  select distinct doc_id, unnest(case when len(ws) = 0 then []::varchar[] when len(ws) < {N} then [array_to_string(ws, ' ')]
    else list_transform(range(1, len(ws) - {N - 2}), lambda i: array_to_string(ws[i:i + {N - 1}], ' ')) end) as gram from w),
n as (select doc_id, count(*) as n from g group by doc_id),
o as (select a.doc_id as a, b.doc_id as b, count(*) as o from g a join g b on a.gram = b.gram and a.doc_id <> b.doc_id group by all),
links as (select a, b from o join n x on a = x.doc_id join n y on b = y.doc_id where o >= {THRESHOLD} * (x.n + y.n - o)),
reach as (select a, b from links union select reach.a, links.b from reach join links on reach.b = links.a),
least as (select a, min(b) as b from reach group by a)
select doc_id, least(doc_id, coalesce(least.b, doc_id)) as class_id, coalesce(n_links, 0) as n_links
from documents left join least on doc_id = least.a left join (select a, count(*) as n_links from links group by a) k on doc_id = k.a
where doc_id is not null"""
