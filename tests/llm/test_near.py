import random
import tracemalloc
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
from odd import none, odd, prose, table
from pyspark import TaskContext

from quillspark.llm import ngram_join as J
from quillspark.llm.common import grams, text_buffers, words
from quillspark.llm.graph import components


def gram_sets(texts):
    import pyarrow as pa

    return [set(map(int, g)) for g in grams(*words(*text_buffers(pa.array(texts))), J.N)]


def corpus():
    r = random.Random(5)
    rows = []
    for i in range(60):
        rows.append(prose(i, 80).split())
    for i in range(60):  # near copies from hardly changed to hardly alike
        w = rows[i % 60][:]
        for _ in range(r.randint(0, 14)):
            w[r.randrange(len(w))] = f"new{r.randrange(999)}"
        rows.append(w)
    rows += [rows[3]] * 30 + [["ab"], ["ab"], ["ab", "cd"]]
    return [(i, " ".join(w)) for i, w in enumerate(rows)]


def brute(rows, threshold=J.THRESHOLD):
    sets = gram_sets([t for _, t in rows])
    out = {}
    for x in range(len(rows)):
        for y in range(x + 1, len(rows)):
            if sets[x] and sets[y] and len(sets[x] & sets[y]) >= threshold * len(sets[x] | sets[y]):
                out[rows[x][0], rows[y][0]] = len(sets[x] & sets[y]) / len(sets[x] | sets[y])
    return out


def classes(want, ids):
    """(least id of the class, links) of each document, from all pairs."""
    parent, links = {i: i for i in ids}, dict.fromkeys(ids, 0)

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in want:
        x, y = sorted((root(a), root(b)))
        parent[y] = x
        links[a] += 1
        links[b] += 1
    return {i: (root(i), links[i]) for i in ids}


def rows_of(df):
    return {r.doc_id: (r.class_id, r.n_links) for r in df.collect()}


def test_classes_and_links(spark):
    rows = corpus()
    got = rows_of(J.near_duplicates(table(spark, *rows)))
    assert got == classes(brute(rows), [i for i, _ in rows])  # 30 copies of a text among them
    assert got == rows_of(J.near_duplicates(table(spark, *rows), block=4))  # every subtree is cut into blocks


def test_a_key_that_many_share(spark):
    """Near copies of one text, each its own content: more than a block holds."""
    r = random.Random(9)
    rows = []
    for i in range(60):
        w = prose(7, 120).split()
        for _ in range(4):
            w[r.randrange(len(w))] = f"new{i}x{r.randrange(99)}"
        rows.append((i, " ".join(w)))
    rows += [(100 + i, prose(50 + i, 120)) for i in range(20)]
    want = classes(brute(rows), [i for i, _ in rows])
    assert want[0][1] > 40
    assert rows_of(J.near_duplicates(table(spark, *rows), block=16)) == want


def test_one_of_each_class_stays(spark):
    rows = corpus()
    kept = {r.doc_id for r in J.drop_near_duplicates(table(spark, *rows)).collect()}
    assert kept == {i for i, (c, _) in classes(brute(rows), [i for i, _ in rows]).items() if i == c}


def test_two_texts_under_one_id(spark):
    a, b, c = prose(1, 60), prose(2, 60), prose(3, 60)
    docs = table(spark, (1, a), (2, a), (2, b), (3, c), (3, c + " more"))
    kept = sorted((r.doc_id, r.text) for r in J.drop_near_duplicates(docs).collect())
    assert [x for x in kept if x[0] != 3] == [(1, a), (2, b)] and len(kept) == 3
    got = sorted((r.doc_id, r.class_id, r.n_links) for r in J.near_duplicates(docs).collect())
    assert got == [(1, 1, 1), (2, 1, 1), (2, 2, 0), (3, 3, 1), (3, 3, 1)]


def test_tree_prunes_nothing_it_should_not():
    r = random.Random(2)
    base = [r.sample(range(10_000), 60) for _ in range(40)]
    sets = [np.unique(np.array(r.sample(b, r.randint(30, 60)) + r.sample(range(10_000), r.randint(0, 20)), np.uint32)) for b in base for _ in range(6)]
    sets.sort(key=len)
    py = [set(s.tolist()) for s in sets]
    want = {(i, j) for i in range(len(py)) for j in range(i + 1, len(py)) if len(py[i] & py[j]) >= 0.5 * len(py[i] | py[j])}
    one = J.Tree(sets, 80)
    got = {(i, j) for a, b in J.tree_pairs(one, None, 0.5) for i, j in zip(a.tolist(), b.tolist())}
    assert want and want <= got and len(got) < 0.5 * len(sets) ** 2 / 2
    for cut in (3, 100, 230):  # two trees of other heights
        two = J.Tree(sets[:cut], 80), J.Tree(sets[cut:], 80)
        got = {(i, cut + j) for a, b in J.tree_pairs(*two, 0.5) for i, j in zip(a.tolist(), b.tolist())}
        assert {(i, j) for i, j in want if i < cut <= j} <= got


def test_odd_rows(spark):
    got = sorted((r.doc_id, r.class_id, r.n_links) for r in J.near_duplicates(odd(spark)).collect())
    assert got == [(1, 1, 0), (1, 1, 1), (2, 1, 1), (4, 4, 0), (5, 5, 0), (6, 6, 0), (7, 7, 0), (8, 8, 1), (9, 8, 1), (10, 10, 0)]
    kept = J.drop_near_duplicates(odd(spark)).collect()
    ids = [r.doc_id for r in kept]
    assert ids.count(1) == 2 and 2 not in ids and 9 not in ids and {4, 5, 6, 7, 8, 10} <= set(ids) and ids.count(None) == 2
    assert kept[0].key == "clash" and kept[0].content == "clash"
    assert J.near_duplicates(none(spark)).collect() == [] and J.drop_near_duplicates(none(spark)).collect() == []


def test_components(spark):
    chain = [(str(i).zfill(3), str(i + 1).zfill(3)) for i in range(40)] + [("900", "901"), ("901", "901"), (None, "1")]
    got = {r.node: r.root for r in components(spark.createDataFrame(chain, "a string, b string")).collect()}
    assert all(got[str(i).zfill(3)] == "000" for i in range(41)) and got["901"] == "900" and len(got) == 43


def test_links_that_no_key_brings_together(spark):
    """With one band most pairs near the threshold share no key: within a component of the others, and between."""
    rows = corpus()
    for i in range(30):  # at the threshold, or hardly above
        w = prose(500 + i, 60).split()
        rows += [(1000 + 2 * i, " ".join(w)), (1001 + 2 * i, " ".join(w[: 41 + i % 3] + [f"x{i}y{k}" for k in range(19 - i % 3)]))]
    want = brute(rows)
    assert sum(v < 0.55 for v in want.values()) > 20
    assert rows_of(J.near_duplicates(table(spark, *rows), bands=1, block=4)) == classes(want, [i for i, _ in rows])


def test_prefixes_lose_no_pair():
    """In any order of n-grams, and with hot ones."""
    r = random.Random(3)
    hot = [r.getrandbits(64) for _ in range(30)]
    sets = []
    for _ in range(40):
        base = [r.getrandbits(64) for _ in range(r.choice([1, 2, 7, 40, 90]))] + r.sample(hot, r.choice([0, 5, 30]))
        for _ in range(4):
            sets.append(np.unique(np.array(r.sample(base, r.randint((len(base) + 1) // 2, len(base))) + [r.getrandbits(64) for _ in range(r.randint(0, 3))], np.uint64)))
    py = [set(s.tolist()) for s in sets]
    want = {(i, j) for i in range(len(py)) for j in range(len(py)) if py[i] != py[j] and J._cid(sets[i]) < J._cid(sets[j]) and len(py[i] & py[j]) >= 0.5 * len(py[i] | py[j])}
    want = {(J._cid(sets[i]), J._cid(sets[j])) for i, j in want}
    nothing = np.zeros(0, np.int64)
    for often in (np.zeros(0, np.uint64), np.sort(np.array(hot, np.uint64)), np.sort(np.array([r.choice(list(p)) for p in py], np.uint64))):
        g, x = J.prefixes(sets, often, np.array([r.randrange(64) for _ in often], np.uint8), 0.5)
        x["gram"] = g >> np.uint64(32)
        seen = {}
        for a, b, n, least in J.meetings(x, 0.5, (nothing, nothing)):
            for p, q, k, m in zip(a.tolist(), b.tolist(), n.tolist(), least.tolist()):
                seen[p, q] = seen.get((p, q), -m) + k
        assert want and want <= {p for p, k in seen.items() if k >= 0}
        assert len(seen) < len(sets) ** 2 / 4


def test_a_task_holds_few_prefixes():
    """One batch of a million prefix entries and more goes on in small parts, without a large temporary."""
    words_of = np.random.default_rng(5).integers(1 << 20, 1 << 24, (6000, 400))
    batch = pa.record_batch([pa.array([" ".join(map(hex, x)) for x in words_of.tolist()])], ["text"])
    run = J._prefixer(3, SimpleNamespace(value=(np.zeros(0, np.uint64), np.zeros(0, np.uint8))), 0.5, 57)
    seen = 0
    list(run(iter([batch.slice(0, 1)])))  # tables of powers
    tracemalloc.start()
    try:
        for out in run(iter([batch])):
            seen += sum(map(len, out.column(1).to_pylist())) // J._ENTRY.itemsize
            assert out.nbytes < 8 << 20
        assert tracemalloc.get_traced_memory()[1] < 80 << 20
    finally:
        tracemalloc.stop()
    assert seen == 6000 * (398 - 199 + 1 + 398 // 16)


def test_a_task_holds_one_part(spark):
    """Parts aren't hashed to tasks, where several would come to one, and each is whole."""
    parts = 24

    def make(raw):
        yield pa.record_batch([pa.array([k], pa.int32()) for k in (TaskContext.get().partitionId(), len(raw), raw[0])], ["task", "n", "part"])

    rows = spark.range(0, 40 * parts, 1, 5).selectExpr(f"cast(id % {parts} as int) part", f"unhex(lpad(hex(id % {parts}), 2, '0')) rows")
    got = J._in_parts(rows, parts, make, "task int, n int, part int").collect()
    assert sorted((r.task, r.n, r.part) for r in got) == [(k, 40, k) for k in range(parts)]


def test_batches_of_long_texts_are_small(spark, monkeypatch):
    """Batches to Python are bounded by bytes, not by 10,000 rows; the session's own bound comes back."""

    def bounded(make):
        def checked(*args):
            run = make(*args)

            def f(batches):
                def seen():
                    for batch in batches:
                        assert batch.nbytes < 8 << 20
                        yield batch

                return run(seen())

            return f

        return checked

    for name in ("_sketcher", "_setter", "_prefixer", "_of_parts", "_joiner"):
        monkeypatch.setattr(J, name, bounded(getattr(J, name)))
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    had = spark.conf.get(key, None)
    docs = spark.range(0, 1500, 1, 1).selectExpr("id doc_id", "array_join(transform(sequence(1, 600), i -> hex(xxhash64(id - id % 2, i - i % 600))), ' ') || ' ' || array_join(transform(sequence(1, 600), i -> hex(xxhash64(id - id % 2, i))), ' ') text")
    got = rows_of(J.near_duplicates(docs))
    assert got == {i: (i - i % 2, 1) for i in range(1500)}
    assert spark.conf.get(key, None) == had


def test_a_traversal_of_wide_bitmaps_is_small():
    r = np.random.default_rng(4)
    sets = [np.unique(r.integers(0, 1 << 32, 20_000, dtype=np.uint32)) for _ in range(160)]
    sets[7] = sets[3]
    tree = J.Tree(sets, 20_000)
    tracemalloc.start()
    try:
        got = [p for a, b in J.tree_pairs(tree, None, 0.5) for p in zip(a.tolist(), b.tolist())]
        assert tracemalloc.get_traced_memory()[1] < 40 << 20
    finally:
        tracemalloc.stop()
    assert got == [(3, 7)]
