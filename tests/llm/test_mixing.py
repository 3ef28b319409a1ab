import hashlib
from collections import defaultdict

import pytest
from odd import none, odd, table

from quillspark.llm import mixing as M


def brute(rows, schedule=None, total=None, epochs=60, seed=M.SEED, steps=20_000):
    """Positions by numeric integration of the weights: (doc_id, epoch) to time."""
    by = defaultdict(list)
    for i, t, s in rows:
        n = max(1, (t or "").count(" ") + 1)
        by[s].append((hashlib.md5(f"{seed}:{'' if i is None else i}".encode()).hexdigest(), i, t or "", n))
    supply = {s: sum(x[3] for x in v) for s, v in by.items()}
    if schedule is None:
        whole = sum(supply.values())
        schedule = {s: [(0.0, n / whole), (1.0, (n / whole) ** M.ALPHA)] for s, n in supply.items()}
    knots = sorted({t for v in schedule.values() for t, _ in v})

    def weight(s, t):
        pts = [(k, dict(schedule[s])[k] / (sum(dict(schedule[x])[k] for x in schedule) or 1.0)) for k in knots]
        for (a, x), (b, y) in zip(pts, pts[1:]):
            if t <= b:
                return x + (y - x) * (t - a) / (b - a)
        return pts[-1][1]

    grid = [(k + 0.5) / steps for k in range(steps)]
    cum = {s: [0.0] for s in schedule}
    for s in schedule:
        for t in grid:
            cum[s].append(cum[s][-1] + weight(s, t) / steps)
    total = total or max(supply[s] / cum[s][-1] for s in supply if s in cum and cum[s][-1] > 0)
    out = {}
    import bisect

    for s in by:
        if s not in cum:
            continue
        at = 0
        for e in range(epochs):
            for _, i, _, n in sorted(by[s]):
                if at < min(cum[s][-1] * total, supply[s] * epochs) - 1e-6:
                    out[i, e] = bisect.bisect_left(cum[s], at / total) / steps
                at += n
    return out


ROWS = [(i, "w " * (1 + i * 7 % 30), ["a", "b", "c"][0 if i % 10 else i % 3]) for i in range(60)]


PLANS = {
    "curriculum": {"a": [(0.0, 1.0), (0.3, 0.5), (1.0, 0.0)], "b": [(0.0, 0.0), (0.3, 0.5), (1.0, 1.0)]},
    "a knot of zeros": {"a": [(0.0, 1.0), (0.3, 0.0), (1.0, 0.5)], "b": [(0.0, 1.0), (0.3, 0.0), (1.0, 1.0)]},
}


@pytest.mark.parametrize("case", ["default", *PLANS])
def test_against_integration(spark, case):
    docs = table(spark, *((i, t, "en", s) for i, t, s in ROWS))
    plan = PLANS.get(case)
    if case == "default":
        got, want = M.mix(docs), brute(ROWS)
    else:
        sched = spark.createDataFrame([(s, t, w) for s, v in plan.items() for t, w in v], "source string, t double, weight double")
        got, want = M.mix(docs, sched, 2000.0, 3), brute(ROWS, plan, 2000.0, 3)
    rows = got.collect()
    assert {(r.doc_id, r.epoch) for r in rows} == set(want)
    assert all(abs(r.position - want[r.doc_id, r.epoch]) < 1e-3 for r in rows)
    assert [r.position for r in rows] == sorted(r.position for r in rows)


def test_everything_is_asked_for_once(spark):
    got = M.mix(odd(spark)).collect()
    assert sum(r.epoch == 0 for r in got) == odd(spark).count()
    assert all(0 <= r.position <= 1 and r.n_tokens >= 1 for r in got)
    assert got[0].term == "clash"


def test_weights_are_met_however_small_a_source(spark):
    rows = [(i, "w " * 20, "en", "big") for i in range(50)] + [(100, "w " * 5, "en", "tiny")]
    sched = spark.createDataFrame([(s, t, 1.0) for s in ("big", "tiny") for t in (0.0, 1.0)], "source string, t double, weight double")
    got = M.mix(table(spark, *rows), sched).collect()
    tokens = {s: sum(r.n_tokens for r in got if r.source == s) for s in ("big", "tiny")}
    assert tokens["big"] == 50 * 21 and abs(tokens["tiny"] - tokens["big"]) <= 6


def test_any_column_names(spark):
    docs = table(spark, (1, "a b", "en", "s"), (2, "c", "en", "s")).selectExpr("*", "1 as __src", "2 as __order", "3 as row", "4 as `a.b`", "5 as n", "6 as c", "7 as bucket", "8 as sum", "9 as start", "'x' as Position")
    got = M.mix(docs).collect()
    assert [r["__src"] + r["row"] + r["a.b"] + r["n"] + r["sum"] for r in got] == [21, 21] and {r.doc_id for r in got} == {1, 2}


def test_empty(spark):
    assert M.mix(none(spark)).collect() == []


def test_buckets_dont_matter(spark):
    docs = table(spark, *((i, t, "en", s) for i, t, s in ROWS))
    rows = lambda d: [(r.doc_id, r.epoch, r.position) for r in M.mix(docs, digits=d).collect()]
    assert rows(1) == rows(3)
