import random

from odd import ROWS, none, odd, table

from quillspark.llm import line_dedup as L


def brute(rows):
    """(doc_id, text) to keep flags: first occurrence by doc_id, digest, position; blank lines stay."""
    seen, out = set(), {}
    for i, t in sorted(set(rows), key=lambda r: (r[0] is not None, r[0] or 0, L._digest(r[1] or ""))):
        flags = []
        for line in (t or "").split("\n") if t else []:
            x = line.strip()
            flags.append(not x or x not in seen)
            if x:
                seen.add(x)
        out[i, L._digest(t or "")] = flags
    return out


def flags(df):
    return {(r.doc_id, r.digest): [bool(x) for x in L.unpack(bytes(r.keep), r.n_lines)] for r in df.collect()}


def test_against_brute_force(spark):
    r = random.Random(9)
    rows = [(i % 70, "\n".join(r.choice(["", " a ", "a", "b\t", "line %d" % r.randrange(90)]) for _ in range(r.randint(0, 25)))) for i in range(90)]
    rows += rows[:5] + [(None, "a\nb\nc"), (3, None)]
    for parts in (1, 5):
        got = L.keep_bitmaps(table(spark, *rows).repartition(parts))
        assert flags(got) == brute(rows)
        assert all(x.n_kept == sum(L.unpack(bytes(x.keep), x.n_lines)) for x in got.collect())


def test_bitmaps():
    import numpy as np

    for n in (0, 1, 7, 8, 9, 5000):
        for p in (0.0, 0.5, 0.99, 1.0):
            keep = np.random.default_rng(n).random(n) < p
            assert (L.unpack(L.pack(keep), n) == keep).all()
    assert len(L.pack(np.ones(10_000, bool))) == 1 and len(L.pack(np.zeros(10_000, bool))) < 100


def test_apply_and_odd_rows(spark):
    marks = L.keep_bitmaps(odd(spark))
    assert flags(marks) == brute([(i, t) for i, t, *_ in ROWS])
    rows = L.apply_bitmaps(odd(spark), marks).collect()
    assert len(rows) == len(ROWS) and rows[0].line == "clash"
    texts = {r.doc_id: r.text for r in rows}
    assert texts[4] is None and texts[5] == "" and texts[2] == ""  # 2's one line is 1's
    assert L.keep_bitmaps(none(spark)).collect() == []
    docs = table(spark, (1, "a\nb"), (2, "b\nc")).selectExpr("*", "1 as __t", "2 as t", "3 as k", "4 as `a.b`")
    got = {r.doc_id: r for r in L.apply_bitmaps(docs, L.keep_bitmaps(docs)).collect()}
    assert (got[2].text, got[2]["__t"], got[2]["t"], got[2]["k"], got[2]["a.b"]) == ("c", 1, 2, 3, 4)
