import re

from odd import LONG, none, odd, prose, table

from quillspark.llm import decontam as D


def brute(docs, items, window=D.WINDOW):
    """(doc, item) pairs that share a run of window words, or all of a shorter item."""
    split = lambda t: re.findall(r"[^\W_]+", t.lower())
    out = set()
    for i, t in docs:
        d = split(t)
        for j, u in items:
            w = split(u)
            n = min(window, len(w))
            if len(w) >= D.LEAST_WORDS:
                runs = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)}
                if any(tuple(d[k : k + n]) in runs for k in range(len(d) - n + 1)):
                    out.add((i, j))
    return out


def unlike(seed, n):
    return " ".join(f"{w}{seed}x{k % 7}" for k, w in enumerate(prose(seed, n).split()))


ITEMS = [(j, unlike(j, 30)) for j in range(1, 9)] + [(20, "tiny item of five words"), (21, "too few words")]


def bench(spark, rows=ITEMS):
    return spark.createDataFrame(rows, "item_id bigint, text string")


def test_phrases(spark):
    docs = [(i, prose(i, 100)) for i in range(30)]
    docs += [(100 + j, f"{prose(j, 40)} {' '.join(t.split()[5:15])}. {prose(j, 30)}") for j, t in ITEMS[:8]]
    docs += [(200 + j, f"{prose(j, 40)} {t.upper()}, {prose(j, 30)}") for j, t in ITEMS]
    docs += [(300, f"{prose(1, 9)} {' '.join(ITEMS[0][1].split()[:7])} {prose(2, 9)}"), (301, LONG + " " + ITEMS[2][1])]
    got = {(r.doc_id, r.item_id): r for r in D.matches(table(spark, *docs), bench(spark)).collect()}
    assert {k for k, r in got.items() if r.kind == "phrase"} == brute(docs, ITEMS)
    assert got[101, 1].position == 40 and got[101, 1].n_words == 10
    assert (300, 1) not in got and (301, 3) in got
    kept = {r.doc_id for r in D.decontaminate(table(spark, *docs), bench(spark)).collect()}
    assert kept == {i for i, _ in docs} - {i for i, _ in got}


def test_proximity(spark):
    w = ITEMS[0][1].split()
    changed = [x if k % 6 else "other" for k, x in enumerate(w)]  # five in six words stay, runs are too short
    docs = table(spark, (1, f"{prose(1, 30)} {' '.join(changed)} {prose(2, 30)}"), (2, " ".join(sorted(w))), (3, prose(3, 90)))
    got = {r.doc_id: r for r in D.matches(docs, bench(spark)).collect()}
    assert got[1].kind == "proximity" and got[1].n_words == 25 and 3 not in got


def test_every_edited_passage_is_found(spark):
    import random

    r = random.Random(8)
    items = [(j, unlike(700 + j, m)) for j, m in enumerate([5, 6, 7, 9, 10, 12, 15, 19, 20, 25, 40, 90])]
    docs = []
    for j, t in items:
        for k in range(12):
            w = t.split()
            for at in sorted(r.sample(range(len(w)), len(w) // 5), reverse=True):
                w[at] = r.choice(prose(k, 5).split())
            docs.append((j * 100 + k, f"{prose(k, r.randint(0, 30))} {' '.join(w)} {prose(j, 20)}"))
    clean = [(10_000 + k, prose(k, 200)) for k in range(40)]
    got = {(x.doc_id, x.item_id) for x in D.matches(table(spark, *docs, *clean), bench(spark, items)).collect()}
    assert got == {(i, i // 100) for i, _ in docs}


def test_odd_rows(spark):
    items = bench(spark, [(1, prose(1, 60)), (None, prose(1, 60)), (2, None), (3, ""), (1, prose(1, 60)), (4, " ".join(LONG.split()[50_000:50_040]))])
    got = {(r.doc_id, r.item_id) for r in D.matches(odd(spark), items).collect()}
    assert got == {(1, 1), (2, 1), (8, 4), (9, 4)}
    kept = D.decontaminate(odd(spark), items).collect()
    assert sorted(str(r.doc_id) for r in kept) == sorted(["None", "None", "1", "4", "5", "6", "7", "10"]) and kept[0].term == "clash"
    assert D.matches(none(spark), items).collect() == []
    assert D.matches(odd(spark), bench(spark, [])).collect() == []
    assert D.decontaminate(odd(spark), bench(spark, [])).count() == odd(spark).count()


def test_two_texts_under_one_id(spark):
    """A clean text stays though another of the same doc_id goes; so does one whose item_id has two texts."""
    leak, clean = f"{prose(1, 20)} {ITEMS[0][1]}", prose(2, 60)
    docs, items = table(spark, (1, leak), (1, clean), (2, clean), (2, ITEMS[3][1])), bench(spark, [(1, ITEMS[0][1]), (1, ITEMS[3][1])])
    assert sorted((r.doc_id, r.text) for r in D.decontaminate(docs, items).collect()) == [(1, clean), (2, clean)]
    assert sorted((r.doc_id, r.item_id, r.n_words) for r in D.matches(docs, items).collect()) == [(1, 1, 30), (2, 1, 30)]


def test_parts_of_the_benchmark(spark):
    docs = table(spark, *((i, f"{prose(i, 5)} {unlike(i % 9, 30)} {unlike(i % 9, 30)}") for i in range(40)), (1, unlike(3, 30)), (-5, unlike(2, 30)))
    got = [sorted(map(tuple, D.matches(docs, bench(spark), part_bytes=n).collect())) for n in (D.PART_BYTES, 5000)]
    assert got[0] == got[1] != []


def test_parameters(spark):
    """Short windows find phrases wherever they stand in an item, low shares items half changed."""
    w = unlike(77, 31).split()
    docs = table(spark, *((k, f"{prose(k, 12)} {' '.join(w[k : k + 4])} {prose(k + 50, 9)}") for k in range(28)))
    got = {r.doc_id for r in D.matches(docs, bench(spark, [(1, " ".join(w))]), window=4, share=1.0).collect()}
    assert got == set(range(28))
    half = [x if k % 2 else f"other{k}" for k, x in enumerate(w)]
    docs = table(spark, (1, " ".join(half)), (2, prose(3, 30)))
    assert {r.doc_id for r in D.matches(docs, bench(spark, [(1, " ".join(w))]), share=0.48).collect()} == {1}
    for bad in ({"window": 0}, {"share": 0}, {"share": 1.5}, {"slop": -1}):
        try:
            D.matches(docs, bench(spark), **bad)
        except ValueError:
            continue
        raise AssertionError(bad)
