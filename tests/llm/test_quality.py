import random

from odd import none, odd, prose, table

from quillspark.llm import quality_zstd as Z


def bad(seed, n):
    r = random.Random(seed)
    return " ".join(w.upper() + r.choice(["!!", "$$$", "%%%"]) for w in prose(seed, n).split())


def sample(first, n):
    return [(first + i, prose(first + i, 80) if i % 3 else bad(first + i, 80), int(bool(i % 3))) for i in range(n)]


def test_held_out_accuracy(spark):
    known, fresh = sample(0, 240), sample(10_000, 150)
    docs = table(spark, *((i, t, "en") for i, t, _ in known + fresh))
    labels = spark.createDataFrame([(i, q, 0) for i, _, q in known] + [(None, 1, 0), (5, None, 0), (999_999, 1, 0)], "doc_id bigint, quality int, toxic int")
    got = {r.doc_id: r for r in Z.classify(docs, labels).collect()}
    assert len(got) == len(known) + len(fresh)
    good = [got[i].keep for i, _, q in fresh if q]
    junk = [got[i].keep for i, _, q in fresh if not q]
    assert sum(good) / len(good) > 0.98 and sum(junk) / len(junk) < 0.05
    model = Z.fit_rows([("en", q, t) for _, t, q in known])
    for i, t, _ in fresh[:5]:  # by the definition, block by block
        d, weight = Z.difference(t, *map(Z.compressor, model.dictionaries["en"]))
        slope, grown, offset = model.curves["en"]
        assert -1 < d < 1 and (slope * d + grown * weight + offset > 0) == bool(_)
    assert all(r.keep for r in Z.score(table(spark, (1, "the"), (2, "a b.")), model).collect())  # too short to tell


def test_dictionary_is_of_all_texts():
    """The first texts count as the last do, though all have less than ten dictionaries' bytes."""
    size, first, last = 16 << 10, [prose(i, 80) for i in range(60)], [bad(i, 80).replace("E", "0") for i in range(100)]
    assert sum(map(len, first + last)) < 10 * size < 10 * sum(map(len, last))
    tail = Z.compressor(b"".join(t.encode() for t in first + last)[-size:])
    made = Z.compressor(Z.dictionary(first + last, size))
    fresh = [prose(1000 + i, 80).encode() for i in range(20)]
    assert sum(len(made.compress(t)) for t in fresh) < 0.8 * sum(len(tail.compress(t)) for t in fresh)
    assert set(b"abc") <= set(Z.dictionary(["aaaa" * 10, "bbbb" * 10, "cccc" * 10], 30))  # too little to train on


def test_odd_rows(spark):
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0)], "doc_id bigint, quality int, toxic int")
    rows = Z.classify(odd(spark), labels).collect()
    assert len(rows) == odd(spark).count() and all(isinstance(r.keep, bool) for r in rows)
    assert all(r.keep and r.difference == 0 for r in rows if not r.text)
    rows = Z.classify(odd(spark), labels.limit(0)).collect()  # no labels, no model
    assert all(r.keep and r.p_good == 1 for r in rows)
    known = sample(0, 60)
    m = Z.fit_rows([("en", q, t) for _, t, q in known])
    rows = Z.score(odd(spark), m).collect()
    assert len(rows) == odd(spark).count() and {r.rank for r in rows} == {"clash"}
    assert Z.classify(none(spark), labels).collect() == []


def test_sample_is_bounded(spark):
    from pyspark.sql import functions as F

    from quillspark.llm.common import bounded_sample

    x = spark.range(10_000).select("id", F.when(F.col("id") % 10 == 0, None).otherwise("a").alias("k"))
    n = {r.k: r["count"] for r in bounded_sample(x, ["k"], 500, F.col("id")).groupBy("k").count().collect()}
    assert 400 < n["a"] < 600 and 400 < n[None] < 600
    assert bounded_sample(x, ["k"], 20_000, F.col("id")).count() == 10_000


def test_any_column_names(spark):
    m = Z.fit_rows([("en", q, t) for _, t, q in sample(0, 60)])
    docs = table(spark, (1, prose(1, 60)), (2, bad(2, 60))).selectExpr("*", "7 as __q", "8 as q", "9 as row", "1 as `x.y`", "'z' as Keep")
    got = {r.doc_id: r for r in Z.score(docs, m).collect()}
    assert [got[1]["__q"], got[1]["q"], got[1]["row"], got[1]["x.y"]] == [7, 8, 9, 1] and got[1].keep and not got[2].keep


def test_many_languages_and_long_texts(spark):
    """A column of languages that holds anything bounds the fit all the same; what isn't a usual language is fitted on as one."""
    rows = [(i, t, f"x{i}") for i, t, _ in sample(0, 240)] + [(900, "WORD!! " * 60_000, "en")]
    labels = spark.createDataFrame([(i, q, 0) for i, _, q in sample(0, 240)] + [(900, 1, 0)], "doc_id bigint, quality int, toxic int")
    m = Z.fit(table(spark, *rows), labels)
    assert list(m.dictionaries) == [Z.ANY]
    good, junk = Z.difference(prose(5, 80), *map(Z.compressor, m.dictionaries[""])), Z.difference(bad(5, 80), *map(Z.compressor, m.dictionaries[""]))
    assert good > junk


def test_whole_query_by_the_definition(spark):
    """classify() against labels, fit and scores worked out one text at a time."""
    import math

    import zstandard

    rows = sample(0, 120)
    docs = table(spark, *((i, t, "en") for i, t, _ in rows))
    labels = spark.createDataFrame([(i, q, 0) for i, _, q in rows if i % 2], "doc_id bigint, quality int, toxic int")
    got = {r.doc_id: r for r in Z.classify(docs, labels).collect()}
    known = sorted(((i, t, q) for i, t, q in rows if i % 2), key=lambda r: Z.hash_order(r[0]))
    sides = [[t for _, t, q in known if q == k] for k in (1, 0)]

    def trained(texts):
        parts = [t.encode()[i : i + Z.BLOCK] for t in texts for i in range(0, len(t.encode()), Z.BLOCK)]
        try:
            d = zstandard.train_dictionary(min(Z.DICT_BYTES, sum(map(len, parts)) // 4), parts, level=Z.LEVEL)
            return zstandard.ZstdCompressionDict(d.as_bytes())
        except zstandard.ZstdError:
            return zstandard.ZstdCompressionDict(Z.dictionary(texts))

    dicts = [trained(s[::2]) for s in sides]

    def size(t, d):
        c = zstandard.ZstdCompressor(level=Z.LEVEL, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False)
        b = t.encode()
        return sum(len(c.compress(b[i : i + Z.BLOCK])) for i in range(0, len(b), Z.BLOCK))

    def of(t):
        n = len(t.encode()) + Z.PRIOR
        return (size(t, dicts[1]) - size(t, dicts[0])) / n, len(t.encode()) / n

    x = [of(t) for s in sides for t in s[1::2]]
    y = [1] * len(sides[0][1::2]) + [0] * len(sides[1][1::2])
    import numpy as np

    a, b, c = Z.logistic(np.array(x), np.array(y, float))
    for i, t, _ in rows:
        d, w = of(t)
        p = 1 / (1 + math.exp(-max(-30, min(30, a * d + b * w + c))))
        assert abs(got[i].difference - d) < 0.02 and abs(got[i].p_good - p) < 0.05 and got[i].keep == (got[i].p_good >= Z.LEAST)
