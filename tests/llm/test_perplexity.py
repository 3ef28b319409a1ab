import math
from collections import Counter, defaultdict

import numpy as np
from odd import ROWS, none, odd, prose, table

from quillspark.llm import perplexity as P


def brute(rows, order=P.ORDER):
    """Log probability of each text under interpolated modified Kneser-Ney, by the definition, for one language."""
    top = Counter()
    for t in rows:
        s = P.BOS * (order - 1) + t
        top.update(s[i - order + 1 : i + 1] for i in range(order - 1, len(s)))
    counts, raw = {order: dict(top)}, {order: dict(top)}
    for n in range(order - 1, 0, -1):
        types, sums = defaultdict(set), Counter()
        for g, c in raw[n + 1].items():
            types[g[1:]].add(g[0])
            sums[g[1:]] += c
        raw[n] = dict(sums)
        counts[n] = {g: sums[g] if g[0] == P.BOS else len(types[g]) for g in types}
    disc = {}
    for n, c in counts.items():
        t = [sum(v == i for v in c.values()) for i in (1, 2, 3, 4)]
        y = t[0] / (t[0] + 2 * t[1]) if t[0] + 2 * t[1] else 0
        plain = (0.5, 1.0, 1.5)
        disc[n] = [i + 1 - (i + 2) * y * t[i + 1] / t[i] if all(t) else plain[i] for i in range(3)]
        disc[n] = [d if all(t) and 0 < d < i + 1 else plain[i] for i, d in enumerate(disc[n])]
    children = {n: defaultdict(dict) for n in counts}
    for n, c in counts.items():
        for g, v in c.items():
            children[n][g[:-1]][g[-1]] = v

    def p(ctx, ch):
        if len(ctx) == 0:
            own, lower = children[1][""], None
        else:
            own = children[len(ctx) + 1].get(ctx)
        if len(ctx) and own is None:
            return p(ctx[1:], ch)
        n = len(ctx) + 1
        total = sum(own.values())
        d = lambda v: disc[n][min(v, 3) - 1]
        back = sum(map(d, own.values())) / total
        q = p(ctx[1:], ch) if len(ctx) else 1 / (len(own) + 1)
        return (own[ch] - d(own[ch])) / total + back * q if ch in own else back * q

    out = []
    for t in rows:
        s = P.BOS * (order - 1) + t
        out.append(sum(math.log(p(s[i - order + 1 : i], s[i])) for i in range(order - 1, len(s))))
    return out


def test_model_is_kneser_ney(spark):
    rows = [prose(i, 12) for i in range(25)] + ["é😀", "aaaa"]
    docs = table(spark, *enumerate(rows))
    model = P.materialize(P.kneser_ney(P.top_counts(docs)))
    want = brute(rows)
    for size in (P.SHARD_BYTES, 20_000):  # one shard, and several
        assert (P.hashed(model, shard_bytes=size)[1] > 1) == (size == 20_000)
        got = {r.doc_id: r for r in P.score(docs, model, shard_bytes=size).collect()}
        assert np.allclose([got[i].log_p for i in range(len(rows))], want, rtol=1e-5)
        assert [got[i].n_chars for i in range(len(rows))] == [len(t) for t in rows]


def test_bands(spark):
    import random

    r = random.Random(1)
    rows = [(i, prose(i, 120), "en") for i in range(120)] + [(500 + i, "".join(r.choice("qxzjkvw0123456789#@") for _ in range(600)), "en") for i in range(3)] + [(600, "the " * 400, "en")]
    got = {x.doc_id: x for x in P.perplexity_bands(table(spark, *rows)).collect()}
    assert all(got[i].keep for i in range(120))
    assert not any(got[500 + i].keep for i in range(3)) and all(got[500 + i].perplexity > got[500 + i].upper for i in range(3))
    assert not got[600].keep and got[600].perplexity < got[600].lower


def test_junk_on_both_sides(spark):
    """Junk that is a share of the corpus, as in documents, doesn't predict itself."""
    import random

    r = random.Random(2)
    clean = [(i, prose(i, 150), "en") for i in range(200)]
    marks = [(1000 + i, " ".join("".join(r.choice("qxzjkvw") for _ in range(4)) + r.choice(["$$$", "&&&", "###"]) for _ in range(150)), "en") for i in range(8)]
    again = [(2000 + i, (prose(500 + i, 1) + " ") * 150, "en") for i in range(8)]
    got = {x.doc_id: x for x in P.perplexity_bands(table(spark, *clean, *marks, *again)).collect()}
    assert sum(not got[i].keep for i in range(200)) <= 2
    assert all(got[i].perplexity > got[i].upper and not got[i].keep for i, *_ in marks)
    assert all(got[i].perplexity < got[i].lower and not got[i].keep for i, *_ in again)


def test_urn_of_model_and_earlier_text(spark):
    """Both ways of scoring texts that the model wasn't counted on, against the definition one character at a time."""
    docs, new = table(spark, *enumerate(prose(i, 30) for i in range(10))), [prose(50, 20), "amet amet amet amet", "Zé amet€", ""]
    model = P.materialize(P.kneser_ney(P.top_counts(docs)))
    shard = P.load_shard(P.hashed(model)[0], 0)
    seed, a, want = P.seed_of("en"), P.CACHE, []
    for t in new:
        s, total, seen, after = [ord(c) for c in P.BOS * (P.ORDER - 1) + t], 0.0, Counter(), Counter()
        for i in range(P.ORDER - 1, len(s)):
            gram = tuple(s[i - P.ORDER + 1 : i + 1])
            p = math.exp(P.log_probabilities(shard, np.array(s, np.uint32), np.array([i]), np.array([seed]), P.ORDER)[0])
            total += math.log((seen[gram] + a * p) / (after[gram[:-1]] + a))
            seen[gram] += 1
            after[gram[:-1]] += 1
        want.append(total)
    x = table(spark, *enumerate(new))
    one, several = ({r.doc_id: r for r in P.score(x, model, cache=a, shard_bytes=n).collect()} for n in (P.SHARD_BYTES, 20_000))
    for got in (one, several):
        assert np.allclose([got[i].log_p for i in range(len(new))], want, rtol=1e-5)
    assert np.allclose([one[i].squares for i in range(len(new))], [several[i].squares for i in range(len(new))], rtol=1e-4, atol=1e-6)


def test_odd_rows(spark):
    rows = P.perplexity_bands(odd(spark)).collect()
    again = P.perplexity_bands(odd(spark), shard_bytes=100_000).collect()
    plain = lambda x: sorted((str(r.doc_id), r.lang, r.n_chars, r.keep, round(r.perplexity or 0, 6)) for r in x)
    assert plain(rows) == plain(again)
    assert len(rows) == len(ROWS)
    assert all(r.keep and r.perplexity is None for r in rows if not r.n_chars) and sum(not r.n_chars for r in rows) == 3
    assert {r.lang for r in rows} == {"en", "fr", "", "xx"}
    assert P.perplexity_bands(none(spark)).collect() == []
    assert P.perplexity_bands(table(spark, (1, "aaaa"))).count() == 1  # hardly any counts of counts


def brute_judge(rows, width=P.WIDTH, least=P.LEAST_CHARS):
    """(half-width, keep) by the definition, of rows (lang, n, log p, squares)."""
    median = lambda x: sorted(x)[math.ceil(len(x) / 2) - 1] if x else None
    out = []
    for lang, n, lp, _ in rows:
        own = [r for r in rows if r[0] == lang]
        h = lambda r: -r[2] / r[1]
        some = [r for r in own if r[1]]
        long, short = [r for r in some if r[1] >= least], [r for r in some if r[1] < least]
        mid = median([h(r) for r in long]) if long else median([h(r) for r in some])
        usual = median([r[1] for r in long]) or least
        tau = sum(max(0.0, r[3] / r[1]) if r[1] else 0.0 for r in own) / len(own)
        if not n:
            out.append((None, True))
            continue
        var = (1.4826 * (median([abs(h(r) - mid) for r in long]) or 0)) ** 2
        rate = max((1.4826 * (median([abs(h(r) - mid) * math.sqrt(r[1]) for r in short]) or 0)) ** 2, var * usual)
        half = width * math.sqrt(max(var + rate * max(0.0, 1 / n - 1 / usual), tau / n))
        out.append((half, abs(-lp / n - mid) <= half))
    return out


def test_bands_by_the_definition(spark):
    import random

    r = random.Random(4)
    rows = []
    for lang, k in (("en", 80), ("fr", 30), ("xx", 3), ("", 1)):
        for _ in range(k):
            n = r.choice([0, 5, 40, 150, 200, 600, 3000])
            h = r.gauss(2.2, 0.1 + 1 / math.sqrt(n + 1)) + r.choice([0, 0, 0, 0, 3, -1.5])
            rows.append((lang, n, -h * n, r.random() * n))
    df = spark.createDataFrame([(i, *x) for i, x in enumerate(rows)], "doc_id bigint, lang string, n_chars bigint, log_p double, squares double")
    got = {x.doc_id: x for x in P.judge(df).collect()}
    for i, (half, keep) in enumerate(brute_judge(rows)):
        assert got[i].keep == keep
        assert (got[i].upper is None) == (half is None)
        if half is not None:
            assert abs(math.log(got[i].upper / got[i].lower) / 2 - half) < 1e-9
    assert 0 < sum(not x.keep for x in got.values()) < 60
