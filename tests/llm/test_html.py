import math

import numpy as np
from odd import prose

from quillspark.llm import html_tree as H


def page(i, article="article"):
    nav = "".join(f'<li><a href="/{k}">link {k}</a></li>' for k in range(5))
    body = "".join(f"<p>{prose(i * 10 + k, 25)}.</p>" for k in range(1 + i % 4))
    return f'<html><head><title>T {i}</title><script>var x = "</p>";</script></head><body><nav><ul>{nav}</ul></nav><div class="ad">{prose(i + 500, 12)}.</div><{article}><h1>{prose(i, 5)}</h1>{body}</{article}><footer>&copy; site {i}</footer></body></html>'


def main_text(i):
    return "\n".join([prose(i, 5)] + [prose(i * 10 + k, 25) + "." for k in range(1 + i % 4)])


def test_parse():
    t = H.parse("<p>a<b>b<p>c<br>d<ul><li>e<li>f</ul><!-- x --><script>if (a<b) {}</script>g &amp; h<")
    tags = [H.TAGS[k] for k in t.tag]
    assert [x for x in t.text if x] == ["a", "b", "c", "d", "e", "f", "g & h<"]
    assert tags.count("p") == 2 and tags.count("li") == 2
    li = [k for k, x in enumerate(tags) if x == "li"]
    assert t.parent[li[0]] == t.parent[li[1]]
    assert H.parse(None).text == [""] and H.parse("").text == [""]
    assert len(H.parse("<div>" * 3000 + "x").parent) == 3002


def exact(f, m):
    """P(content) by summing over all labellings of one small tree."""
    n = len(f.parent)
    total, own = 0.0, np.zeros(n)
    for mask in range(1 << n):
        y = [(mask >> k) & 1 for k in range(n)]
        s = m.start[y[0]]
        for k in range(n):
            s += m.unary[f.features[k], y[k]].sum()
            if f.parent[k] >= 0:
                s += m.edge[f.tag[k], y[f.parent[k]], y[k]]
        p = math.exp(s)
        total += p
        own += p * np.array(y)
    return own / total


def test_messages_give_exact_marginals():
    m = H.Model.of(H.counts_of([H.parse(page(i)) for i in range(20)], [None] * 20))
    for doc in ("<p>a b c.</p>", "<div><a>x</a><p>long text here, and more.</p></div>", "<nav><ul><li>q</ul></nav><p>z", ""):
        f = H.forest([H.parse(doc)])
        assert np.allclose(H.marginals(f, m), exact(f, m), atol=1e-9)


def test_held_out_pages(spark):
    rows = [(i, page(i)) for i in range(120)] + [(1000 + i, page(1000 + i, "div")) for i in range(60)]
    pages = spark.createDataFrame(rows, "page_id bigint, html string")
    got = {r.page_id: r for r in H.extract_pages(pages).collect()}
    assert len(got) == 180
    right = sum(got[i].text == main_text(i) for i, _ in rows)
    assert right / len(rows) > 0.97  # those with a plain div mark nothing
    gold = spark.createDataFrame([(page(i, "div"), main_text(i)) for i in range(80)], "html string, content string")
    got = H.extract_pages(pages.where("page_id >= 1000"), gold).collect()
    assert sum(r.text == main_text(r.page_id) for r in got) / 60 > 0.97


def test_odd_rows(spark):
    rows = [(1, None, "x"), (None, page(1), "x"), (2, "", "x"), (3, "plain text", "x"), (3, "plain text", "x"), (4, "<p>" + "word " * 200_000, "x"), (5, "<div>" * 5000 + "deep", "x"), (6, "&#xD800; \x00 <>", "x"), (7, page(2), None)]
    pages = spark.createDataFrame(rows, "page_id bigint, html string, text string")
    got = H.extract_pages(pages).collect()
    assert len(got) == len(rows) and all(r.text is not None for r in got)
    first = next(r for r in got if r.page_id == 1)
    assert (first.text, first.n_nodes, first.n_text, first.confidence) == ("", 1, 0, 1.0)
    assert H.extract_pages(pages.limit(0)).collect() == []


def test_long_pages_take_linear_time():
    import time

    began = time.time()
    for page_ in ("<div>" * 20_000 + "x</b>" * 20_000, "<div>" * 400_000 + "deep", "<p>" * 100_000 + "</div>" * 100_000 + "end"):
        t = H.parse(page_)
        H.marginals(H.forest([t]), H.Model.of(np.ones(H.SLOTS)))
        assert max(t.depth) <= H.MAX_DEPTH
        assert "".join(t.text) == "".join(page_.replace("</", "<").split("<div>")).replace("<b>", "").replace("<p>", "")
    assert time.time() - began < 30


def test_held_out_by_hash(spark):
    """Fitted on some of the pages of a folder, held against what the others mark."""
    from pathlib import Path

    import pytest

    if not Path("/root/testdata/sf0.01/pages.parquet").exists():
        pytest.skip("no tables")
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    half = "pmod(xxhash64(page_id), 2) = {}"
    model = H.fit(H.self_labelled(pages.where(half.format(0))))
    right = all_ = 0
    for r in pages.where(half.format(1)).collect():
        t = H.parse(r.html)
        p = H.marginals(H.forest([t]), model)
        for k, x in enumerate(t.text):
            if x and any(t.marked):
                all_ += len(x)
                right += len(x) * ((p[k] >= H.LEAST) == t.marked[k])
    assert right > 0.97 * all_ > 0


def test_whole_query_by_the_definition(spark):
    """Counting, smoothing, marginals by enumeration and assembly, a node at a time."""
    pages_ = [f"<div class='nav'><a href='/'>home {i}</a></div><article><p>Some text of {i}, which is long enough.</p><p>And <b>more {i}</b>.</p></article>" for i in range(12)]
    pages_ += ["<div><p>Plain words, no mark.</p><a>x</a></div>", "", "<ul><li><a>one</a><li>two</ul>"]
    trees = [H.parse(p) for p in pages_]
    label, seen, edge = {}, {}, {}

    def text_below(t, k):
        return (len(t.text[k]), len(t.text[k]) * t.marked[k]) if t.text[k] else tuple(map(sum, zip((0, 0), *(text_below(t, c) for c in range(len(t.parent)) if t.parent[c] == k))))

    for t, p in zip(trees, pages_):
        if "<article" not in p:
            continue
        f = H.forest([t])
        y = []
        for k in range(len(t.parent)):
            size, marked = text_below(t, k)
            y.append(int(2 * marked > size))
        label[y[0]] = label.get(y[0], 0) + 1
        for k in range(len(t.parent)):
            for x in f.features[k].tolist():
                seen[x, y[k]] = seen.get((x, y[k]), 0) + 1
            if k:
                e = (t.tag[k], y[t.parent[k]], y[k])
                edge[e] = edge.get(e, 0) + 1
    s = H.SMOOTH

    def unary(x, y):
        at = max(o for o in H._OFFS if o <= x)
        kinds = range(at + 1, at + H.SIZES[list(H._OFFS).index(at)])
        return 0.0 if x == at else math.log((seen.get((x, y), 0) + s) / sum(seen.get((v, y), 0) + s for v in kinds))

    def content(t):
        f, n = H.forest([t]), len(t.parent)
        own, total = [0.0] * n, 0.0
        one = [[sum(unary(x, y) for x in f.features[k].tolist()) for y in (0, 1)] for k in range(n)]
        for mask in range(1 << n):
            y = [(mask >> k) & 1 for k in range(n)]
            p = math.log((label.get(y[0], 0) + s) / (sum(label.values()) + 2 * s)) + sum(one[k][y[k]] for k in range(n))
            for k in range(1, n):
                c = [edge.get((t.tag[k], y[t.parent[k]], z), 0) + s for z in (0, 1)]
                p += math.log(c[y[k]] / sum(c))
            total += math.exp(p)
            own = [o + math.exp(p) * z for o, z in zip(own, y)]
        return [o / total for o in own]

    got = {r.page_id: r for r in H.extract_pages(spark.createDataFrame(list(enumerate(pages_)), "page_id bigint, html string")).collect()}
    for i, t in enumerate(trees):
        p, lines = content(t), [[]]
        for k, x in enumerate(t.text):
            if x:
                if t.gap[k]:
                    lines.append([])
                if p[k] >= H.LEAST:
                    lines[-1].append(x)
        want = [" ".join("".join(x).split()) for x in lines]
        assert got[i].text == "\n".join(x for x in want if x)
        sure = [max(p[k], 1 - p[k]) for k, x in enumerate(t.text) if x]
        assert abs(got[i].confidence - (sum(sure) / len(sure) if sure else 1.0)) < 1e-6
