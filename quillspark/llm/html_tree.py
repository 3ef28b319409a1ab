"""HTML extraction with a tree-structured graphical model.

A page's elements and runs of text are the nodes of a tree; each is content or
not. A node's potential comes from what is seen of it (tag, length, share of link
text, punctuation, hints in class and id), an edge's from the labels of parent and
child and the kind of the child. Sum-product messages go up from the leaves and
down from the root, for all pages of a batch at once, depth by depth, and give each
node's exact marginal. Text whose marginal is at least one half is kept.

The tables are smoothed counts over labelled pages, summed by Spark. Where no
gold texts are given, pages that mark their content (article, main) label
themselves; these two tags are then seen as plain div, so that the model learns
what content looks like and not the mark.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pick

#: Labelled pages that the tables are counted on, at most about so many, by a hash of page_id; smoothing; the least marginal of kept text; text handled at once.
FIT_PAGES, SMOOTH, LEAST, BATCH_CHARS = 5000, 0.5, 0.5, 4 << 20
#: Elements nested deeper stand in the one at this depth, as browsers have it; their text isn't lost.
MAX_DEPTH = 512

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?][^>]*>", re.S)
_RAW_END = {t: re.compile(rf"</{t}\s*>", re.I) for t in ("script", "style", "textarea", "noscript", "template")}
_HINT = re.compile(r"(?:class|id|role)\s*=\s*[\"']?([^\"'>]*)", re.I)
_BAD = re.compile(r"\b(?:ads?|advert\w*|banner|nav\w*|menu|foot\w*|side\w*|comment\w*|promo\w*|share|social|cookie\w*|related|sponsor\w*|breadcrumbs?)\b", re.I)
_GOOD = re.compile(r"\b(?:content|article|post|entry|body|main|story|text)\b", re.I)
_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_INLINE = frozenset("a abbr b bdi bdo cite code data dfn em font i kbd label mark q s samp small span strong sub sup time u var wbr".split())
_CLOSES_P = frozenset("address article aside blockquote div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
_CLOSES = {"li": ("li", ("ul", "ol")), "dt": ("dt", ("dl",)), "dd": ("dd", ("dl",)), "tr": ("tr", ("table",)), "td": ("td", ("tr",)), "th": ("th", ("tr",)), "option": ("option", ("select",))}
_MARKS = ("article", "main")

TAGS = ["#other", "#text", "html", "head", "title", "meta", "link", "script", "style", "body", "nav", "header", "footer", "aside", "div", "section", "p", "h1", "h2", "h3", "h4", "ul", "ol", "li", "a", "table", "tr", "td", "th", "form", "button", "img", "br", "blockquote", "pre", "code", "figure", "span", "b", "i", "em", "strong", "dl", "dt", "dd", "iframe", "noscript", "select", "template"]
_TAG = {t: i for i, t in enumerate(TAGS)} | {m: TAGS.index("div") for m in _MARKS}
#: Values of each feature, 0 being for nodes that lack it: an element's tag and hints; of a run of text the log2 of its length, the share of
#: links in its parent's text, what it ends with, its parent's tag. An element has no features of its text, which would count twice.
SIZES = (1 + len(TAGS), 4, 17, 7, 4, 1 + len(TAGS))
_OFFS = np.r_[0, np.cumsum(SIZES)][:-1]
_N = int(sum(SIZES))
#: Slots of the counts: label, feature value and label, child's tag and both labels.
SLOTS = 2 + 2 * _N + 4 * len(TAGS)


@dataclass
class Tree:
    """A page's nodes, parents first; text is '' for elements, gap whether a block begins before it."""

    parent: list[int]
    tag: list[int]
    text: list[str]
    gap: list[bool]
    hint: list[int]
    marked: list[bool]
    depth: list[int]


def parse(page: str | None) -> Tree:
    """The tree of a page, of unclosed and misnested tags as browsers nearly do.
    Raw text elements and comments have no text nodes."""
    t = Tree([-1], [_TAG["html"]], [""], [True], [0], [False], [0])
    stack: list[tuple[int, str]] = [(0, "html")]
    open_: dict[str, list[int]] = {}  # where each name stands in the stack
    gap, at, page = True, 0, page or ""

    def add(tag: int, text: str, hint: int, mark: bool) -> int:
        p = stack[min(len(stack), MAX_DEPTH) - 1][0]
        t.parent.append(p)
        t.depth.append(t.depth[p] + 1)
        t.tag.append(tag)
        t.text.append(text)
        t.gap.append(gap)
        t.hint.append(hint)
        t.marked.append(mark or t.marked[p])
        return len(t.parent) - 1

    def close(name: str, within: tuple[str, ...] = ()) -> None:
        """Closes the innermost element of a name and what it holds, unless one of `within` is nearer."""
        at = open_.get(name)
        if at and not any(open_.get(w) and open_[w][-1] > at[-1] for w in within):
            k = at[-1]
            for _, closed in stack[k:]:
                open_[closed].pop()
            del stack[k:]

    def words(piece: str) -> None:
        nonlocal gap
        if "&" in piece:
            piece = entities.unescape(piece)
        if piece and not piece.isspace():
            add(1, piece, 0, False)
            gap = False

    size = len(page)
    while at < size:
        m = _TOKEN.search(page, at)
        if not m:
            words(page[at:])
            break
        if m.start() > at:
            words(page[at : m.start()])
        at = m.end()
        name = m[2]
        if name is None:
            continue
        name = name.lower()
        if name not in _INLINE:
            gap = True
        if m[1]:
            if name != "html":
                close(name)
            continue
        if name == "html":
            continue
        if name in _CLOSES_P:
            close("p", ("td", "th", "button", "li", "div", "section", "article", "body"))
        if name in _CLOSES:
            close(*_CLOSES[name])
        hint = 0
        if m[3]:
            found = " ".join(_HINT.findall(m[3])).replace("-", " ").replace("_", " ")
            hint = 2 if _BAD.search(found) else 1 if _GOOD.search(found) else 0
        node = add(_TAG.get(name, 0), "", hint, name in _MARKS)
        if name in _RAW_END:
            end = _RAW_END[name].search(page, at)
            at = end.end() if end else size
        elif name not in _VOID and not m[3].endswith("/"):
            open_.setdefault(name, []).append(len(stack))
            stack.append((node, name))
    return t


@dataclass
class Forest:
    """The trees of a batch as arrays; first[k] is the root of page k."""

    parent: np.ndarray
    tag: np.ndarray
    features: np.ndarray
    depth: np.ndarray
    first: np.ndarray


def forest(trees: list[Tree]) -> Forest:
    sizes = np.array([len(t.parent) for t in trees], np.int64)
    first = np.r_[0, np.cumsum(sizes)]
    flat = lambda name: [x for t in trees for x in getattr(t, name)]
    parent, tag, hint = (np.array(flat(k), np.int64) for k in ("parent", "tag", "hint"))
    parent += np.where(parent >= 0, np.repeat(first[:-1], sizes), 0)
    texts = flat("text")
    chars = np.array(list(map(len, texts)), np.int64)
    ends = np.array([0 if not x else 1 if x.rstrip()[-1:] in ".!?:;。…\"”»" else 2 if any(c in x for c in ".,;") else 3 for x in texts], np.int64)
    depth = np.array(flat("depth"), np.int64)
    order = np.argsort(-depth, kind="stable")
    cuts = np.searchsorted(-depth[order], np.arange(-depth.max(initial=0), 2))
    link = np.zeros(len(parent), bool)
    for k in range(len(cuts) - 2, -1, -1):  # from the roots down
        part = order[cuts[k] : cuts[k + 1]]
        link[part] = (tag[part] == _TAG["a"]) | ((parent[part] >= 0) & link[parent[part]])
    total, linked = chars.copy(), np.where(link, chars, 0)
    for k in range(len(cuts) - 1):
        part = order[cuts[k] : cuts[k + 1]]
        part = part[parent[part] >= 0]
        np.add.at(total, parent[part], total[part])
        np.add.at(linked, parent[part], linked[part])
    text = chars > 0
    size = np.minimum(16, np.log2(np.maximum(chars, 1)).astype(np.int64) + 1)
    share = 1 + 5 * linked[parent] // np.maximum(total[parent], 1)  # a run of text has a parent
    columns = [(~text, 1 + tag), (~text, 1 + hint), (text, size), (text, share), (text, ends), (text, 1 + tag[parent])]
    return Forest(parent, tag, np.stack([np.where(has, value, 0) for has, value in columns], 1) + _OFFS, depth, first)


@dataclass
class Model:
    """Log potentials: start[y], unary[feature value, y], edge[child's tag, parent's y, child's y]."""

    start: np.ndarray
    unary: np.ndarray
    edge: np.ndarray

    @classmethod
    def of(cls, counts: np.ndarray, smooth: float = SMOOTH) -> Model:
        label, seen, edge = counts[:2], counts[2 : 2 + 2 * _N].reshape(_N, 2), counts[2 + 2 * _N :].reshape(-1, 2, 2)
        start = np.log((label + smooth) / (label + smooth).sum())
        unary = np.empty((_N, 2))
        for at, n in zip(_OFFS, SIZES):
            part = seen[at + 1 : at + n] + smooth
            unary[at], unary[at + 1 : at + n] = 0, np.log(part / part.sum(0))
        edge = edge + smooth
        return cls(start, unary, np.log(edge / edge.sum(2, keepdims=True)))


def marginals(f: Forest, m: Model) -> np.ndarray:
    """P(content) of each node, by sum-product messages up and down the trees."""
    n = len(f.parent)
    own = m.unary[f.features].sum(1)
    roots = f.parent < 0
    own[roots] += m.start
    order = np.argsort(f.depth, kind="stable")
    cuts = np.searchsorted(f.depth[order], np.arange(f.depth.max(initial=0) + 2))
    up = np.zeros((n, 2))  # message of a node to its parent
    below = own.copy()  # own potential and the messages from below
    for d in range(len(cuts) - 2, 0, -1):
        part = order[cuts[d] : cuts[d + 1]]
        x = m.edge[f.tag[part]] + below[part][:, None, :]
        up[part] = np.logaddexp(x[:, :, 0], x[:, :, 1])
        np.add.at(below, f.parent[part], up[part])
    belief = below.copy()
    for d in range(1, len(cuts) - 1):
        part = order[cuts[d] : cuts[d + 1]]
        rest = belief[f.parent[part]] - up[part]
        rest -= rest.max(1, keepdims=True)
        x = m.edge[f.tag[part]] + rest[:, :, None]
        belief[part] = below[part] + np.logaddexp(x[:, 0], x[:, 1])
    return 1 / (1 + np.exp(np.clip(belief[:, 0] - belief[:, 1], -700, 700)))


def label(t: Tree, gold: str | None) -> np.ndarray:
    """0/1 for each node: text is content if the gold text has it (without one,
    if it's inside article or main); an element if most of its text is."""
    y = np.zeros(len(t.parent))
    size = np.zeros(len(t.parent))
    squeezed = None if gold is None else " ".join(gold.split())
    for k, x in enumerate(t.text):
        if x:
            size[k] = len(x)
            y[k] = size[k] * (t.marked[k] if squeezed is None else " ".join(x.split()) in squeezed)
    for k in range(len(t.parent) - 1, 0, -1):
        y[t.parent[k]] += y[k]
        size[t.parent[k]] += size[k]
    return (2 * y > size).astype(np.int64)


def counts_of(trees: list[Tree], golds: list[str | None]) -> np.ndarray:
    f = forest(trees)
    y = np.concatenate([label(t, g) for t, g in zip(trees, golds)])
    out = np.zeros(SLOTS)
    out[:2] = np.bincount(y[f.first[:-1]], minlength=2)
    seen = (f.features * 2 + y[:, None]).ravel()
    out[2 : 2 + 2 * _N] = np.bincount(seen, minlength=2 * _N)
    child = np.flatnonzero(f.parent >= 0)
    out[2 + 2 * _N :] = np.bincount(f.tag[child] * 4 + y[f.parent[child]] * 2 + y[child], minlength=4 * len(TAGS))
    return out


def _chunks(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    i = 0
    while i < len(texts):
        j, n = i, 0
        while j < len(texts) and (j == i or n + len(texts[j] or "") <= BATCH_CHARS):
            n += len(texts[j] or "")
            j += 1
        yield i, j
        i = j


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(SLOTS)
    for batch in batches:
        pages, golds = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        for i, j in _chunks(pages):
            total += counts_of([parse(p) for p in pages[i:j]], golds[i:j])
    some = np.flatnonzero(total)
    yield pa.record_batch([pa.array(some.astype(np.int32)), pa.array(total[some])], ["slot", "n"])


def fit(labelled: DataFrame) -> Model:
    """A model from labelled pages (html, content): content is a page's gold text,
    or null where the page marks it. Null pages teach nothing."""
    rows = labelled.where("html is not null").select("html", F.col("content").cast("string")).mapInArrow(_count, "slot int, n double")
    counts = np.zeros(SLOTS)
    for r in rows.groupBy("slot").agg(F.sum("n").alias("n")).collect():  # SLOTS rows at most
        counts[r.slot] = r.n
    return Model.of(counts)


def self_labelled(pages: DataFrame, most: int = FIT_PAGES) -> DataFrame:
    """(html, content) of about `most` pages that mark their content, chosen by a hash of page_id; all if there are fewer."""
    marked = pick(pages, "page_id", "html").where(F.col("html").rlike(r"(?i)<(article|main)[\s>]"))
    n = marked.count()
    if n > most:
        marked = marked.where(F.expr(f"pmod(xxhash64(page_id), {n}) < {most}"))
    return marked.select("html", F.lit(None).cast("string").alias("content"))


def assemble(t: Tree, keep: np.ndarray) -> str:
    """The kept text, a line for each block, white space squeezed."""
    out: list[str] = []
    line: list[str] = []
    for x, gap, k in zip(t.text, t.gap, keep.tolist()):
        if not x:
            continue
        if gap and line:
            out.append(" ".join("".join(line).split()))
            line = []
        if k:
            line.append(x)
    out.append(" ".join("".join(line).split()))
    return "\n".join(x for x in out if x)


def extract(pages: DataFrame, model: Model, least: float = LEAST) -> DataFrame:
    """(page_id, text, n_nodes, n_text, n_kept, confidence) of each row of pages:
    the text kept, the nodes, the runs of text and those kept, and the mean over
    runs of text of the likelier label's probability.

    A null or empty page has an empty text, its root for a node and a confidence
    of 1; so has a page without text. A null page_id stays null; repeated rows
    repeat; an empty table gives no rows; other columns aren't read. Text outside
    any tag belongs to the root."""
    shared = pages.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = batch.column(1).to_pylist()
            for i, j in _chunks(got):
                trees = [parse(p) for p in got[i:j]]
                f = forest(trees)
                p = marginals(f, shared.value)
                rows = []
                for k, t in enumerate(trees):
                    own = p[f.first[k] : f.first[k + 1]]
                    runs = np.array([bool(x) for x in t.text])
                    keep = runs & (own >= least)
                    sure = np.maximum(own, 1 - own)[runs]
                    rows.append((assemble(t, keep), len(own), int(runs.sum()), int(keep.sum()), float(sure.mean()) if len(sure) else 1.0))
                types = [pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.float64()]
                text = [r[0].encode("utf-8", "replace").decode() for r in rows]
                columns = [text, *list(zip(*rows))[1:]]
                yield pa.record_batch([batch.column(0).slice(i, j - i), *(pa.array(c, x) for c, x in zip(columns, types))], ["page_id", "text", "n_nodes", "n_text", "n_kept", "confidence"])

    return pick(pages, "page_id", "html").mapInArrow(run, "page_id bigint, text string, n_nodes int, n_text int, n_kept int, confidence double")


def extract_pages(pages: DataFrame, labelled: DataFrame | None = None, most: int = FIT_PAGES, least: float = LEAST) -> DataFrame:
    """extract() with a model fitted on labelled (html, content), or on the pages that label themselves."""
    return extract(pages, fit(self_labelled(pages, most) if labelled is None else labelled), least)
