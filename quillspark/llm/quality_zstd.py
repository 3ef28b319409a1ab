"""Quality classifier by compression.

For each language a zstandard dictionary is built from good and one from bad
labelled texts. A text is compressed with both, in blocks, as a dictionary helps
only the first of a long text; (bytes with bad - bytes with good) / (bytes +
`PRIOR`) is the normalised difference, the prior pulling short texts to 0. A
logistic curve over it and the text's weight, bytes / (bytes + PRIOR), makes it the
probability that the text is good: what is too short to tell isn't taken for bad.
The curve is fitted for each language on labelled texts that no dictionary has seen.

Only fitting is bounded: about `per_class` labelled texts of each class in each of the
`LANGUAGES` that have most, by a hash of doc_id, half of them for the dictionaries; the
other languages' are fitted on as one. Texts of more than `FIT_CHARS` are left out of it.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard as zstd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_sample, materialize, pick, sized_broadcast

PER_CLASS, LANGUAGES, FIT_CHARS, DICT_BYTES, BLOCK, LEVEL, PRIOR = 2000, 64, 1 << 18, 64 << 10, 1024, 3, 100
#: A text is rejected below this probability of being good.
LEAST = 0.3
ANY = ""


@dataclass
class Model:
    """Dictionaries and curves by language; ANY is for the others."""

    dictionaries: dict[str, tuple[bytes, bytes]]
    curves: dict[str, tuple[float, float, float]]

    def language(self, lang: str | None) -> str | None:
        return lang if lang in self.dictionaries else ANY if ANY in self.dictionaries else None


def blocks(text: str, size: int = BLOCK) -> list[bytes]:
    b = text.encode("utf-8", "surrogatepass")
    return [b[i : i + size] for i in range(0, len(b), size)]


def dictionary(texts: list[str], size: int = DICT_BYTES) -> bytes:
    """A dictionary trained on all texts, of at most a quarter of their bytes; where
    training fails, plain content, a like share of each block,
    the texts' blocks in turn."""
    each = [blocks(t) for t in texts]
    parts = [b for x in each for b in x]
    try:
        return zstd.train_dictionary(min(size, sum(map(len, parts)) // 4), parts, level=LEVEL).as_bytes()
    except (zstd.ZstdError, ValueError):  # too few distinct parts
        pass
    share = max(1, size // max(1, len(parts)))
    turns = range(max(map(len, each), default=0))
    return b"".join(x[k][:share] for k in turns for x in each if k < len(x))[:size]


def compressor(content: bytes) -> zstd.ZstdCompressor:
    d = zstd.ZstdCompressionDict(content)
    d.precompute_compress(level=LEVEL)
    return zstd.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False)


def difference(text: str, good: zstd.ZstdCompressor, bad: zstd.ZstdCompressor) -> tuple[float, float]:
    """(normalised difference, weight) of a text."""
    parts = blocks(text)
    n = sum(map(len, parts))
    d = sum(len(bad.compress(b)) - len(good.compress(b)) for b in parts)
    return d / (n + PRIOR), n / (n + PRIOR)


def logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, ...]:
    """(slopes, offset) of a logistic curve over the columns of x (or x itself), by Newton steps with a light ridge."""
    x = np.asarray(x, float).reshape(len(y), -1)
    scale = np.std(x, axis=0)
    scale[scale == 0] = 1.0
    m = np.c_[x / scale, np.ones(len(x))]
    w = np.zeros(m.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(m @ w, -30, 30)))
        grad = m.T @ (y - p) - 1e-2 * w
        hess = (m * (p * (1 - p))[:, None]).T @ m + 1e-2 * np.eye(len(w))
        step = np.linalg.solve(hess, grad)
        w += step
        if abs(step).max() < 1e-9:
            break
    return *map(float, w[:-1] / scale), float(w[-1])


def fit_rows(rows: list[tuple[str | None, int, str]]) -> Model:
    """A model from (lang, quality, text) in a fixed order; even places make
    dictionaries, odd ones curves. A language with fewer than 8 texts of a class
    is left to ANY, which is made of all rows."""
    model = Model({}, {})
    for lang in sorted({r[0] for r in rows if r[0] is not None}) + [ANY]:
        own = [r for r in rows if lang in (ANY, r[0])]
        sides = [[r[2] for r in own if r[1] == q] for q in (1, 0)]
        if min(map(len, sides)) < (8 if lang != ANY else 2):
            continue
        dicts = tuple(dictionary(s[::2]) for s in sides)
        if not all(len(d) >= 8 for d in dicts):
            continue
        good, bad = map(compressor, dicts)
        held = [s[1::2] for s in sides]
        x = np.array([difference(t, good, bad) for s in held for t in s])
        y = np.r_[np.ones(len(held[0])), np.zeros(len(held[1]))]
        model.dictionaries[lang], model.curves[lang] = dicts, logistic(x, y)
    return model


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Model:
    """A model from the labelled texts of docs. Labels with a null doc_id or
    quality, and labelled documents without text, are left out; so are texts of more
    than FIT_CHARS. A doc_id labelled both good and bad counts as bad."""
    chosen = labels.where("doc_id is not null and quality is not null").select("doc_id", F.col("quality").cast("int").alias("quality")).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    size = F.length("text")
    ids = docs.where((size > 0) & (size <= FIT_CHARS)).select("doc_id", "lang").where("doc_id is not null").join(chosen, "doc_id")
    ids = materialize(ids)
    most = materialize(ids.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(LANGUAGES).select(F.col("lang").alias("known")))
    ids = ids.join(sized_broadcast(most), F.col("lang").eqNullSafe(F.col("known")), "left").withColumn("kind", F.coalesce("known", F.lit(ANY)))
    ids = materialize(bounded_sample(ids, ["kind", "quality"], per_class, F.col("doc_id")).select("doc_id", "quality").distinct())
    texts = pick(docs, "doc_id", "lang", "text").join(sized_broadcast(ids), "doc_id").where((size > 0) & (size <= FIT_CHARS))
    rows = sorted({(r.doc_id, r.lang, r.quality, r.text) for r in texts.collect()}, key=lambda r: (hash_order(r[0]), r[3]))
    return fit_rows([r[1:] for r in rows])


def hash_order(doc_id: int) -> str:
    import hashlib

    return hashlib.md5(str(doc_id).encode()).hexdigest()


def score(docs: DataFrame, model: Model, least: float = LEAST) -> DataFrame:
    """docs with (difference, p_good, keep). A null or empty text has difference 0
    and stays; so does every text if the model has no dictionaries. A null or
    unknown language takes the model of all languages. Repeated rows repeat, an empty
    table gives none. Columns of these names are replaced, others left as they are,
    whatever their names."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    made: dict[str, tuple] = {}
    kind = T.StructType([T.StructField("difference", T.DoubleType()), T.StructField("p_good", T.DoubleType())])

    @F.arrow_udf(kind)
    def judge(text: pa.Array, lang: pa.Array) -> pa.Array:
        m = shared.value
        diff, prob = [], []
        for t, x in zip(text.to_pylist(), lang.to_pylist()):
            key = m.language(x)
            if not t or key is None:
                diff.append(0.0)
                prob.append(1.0)
                continue
            if key not in made:
                made[key] = tuple(map(compressor, m.dictionaries[key]))
            d, weight = difference(t, *made[key])
            slope, grown, offset = m.curves[key]
            diff.append(d)
            prob.append(float(1 / (1 + np.exp(-np.clip(slope * d + grown * weight + offset, -30, 30)))))
        return pa.StructArray.from_arrays([pa.array(diff, pa.float64()), pa.array(prob, pa.float64())], ["difference", "p_good"])

    names = [c for c in docs.columns if c.lower() not in ("difference", "p_good", "keep")]
    x = docs.select(F.struct(*(F.col(f"`{c}`") for c in names)).alias("row"), judge(F.col("text"), F.col("lang")).alias("q"))
    return x.select("row.*", "q.difference", "q.p_good", (F.col("q.p_good") >= least).alias("keep"))


def classify(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, least: float = LEAST) -> DataFrame:
    """docs with scores, from a model fitted on the labels."""
    return score(docs, fit(docs, labels, per_class), least)
