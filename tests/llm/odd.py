"""Documents with all that operators must stand: nulls in every column, empty and long texts, repeats, clashing columns."""

import random

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, n_tokens string, position string, epoch string, keep string, term string, count string, a string, b string, h string, rank string, content string, key string, docs string, difference string, p_good string, line string, supply string, total string, limit string, pieces string, src string, weight string, share string"
WORDS = "lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua enim minim veniam quis nostrud".split()


def prose(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + r.choice(["", "", "s", "ly", "ing"]) for _ in range(n))


LONG = prose(99, 60_000)
ROWS = [
    (1, prose(1, 60), "en", "a"),
    (1, prose(1, 60), "en", "a"),
    (1, prose(2, 60), "en", "a"),
    (2, prose(1, 60), "en", "b"),
    (None, prose(3, 50), "en", "b"),
    (4, None, "en", "a"),
    (5, "", "fr", "a"),
    (6, " \n\n ", None, "b"),
    (7, prose(4, 40), None, None),
    (8, LONG, "en", "a"),
    (9, LONG + " end", "en", "a"),
    (10, "été 日本語 \x00 😀 naïve", "xx", ""),
    (None, None, None, None),
]


def odd(spark):
    rows = [(i, t, g, s, None if t is None else len(t), *["clash"] * 23) for i, t, g, s in ROWS]
    return spark.createDataFrame(rows, SCHEMA)


def none(spark):
    return spark.createDataFrame([], SCHEMA)


def table(spark, *rows):
    """Rows (doc_id, text[, lang[, source]])."""
    return spark.createDataFrame([(i, t, *(list(rest) + ["en", "a"][len(rest) :]), 0 if t is None else len(t)) for i, t, *rest in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
