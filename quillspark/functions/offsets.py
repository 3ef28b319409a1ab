"""Where tokens stand in their text: start and end in characters, on demand.

An analyser gives an array of tokens; most uses need no more. Here each token
of a tokeniser that matches a pattern comes with its place, and goes through the
analyser's filters by itself.
"""

from __future__ import annotations

from array import array

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from .analysis import Analyser

#: Matches whose tokens are Python strings at once.
PIECE = 1 << 14
_SPAN = StructType([StructField("token", StringType()), StructField("start", IntegerType()), StructField("end", IntegerType())])


def pattern_of(analyser: Analyser) -> regex.Pattern:
    """The tokeniser's pattern. An error if it has none, or if character filters move the text."""
    found = getattr(analyser.tokeniser, "pattern", None)
    if found is None or analyser.char_filters:
        raise ValueError(f"the {analyser.name} analyser's tokens have no places")
    return regex.compile(found.replace("(?U)", ""))


def token_spans(text: Column, analyser: Analyser) -> Column:
    """The tokens before any filter as structs (token, start, end); null of null."""
    pattern = pattern_of(analyser)

    @F.arrow_udf(ArrayType(_SPAN))
    def run(texts: pa.Array) -> pa.Array:
        return found_spans(texts, pattern)

    return run(text)


def found_spans(texts: pa.Array, pattern: regex.Pattern) -> pa.Array:
    """The matches in each text. Python holds the tokens of PIECE matches, or of one
    text, at once; all else is in flat arrays."""
    tokens, starts, ends, first, done = [], array("i"), array("i"), array("i", [0]), []
    for t in texts:
        for m in pattern.finditer(t.as_py() or ""):
            tokens.append(m[0])
            starts.append(m.start())
            ends.append(m.end())
        first.append(len(starts))
        if len(tokens) >= PIECE:
            done.append(pa.array(tokens, pa.string()))
            tokens = []
    flat = pa.concat_arrays([*done, pa.array(tokens, pa.string())])
    made = pa.StructArray.from_arrays([flat, *(pa.array(np.frombuffer(x, np.int32)) for x in (starts, ends))], ["token", "start", "end"])
    return pa.ListArray.from_arrays(pa.array(np.frombuffer(first, np.int32)), made, mask=texts.is_null() if texts.null_count else None)


def spans(docs: DataFrame, key: str, field: str, analyser: Analyser) -> DataFrame:
    """(key, place, start, end, term): a row for each term of each token; place is the
    token's number before filters. Filters see one token at a time."""
    x = docs.select(key, F.posexplode(token_spans(F.col(field), analyser)).alias("place", "t"))
    toks = F.array("t.token")
    for f in analyser.filters:
        toks = f(toks)
    return x.select(key, "place", "t.start", "t.end", F.explode(toks).alias("term"))


def forms(docs: DataFrame, field: str, analyser: Analyser, terms: list[str]) -> list[str]:
    """The spellings in docs that the analyser takes to one of the terms: a few for each term."""
    x = docs.select(F.explode(F.array_distinct(analyser.tokeniser(F.col(field)))).alias("token")).distinct()
    toks = F.array("token")
    for f in analyser.filters:
        toks = f(toks)
    hit = x.select("token", toks.alias("toks")).where(F.arrays_overlap("toks", F.array(*map(F.lit, terms))) if terms else F.lit(False))
    return sorted(r.token for r in hit.collect())


def unique_at_place(found: DataFrame, key: str) -> DataFrame:
    """spans() with each term once where it stands; the same term elsewhere stays."""
    return found.dropDuplicates([key, "start", "term"])
