"""Python functions over token arrays, called once for each distinct token of an Arrow batch."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType


#: Terms whose results a task remembers, and the most characters of such a term.
KNOWN, SHORT = 1 << 16, 40


def pieces(size: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """(first row, number of rows) of runs of rows with at most so many items, or one row; size: items of each row."""
    ends, i = np.cumsum(size), 0
    while i < len(size):
        j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + most, "right")))
        yield i, j - i
        i = j


def per_term(f: Callable[[str], str]) -> Callable[[Column], Column]:
    """An array<string> function that applies f to each token."""
    known: dict[str, str] = {}

    def of(t: str | None) -> str | None:
        if t is None or len(t) > SHORT:
            return None if t is None else f(t)
        made = known.get(t)
        if made is None:
            if len(known) >= KNOWN:
                known.clear()
            made = known[t] = f(t)
        return made

    @F.arrow_udf(ArrayType(StringType()))
    def run(tokens: pa.Array) -> pa.Array:
        d = tokens.flatten().dictionary_encode()
        made = pa.array([of(t) for t in d.dictionary.to_pylist()], pa.string())
        offsets = pa.array([0] + pc.cumulative_sum(pc.fill_null(pc.list_value_length(tokens), 0)).to_pylist(), pa.int32())
        return pa.ListArray.from_arrays(offsets, made.take(d.indices), mask=tokens.is_null() if tokens.null_count else None)

    return run


def fold_accents(word: str) -> str:
    """The word without combining marks."""
    if word.isascii():
        return word
    return unicodedata.normalize("NFC", "".join(c for c in unicodedata.normalize("NFD", word) if unicodedata.category(c) != "Mn"))


# --- Porter


def _shape(word: str) -> str:
    """A letter for each character: v of a vowel, c of a consonant; y is a vowel after a consonant."""
    out = ""
    for c in word:
        out += "v" if c in "aeiou" or (c == "y" and out[-1:] == "c") else "c"
    return out


def _measure(shape: str) -> int:
    return sum(shape[i : i + 2] == "vc" for i in range(len(shape) - 1))


def _short(word: str) -> bool:
    return len(word) > 2 and _shape(word)[-3:] == "cvc" and word[-1] not in "wxy"


_TWO = {"ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "abli": "able", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble"}
_THREE = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
_FOUR = dict.fromkeys("al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize".split(), "")


def _swap(word: str, table: dict[str, str], least: int) -> str:
    for end in sorted((e for e in table if word.endswith(e)), key=len, reverse=True)[:1]:
        stem = word[: -len(end)]
        if _measure(_shape(stem)) > least and (end != "ion" or stem[-1:] in ("s", "t")):
            return stem + table[end]
    return word


def porter(word: str) -> str:
    """Porter's stem of a lower-case English word; words of one or two letters stay."""
    if len(word) < 3:
        return word
    if word.endswith(("sses", "ies")):
        word = word[:-2]
    elif word.endswith("s") and not word.endswith("ss"):
        word = word[:-1]
    if word.endswith("eed"):
        if _measure(_shape(word[:-3])) > 0:
            word = word[:-1]
    else:
        cut = 2 if word.endswith("ed") else 3 if word.endswith("ing") else 0
        if cut and "v" in _shape(word[:-cut]):
            word = word[:-cut]
            if word.endswith(("at", "bl", "iz")):
                word += "e"
            elif len(word) > 1 and word[-1] == word[-2] and _shape(word)[-1] == "c" and word[-1] not in "lsz":
                word = word[:-1]
            elif _measure(_shape(word)) == 1 and _short(word):
                word += "e"
    if word.endswith("y") and "v" in _shape(word[:-1]):
        word = word[:-1] + "i"
    word = _swap(_swap(_swap(word, _TWO, 0), _THREE, 0), _FOUR, 1)
    if word.endswith("e"):
        m = _measure(_shape(word[:-1]))
        if m > 1 or (m == 1 and not _short(word[:-1])):
            word = word[:-1]
    if word.endswith("ll") and _measure(_shape(word)) > 1:
        word = word[:-1]
    return word


# --- synonyms


def synonyms(table: dict[str, list[str]]) -> Callable[[Column], Column]:
    """After each longest match of a (possibly multi-word) key come its synonyms; matching ignores case."""
    expand = expander(table)

    @F.arrow_udf(ArrayType(StringType()))
    def run(tokens: pa.Array) -> pa.Array:
        return expand(tokens)

    return run


def expander(table: dict[str, list[str]]) -> Callable[[pa.Array], pa.Array]:
    """The work of synonyms() on an Arrow array of lists. Tokens stay numbers: only
    where a key may begin, which the distinct tokens tell, is the trie walked."""
    trie: dict = {}
    for key, values in table.items():
        node = trie
        for w in key.lower().split():
            node = node.setdefault(w, {})
        node[None] = list(values)

    added = sorted({v for values in table.values() for v in values})
    number = {v: k for k, v in enumerate(added)}

    def expand(tokens: pa.Array) -> pa.Array:
        size = np.asarray(pc.fill_null(pc.list_value_length(tokens), 0)).astype(np.int64)
        d = tokens.flatten().dictionary_encode(null_encoding="encode")
        words, codes = [(w or "").lower() for w in d.dictionary.to_pylist()], np.asarray(d.indices)
        ends = np.cumsum(size)
        starts = np.flatnonzero(np.array([w in trie for w in words], bool)[codes]) if words else np.zeros(0, np.int64)
        row = np.searchsorted(ends, starts, "right")
        at, put, done = [], [], 0  # before which token, which synonym; tokens before done are matched
        for i, r in zip(starts.tolist(), row.tolist()):
            if i < done:
                continue
            node, best, found = trie, 0, []
            for j in range(i, int(ends[r])):
                node = node.get(words[codes[j]])
                if node is None:
                    break
                if None in node:
                    best, found = j - i + 1, node[None]
            done = i + max(1, best)
            at += [done] * len(found)
            put += [number[v] for v in found]
        size += np.bincount(np.searchsorted(ends, np.array(at, np.int64) - 1, "right"), minlength=len(size))
        made = np.insert(codes.astype(np.int64), np.array(at, np.int64), np.array(put, np.int64) + len(words))
        values = pa.concat_arrays([d.dictionary.cast(pa.string()), pa.array(added, pa.string())]).take(pa.array(made))
        offsets = pa.array(np.r_[0, np.cumsum(size)].astype(np.int32))
        return pa.ListArray.from_arrays(offsets, values, mask=tokens.is_null() if tokens.null_count else None)

    return expand
