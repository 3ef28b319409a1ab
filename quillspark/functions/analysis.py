"""Text analysis: character filters, tokenisers, token filters and analysers.

A tokeniser is a function from a string Column to an array<string> Column, a
filter one from tokens to tokens, a character filter one from string to string;
an Analyser composes them. Nearly all are JVM expressions; see terms for the few
that aren't. Positions are array indexes: a removed token leaves no gap. Nulls
give null.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from .stem import LANGUAGES, stem, stemmer
from .stopwords import STOP_WORDS
from .terms import fold_accents, per_term, porter, synonyms

Step = Callable[[Column], Column]
_WORDS = r"[\p{L}\p{Nd}]+"
_CJK = "一-鿿㐀-䶿぀-ゟ゠-ヿ가-힯"


def _matches(pattern: str) -> Step:
    def run(s: Column) -> Column:
        return F.regexp_extract_all(s, F.lit(pattern), F.lit(0))

    run.pattern = pattern  # where tokens stand is told by it, see offsets
    return run


def bound(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that a lambda inside f may use often, but which is made once."""
    return F.transform(F.array(value), f)[0]


def _windows(items: Column, least: int, most: int, separator: str) -> Column:
    """Runs of least to most items, joined, by start, then size."""
    n = F.size(items)
    at = F.when(n >= least, F.sequence(F.lit(1), n - least + 1)).when(items.isNotNull(), F.array().cast("array<int>"))
    return F.flatten(F.transform(at, lambda i: F.transform(F.sequence(F.lit(least), F.least(F.lit(most), n - i + 1)), lambda k: F.array_join(F.slice(items, i, k), separator))))


# --- tokenisers

standard: Step = _matches(_WORDS)
whitespace: Step = _matches(r"(?U)\S+")
letters: Step = _matches(r"\p{L}+")


def keyword(s: Column) -> Column:
    """The whole value as one token; none of an empty one."""
    return F.when(s == "", F.array().cast("array<string>")).when(s.isNotNull(), F.array(s))


def ngrams(least: int, most: int) -> Step:
    """Every substring of least to most characters, by start, then length."""

    def run(s: Column) -> Column:
        return bound(F.filter(F.split(s, ""), lambda c: c != ""), lambda chars: _windows(chars, least, most, ""))

    return run


def edge_ngrams(least: int, most: int) -> Step:
    """The prefixes of least to most characters of each piece between white space."""

    def run(s: Column) -> Column:
        pieces = F.filter(F.split(s, "[ \t\r\n]+"), lambda t: F.length(t) >= least)
        return F.flatten(F.transform(pieces, lambda t: F.transform(F.sequence(F.lit(least), F.least(F.lit(most), F.length(t))), lambda k: F.substring(t, F.lit(1), k))))

    return run


def cjk_bigrams(s: Column) -> Column:
    """Overlapping pairs of runs of CJK characters, single ones alone, other words whole."""
    runs = F.regexp_extract_all(s, F.lit(rf"[{_CJK}]+|[\p{{L}}\p{{Nd}}&&[^{_CJK}]]+"), F.lit(0))
    pairs = lambda t: F.transform(F.sequence(F.lit(1), F.length(t) - 1), lambda i: F.substring(t, i, F.lit(2)))
    return F.flatten(F.transform(runs, lambda t: F.when(t.rlike(f"^[{_CJK}]{{2,}}$"), pairs(t)).otherwise(F.array(t))))


# --- token filters


def each(f: Callable[[Column], Column]) -> Step:
    return lambda toks: F.transform(toks, f)


lowercase: Step = each(F.lower)
reverse: Step = each(F.reverse)
porter_stem: Step = per_term(porter)
accent_folding: Step = per_term(fold_accents)
unique: Step = F.array_distinct
synonym_graph = synonyms


def stop(words: Iterable[str] = STOP_WORDS["en"]) -> Step:
    """Without the words, whatever their case."""
    lowered = sorted({w.lower() for w in words})
    return lambda toks: F.filter(toks, lambda t: ~F.lower(t).isin(lowered)) if lowered else toks


def length_between(least: int, most: int) -> Step:
    return lambda toks: F.filter(toks, lambda t: F.length(t).between(least, most))


def truncate(most: int) -> Step:
    return each(lambda t: F.substring(t, 1, most))


def elision(articles: Iterable[str] = tuple("jusqu lorsqu puisqu quoiqu qu c d j l m n s t".split())) -> Step:
    """Without an article and apostrophe at the front, if anything follows."""
    pattern = rf"(?i)^(?:{'|'.join(articles)})['’](?=.)"
    return each(lambda t: F.regexp_replace(t, pattern, ""))


def keyword_marker(stemming: Callable[[Column], Column], keep: Iterable[str]) -> Step:
    """Stemming of each token but those to keep."""
    kept = sorted(keep)
    return each(lambda t: F.when(t.isin(kept), t).otherwise(stemming(t)) if kept else stemming(t))


def _digits() -> tuple[str, str]:
    import sys
    import unicodedata

    found = [c for c in map(chr, range(128, min(sys.maxunicode, 0xFFFF) + 1)) if unicodedata.category(c) == "Nd"]
    return "".join(found), "".join(str(unicodedata.digit(c)) for c in found)


def decimal_digits(toks: Column) -> Column:
    """Decimal digits of any script as ASCII."""
    return F.transform(toks, lambda t: F.translate(t, *_digits()))


def shingles(least: int = 2, most: int = 2, unigrams: bool = True, separator: str = " ") -> Step:
    """Runs of least to most tokens, by start, then size; after the single tokens, if wanted."""

    def run(toks: Column) -> Column:
        return bound(toks, lambda t: F.concat(t, _windows(t, least, most, separator)) if unigrams else _windows(t, least, most, separator))

    return run


def word_delimiter(case_changes: bool = True, numerics: bool = True, preserve: bool = False, join_words: bool = False, join_numbers: bool = False) -> Step:
    """The parts of each token between delimiters, changes of case and digits; with
    the token itself before, and joined words or numbers (of two or more) behind, if wanted."""
    cuts = []
    if numerics:
        cuts += [r"(?<=\p{Nd})(?=\p{L})", r"(?<=\p{L})(?=\p{Nd})"]
    if case_changes:
        cuts += [r"(?<=\p{Ll})(?=\p{Lu})", r"(?<=\p{Lu})(?=\p{Lu}\p{Ll})"]
    pattern = "|".join([r"[^\p{L}\p{Nd}]+", *cuts])

    def joined(found: Column, number: bool) -> Column:
        own = F.filter(found, lambda p: p.rlike(r"^\p{Nd}") if number else ~p.rlike(r"^\p{Nd}"))
        return F.when(F.size(own) > 1, F.array(F.array_join(own, ""))).otherwise(F.array().cast("array<string>"))

    def parts(t: Column) -> Column:
        # a pattern is compiled once by a replacement, but for each value by a split
        found = F.filter(F.split(F.regexp_replace(t, pattern, "\x01"), "\x01"), lambda p: p != "")
        first = [F.array(t)] if preserve else []
        wanted = [number for number, on in ((False, join_words), (True, join_numbers)) if on]
        return bound(found, lambda f: F.concat(*first, f, *(joined(f, number) for number in wanted)))

    return lambda toks: F.flatten(F.transform(toks, parts))


def budget(most: int, policy: str = "truncate") -> Step:
    """At most so many tokens of a value (0: any number): cut off, let through ("warn"), or an error ("reject")."""
    if policy not in ("truncate", "warn", "reject"):
        raise ValueError(f"unknown policy {policy}")
    if most <= 0 or policy == "warn":
        return lambda toks: toks
    if policy == "truncate":
        return lambda toks: F.slice(toks, 1, most)
    return lambda toks: F.when(F.size(toks) > most, F.raise_error(F.lit(f"more than {most} tokens")).cast("array<string>")).otherwise(toks)


# --- character filters


def html_strip(s: Column) -> Column:
    """Tags, then entities, as spaces."""
    return F.regexp_replace(F.regexp_replace(s, "<[^>]+>", " "), r"&\w+;", " ")


def mapping(table: dict[str, str]) -> Step:
    """Literal replacements, one after the other."""

    def run(s: Column) -> Column:
        for a, b in table.items():
            s = F.replace(s, F.lit(a), F.lit(b))
        return s

    return run


def pattern_replace(pattern: str, to: str) -> Step:
    return lambda s: F.regexp_replace(s, pattern, to)


# --- analysers


@dataclass(frozen=True)
class Analyser:
    """Character filters, a tokeniser and token filters, applied in this order."""

    tokeniser: Step = standard
    filters: tuple[Step, ...] = ()
    char_filters: tuple[Step, ...] = ()
    name: str = field(default="custom", compare=False)

    def __call__(self, text: Column) -> Column:
        for f in self.char_filters:
            text = f(text)
        toks = self.tokeniser(text)
        for f in self.filters:
            toks = f(toks)
        return toks

    def then(self, *filters: Step) -> Analyser:
        return Analyser(self.tokeniser, self.filters + filters, self.char_filters, self.name)

    def words(self, spark, text: str) -> list[str]:
        """The tokens of one text."""
        return spark.sql("select 1").select(self(F.lit(text)).alias("t")).first().t  # folded, without a job


def standard_analyser(stop_words: Iterable[str] = STOP_WORDS["en"], name: str = "standard") -> Analyser:
    return Analyser(standard, (lowercase, stop(stop_words)), name=name)


def stemmed_analyser(keep: Iterable[str] = (), stop_words: Iterable[str] = STOP_WORDS["en"]) -> Analyser:
    """The standard analyser and Porter's stemmer, which leaves the words to keep."""
    kept = frozenset(keep)
    return standard_analyser(stop_words, "stemmed").then(per_term(lambda t: t if t in kept else porter(t)) if kept else porter_stem)


def language_analyser(lang: str) -> Analyser:
    """The analyser of a language code; a region ("pt-BR") doesn't count."""
    code = lang.replace("_", "-").split("-")[0].lower()
    if code not in LANGUAGES:
        raise ValueError(f"no analyser for language {lang}")
    stemming = (porter_stem,) if code == "en" else () if code in ("zh", "ja", "ko") else (per_term(stemmer(code)),)
    first = cjk_bigrams if code in ("zh", "ja", "ko") else standard
    return Analyser(first, (lowercase, stop(STOP_WORDS[code]), *stemming), name=code)


whitespace_analyser = Analyser(whitespace, name="whitespace")
keyword_analyser = Analyser(keyword, name="keyword")
simple_analyser = Analyser(letters, (lowercase,), name="simple")


def by_language(text: Column, lang: Column, languages: Iterable[str] = ("en", "fr", "de", "es")) -> Column:
    """Each row's tokens by the analyser of its language; the standard one for others."""
    out = None
    for code in languages:
        toks = language_analyser(code)(F.when(lang == code, text))  # Python's part of it runs whatever the language
        out = F.when(lang == code, toks) if out is None else out.when(lang == code, toks)
    other = standard_analyser()(text)
    return other if out is None else out.otherwise(other)
