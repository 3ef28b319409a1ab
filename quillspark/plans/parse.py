"""The query-string language.

    word  field:word  "a phrase"  "a phrase"~2  pre*  w?ld*rd  word~  word~1
    +must  -must_not  ( grouped clauses )  clause^2.5

Words and phrases go through the analyser, patterns don't; a word that the
analyser drops is no clause. AND, OR and NOT are words like others.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import replace

from .query import Bool, Fuzzy, Occur, Phrase, Prefix, Query, Term, Wildcard

_LEX = re.compile(r'\s*(?:(?P<sign>[-+(:~^)])|"(?P<quoted>[^"]*)(?P<closed>"?)|(?P<word>[^\s():"~^]+))')
_OCCUR = {"+": Occur.MUST, "-": Occur.MUST_NOT}


class QueryParseError(ValueError):
    """A query string that can't be read; offset: where."""

    def __init__(self, message: str, offset: int):
        super().__init__(message)
        self.offset = offset


class _Parser:
    def __init__(self, text: str, field: str, analyse: Callable[[str], list[str]], lenient: bool):
        self.field, self.analyse, self.lenient, self.at = field, analyse, lenient, 0
        self.lexed: list[tuple[str, str, int]] = []
        at, text = 0, text.rstrip()
        while at < len(text):
            m = _LEX.match(text, at)
            at = m.end()
            if m["sign"]:
                self.lexed.append((m["sign"], m["sign"], m.start("sign")))
            elif m["word"]:
                self.lexed.append(("word", m["word"], m.start("word")))
            elif m["closed"]:
                self.lexed.append(("phrase", m["quoted"], m.start("quoted") - 1))
            elif lenient:
                self.lexed.append(("word", m["quoted"], m.start("quoted") - 1))
            else:
                raise QueryParseError("a quote isn't closed", m.start("quoted") - 1)

    def kind(self) -> str:
        return self.lexed[self.at][0] if self.at < len(self.lexed) else ""

    def take(self) -> tuple[str, str, int]:
        self.at += 1
        return self.lexed[self.at - 1]

    def number(self, convert):
        """What the next word says as a number, if it does."""
        if self.kind() == "word":
            try:
                n = convert(self.lexed[self.at][1])
            except ValueError:
                return None
            self.at += 1
            return n
        return None

    def clauses(self) -> Query:
        found: list[tuple[Query, Occur]] = []
        while self.kind() not in ("", ")"):
            occur, offset = _OCCUR.get(self.kind(), Occur.SHOULD), self.lexed[self.at][2]
            if occur is not Occur.SHOULD:
                self.take()
                if not self.kind():
                    if self.lenient:
                        break
                    raise QueryParseError("nothing follows + or -", offset)
            try:
                q = self.clause()
            except QueryParseError:
                if not self.lenient:
                    raise
                break
            if q is not None:
                found.append((q, occur))
            elif self.lenient and self.at < len(self.lexed) and self.lexed[self.at][2] == offset:
                self.take()  # what can't start a clause
        if len(found) == 1 and found[0][1] is Occur.SHOULD:
            return found[0][0]
        return Bool(tuple(found))

    def boosted(self, q: Query) -> Query:
        if self.kind() == "^":
            self.take()
            boost = self.number(float)
            return q if boost is None else replace(q, boost=boost)
        return q

    def phrase(self, field: str, text: str) -> Query:
        terms = self.analyse(text) or text.split(" ")
        slop = 0
        if self.kind() == "~":
            self.take()
            slop = self.number(int) or 0
        return self.boosted(Phrase(field, tuple(terms), slop))

    def clause(self) -> Query | None:
        kind, value, offset = self.take()
        if kind == "(":
            inner = self.clauses()
            if self.kind() == ")":
                self.take()
            elif not self.lenient:
                raise QueryParseError("a parenthesis isn't closed", offset)
            return self.boosted(inner)
        if kind == "phrase":
            return self.phrase(self.field, value)
        if kind != "word":
            if self.lenient:
                return None
            raise QueryParseError(f"unexpected {value}", offset)
        field = self.field
        if self.kind() == ":":
            self.take()
            field = value
            if self.kind() not in ("word", "phrase"):
                if self.lenient:
                    return None
                raise QueryParseError(f"field {field} needs a word or phrase", self.lexed[self.at][2] if self.kind() else offset)
            kind, value, offset = self.take()
            if kind == "phrase":
                return self.phrase(field, value)
        if "*" in value or "?" in value:
            head = value[:-1]
            plain = value[-1] == "*" and "*" not in head and "?" not in head
            return self.boosted(Prefix(field, head) if plain else Wildcard(field, value))
        words = self.analyse(value)
        if self.kind() == "~":
            self.take()
            edits = self.number(int)
            return self.boosted(Fuzzy(field, words[0] if words else "", 2 if edits is None else edits))
        return self.boosted(Term(field, words[0])) if words else None


def parse(text: str, field: str, analyse: Callable[[str], list[str]], lenient: bool = False) -> Query:
    """The query that a string means; field is that of clauses that name none. A
    blank string is the empty Bool. lenient: read what can be read, raise nothing."""
    p = _Parser(text, field, analyse, lenient)
    q = p.clauses()
    if p.kind() and not lenient:
        raise QueryParseError(f"unexpected {p.lexed[p.at][1]}", p.lexed[p.at][2])
    return q
