"""Suffix-stripping stemmers as JVM expressions, and as functions of one token.

A step takes off the longest listed suffix that leaves enough letters, which a
lazy prefix before an alternation finds; so a language is a few nested regular
expressions, and no Python runs. Suffixes with a replacement come first, as
branches of their own.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: By language its steps: suffixes taken off, and those replaced.
_SUFFIXES = {
    "fr": [
        ("""
            issements issement ations ements ation ement euses eurs euse ités ives eur ifs ité ive if
        """, {'aux': 'al'}),
        ("""
            issent issons erons eront irent issez erez ent ons er es ez
        """, {}),
    ],
    "de": [
        ("""
            schaften erungen heiten keiten schaft erung heits ismus isten ungen heit keit ist ung
        """, {}),
        ("""
            ischem ischen ischer isches lichem lichen licher liches ische liche igem igen iger iges isch lich ige ig
        """, {}),
        ("""
            etet test est tet et nd te
        """, {}),
        ("""
            innen erns ens ern ers em en er es e s
        """, {}),
    ],
    "es": [
        ("""
            amientos imientos aciones amiento imiento uciones idades ables ación ibles ismos istas mente ución able ible idad ismo ista
        """, {}),
        ("""
            iéndose ándome ándose iendo ieron aban abas adas ados amos ando aron arán emos erán idas idos imos irán aba ada ado aré eré ida
            ido iré ían ías ar er ir ía
        """, {}),
        ("""
            as es os a o
        """, {}),
    ],
    "it": [
        ("""
            amenti amento azione azioni imenti imento abile abili ibile ibili mente ismi ismo ista isti ità
        """, {}),
        ("""
            andosi endosi arono avano erono evano irono ivano ando anno arsi endo erei ersi irei irsi are ate ati ato ere ire ita ite iti ito
            uta ute uti uto
        """, {}),
        ("""
            ose osi a e i o
        """, {}),
    ],
    "pt": [
        ("""
            amentos imentos amento idades imento ações idade ismos istas mente áveis íveis ação ismo ista ável ível
        """, {}),
        ("""
            adas ados amos ando aram avam emos endo eram idas idos imos indo iram ada ado ava ias ida ido ar er ia ir
        """, {}),
        ("""
            as es os a o
        """, {}),
    ],
    "nl": [
        ("""
            achtig ingen baar erij heid isme lijk ster zaam ing ist
        """, {'heden': 'heid'}),
        ("""
            enden ende den ten de te
        """, {'tten': 't', 'dden': 'd', 'tte': 't', 'dde': 'd'}),
        ("""
            eren ens ers en es s
        """, {}),
    ],
    "ru": [
        ("""
            ившись ывшись вшись ивши ывши вши
        """, {}),
        ("""
            ться тся
        """, {}),
        ("""
            ованного ованному ованными ованная ованное ованной ованную ованные ованный ованным ованных ованно ующего ующему ующими ованн ующая
            ующее ующей ующие ующий ующим ующих ующую ими ого ому ыми ая ей ие ий им их ой ую ые ый ым ых яя
        """, {}),
        ("""
            ивайте ывайте евать ивать овать ывать ейте иваю уйте ываю ала али ать ают ешь ите ить ишь яла яли ять яют ал ут ют ял
        """, {}),
        ("""
            ание аний анию ания ение ений ению ения ости ость ами ями ам ах ая ев ей ем ий ов ом ям ях яя а е и у ы ю я
        """, {}),
        ("""
            ость ь
        """, {}),
    ],
    "ar": [
        ("""
            تين ات ان تا تم تن كم نا ني ها هم هن ون يا ية ين ا ة ت ي
        """, {}),
    ],
}
_STEPS = {c: [(a.split(), b) for a, b in steps] for c, steps in _SUFFIXES.items()}
#: Least letters that stay before a suffix; words of at most so many letters stay as they are.
_STAY = {"fr": 2, "ru": 2, "ar": 2}
_SHORT = {"ru": 2, "ar": 2}
_PREFIXES = {"ar": ["^(?:وال|بال|كال|فال|ال)(.{3,})$", "^[وفبلكس](.{3,})$"]}
_FINAL_E = {"fr": 2, "nl": 3}
_NOTHING = ((), ())
_UMLAUTS = str.maketrans({"ä": "a", "ö": "o", "ü": "u", "ß": "ss"})
LANGUAGES = ("en", "zh", "ja", "ko", *_STEPS)


class _Spark:
    """Writes the expressions as Columns."""

    replace = staticmethod(lambda t, pattern, to: F.regexp_replace(t, pattern, to))
    length = staticmethod(F.length)
    group = "$1"

    @staticmethod
    def case(t, branches, other):
        if not branches:
            return other
        (pattern, value), *rest = branches
        out = F.when(t.rlike(pattern), value)
        for p, v in rest:
            out = out.when(t.rlike(p), v)
        return out.otherwise(other)

    @staticmethod
    def longer(t, n, then):
        return F.when(F.length(t) > n, then).otherwise(t)


class _Sql:
    """Writes the expressions as DuckDB SQL."""

    replace = staticmethod(lambda t, pattern, to: f"regexp_replace({t}, '{pattern}', '{to}', 'g')")
    group = r"\1"

    @staticmethod
    def case(t, branches, other):
        if not branches:
            return other
        return "case " + " ".join(f"when regexp_matches({t}, '{p}') then {v}" for p, v in branches) + f" else {other} end"

    @staticmethod
    def longer(t, n, then):
        return f"case when length({t}) > {n} then {then} else {t} end"


def _stem(t, lang: str, w):
    if lang not in _STEPS:
        return t
    least, x = _STAY.get(lang, 3), t
    if lang == "de":
        for a, b in (("ä", "a"), ("ö", "o"), ("ü", "u"), ("ß", "ss")):
            x = w.replace(x, a, b)
    for p in _PREFIXES.get(lang, []):
        x = w.replace(x, p, w.group)
    for strip, swap in _STEPS[lang]:
        pattern = f"^(.{{{least},}}?)(?:{'|'.join(strip)})$"
        branches = [(f"^.{{{least},}}{a}$", w.replace(x, f"{a}$", b)) for a, b in swap.items()]
        x = w.case(x, branches, w.replace(x, pattern, w.group))
    if lang in _FINAL_E:
        x = w.replace(x, f"^(.{{{_FINAL_E[lang]},}})e$", w.group)
    return w.longer(t, _SHORT.get(lang, 3), x)


def stem(token: Column, lang: str) -> Column:
    """The stem of a lower-case token of a language; zh, ja and ko tokens stay."""
    return _stem(token, lang, _Spark)


def stemmer(lang: str) -> Callable[[str], str]:
    """The same as a function of a token of letters and digits, for per_term: a
    language's regular expressions over each token of a table cost far more."""
    least, short, e = _STAY.get(lang, 3), _SHORT.get(lang, 3), _FINAL_E.get(lang)
    heads = {"ar": (("وال", "بال", "كال", "فال", "ال"), tuple("وفبلكس"))}.get(lang, ())
    # what a step does at each last letter: (suffix, fewest letters of the word, what it becomes), replaced ones first, then the longest
    steps = []
    for strip, swap in _STEPS.get(lang, []):
        by_last: dict[str, list[tuple[str, int, str]]] = {}
        for a, b in [*swap.items(), *((a, "") for a in sorted(strip, key=len, reverse=True))]:
            by_last.setdefault(a[-1], []).append((a, len(a) + least, b))
        steps.append({c: (tuple(a for a, _, _ in found), found) for c, found in by_last.items()})

    def run(t: str) -> str:
        if not steps or len(t) <= short:
            return t
        x = t.translate(_UMLAUTS) if lang == "de" else t
        for group in heads:
            x = next((x[len(p) :] for p in group if x.startswith(p) and len(x) >= len(p) + 3), x)
        for by_last in steps:
            any_of, found = by_last.get(x[-1], _NOTHING)
            if any_of and x.endswith(any_of):
                for a, fewest, b in found:
                    if len(x) >= fewest and x.endswith(a):
                        x = x[: -len(a)] + b
                        break
        return x[:-1] if e and len(x) > e and x.endswith("e") else x

    return run


def stem_sql(token: str, lang: str) -> str:
    """The same as DuckDB SQL."""
    return _stem(token, lang, _Sql)
