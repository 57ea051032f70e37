"""English stems (Porter, 1980) as rules that become Spark columns, SQL text or, in tasks that see a word often, a cached call.

A step is a list of rules. The first whose ending fits decides: if what is before the ending passes the
rule's test, the ending is replaced; if not, the word stays. Words shorter than three letters, or with
anything but a to z, are their own stems.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from corvane.functions.scalar import let

_C, _V = "[^aeiou][^aeiouy]*", "[aeiouy][aeiou]*"
#: Tests of what is before an ending: measures over 0, over 1, of 1; a vowel; consonant, vowel, consonant.
OVER_0, OVER_1, ONE = f"^({_C})?{_V}{_C}", f"^({_C})?{_V}{_C}{_V}{_C}", f"^({_C})?{_V}{_C}({_V})?$"
VOWEL, SHORT = f"^({_C})?[aeiouy]", f"^{_C}[aeiouy][^aeiouwxy]$"
#: Stands behind a word that has lost -ed or -ing until the next step.
LOST = "+"


@dataclass(frozen=True)
class Rule:
    """``ending``: a pattern; ``by``: what replaces it; the test: any of ``tests``, or ``also`` without ``unless``."""

    ending: str
    by: str
    tests: tuple[str, ...] = ()
    also: str | None = None
    unless: str | None = None
    stem: str = ".*"

    @property
    def pattern(self) -> str:
        return f"^({self.stem}){self.ending}$"


def _map(pairs: str, test: str) -> list[Rule]:
    """``ending:by`` pairs, the longest ending first."""
    found = [p.split(":") for p in pairs.split()]
    return [Rule(a, b, (test,)) for a, b in sorted(found, key=lambda p: -len(p[0]))]


#: The steps of the published algorithm.
STEPS: tuple[tuple[Rule, ...], ...] = (
    (Rule("sses", "ss"), Rule("ies", "i"), Rule("ss", "ss"), Rule("s", "")),
    (Rule("eed", "ee", (OVER_0,)), Rule("ed", LOST, (VOWEL,)), Rule("ing", LOST, (VOWEL,))),
    (
        *(Rule(rf"{x}\+", f"{x}e") for x in ("at", "bl", "iz")),
        *(Rule(rf"{x}{x}\+", x) for x in "bcdfghjkmnpqrtvwx"),
        Rule(r"\+", "e", (), stem=SHORT[1:-1]),
        Rule(r"\+", ""),
    ),
    (Rule("y", "i", (VOWEL,)),),
    tuple(_map("ational:ate tional:tion enci:ence anci:ance izer:ize abli:able alli:al entli:ent eli:e ousli:ous ization:ize ation:ate ator:ate alism:al iveness:ive fulness:ful ousness:ous aliti:al iviti:ive biliti:ble", OVER_0)),
    tuple(_map("icate:ic ative: alize:al iciti:ic ical:ic ful: ness:", OVER_0)),
    (
        *_map("al: ance: ence: er: ic: able: ible: ant: ement: ment: ent: ou: ism: ate: iti: ous: ive: ize:", OVER_1),
        Rule("ion", "", (OVER_1,), stem=".*[st]"),
    ),
    (Rule("e", "", (OVER_1,), also=ONE, unless=SHORT),),
    (Rule("l", "", (OVER_1,), stem=".*l"),),
)


def step(rules: tuple[Rule, ...]) -> Callable[[Column], Column]:
    return lambda w: step_column(w, rules)


def step_column(w: Column, rules: tuple[Rule, ...]) -> Column:
    out = None
    for r in rules:
        before = F.regexp_extract(w, r.pattern, 1)
        ok = F.lit(not r.tests and r.also is None)
        for t in r.tests:
            ok |= before.rlike(t)
        if r.also is not None:
            ok |= before.rlike(r.also) & ~before.rlike(r.unless)
        new = F.when(ok, F.concat(before, F.lit(r.by))).otherwise(w)
        out = F.when(w.rlike(r.pattern), new) if out is None else out.when(w.rlike(r.pattern), new)
    return out.otherwise(w)


def step_sql(w: str, rules: tuple[Rule, ...]) -> str:
    whens = []
    for r in rules:
        before = f"regexp_extract({w}, '{r.pattern}', 1)"
        oks = [f"regexp_matches({before}, '{t}')" for t in r.tests]
        if r.also is not None:
            oks.append(f"(regexp_matches({before}, '{r.also}') AND NOT regexp_matches({before}, '{r.unless}'))")
        new = f"concat({before}, '{r.by}')"
        whens.append(f"WHEN regexp_matches({w}, '{r.pattern}') THEN " + (f"CASE WHEN {' OR '.join(oks)} THEN {new} ELSE {w} END" if oks else new))
    return f"CASE {' '.join(whens)} ELSE {w} END"


PLAIN = "^[a-z]{3,}$"


def stem(word: Column) -> Column:
    """The stem of a lower-case word. Each step holds what the one before gave, so nothing is computed twice, wherever the optimiser moves it."""
    x = F.regexp_replace(word, "^y", "Y")  # a first y is a consonant
    for rules in STEPS:
        x = let(x, step(rules))
    return F.when(word.rlike(PLAIN), F.lower(x)).otherwise(word)


@lru_cache(1 << 18)
def stem_word(word: str) -> str:
    """``stem`` of one word."""
    if not re.fullmatch(PLAIN[1:-1], word):
        return word
    x = re.sub("^y", "Y", word)
    for rules in STEPS:
        for r in rules:
            if x.endswith(r.ending.replace("\\", "")) and (m := re.match(r.pattern, x)):  # endings are letters, and a plus
                before = m[1]
                fits = lambda test: re.search(test, before) is not None  # noqa: B023, E731
                if (not r.tests and r.also is None) or any(map(fits, r.tests)) or (r.also is not None and fits(r.also) and not fits(r.unless)):
                    x = before + r.by
                break
    return x.lower()


def stems_sql(words: str, word: str = "word") -> str:
    """SQL for ``word, stem`` of the distinct words of a relation."""
    x = f"SELECT DISTINCT {word} AS word, regexp_replace({word}, '^y', 'Y') AS stem FROM {words}"
    for rules in STEPS:
        x = f"SELECT word, {step_sql('stem', rules)} AS stem FROM ({x})"
    return f"SELECT word, CASE WHEN regexp_matches(word, '{PLAIN}') THEN lower(stem) ELSE word END AS stem FROM ({x})"
