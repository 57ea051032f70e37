"""Scalar functions of the data model, as expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body) -> Column:
    """``body(value)``, with the value computed once however often the body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def json_at(data: str | Column, path: str) -> Column:
    return F.get_json_object(data, path)


def tokens(text: Column) -> Column:
    """Lower-cased words of a text; stems are not formed."""
    return F.filter(F.split(F.lower(text), r"\W+"), lambda w: w != "")


def matches_words(text: Column, *words: str) -> Column:
    """Whether a text holds all words."""
    return F.size(F.array_except(F.array(*(F.lit(w.lower()) for w in words)), tokens(text))) == 0


def masked(mask: str, column: str) -> Column:
    """An expression like ``lower(?)`` over a column."""
    return F.expr(mask.replace("?", f"`{column}`"))


def fingerprint(lines: Column) -> Column:
    """Upper-case SHA-256 of lines, sorted."""
    return F.upper(F.sha2(F.array_join(F.array_sort(lines), "\n"), 256))


def contains_all(a: Column, b: Column) -> Column:
    """Array containment: every element of b is in a."""
    return F.size(F.array_except(b, a)) == 0


def with_ordinality(x: Column) -> Column:
    """Generator of ``pos`` (from 1) and the element, for ``select``."""
    return F.explode(F.transform(x, lambda v, i: F.struct((i + 1).alias("pos"), v.alias("value"))))
