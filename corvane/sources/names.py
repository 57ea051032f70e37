"""Identifiers and literals."""

from __future__ import annotations

import datetime as dt
import re
from collections.abc import Iterable
from typing import Any

from corvane.operators.predicate import literal, quoted

__all__ = ["BadName", "checked", "delimited", "literal", "qualified", "quoted", "shortened", "split_qualified", "undelimited"]
#: Characters of an identifier at most.
LONGEST = 63


def delimited(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def undelimited(name: str) -> str:
    """Without its quotes, whichever dialect's they are."""
    for a, b in ("``", '""', "[]"):
        if len(name) > 1 and name[0] == a and name[-1] == b:
            return name[1:-1].replace(b * 2, b)
    return name


def split_qualified(name: str, schema: str = "default") -> tuple[str, str]:
    """Schema and object of ``a.b``, ```a.x`.b`` or ``b``."""
    parts = re.findall(r"`(?:[^`]|``)*`|\"(?:[^\"]|\"\")*\"|\[(?:[^\]]|\]\])*\]|[^.]+", name)
    if not 1 <= len(parts) <= 2:
        raise ValueError(f"{name} isn't a qualified name")
    plain = [undelimited(p) for p in parts]
    return (schema, plain[0]) if len(plain) == 1 else (plain[0], plain[1])


def qualified(schema: str, name: str) -> str:
    return f"{delimited(schema)}.{delimited(name)}"


class BadName(ValueError):
    pass


def shortened(name: str, most: int = LONGEST) -> str:
    """Cut to the longest identifier; long names can meet, which ``checked`` finds out."""
    return name[:most]


def checked(names: Iterable[str], what: str, most: int = LONGEST) -> None:
    """Raises for a name that is empty, too long or holds a control character, and for two that are one whatever the case, also once shortened."""
    seen: dict[str, str] = {}
    for name in names:
        if not name or re.search(r"[\x00-\x1f\x7f]", name):
            raise BadName(f"{what} {name!r} can't be a name")
        short = shortened(name, most).lower()
        if short in seen:
            raise BadName(f"{what} {name!r} meets {seen[short]!r}")
        seen[short] = name
        if len(name) > most:
            raise BadName(f"{what} {name!r} is longer than {most} characters")


def normalised(value: Any) -> str:
    """A partition bound as text: without quotes, a time with an offset in UTC."""
    text = undelimited(str(value).strip()).strip("'")
    try:
        at = dt.datetime.fromisoformat(text)
    except ValueError:
        return text
    if not re.match(r"\d{4}-\d{2}-\d{2}[ T]", text):
        return text
    at = at.astimezone(dt.UTC).replace(tzinfo=None) if at.tzinfo else at
    return at.isoformat(sep=" ")
