"""Which of many words or names a text holds: one combined pattern, one scan a text."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from cinelake.functions.text import col

_EDGE = "[A-Za-z0-9]"


def quoted(text: str) -> str:
    return re.sub(r"([.+*?^$()\[\]{}|\\])", r"\\\1", text)


def any_of(words: list[str]) -> str:
    """Alternatives, the longest first, so that the first that fits is the longest."""
    return "|".join(quoted(w) for w in sorted(set(words), key=lambda w: (-len(w), w)))


def holds_any(c: Column | str, terms: list[str]) -> Column:
    """The text has one of the terms anywhere; null has none."""
    return F.coalesce(col(c).rlike(any_of(terms)), F.lit(False))


def names_any(c: Column | str, names: list[str]) -> Column:
    """The text has one of the names, in any case, with no letter or digit of a-z on either side; null has none."""
    return F.coalesce(col(c).rlike(rf"(?i)(?<!{_EDGE})(?:{any_of(names)})(?!{_EDGE})"), F.lit(False))


def _beginnings(names: list[str]) -> dict[str, list[int]]:
    """Of each name in lower case the places of all names that it begins with, itself and those of another case included, and that end where a word may end."""
    lower = [n.lower() for n in names]
    return {n: [i for i, m in enumerate(lower) if n.startswith(m) and not re.match(_EDGE, n[len(m) :])] for n in lower}


def named(c: Column | str, names: list[str]) -> Column:
    """All names that a text has, as names_any finds them, in the list's order.

    A match is the longest name at its place and takes up no room, so that names which overlap are
    all found; what else begins at that place is known from the name.
    """
    starts = F.regexp_extract_all(F.coalesce(col(c), F.lit("")), F.lit(rf"(?i)(?<!{_EDGE})(?=({any_of(names)})(?!{_EDGE}))"), F.lit(1))
    places = F.create_map(*(F.lit(x) if isinstance(x, str) else F.array(*map(F.lit, x)) for pair in _beginnings(names).items() for x in pair))
    found = F.array_sort(F.array_distinct(F.flatten(F.transform(starts, lambda s: F.try_element_at(places, F.lower(s))))))
    return F.transform(F.coalesce(found, F.array().cast("array<int>")), lambda i: F.get(F.array(*map(F.lit, names)), i))
