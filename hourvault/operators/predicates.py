"""Conditions beyond equality: LIKE, regular expressions, OR, NOT and values inside the raw JSON.

A condition is a tree made with the functions below. Besides the condition itself
it knows what it implies for the indexed columns in a form that Parquet can check
(equality, a list, a beginning, NULL), however deep that stands in the tree:

    all_of(field_like("user_id", "user-1_"), any_of(field_is("category", "account"), json_number("$.payload.k", ">", 5)))

implies that `user_id` begins with `user-1`. A search hands that to the scan, which
leaves out row groups and pages, and checks the whole condition on the rest. The raw
text is read only if the condition has a JSON part.

NULL counts as in SQL: a condition on a missing value is neither true nor false,
and a search returns the events for which it is true.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from hourvault.schema import FILTER_FIELDS

_NUMBERS = {
    "=": Column.__eq__, "<>": Column.__ne__, "<": Column.__lt__, "<=": Column.__le__, ">": Column.__gt__, ">=": Column.__ge__,
}
# A member by name or by place, as all JSON path dialects write it.
_PATH = re.compile(r"\$(?:\.[A-Za-z_][A-Za-z0-9_]*|\[[0-9]+\])+")
_LITERAL = re.compile(r"\^((?:[A-Za-z0-9 _:/@-](?![*?{+]))+)")


@dataclass(frozen=True)
class Predicate:
    """`whole`: the condition. `implied`: what Parquet can check of it, None if nothing; `exact` if that is all of it."""

    whole: Column
    implied: Column | None = None
    exact: bool = False

    def conditions(self) -> list[Column]:
        """The condition as a search uses it, the part for the scan first."""
        if self.implied is None or self.exact:
            return [self.whole]
        # Inside `coalesce`, or the optimizer would take what both have in common out of
        # their ORs again, and with it all that could be handed to the scan.
        return [self.implied, F.coalesce(self.whole, F.lit(False))]


def _field(name: str) -> Column:
    if name not in FILTER_FIELDS:
        raise ValueError(f"Unknown field: {name!r}")
    return F.col(name)


def _exact(condition: Column) -> Predicate:
    return Predicate(condition, condition, True)


def field_is(name: str, *values: str) -> Predicate:
    """The field has one of the values."""
    if not values:
        raise ValueError("name at least one value")
    return _exact(_field(name) == values[0] if len(values) == 1 else _field(name).isin(list(values)))


def field_missing(name: str) -> Predicate:
    return _exact(_field(name).isNull())


def like_beginning(pattern: str) -> tuple[str, str]:
    """The literal beginning of a LIKE pattern, and what follows it; `\\` escapes a sign."""
    literal, at = [], 0
    while at < len(pattern) and pattern[at] not in "%_":
        if pattern[at] == "\\":
            at += 1
            if at == len(pattern) or pattern[at] not in "%_\\":
                raise ValueError(f"a backslash escapes %, _ or itself: {pattern!r}")
        literal.append(pattern[at])
        at += 1
    return "".join(literal), pattern[at:]


def field_like(name: str, pattern: str, ignore_case: bool = False) -> Predicate:
    """SQL LIKE on the whole value: % any text, _ one sign, a backslash before them for the sign itself."""
    column = _field(name)
    literal, rest = like_beginning(pattern)
    if ignore_case:
        return Predicate(column.ilike(pattern))
    if not rest:
        return _exact(column == literal)
    implied = column.startswith(literal) if literal else None
    return Predicate(column.like(pattern), implied, rest == "%" and implied is not None)


def field_matches(name: str, pattern: str) -> Predicate:
    """The regular expression occurs in the value; `^` and `$` anchor it."""
    re.compile(pattern)
    column = _field(name)
    literal = None if "|" in pattern else _LITERAL.match(pattern)
    return Predicate(column.rlike(pattern), column.startswith(literal.group(1)) if literal else None)


def _json(path: str) -> Column:
    if not _PATH.fullmatch(path):
        raise ValueError(f"not a path of members and places: {path!r}")
    return F.get_json_object("raw_json", path)


def json_is(path: str, *values: str) -> Predicate:
    """The value at the path, as text, is one of these."""
    if not values:
        raise ValueError("name at least one value")
    return Predicate(_json(path).isin(list(values)))


def json_like(path: str, pattern: str) -> Predicate:
    like_beginning(pattern)
    return Predicate(_json(path).like(pattern))


def json_matches(path: str, pattern: str) -> Predicate:
    re.compile(pattern)
    return Predicate(_json(path).rlike(pattern))


def json_number(path: str, comparison: str, value: float) -> Predicate:
    """The number at the path compared (=, <>, <, <=, >, >=); a value that is no number is like a missing one."""
    if comparison not in _NUMBERS:
        raise ValueError(f"Unknown comparison: {comparison!r}")
    return Predicate(_NUMBERS[comparison](_json(path).try_cast("double"), F.lit(float(value))))


def json_present(path: str) -> Predicate:
    """There is a value other than null at the path."""
    return Predicate(_json(path).isNotNull())


def _members(parts: Iterable[Predicate]) -> list[Predicate]:
    parts = list(parts)
    if not parts:
        raise ValueError("name at least one condition")
    return parts


def all_of(*parts: Predicate) -> Predicate:
    parts = _members(parts)
    implied = [p.implied for p in parts if p.implied is not None]
    return Predicate(
        reduce(Column.__and__, [p.whole for p in parts]),
        reduce(Column.__and__, implied) if implied else None,
        all(p.exact for p in parts),
    )


def any_of(*parts: Predicate) -> Predicate:
    """What an OR implies is an OR again, and only if each of its parts implies something."""
    parts = _members(parts)
    known = all(p.implied is not None for p in parts)
    return Predicate(
        reduce(Column.__or__, [p.whole for p in parts]),
        reduce(Column.__or__, [p.implied for p in parts]) if known else None,
        all(p.exact for p in parts),
    )


def none_of(*parts: Predicate) -> Predicate:
    """NOT (a OR b ...); only an exact condition says something about its opposite."""
    inner = any_of(*parts)
    return Predicate(~inner.whole, ~inner.whole if inner.exact else None, inner.exact)
