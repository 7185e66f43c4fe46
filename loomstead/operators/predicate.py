"""Comparison predicates as values, and boolean expressions over columns."""

from __future__ import annotations

import operator
from enum import Enum
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Predicate(Enum):
    """The six comparisons of a column with a constant or another column."""

    EQUAL = "=="
    NOT_EQUAL = "!="
    GREATER = ">"
    GREATER_OR_EQUAL = ">="
    LESS = "<"
    LESS_OR_EQUAL = "<="

    def public(self, column: str | Column, value: Any) -> Column:
        """The column against a constant."""
        return _COMPARE[self](_col(column), F.lit(value))

    def shared(self, left: str | Column, right: str | Column) -> Column:
        """One column against another."""
        return _COMPARE[self](_col(left), _col(right))

    def open_mask(self, df: DataFrame, column: str | Column, value: Any) -> list[bool]:
        """The comparison's values, for looking at small tables."""
        return [r[0] for r in df.select(self.public(column, value)).collect()]


_COMPARE = {
    Predicate.EQUAL: operator.eq,
    Predicate.NOT_EQUAL: operator.ne,
    Predicate.GREATER: operator.gt,
    Predicate.GREATER_OR_EQUAL: operator.ge,
    Predicate.LESS: operator.lt,
    Predicate.LESS_OR_EQUAL: operator.le,
}


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def all_of(*conditions: Column) -> Column:
    return reduce(operator.and_, conditions, F.lit(True))


def any_of(*conditions: Column) -> Column:
    return reduce(operator.or_, conditions, F.lit(False))


def negative(column: str | Column) -> Column:
    """The sign test of a signed number."""
    return _col(column) < 0


def is_in(column: str | Column, values: list[Any]) -> Column:
    """Membership; an empty list matches nothing."""
    return _col(column).isin(*values) if values else F.lit(False)


def as_bit(condition: Column) -> Column:
    """A condition as 0 or 1."""
    return condition.cast("bigint")
