"""Exact fixed-point arithmetic: money in cents, rates in percent, truncating division.

Sums of whole numbers do not depend on the order of rows, so that results are
the same on any cluster.  Overflow and division by zero are errors.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: str | Column | int) -> Column:
    return F.col(c) if isinstance(c, str) else c if isinstance(c, Column) else F.lit(c)


def cents(amount: str | Column) -> Column:
    """An amount in cents."""
    return F.round(_col(amount) * 100).cast("bigint")


def percent(rate: str | Column) -> Column:
    """A rate in whole percent."""
    return F.round(_col(rate) * 100).cast("bigint")


def idiv(a: str | Column | int, b: str | Column | int) -> Column:
    """The quotient, truncated towards zero."""
    a, b = _col(a), _col(b)
    return F.call_function("div", a, b)


def discounted(price: str | Column = "l_extendedprice", discount: str | Column = "l_discount") -> Column:
    """A price less its discount in cents, truncated row by row."""
    return idiv(cents(price) * (100 - percent(discount)), 100)


def charged(price: str | Column = "l_extendedprice", discount: str | Column = "l_discount", tax: str | Column = "l_tax") -> Column:
    """The discounted price with tax in cents, truncated row by row."""
    return idiv(discounted(price, discount) * (100 + percent(tax)), 100)


def mux(condition: Column, yes: Column | int, no: Column | int) -> Column:
    """If-then-else."""
    return F.when(condition, yes).otherwise(no)


def share_percent(part: Column, whole: Column) -> Column:
    """Whole percent of a total; null for a total of 0."""
    return idiv(100 * part, F.nullif(whole, F.lit(0)))
