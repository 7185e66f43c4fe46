"""Grouped tables: aggregates are gathered and run as one aggregation."""

from __future__ import annotations

from typing import TYPE_CHECKING

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomstead.functions.fixed import idiv

if TYPE_CHECKING:
    from .table import Table


class GroupedTable:
    """A table with grouping keys; every ``agg_*`` adds a column, ``table()`` ends the group.

    Without an aggregate the result is the distinct keys.
    """

    def __init__(self, table: Table, keys: tuple[str, ...], aggregates: tuple[Column, ...] = ()) -> None:
        self._table, self._keys, self._aggregates = table, keys, aggregates

    def _with(self, column: Column, name: str) -> GroupedTable:
        return GroupedTable(self._table, self._keys, (*self._aggregates, column.alias(name)))

    def agg_count(self, name: str) -> GroupedTable:
        return self._with(F.count(F.lit(1)), name)

    def agg_count_if(self, condition: Column, name: str) -> GroupedTable:
        """Number of rows that satisfy a condition."""
        return self._with(F.count_if(condition), name)

    def agg_count_distinct(self, column: str, name: str) -> GroupedTable:
        return self._with(F.count_distinct(F.col(column)), name)

    def agg_sum(self, column: str | Column, name: str) -> GroupedTable:
        return self._with(F.sum(column), name)

    def agg_sum_if(self, condition: Column, column: str | Column, name: str) -> GroupedTable:
        """Sum over the rows that satisfy a condition, 0 if none does."""
        value = F.col(column) if isinstance(column, str) else column
        return self._with(F.sum(F.when(condition, value).otherwise(0)), name)

    def agg_min(self, column: str, name: str) -> GroupedTable:
        return self._with(F.min(column), name)

    def agg_max(self, column: str, name: str) -> GroupedTable:
        return self._with(F.max(column), name)

    def agg_avg(self, column: str | Column, name: str) -> GroupedTable:
        """The truncated mean of whole numbers."""
        return self._with(idiv(F.sum(column), F.count(column)), name)

    def carry(self, *columns: str) -> GroupedTable:
        """Columns that the keys determine, carried along without being keys."""
        out = self
        for c in columns:
            out = out._with(F.max(c), c)
        return out

    def table(self) -> Table:
        from .table import Table

        df = self._table.df
        if not self._aggregates:
            return Table(df.select(*self._keys).distinct())
        return Table(df.groupBy(*self._keys).agg(*self._aggregates))
