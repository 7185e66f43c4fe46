"""``Table``: a lazy, immutable columnar table on a DataFrame.

Filters remove rows; there is no mask of valid rows.  Joins are real joins
for any multiplicity of keys.  A chain of ``order_by`` calls becomes one sort in
which the last call counts most, and ``head`` and ``tail`` are defined by it.
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from .grouped import GroupedTable
from .predicate import Predicate, is_in


class Table:
    def __init__(self, df: DataFrame, key: str | None = None, order: tuple[tuple[str, bool], ...] = ()) -> None:
        self._df, self.key, self._order = df, key, order

    # -- shape -------------------------------------------------------------

    @property
    def df(self) -> DataFrame:
        """The DataFrame, sorted if an order was asked for."""
        return self._df.orderBy(*self._sort()) if self._order else self._df

    @property
    def columns(self) -> list[str]:
        return self._df.columns

    @property
    def num_columns(self) -> int:
        return len(self._df.columns)

    def num_rows(self) -> int:
        """An action: it counts."""
        return self._df.count()

    def column(self, at: str | int) -> Column:
        """A column by name or place; an unknown one is an error."""
        name = self.columns[at] if isinstance(at, int) else at
        if name not in self.columns:
            raise KeyError(f"no column {name!r} in {self.columns}")
        return F.col(f"`{name}`")

    def column_index(self, name: str) -> int:
        return self.columns.index(name)

    def key_column(self) -> Column:
        if self.key is None:
            raise KeyError("the table has no key")
        return self.column(self.key)

    __getitem__ = column

    def print_schema(self) -> None:
        self._df.printSchema()

    def print_first_rows(self, n: int = 10) -> None:
        self.df.show(n, truncate=False)

    def open(self) -> list[Any]:
        """All rows, to the driver."""
        return self.df.collect()

    def _new(self, df: DataFrame) -> Table:
        return Table(df, self.key if self.key in df.columns else None, tuple(o for o in self._order if o[0] in df.columns))

    # -- projection --------------------------------------------------------

    def project(self, *names: str) -> Table:
        """The named columns in the given order."""
        return self._new(self._df.select(*[self.column(n) for n in names]))

    def insert_column(self, name: str, value: Column) -> Table:
        """A new column at the end, or a new value in an old column's place."""
        return self._new(self._df.withColumn(name, value))

    def delete_column(self, name: str) -> Table:
        self.column(name)
        return self._new(self._df.drop(name))

    def rename_column(self, old: str, new: str) -> Table:
        """The column under a new name, at the end; a name that is taken is an error."""
        if new in self.columns and new != old:
            raise ValueError(f"there is a column {new!r} already")
        rest = [self.column(c) for c in self.columns if c != old]
        return Table(self._df.select(*rest, self.column(old).alias(new)), new if self.key == old else self.key, tuple((new if c == old else c, asc) for c, asc in self._order))

    # -- filters -----------------------------------------------------------

    def filter_public(self, column: str, predicate: Predicate, value: Any) -> Table:
        return self._new(self._df.where(predicate.public(self.column(column), value)))

    def filter_shared(self, left: str, right: str, predicate: Predicate) -> Table:
        return self._new(self._df.where(predicate.shared(self.column(left), self.column(right))))

    def filter_in(self, column: str, values: list[Any]) -> Table:
        """Rows whose value is in the list; none for an empty list."""
        return self._new(self._df.where(is_in(self.column(column), values)))

    def filter_scalar(self, column: str, predicate: Predicate, scalar: DataFrame) -> Table:
        """Compare a column with the one value of a table of one row and one column."""
        return self._new(self._df.where(predicate.shared(self.column(column), scalar.scalar())))

    def filter_vector(self, column: str, predicate: Predicate, vector: Table, value: str) -> Table:
        """Compare a column row by row with a vector: the ``value`` of the row of ``vector`` that has the same key.

        Both tables need a key; rows without a value are removed, and a key that
        occurs twice in the vector is an error when the join runs.
        """
        if self.key is None or vector.key is None:
            raise KeyError("both tables need a key")
        twice = F.raise_error(F.concat(F.lit("a key occurs twice: "), F.col("__k").cast("string")))
        values = vector.df.groupBy(vector.column(vector.key).alias("__k")).agg(F.count(F.lit(1)).alias("__n"), F.first(vector.column(value)).alias("__v"))
        values = values.where(F.when(F.col("__n") > 1, twice.cast("boolean")).otherwise(True)).drop("__n")
        both = self._df.join(values, self.key_column() == F.col("__k"))
        return self._new(both.where(predicate.shared(self.column(column), "__v")).select(*[self.column(c) for c in self.columns]))

    def filter_by(self, condition: Column) -> Table:
        """Rows for which a composed condition holds."""
        return self._new(self._df.where(condition))

    # -- joins -------------------------------------------------------------

    def inner_join(self, left_key: str, right_key: str, right: Table, expect_unique_left: bool = False) -> Table:
        """Columns: the right key, the left's other columns, the right's other columns."""
        return self.inner_join_multi([left_key], [right_key], right, expect_unique_left)

    def inner_join_multi(self, left_keys: list[str], right_keys: list[str], right: Table, expect_unique_left: bool = False) -> Table:
        """Equi-join on several keys, which keep the right's names.

        The same name on both sides is an error.  ``expect_unique_left`` makes a
        left key that occurs twice an error when the join runs.
        """
        rest_left = [c for c in self.columns if c not in left_keys]
        rest_right = [c for c in right.columns if c not in right_keys]
        clash = set(rest_left) & (set(rest_right) | set(right_keys))
        if clash:
            raise ValueError(f"columns on both sides: {sorted(clash)}")
        left = self._df
        if expect_unique_left:
            # The keys alone are counted; the columns are not shuffled for it.
            named = [F.col(k).alias(f"__k{i}") for i, k in enumerate(left_keys)]
            twice = F.raise_error(F.concat(F.lit("a left key occurs twice: "), F.to_json(F.struct(*[f"__k{i}" for i in range(len(left_keys))]))))
            counts = left.select(*named).groupBy(*[f"__k{i}" for i in range(len(left_keys))]).agg(F.count(F.lit(1)).alias("__n"))
            once = counts.where(F.when(F.col("__n") > 1, twice.cast("boolean")).otherwise(True)).drop("__n")
            left = left.join(once, [F.col(k) == F.col(f"__k{i}") for i, k in enumerate(left_keys)], "left_semi")
        a = left.select(*[F.col(k).alias(f"__l{i}") for i, k in enumerate(left_keys)], *rest_left)
        b = right._df
        condition = [F.col(f"__l{i}") == b[k] for i, k in enumerate(right_keys)]
        return Table(a.join(b, condition, "inner").select(*right_keys, *rest_left, *rest_right), right.key if right.key in right_keys else None)

    def semi_join(self, left_key: str, right_key: str, right: Table) -> Table:
        """Rows of this table with a match."""
        return self._half(left_key, right_key, right, "left_semi")

    def anti_join(self, left_key: str, right_key: str, right: Table) -> Table:
        """Rows of this table without a match."""
        return self._half(left_key, right_key, right, "left_anti")

    def member_flag(self, left_key: str, right_key: str, right: Table, name: str) -> Table:
        """All rows of this table, with 1 in column ``name`` where there is a match and else 0."""
        if name in self.columns:
            raise ValueError(f"there is a column {name!r} already")
        keys = right._df.select(F.col(right_key).alias("__r")).distinct()
        both = self._df.join(keys, self.column(left_key) == F.col("__r"), "left")
        return self._new(both.select(*[self.column(c) for c in self.columns], F.col("__r").isNotNull().cast("bigint").alias(name)))

    def _half(self, left_key: str, right_key: str, right: Table, how: str) -> Table:
        keys = right._df.select(F.col(right_key).alias("__r"))
        return self._new(self._df.join(keys, self.column(left_key) == F.col("__r"), how))

    def left_join(self, left_key: str, right_key: str, right: Table) -> Table:
        """All rows of this table, with nulls where there is no match."""
        clash = set(self.columns) & set(right.columns)
        if clash:
            raise ValueError(f"columns on both sides: {sorted(clash)}")
        return Table(self._df.join(right._df, F.col(left_key) == F.col(right_key), "left"), self.key)

    # -- aggregation -------------------------------------------------------

    def group_by(self, *keys: str) -> GroupedTable:
        for k in keys:
            self.column(k)
        return GroupedTable(Table(self._df), keys)

    def distinct(self, *columns: str) -> Table:
        return Table(self._df.select(*(columns or self.columns)).distinct())

    def aggregate(self, **aggregates: Column) -> Table:
        """One row of aggregates over all rows."""
        return Table(self._df.agg(*[c.alias(n) for n, c in aggregates.items()]))

    # -- windows -----------------------------------------------------------

    def _window(self, partition_by: tuple[str, ...], what: str) -> WindowSpec:
        """Rows in the table's order, within groups; a window over the whole table runs in one task."""
        self._ordered(what)
        return Window.partitionBy(*(self.column(c) for c in partition_by) if partition_by else (F.lit(0),)).orderBy(*self._sort())

    def running_sum(self, column: str, name: str, *partition_by: str) -> Table:
        """The sum of a column up to each row, in the table's order."""
        own = self._window(partition_by, "running_sum").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        return self.insert_column(name, F.sum(self.column(column)).over(own))

    def lead(self, column: str, name: str, *partition_by: str, offset: int = 1) -> Table:
        """A column's value ``offset`` rows further on in the table's order; null where there is none."""
        return self.insert_column(name, F.lead(self.column(column), offset).over(self._window(partition_by, "lead")))

    # -- order -------------------------------------------------------------

    def order_by(self, column: str, ascending: bool = True) -> Table:
        """Stable order; of several calls the last counts most."""
        self.column(column)
        return Table(self._df, self.key, ((column, ascending), *(o for o in self._order if o[0] != column)))

    def _sort(self, reverse: bool = False) -> list[Column]:
        return [F.col(c).asc() if asc != reverse else F.col(c).desc() for c, asc in self._order]

    def head(self, n: int) -> Table:
        """The first ``n`` rows of the order."""
        self._ordered("head")
        return Table(self._df.orderBy(*self._sort()).limit(n), self.key, self._order)

    def tail(self, n: int) -> Table:
        """The last ``n`` rows of the order, all if there are fewer."""
        self._ordered("tail")
        return Table(self._df.orderBy(*self._sort(reverse=True)).limit(n), self.key, self._order)

    def _ordered(self, what: str) -> None:
        if not self._order:
            raise ValueError(f"{what} needs an order: call order_by first")
