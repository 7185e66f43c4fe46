"""The columnar dataflow API: tables, predicates, grouped tables."""

from .grouped import GroupedTable
from .predicate import Predicate
from .table import Table

__all__ = ["GroupedTable", "Predicate", "Table"]
