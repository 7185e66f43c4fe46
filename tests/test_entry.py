from __future__ import annotations

import contextlib
from pathlib import Path

import pytest

import __spark_entry__ as entry


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0


def test_the_library_does_not_import_the_training_operators():
    root = Path(entry.__file__).parent / "loomstead"
    for p in root.rglob("*.py"):
        if "llm" not in p.relative_to(root).parts:
            assert ".llm" not in p.read_text(), p


def test_a_broken_import_of_the_training_operators_leaves_the_rest(monkeypatch):
    """What they import may be missing: the other queries stay, with a warning."""
    import sys

    for name in [m for m in sys.modules if m.startswith("loomstead.llm") or m == "corpus_pipeline"]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "numpy", None)
    with pytest.warns(UserWarning) if (Path(entry.__file__).parent / "loomstead/llm/queries.py").exists() else contextlib.nullcontext():
        names = set(entry.queries())
    assert "tpch_q1" in names and not any(n.startswith("op") and n[2].isdigit() for n in names)
