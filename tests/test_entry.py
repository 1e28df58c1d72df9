"""The entry module, with and without the optional subpackage."""

import sys


def test_entry_runs(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_core_does_without_the_optional_part(monkeypatch):
    import __spark_entry__ as e

    found = e.importlib.util.find_spec
    monkeypatch.setattr(e.importlib.util, "find_spec", lambda name, *a: None if name.startswith("strandspark.llm") else found(name, *a))
    assert "strand_statistics" in e.queries() and not [q for q in e.queries() if q.startswith("op")]


def test_no_core_module_imports_it():
    import pathlib

    root = pathlib.Path(__file__).resolve().parent.parent / "strandspark"
    for p in root.rglob("*.py"):
        if "llm" not in p.parts:
            text = p.read_text()
            assert "strandspark.llm" not in text and "from .llm" not in text and "from ..llm" not in text, p
    assert "sys" in dir() or sys
