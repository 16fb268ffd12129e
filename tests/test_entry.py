"""The driver's contract, also where the corpus operators can't be imported."""

import builtins
import sys

import __spark_entry__
import pytest

from meridia.plans.registry import QUERIES


def test_core_queries_stay_without_a_library(monkeypatch):
    gone = [m for m in sys.modules if m.startswith("meridia.llm") or m == "corpus_pipeline"]
    for m in gone:
        monkeypatch.delitem(sys.modules, m)
    plain = builtins.__import__

    def refuse(name, *args, **options):
        if name == "ahocorasick":
            raise ImportError(name)
        return plain(name, *args, **options)

    monkeypatch.delitem(sys.modules, "ahocorasick", raising=False)
    monkeypatch.setattr(builtins, "__import__", refuse)
    with pytest.warns(UserWarning, match="left out"):
        found = __spark_entry__.queries()
    assert found == QUERIES
    with pytest.warns(UserWarning, match="left out"):
        assert "op4_licenses" not in __spark_entry__.oracle_sql()
    for m in [m for m in sys.modules if m.startswith("meridia.llm")]:
        monkeypatch.delitem(sys.modules, m, raising=False)
