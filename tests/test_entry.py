"""The entry module offers the core queries whatever the corpus part lacks."""

import importlib
import sys

import pytest

from terrafold.plans import catalog


@pytest.mark.parametrize("missing", ["corpus_pipeline", "terrafold.llm", "public_tokenizers", "xxhash", "zstandard", "pyarrow"])
def test_entry_without_a_dependency_of_the_corpus_part(monkeypatch, missing):
    for name in [n for n in sys.modules if n.startswith(("terrafold.llm", "corpus_pipeline", "__spark_entry__"))]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, missing, None)
    entry = importlib.import_module("__spark_entry__")
    assert set(entry.queries()) == set(catalog.queries()) and set(entry.oracle_sql()) == set(catalog.oracle_sql())
