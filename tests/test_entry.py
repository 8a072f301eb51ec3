"""The driver contract holds with and without the training-data subpackage."""

import sys

import __spark_entry__ as entry


def test_queries_without_the_subpackage(monkeypatch):
    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    assert not [q for q in entry.queries() if q.startswith("op") and q[2:3].isdigit()] and "pipeline" not in entry.queries()
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
