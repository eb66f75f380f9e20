"""The driver's contract, with and without the corpus queries."""

import builtins
import sys

import __spark_entry__


def test_every_sql_has_its_query():
    queries, sql = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert len(queries) > 150 and set(sql) <= set(queries)


def test_the_rest_works_without_the_corpus_queries(monkeypatch):
    real = builtins.__import__

    def refuse(name, *rest):
        if name.startswith(("isobath.llm", "corpus_pipeline")):
            raise ImportError(name)
        return real(name, *rest)

    for name in [m for m in sys.modules if m.startswith("isobath.llm") or m == "corpus_pipeline"]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setattr(__spark_entry__.importlib, "import_module", lambda name: refuse(name))
    left = __spark_entry__.queries()
    assert len(left) > 140 and not any(n.startswith("op") and n[2].isdigit() or n == "pipeline" for n in left)
