"""The driver's contract, with and without the corpus operators."""

import sys

import __spark_entry__ as entry


def test_names():
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries)
    assert {"degree_out", "pagerank_pull_20", "bfs_hops", "sssp_weighted", "cc_labels"} <= set(sql)


def test_without_the_corpus_operators(monkeypatch):
    for name in ("loomgraph.llm", "loomgraph.llm.queries", "corpus_pipeline"):
        monkeypatch.setitem(sys.modules, name, None)
    monkeypatch.delattr("loomgraph.llm", raising=False)
    queries = entry.queries()
    assert "pagerank_pull_20" in queries
    assert not [n for n in queries if n.startswith("op") or n == "pipeline"]
    assert not [n for n in entry.oracle_sql() if n.startswith("op")]
