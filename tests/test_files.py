"""Edge files: what is read, refused, written and converted."""

import struct

import pytest

from loomgraph import cli
from loomgraph.plans.graph import Graph
from loomgraph.sources import edge_files as E
from loomgraph.streaming.edges import running_degree, stream_edges

EDGES = [(1, 2, 3), (4294967295, 0, 1), (7, 7, 128)]


@pytest.fixture
def edges(make):
    return make("src long, dst long, weight long", EDGES)


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_text(spark, tmp_path):
    (tmp_path / "a.txt").write_text("# head\n% more\n\n1 2\n3 4\n# between\n\n3 4\n")
    assert rows(E.read_edges(spark, str(tmp_path / "a.txt"))) == [(1, 2), (3, 4), (3, 4)]
    (tmp_path / "w.txt").write_text("1 2 9\n")
    assert rows(E.read_edges(spark, str(tmp_path / "w.txt"), weighted=True)) == [(1, 2, 9)]


@pytest.mark.parametrize("line", ["1", "1 2 3", "1  2", "1\t2", "1 2 ", "a b", "-1 2"])
def test_bad_lines(spark, tmp_path, line):
    (tmp_path / "a.txt").write_text(f"5 6\n{line}\n")
    with pytest.raises(Exception, match="must have 2 numbers"):
        E.read_text(spark, str(tmp_path / "a.txt")).collect()
    assert rows(E.read_text(spark, str(tmp_path / "a.txt"), mode="DROPMALFORMED")) == [(5, 6)]


@pytest.mark.parametrize("weighted", [False, True])
def test_binary(spark, tmp_path, weighted):
    data = [e[: 2 + weighted] for e in EDGES]
    (tmp_path / "a.bin").write_bytes(b"".join(struct.pack(f"<{2 + weighted}I", *e) for e in data))
    assert E.sniff(spark, str(tmp_path / "a.bin")) == "binary"
    assert rows(E.read_edges(spark, str(tmp_path / "a.bin"), weighted=weighted)) == sorted(data)


def test_partial_record(spark, tmp_path):
    (tmp_path / "a.bin").write_bytes(b"\0" * 13)
    with pytest.raises(ValueError, match="no multiple of 8"):
        E.read_binary(spark, str(tmp_path / "a.bin"))


def test_reconciled(edges):
    assert E.reconciled(edges, 3) is edges
    with pytest.raises(ValueError, match="3 edges were read, 4 expected"):
        E.reconciled(edges, 4)


def test_missing_and_empty(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        E.read_edges(spark, str(tmp_path / "none"))
    (tmp_path / "e.txt").write_text("")
    assert rows(E.read_edges(spark, str(tmp_path / "e.txt"))) == []


@pytest.mark.parametrize("kind", ["text", "binary"])
def test_round_trip(spark, tmp_path, edges, kind):
    {"text": E.write_text, "binary": E.write_binary}[kind](edges.repartition(3), str(tmp_path / "out"))
    assert rows(E.read_edges(spark, str(tmp_path / "out"), weighted=True)) == sorted(EDGES)


def test_binary_refuses_what_does_not_fit(make, tmp_path):
    with pytest.raises(Exception, match="32 bits"):
        E.write_binary(make("src long, dst long", [(1 << 32, 0)]), str(tmp_path / "out"))


def test_convert(spark, tmp_path):
    (tmp_path / "a.txt").write_text("# c\n1 2\n3 4\n")
    got = E.convert(spark, str(tmp_path / "a.txt"), str(tmp_path / "b"), target_format="binary", target_weighted=True, offset=10)
    assert got == {"comments": 1, "max_id": 14, "edges": 2, "lines": 3}
    back = rows(E.read_edges(spark, str(tmp_path / "b"), weighted=True))
    assert [r[:2] for r in back] == [(11, 12), (13, 14)]
    assert all(1 <= r[2] <= 128 for r in back)
    E.convert(spark, str(tmp_path / "b"), str(tmp_path / "c"), source_weighted=True)
    assert rows(E.read_edges(spark, str(tmp_path / "c"))) == [(11, 12), (13, 14)]


def test_made_up_weights_are_the_same_each_time(make):
    df = make("src long, dst long", [(k, k + 1) for k in range(200)])
    assert rows(E.with_weights(df)) == rows(E.with_weights(df.repartition(5)))
    assert rows(E.with_weights(df, 1)) != rows(E.with_weights(df))


def test_load(spark, tmp_path):
    (tmp_path / "a.txt").write_text("0 1\n1 0\n1 1\n")
    g = Graph.load(spark, str(tmp_path / "a.txt"), 3, self_loops=False)
    assert rows(g.edges) == [(0, 1), (1, 0)]
    assert g.vertices().count() == 4


def test_cli(spark, tmp_path, capsys, monkeypatch):
    monkeypatch.setattr(cli, "session", lambda: spark)
    (tmp_path / "a.txt").write_text("0 1\n1 2\n")
    assert cli.main(["bfs", str(tmp_path / "a.txt"), "2", "0"]) == 0
    out = capsys.readouterr().out
    assert "Number of iterations: 3" in out
    assert "Value checksum: 3" in out
    assert "vertex[2]:Parent=1,Hops=2" in out
    for command in (["deg"], ["pr", "2"], ["sssp"], ["cc"]):
        assert cli.main([command[0], str(tmp_path / "a.txt"), "2", *command[1:]]) == 0
    with pytest.raises(SystemExit):
        cli.main(["bfs"])


def test_stream(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "1.txt").write_text("0 1\n0 2\n")
    q = running_degree(stream_edges(spark, str(folder))).writeStream.outputMode("complete").format("memory").queryName("degrees").option(
        "checkpointLocation", str(tmp_path / "ck")).start()
    try:
        q.processAllAvailable()
        assert rows(spark.table("degrees")) == [(0, 2)]
        (folder / "2.txt").write_text("# later\n0 3\n5 1\n")
        q.processAllAvailable()
        assert rows(spark.table("degrees")) == [(0, 3), (5, 1)]
    finally:
        q.stop()
