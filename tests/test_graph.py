"""The golden graph, the normalisation steps, and random graphs against a plain simulator."""

import heapq

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loomgraph.functions.hashing import BucketHash
from loomgraph.functions.tiling import Tiling, factors
from loomgraph.operators import algorithms as A
from loomgraph.operators import report as R
from loomgraph.operators.edges import EdgeOptions, compact_index, normalize
from loomgraph.plans.graph import Graph
from loomgraph.plans.program import VertexProgram, run

GOLDEN = [(0, 1, 4), (0, 2, 1), (2, 1, 2), (1, 3, 5), (1, 3, 3), (3, 3, 7), (3, 4, 1), (4, 1, 6), (5, 6, 2), (7, 5, 9), (6, 5, 2)]
SCHEMA = "src long, dst long, weight long"
UNDIRECTED = {"directed": False, "parallel_edges": False}


@pytest.fixture
def golden(make):
    def build(weighted=False, **flags):
        return Graph.from_edges(make(SCHEMA, GOLDEN), weight="weight" if weighted else None, num_vertices=9, **flags)

    return build


def column(df, name):
    return [r[name] for r in df.orderBy("id").collect()]


def edge_set(df):
    return sorted(tuple(r) for r in df.collect())


def test_degrees(golden):
    assert column(A.degree(golden()), "degree") == [2, 2, 1, 2, 1, 1, 1, 1, 0, 0]
    assert column(A.degree(golden(), "col"), "degree") == [0, 3, 1, 3, 1, 2, 1, 0, 0, 0]
    assert column(A.degree(golden(transpose=True)), "degree") == [0, 3, 1, 3, 1, 2, 1, 0, 0, 0]
    assert column(A.degree(golden(True)), "degree") == [5, 8, 2, 8, 6, 2, 2, 9, 0, 0]


@pytest.mark.parametrize(("n", "want", "iterations"), [
    (1, [.34125, .2775, .21375, .34125, .21375, .2775, .2775, .2775, 0, 0], 1),
    (20, [1.181580, 1.161056, .640362, 1.196746, .640362, .967054, .967054, .967054, 0, 0], 20),
    (0, [1.222708, 1.202187, .660925, 1.237876, .660925, .999958, .999958, .999958, 0, 0], 61),
])
@pytest.mark.parametrize("split", [True, False])
def test_pagerank(golden, n, want, iterations, split):
    got = A.pagerank(golden(), n, split=split)
    assert got.iterations == iterations
    assert column(got.state, "rank") == pytest.approx(want, abs=1e-6)


def test_pagerank_standard(golden):
    assert column(A.pagerank(golden(), 20, mode="standard").state, "rank") == pytest.approx(
        [.15, 1.283292, .21375, 2.136423, 1.051807, 1.408705, 1.342458, .15, .15, .15], abs=1e-6)


def test_pagerank_without_regular_vertices_stops_at_once(make):
    g = Graph.from_edges(make("src long, dst long", [(0, 2), (1, 2)]))
    assert A.pagerank(g).iterations == 1


@pytest.mark.parametrize(("method", "iterations"), [("plain", 3), ("jump", None)])
def test_components(golden, method, iterations):
    got = A.connected_components(golden(**UNDIRECTED), method=method)
    assert column(got.state, "label") == [0, 0, 0, 0, 0, 5, 5, 5, 8, 9]
    assert iterations in (None, got.iterations)


def test_bfs(golden):
    g = golden(self_loops=False, **UNDIRECTED)
    got = A.bfs(g, 0)
    assert got.iterations == 3
    assert column(got.state, "hops") == [0, 1, 1, 2, 2, None, None, None, None, None]
    assert column(got.state, "parent") == [0, 0, 0, 1, 1, None, None, None, None, None]
    far = A.bfs(g, 5, sentinel=True)
    assert far.iterations == 2
    assert column(far.state, "hops") == [A.INFINITY] * 5 + [0, 1, 1] + [A.INFINITY] * 2
    assert column(far.state, "parent")[:2] == [0, 0]


def test_sssp(golden):
    flags = {"self_loops": False, "parallel_edges": False}
    got = A.sssp(golden(True, **flags))
    assert (got.iterations, column(got.state, "distance")) == (5, [0, 3, 1, 6, 7, None, None, None, None, None])
    got = A.sssp(golden(**flags))
    assert (got.iterations, column(got.state, "distance")) == (4, [0, 1, 1, 2, 3, None, None, None, None, None])


@pytest.mark.parametrize(("flags", "want"), [
    ({"self_loops": False, "parallel_edges": False}, "0-1:4 0-2:1 1-3:3 2-1:2 3-4:1 4-1:6 5-6:2 6-5:2 7-5:9"),
    (UNDIRECTED, "0-1:4 0-2:1 1-0:4 1-2:2 1-3:3 1-4:6 2-0:1 2-1:2 3-1:3 3-3:7 3-4:1 4-1:6 4-3:1 5-6:2 5-7:9 6-5:2 7-5:9"),
    ({"transpose": True}, "1-0:4 1-2:2 1-4:6 2-0:1 3-1:3 3-1:5 3-3:7 4-3:1 5-6:2 5-7:9 6-5:2"),
    ({"acyclic": True, "parallel_edges": False}, "0-1:4 0-2:1 1-2:2 1-3:3 1-4:6 3-3:7 3-4:1 5-6:2 5-7:9"),
])
def test_normalisation(golden, flags, want):
    assert edge_set(golden(True, **flags).edges) == sorted((int(a), int(b), int(w)) for e in want.split() for ab, w in [e.split(":")] for a, b in [ab.split("-")])


def test_transposing_twice_is_nothing(make):
    edges = make(SCHEMA, GOLDEN)
    once = normalize(edges, EdgeOptions(transpose=True))
    assert edge_set(normalize(once, EdgeOptions(transpose=True))) == edge_set(edges)


def test_classes_and_index(golden):
    assert column(golden().classes(), "class") == ["source", *["regular"] * 6, "source", "isolated", "isolated"]
    got = compact_index(golden().edges, "src", 4)
    assert sorted(tuple(r) for r in got.collect()) == [(0, 0, 0), (1, 0, 1), (2, 0, 2), (3, 0, 3), (4, 1, 0), (5, 1, 1), (6, 1, 2), (7, 1, 3)]


def test_ids_outside_the_domain_are_an_error(make):
    g = Graph.from_edges(make("src long, dst long", [(0, 7)]), num_vertices=3)
    with pytest.raises(Exception, match="outside 0..3"):
        g.edges.collect()


def test_edge_cases(make):
    empty = make("src long, dst long", [])
    g = Graph.from_edges(empty)
    assert g.num_vertices == 0
    assert column(A.degree(g), "degree") == [0]
    assert column(A.connected_components(g).state, "label") == [0]
    nulls = Graph.from_edges(make("src long, dst long, weight string", [(0, None, "x"), (None, 1, "y"), (0, 1, None), (0, 1, "z")]))
    assert column(A.degree(nulls), "degree") == [2, 0]


def test_reports(golden):
    ranks = A.pagerank(golden(), 20).state
    assert tuple(R.checksum(ranks).first()) == (3, 8)
    assert tuple(R.checksum(A.degree(golden())).first()) == (11, 8)
    shown = [r["shown"] for r in R.display(A.bfs(golden(self_loops=False, **UNDIRECTED)).state, 6).collect()]
    assert shown[:2] == ["vertex[0]:Parent=0,Hops=0", "vertex[1]:Parent=0,Hops=1"]
    assert shown[5] == "vertex[5]:Parent=0,Hops=INF"
    assert R.display(ranks, 1).first()["shown"] == "vertex[0]:Rank=1.181580,Degree=2"
    assert R.timing([1.0, 3.0]) == "4.000: 2.000 +/- 1.000"
    got = R.balance(golden().edges, 2, 5).orderBy("group").collect()
    assert [(r["edges"], r["uneven"]) for r in got] == [(8, True), (3, True)]


def test_hot_senders_are_spread(make, monkeypatch):
    """A vertex with most of the edges gives the same results from several partitions."""
    monkeypatch.setattr("loomgraph.plans.graph.LEAST_SHARE", 10)
    edges = [(0, k, k) for k in range(1, 80)] + [(k, k + 1, 1) for k in range(1, 79)]
    g = Graph.from_edges(make(SCHEMA, edges), weight="weight", self_loops=False, parallel_edges=False)
    dealt = g.dealt("src")
    assert dealt.hot is not None and dealt.edges.where("src = 0").select("__salt").distinct().count() > 1
    assert dealt.edges.count() == len(edges)
    g.release()
    assert column(A.sssp(g).state, "distance") == list(range(80))
    both = Graph.from_edges(make(SCHEMA, edges), self_loops=False, **UNDIRECTED)
    assert column(A.bfs(both).state, "hops") == [0, *[1] * 79]
    assert set(column(A.connected_components(both).state, "label")) == {0}


def test_custom_program_on_the_transpose(golden):
    """Row and column ordering of one program are each other's transpose."""
    def counts(ordering):
        return VertexProgram(init={"n": F.lit(0).cast("long")}, message=F.lit(1), combine=F.sum, stationary=True, ordering=ordering,
                             apply=lambda _: {"n": F.coalesce("acc", F.lit(0)).cast("long")}, changed=F.col("new_n") != F.col("n"))

    assert column(run(golden(), counts("row"), 1).state, "n") == column(A.degree(golden()), "degree")
    assert column(run(golden(), counts("col"), 1).state, "n") == column(run(golden(transpose=True), counts("row"), 1).state, "n")


def test_hashed_graph_has_the_same_components(make):
    edges = [(k, k + 3) for k in range(0, 300, 7)]
    plain = Graph.from_edges(make("src long, dst long", edges), num_vertices=400, **UNDIRECTED)
    hashed = Graph.from_edges(make("src long, dst long", edges), num_vertices=400, hashing="bucket", buckets=1, **UNDIRECTED)
    assert edge_set(hashed.edges) != edge_set(plain.edges)

    def partition(g):
        groups = {}
        for r in g.original(A.connected_components(g).state, "label").collect():
            groups.setdefault(r["label"], set()).add(r["id"])
        return sorted(map(sorted, groups.values()))

    assert partition(hashed) == partition(plain)


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 5000), st.integers(1, 9))
def test_bucket_hash_is_a_bijection(domain, buckets):
    h = BucketHash(domain, buckets)
    low, high = h.parts, h.height
    top = low * high
    hashed = [v if v >= top else v // low + v % low * high for v in range(domain)]
    assert sorted(hashed) == list(range(domain))


def test_bucket_hash_columns(spark):
    h = BucketHash(3000, 2)
    got = spark.range(3000).select("id", h.unhash(h.hash(F.col("id"))).alias("back"), h.hash(F.col("id")).alias("h"))
    assert got.where("id <> back").count() == 0
    assert got.select("h").distinct().count() == 3000


@pytest.mark.parametrize(("ranks", "threads"), [(1, 1), (2, 1), (4, 3), (6, 4), (9, 2), (16, 5)])
def test_diagonal_of_tiles_is_even(spark, ranks, threads):
    t = Tiling(ranks, threads)
    cells = t.placement(spark).where("row_group = col_group").collect()
    owners = [r["owner"] for r in cells]
    assert sorted(owners) == list(range(ranks * threads))
    assert all(sum(r["rank"] == k for r in cells) == threads for k in range(ranks))
    assert all(sum(r["thread"] == k for r in cells) == ranks for k in range(threads))


def test_factors():
    assert [factors(n) for n in (1, 6, 12, 13, 36)] == [(1, 1), (2, 3), (3, 4), (1, 13), (6, 6)]


def simulate(n, edges):
    """hops, parents, distances, labels by plain means."""
    both = {(a, b) for a, b, _ in edges if a != b} | {(b, a) for a, b, _ in edges if a != b}
    hops, parent, level = {0: 0}, {0: 0}, [0]
    while level:
        new = {}
        for a in sorted(level):
            for x, b in both:
                if x == a and b not in hops:
                    new[b] = min(new.get(b, a), a)
        for b, a in new.items():
            hops[b], parent[b] = hops[a] + 1, a
        level = list(new)
    least = {}
    heap = [(0, 0)]
    while heap:
        d, a = heapq.heappop(heap)
        if a in least:
            continue
        least[a] = d
        for x, b, w in edges:
            if x == a and b not in least:
                heapq.heappush(heap, (d + w, b))
    label = list(range(n + 1))
    for _ in range(n + 1):
        for a, b in both:
            label[a] = label[b] = min(label[a], label[b])
    ids = range(n + 1)
    return [hops.get(i) for i in ids], [parent.get(i) for i in ids], [least.get(i) for i in ids], label


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 9), st.integers(0, 9), st.integers(1, 9)), min_size=1, max_size=14))
def test_random_graphs(make, edges):
    df, n = make(SCHEMA, edges), 9
    hops, parent, least, label = simulate(n, edges)
    found = A.bfs(Graph.from_edges(df, num_vertices=n, self_loops=False, **UNDIRECTED)).state
    assert (column(found, "hops"), column(found, "parent")) == (hops, parent)
    assert column(A.sssp(Graph.from_edges(df, weight="weight", num_vertices=n, self_loops=False, parallel_edges=False)).state, "distance") == least
    assert column(A.connected_components(Graph.from_edges(df, num_vertices=n, **UNDIRECTED)).state, "label") == label
