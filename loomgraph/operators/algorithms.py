"""Degree, PageRank, breadth-first search, shortest paths, connected components."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.graph import Graph
from ..plans.program import Result, VertexProgram, run
from ..storage import Stored

#: Teleport share and tolerance of PageRank, and what stands for "not reached" with sentinel=True; fixed values.
ALPHA, TOLERANCE, INFINITY = 0.15, 1e-5, 2147483647


def degree(graph: Graph, ordering: str = "row", weighted: bool | None = None) -> DataFrame:
    """(id, degree) over the whole domain: records per row (out-degree), or per column; sums of weights if weighted.

    One partial and final aggregation; the domain is joined afterwards, so no vertex is lost and none is invented.
    """
    weighted = graph.weighted if weighted is None else weighted
    own = graph.edges.groupBy(F.col("src" if ordering == "row" else "dst").alias("id")).agg((F.sum("weight") if weighted else F.count(F.lit(1))).alias("degree"))
    return graph.vertices().join(own, "id", "left").select("id", F.coalesce("degree", F.lit(0)).cast("long").alias("degree"))


def pagerank(graph: Graph, iterations: int = 0, *, mode: str = "row_pull", alpha: float = ALPHA, tolerance: float = TOLERANCE, split: bool = True) -> Result:
    """(id, rank, degree). Ranks do not sum to 1; alpha is the teleport share.

    row_pull: rank(u) = alpha + (1 - alpha) * sum of rank(v) / degree(v) over the entries (u, v) of row u; vertices
    without a row keep 0. standard: the textbook direction, along edges from v to u, every vertex starting at alpha.
    iterations 0 runs until no vertex that both sends and receives moves by more than the tolerance.

    ``split`` (row_pull): vertices that receive but are no one's column cannot influence others; they are left out of
    the loop and evaluated once, from the messages of the last superstep, which gives the same ranks.
    """
    if mode not in ("row_pull", "standard"):
        raise ValueError(f"unknown mode {mode!r}")
    pull = mode == "row_pull"
    # The source is read and normalised once; degrees, classes, the loop and the last step all start from the stored edges.
    graph = graph.prepare()
    out_degree = degree(graph, weighted=False)
    acc = F.coalesce(F.col("acc"), F.lit(0.0))
    new_rank = F.lit(alpha) + (1 - alpha) * acc
    start = F.when(F.col("degree") > 0, F.lit(alpha)).otherwise(F.lit(0.0)) if pull else F.lit(alpha)
    program = VertexProgram(
        init={"rank": start, "degree": F.coalesce("degree", F.lit(0))},
        message=F.when(F.col("degree") > 0, F.col("rank") / F.col("degree")),
        combine=F.sum,
        apply=lambda _: {"rank": F.when(F.col("degree") > 0, new_rank).otherwise(F.lit(0.0)) if pull else new_rank},
        changed=F.abs(F.col("new_rank") - F.col("rank")) > tolerance,
        stationary=True,
        ordering="row" if pull else "col",
    )
    if not (pull and split):
        watched = Stored(graph.classes().where("class = 'regular'"), "classes") if pull and not iterations else None
        out = run(graph, program, iterations, init_from=out_degree, converge_on=watched and watched.df)
        if watched:
            watched.drop()
        graph.release()
        return out
    classes = Stored(graph.classes(), "classes")
    regular = classes.df.where("class = 'regular'").select("id")
    inner = Graph(graph.edges.join(regular.withColumnRenamed("id", "src"), "src", "leftsemi"), graph.num_vertices, graph.options)
    # The ranks that the last superstep sent: one superstep earlier, which is where the loop without the last stops.
    done = _loop_keeping_last(inner, program, iterations, out_degree, regular)
    before, after, n, seconds = done
    sources = classes.df.where("class = 'source'").select("id")
    # Ids go with the messages of sinks too: a sink has degree 0 and sends nothing.
    messages = before.df.select("id", program.message.alias("msg")).where("msg is not null")
    edge = graph.edges.join(sources.withColumnRenamed("id", "src"), "src", "leftsemi")
    summed = edge.join(messages.withColumnRenamed("id", "dst"), "dst").groupBy(F.col("src").alias("id")).agg(F.sum("msg").alias("acc"))
    late = sources.join(summed, "id", "left").select("id", new_rank.alias("late"))
    whole = Stored(after.df.select("id", "rank", "degree").join(late, "id", "left").select("id", F.coalesce("late", "rank").alias("rank"), "degree"), "ranks")
    for x in (before, after, classes):
        x.drop()
    graph.release()
    return Result(whole.df, n, seconds, whole)


def _loop_keeping_last(graph: Graph, program: VertexProgram, iterations: int, init_from: DataFrame, watched: DataFrame):
    """The states before and after the last superstep, the count of supersteps and their seconds."""
    import time

    from pyspark.sql import Observation

    from ..plans.program import initial, step

    own = graph.prepare()
    edges = own.dealt("dst")
    mark = watched.withColumn("__watched", F.lit(True))
    before, state = None, Stored(initial(graph, program, init_from), "state")
    seconds, n = [], 0
    while True:
        began = time.perf_counter()
        after = step(state.df, edges, program, graph.weighted, n)
        seen = Observation()
        if iterations:
            counted = after
        else:
            counted = after.join(mark, "id", "left").observe(seen, F.count_if(F.col("__active") & F.col("__watched")).alias("changed")).drop("__watched")
        new = Stored(counted, "state")
        if before is not None:
            before.drop()
        before, state, n = state, new, n + 1
        seconds.append(time.perf_counter() - began)
        if n == iterations or not iterations and not seen.get["changed"]:
            break
    own.release()
    return before, state, n, seconds


def bfs(graph: Graph, root: int = 0, *, sentinel: bool = False) -> Result:
    """(id, hops, parent): levels from the root; the parent is the smallest id among the neighbours of the level before.

    For undirected search give a graph with directed=False. Not reached: null, or with sentinel INFINITY and parent 0.
    """
    program = VertexProgram(
        init={"hops": F.when(F.col("id") == root, F.lit(0)).cast("long"), "parent": F.when(F.col("id") == root, F.col("id"))},
        active=F.col("hops").isNotNull(),
        message=F.col("id"),
        apply=lambda k: {"hops": F.when(F.col("hops").isNull() & F.col("acc").isNotNull(), F.lit(k + 1).cast("long")).otherwise(F.col("hops")),
                         "parent": F.when(F.col("hops").isNull(), F.col("acc")).otherwise(F.col("parent"))},
        changed=F.col("hops").isNull() & F.col("new_hops").isNotNull(),
    )
    out = run(graph, program)
    if sentinel:
        out.state = out.state.select("id", F.coalesce("hops", F.lit(INFINITY)).alias("hops"), F.coalesce("parent", F.lit(0)).alias("parent"))
    return out


def sssp(graph: Graph, root: int = 0, *, sentinel: bool = False) -> Result:
    """(id, distance) from the root along edges src -> dst, by relaxation from changed vertices; every edge counts 1 if unweighted."""
    program = VertexProgram(
        init={"distance": F.when(F.col("id") == root, F.lit(0)).cast("long")},
        active=F.col("distance").isNotNull(),
        message=F.col("distance"),
        edge_map=lambda msg, weight: msg + (weight if weight is not None else F.lit(1)),
        apply=lambda _: {"distance": F.least("distance", "acc")},
        changed=~F.col("distance").eqNullSafe(F.col("new_distance")),
        ordering="col",
    )
    out = run(graph, program)
    if sentinel:
        out.state = out.state.select("id", F.coalesce("distance", F.lit(INFINITY)).alias("distance"))
    return out


def connected_components(graph: Graph, *, method: str = "jump") -> Result:
    """(id, label): the smallest id of the vertex's component; give a graph with directed=False.

    plain: labels go from neighbour to neighbour, as many supersteps as the graph is deep. jump: after each exchange,
    labels are replaced by their labels' labels, which takes about the logarithm of that; the labels are the same,
    only the iteration count differs.
    """
    if method == "plain":
        return run(graph, VertexProgram(
            init={"label": F.col("id")}, message=F.col("label"),
            apply=lambda _: {"label": F.least("label", "acc")}, changed=F.col("new_label") < F.col("label")))
    if method != "jump":
        raise ValueError(f"unknown method {method!r}")
    return _components_by_jumps(graph)


def _components_by_jumps(graph: Graph) -> Result:
    import time

    from pyspark.sql import Observation

    own = graph.prepare()
    edges = own.dealt("dst")
    state = Stored(graph.vertices().select("id", F.col("id").alias("label")), "labels")
    seconds, n = [], 0
    while True:
        began = time.perf_counter()
        heard = edges.meet(state.df.select("id", F.col("label").alias("msg"))).groupBy(F.col("src").alias("id")).agg(F.min("msg").alias("heard"))
        # Whoever holds a label tells it the smallest label heard (hooking); then labels take over their labels' labels.
        told = state.df.join(heard, "id", "left").select("id", "label", F.least("label", "heard").alias("best"))
        told = Stored(told, "labels-told")
        hooked = told.df.groupBy(F.col("label").alias("id")).agg(F.min("best").alias("hook"))
        nearer = told.df.join(hooked, "id", "left").select("id", F.col("label").alias("old"), F.least("best", "hook").alias("near"))
        nearer = Stored(nearer, "labels-near")
        jumped = nearer.df.join(nearer.df.select(F.col("id").alias("near"), F.col("near").alias("far")), "near").select("id", F.least("near", "far").alias("label"), "old")
        seen = Observation()
        new = Stored(jumped.observe(seen, F.count_if(F.col("label") < F.col("old")).alias("changed")).select("id", "label"), "labels")
        for x in (told, nearer, state):
            x.drop()
        state, n = new, n + 1
        seconds.append(time.perf_counter() - began)
        if not seen.get["changed"]:
            break
    own.release()
    return Result(state.df, n, seconds, state)
