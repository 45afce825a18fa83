"""Vertex programs: four Column-level hooks evaluated as joins and aggregations.

A superstep is

    messages = state of the senders, projected by ``message``
    gathered = edges joined with messages on the sending column,
               mapped by ``edge_map`` and reduced by ``combine`` per receiving row
    state'   = state left-joined with gathered, through ``apply``

A stationary program sends from every vertex in each superstep; the other kind
sends only from vertices that changed in the last one. Hooks are Columns, so
all of it stays in generated code, and min, max and sum reduce before the
shuffle. Each superstep is written to the shared folder, which cuts lineage
and survives executors; the count of changed vertices comes back with that
write and needs no job of its own.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..storage import Stored
from .graph import Dealt, Graph

#: The reduced value of a vertex in ``apply``; null where nothing arrived.
ACC = "acc"


@dataclass(frozen=True)
class VertexProgram:
    """Hooks see state columns by name.

    init: state columns of a new vertex (``id`` and, with ``init_from``, the other result's columns are in scope).
    message: what a sender sends; null is not sent.
    apply: (iteration) -> new values of state columns, from the old ones and ``acc``.
    changed: from the old columns and the new ones, which are prefixed ``new_``.
    active: who sends first (not stationary).
    """

    init: dict[str, Column]
    message: Column
    apply: Callable[[int], dict[str, Column]]
    changed: Column
    combine: Callable[[Column], Column] = F.min
    edge_map: Callable[[Column, Column | None], Column] = lambda msg, weight: msg
    active: Column = field(default_factory=lambda: F.lit(True))
    stationary: bool = False
    ordering: str = "row"  # "col": rows send and columns receive, as on the transposed graph


@dataclass
class Result:
    state: DataFrame
    iterations: int
    seconds: list[float]
    stored: Stored | None = None


def gather(edges: Dealt, messages: DataFrame, program: VertexProgram, weighted: bool) -> DataFrame:
    """(id, acc): the reduced messages of each receiving vertex; messages is (id, msg)."""
    value = program.edge_map(F.col("msg"), F.col("weight") if weighted else None)
    return edges.meet(messages).groupBy(F.col("src" if edges.sender == "dst" else "dst").alias("id")).agg(program.combine(value).alias(ACC))


def initial(graph: Graph, program: VertexProgram, init_from: DataFrame | None = None) -> DataFrame:
    """(id, state columns, __active)."""
    start = graph.vertices()
    if init_from is not None:
        start = start.join(init_from, "id", "left")
    names = list(program.init)
    return start.select("id", *[c.alias(n) for n, c in program.init.items()]).select("id", *names, program.active.alias("__active"))


def step(state: DataFrame, edges: Dealt, program: VertexProgram, weighted: bool, iteration: int) -> DataFrame:
    names = list(program.init)
    senders = state if program.stationary else state.where("__active")
    messages = senders.select("id", program.message.alias("msg")).where("msg is not null")
    joined = state.drop("__active").join(gather(edges, messages, program, weighted), "id", "left")
    new = program.apply(iteration)
    after = joined.select("id", *names, *[new.get(n, F.col(n)).alias(f"new_{n}") for n in names])
    return after.select("id", *[F.col(f"new_{n}").alias(n) for n in names], program.changed.alias("__active"))


def run(graph: Graph, program: VertexProgram, max_iter: int = 0, *, init_from: DataFrame | None = None, converge_on: DataFrame | None = None,
        limit: int = 100_000) -> Result:
    """max_iter > 0: exactly that many supersteps; 0: until a superstep changes nothing (counted as well).

    ``converge_on`` (ids) restricts which vertices count as changed for stopping.
    """
    own = graph.prepare()
    edges = own.dealt("dst" if program.ordering == "row" else "src")
    names = list(program.init)
    state = Stored(initial(graph, program, init_from), "state")
    seconds, iteration = [], 0
    watched = converge_on.select("id", F.lit(True).alias("__watched")) if converge_on is not None else None
    while True:
        began = time.perf_counter()
        after = step(state.df, edges, program, graph.weighted, iteration)
        seen = Observation()
        if watched is None:
            counted = after.observe(seen, F.count_if("__active").alias("changed"))
        else:
            counted = after.join(watched, "id", "left").observe(seen, F.count_if(F.col("__active") & F.col("__watched")).alias("changed")).drop("__watched")
        new = Stored(counted, "state")
        state.drop()
        state, iteration = new, iteration + 1
        seconds.append(time.perf_counter() - began)
        if iteration == max_iter or not max_iter and not seen.get["changed"]:
            break
        if iteration >= limit:
            raise RuntimeError(f"no convergence in {limit} supersteps")
    own.release()
    return Result(state.df.select("id", *names), iteration, seconds, state)
