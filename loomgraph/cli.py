"""python -m loomgraph.cli deg|pr|bfs|sssp|cc FILE NUM_VERTICES [ITERATIONS|ROOT], or convert IN OUT ..."""

from __future__ import annotations

import argparse
import sys
import time

from .operators import algorithms as A
from .operators import report
from .plans.graph import Graph
from .session import session
from .sources.edge_files import convert

#: Flags of the graph that each algorithm is defined on.
FLAGS: dict[str, dict] = {
    "deg": {},
    "pr": {},
    "bfs": {"directed": False, "self_loops": False, "parallel_edges": False},
    "sssp": {"self_loops": False, "parallel_edges": False},
    "cc": {"directed": False, "parallel_edges": False},
}


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="loomgraph")
    commands = p.add_subparsers(dest="command", required=True)
    for name in FLAGS:
        c = commands.add_parser(name)
        c.add_argument("file")
        c.add_argument("num_vertices", type=int)
        if name == "pr":
            c.add_argument("iterations", type=int, nargs="?", default=0)
        if name in ("bfs", "sssp"):
            c.add_argument("root", type=int, nargs="?", default=0)
        c.add_argument("--weighted", action="store_true")
    c = commands.add_parser("convert")
    c.add_argument("source")
    c.add_argument("target")
    c.add_argument("--source-format", default="auto", choices=["auto", "text", "binary"])
    c.add_argument("--source-weighted", action="store_true")
    c.add_argument("--target-format", default="text", choices=["text", "binary"])
    c.add_argument("--target-weighted", action="store_true")
    c.add_argument("--offset", type=int, default=0)
    return p


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    spark = session()
    if a.command == "convert":
        done = convert(spark, a.source, a.target, source_format=a.source_format, source_weighted=a.source_weighted, target_format=a.target_format,
                       target_weighted=a.target_weighted, offset=a.offset)
        print(" ".join(f"{k}={v}" for k, v in done.items()))
        return 0
    began = time.perf_counter()
    graph = Graph.load(spark, a.file, a.num_vertices, weighted=a.weighted, **FLAGS[a.command])
    iterations, seconds = 1, []
    if a.command == "deg":
        state = A.degree(graph)
    else:
        result = (A.pagerank(graph, a.iterations) if a.command == "pr" else A.bfs(graph, a.root) if a.command == "bfs"
                  else A.sssp(graph, a.root) if a.command == "sssp" else A.connected_components(graph))
        state, iterations, seconds = result.state, result.iterations, result.seconds
    total = report.checksum(state).first()
    print(f"Execute time: {time.perf_counter() - began:.3f}")
    print(f"Supersteps: {report.timing(seconds)}")
    print(f"Number of iterations: {iterations}")
    print(f"Value checksum: {total['checksum']}")
    print(f"Reachable vertices: {total['reachable']}")
    for row in report.display(state).collect():
        print(row["shown"])
    return 0


if __name__ == "__main__":
    sys.exit(main())
