"""The graph, the vertex program, and the superstep plan that evaluates one on the other."""
