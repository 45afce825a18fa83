"""Two-dimensional tiles of the adjacency matrix: who would own which, for diagnostics.

Spark deals rows by hash, so placement decides nothing here; the formulas are
kept because reports and their properties are part of the analytics.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import gcd, isqrt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def factors(n: int) -> tuple[int, int]:
    """The pair (a, b) with a * b = n and a <= b that is nearest to square."""
    if n < 1:
        raise ValueError("n must be positive")
    a = next(a for a in range(isqrt(n), 0, -1) if n % a == 0)
    return a, n // a


@dataclass(frozen=True)
class Tiling:
    """A grid of ranks * threads row groups by as many column groups over ids 0 .. num_vertices."""

    ranks: int
    threads: int
    num_vertices: int = 0

    @property
    def groups(self) -> int:
        return self.ranks * self.threads

    @property
    def height(self) -> int:
        """Ids per group; the domain is padded to a multiple of the groups."""
        return -(-(self.num_vertices + 1) // self.groups)

    def group(self, v: Column) -> Column:
        return F.call_function("div", v, F.lit(self.height))

    def owner(self, i: Column, j: Column) -> Column:
        """The global thread that owns tile (i, j), staggered so that each diagonal meets every owner."""
        across = factors(self.ranks)[0]
        down = self.groups // across
        step = self.groups // gcd(across, down)
        return ((i % down * across + j % across + F.call_function("div", i, F.lit(step)) * (self.groups // down)) % self.groups).cast("long")

    def rank(self, i: Column, j: Column) -> Column:
        return self.owner(i, j) % self.ranks

    def thread(self, i: Column, j: Column) -> Column:
        return F.call_function("div", self.owner(i, j), F.lit(self.ranks))

    def placement(self, spark: SparkSession) -> DataFrame:
        """(row_group, col_group, owner, rank, thread) of every tile."""
        cells = spark.range(self.groups * self.groups).select(
            F.call_function("div", F.col("id"), F.lit(self.groups)).alias("row_group"), (F.col("id") % self.groups).alias("col_group"))
        i, j = F.col("row_group"), F.col("col_group")
        return cells.select(i, j, self.owner(i, j).alias("owner"), self.rank(i, j).alias("rank"), self.thread(i, j).alias("thread"))
