"""The graph: normalised edges over the vertex domain 0 .. num_vertices."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.hashing import hasher as make_hasher
from ..operators.edges import EdgeOptions, normalize, vertex_classes
from ..storage import Stored


#: The column that spreads a hot sender's edges, and the number of edges below which no sender is hot.
SALT, LEAST_SHARE = "__salt", 10_000


class Dealt:
    """Edges by sender, and what brings messages to them."""

    def __init__(self, edges: DataFrame, sender: str, hot: DataFrame | None):
        self.edges, self.sender, self.hot = edges, sender, hot

    def meet(self, messages: DataFrame) -> DataFrame:
        """Each edge with the message (id, msg) of its sender; messages of hot senders go to each of their partitions."""
        sent = messages.select(F.col("id").alias(self.sender), "msg")
        if self.hot is None:
            return self.edges.join(sent, self.sender)
        sent = sent.join(F.broadcast(self.hot.withColumnRenamed("id", self.sender)), self.sender, "left").select(
            self.sender, "msg", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("parts", F.lit(1)) - 1)).alias(SALT))
        return self.edges.join(sent, [self.sender, SALT])


class Graph:
    """An edge (src, dst) is an entry of row src and column dst: columns send, rows receive.

    Nothing is read until an algorithm runs. ``prepare`` stores the normalised edges once, for algorithms of many
    supersteps; each superstep then shuffles messages and partial results, never the edges.
    """

    def __init__(self, edges: DataFrame, num_vertices: int, options: EdgeOptions = EdgeOptions(), hasher=None):
        self.edges, self.num_vertices, self.options, self.hasher = edges, num_vertices, options, hasher
        self.weighted = "weight" in edges.columns
        self._held: list = []

    @property
    def spark(self) -> SparkSession:
        return self.edges.sparkSession

    @classmethod
    def from_edges(cls, df: DataFrame, src: str = "src", dst: str = "dst", weight: str | None = None, num_vertices: int | None = None,
                   hashing: str = "none", buckets: int = 8, **flags: bool) -> Graph:
        """flags: directed, transpose, self_loops, acyclic, parallel_edges. Without num_vertices the largest id is looked up."""
        options = EdgeOptions(**flags)
        edges = df.select(F.col(src).cast("long").alias("src"), F.col(dst).cast("long").alias("dst"), *([F.col(weight).cast("long").alias("weight")] if weight else []))
        if num_vertices is None:
            num_vertices = edges.agg(F.max(F.greatest("src", "dst"))).first()[0] or 0
        own = None if hashing == "none" else make_hasher(hashing, num_vertices + 1, buckets)
        return cls(normalize(edges, options, num_vertices=num_vertices, hasher=own), num_vertices, options, own)

    @classmethod
    def load(cls, spark: SparkSession, path: str, num_vertices: int | None = None, *, fmt: str = "auto", weighted: bool = False, mode: str = "FAILFAST",
             expected_edges: int | None = None, **flags) -> Graph:
        """From a text or binary edge list; fmt "auto" looks at the first bytes. expected_edges: another number of records is an error."""
        from ..sources.edge_files import read_edges, reconciled

        edges = read_edges(spark, path, fmt=fmt, weighted=weighted, mode=mode)
        if expected_edges is not None:
            edges = reconciled(edges, expected_edges)
        return cls.from_edges(edges, weight="weight" if weighted else None, num_vertices=num_vertices, **flags)

    def original(self, state: DataFrame, *columns: str) -> DataFrame:
        """A result with the ids of before hashing, in ``id`` and further columns that hold ids (parent, label)."""
        if self.hasher is None:
            return state
        return state.withColumns({c: self.hasher.unhash(F.col(c)) for c in ("id", *columns)})

    def vertices(self) -> DataFrame:
        return self.spark.range(self.num_vertices + 1)

    def classes(self) -> DataFrame:
        return vertex_classes(self.edges, self.num_vertices)

    def prepare(self) -> Graph:
        """This graph with its edges stored. The caller's graph stays as it is; of stored edges no second copy is made."""
        if any(isinstance(x, Stored) for x in self._held):
            return Graph(self.edges, self.num_vertices, self.options, self.hasher)
        stored = Stored(self.edges, "edges")
        out = Graph(stored.df, self.num_vertices, self.options, self.hasher)
        out._held.append(stored)
        return out

    def dealt(self, column: str) -> Dealt:
        """The edges dealt and sorted by the sending column and held in executors (spilling to disk), so that joins with messages
        move only messages. Senders with more edges than a partition's fair share are dealt over several partitions."""
        n = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        counts = self.edges.groupBy(F.col(column).alias("id")).agg(F.count(F.lit(1)).alias("n"))
        fair = max(LEAST_SHARE, -(-(self.edges.count()) // n))
        # Fewer than n vertices can have more than an n-th of the edges.
        hot = [(r["id"], -(-r["n"] // fair)) for r in counts.where(F.col("n") > fair).collect()]
        if not hot:
            held, table = self.edges.repartition(n, column).sortWithinPartitions(column), None
        else:
            table = self.spark.createDataFrame(hot, "id long, parts long")
            salted = self.edges.join(F.broadcast(table.withColumnRenamed("id", column)), column, "left").withColumn(
                SALT, F.pmod(F.xxhash64("src", "dst"), F.coalesce("parts", F.lit(1)))).drop("parts")
            held = salted.repartition(n, column, SALT).sortWithinPartitions(column, SALT)
        held = held.persist()
        self._held.append(held)
        return Dealt(held, column, table)

    def release(self) -> None:
        """Give back what prepare() and dealt() hold."""
        for x in self._held:
            x.drop() if isinstance(x, Stored) else x.unpersist()
        self._held.clear()
