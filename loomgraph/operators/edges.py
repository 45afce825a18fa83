"""Edge normalisation: the order of the steps is part of their meaning.

Drop self loops, orient upwards, transpose, hash ids, check the domain, add
reversed copies, drop parallel edges. All but the last are one projection.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class EdgeOptions:
    directed: bool = True
    transpose: bool = False
    self_loops: bool = True
    acyclic: bool = False
    parallel_edges: bool = True


def normalize(edges: DataFrame, options: EdgeOptions = EdgeOptions(), *, num_vertices: int | None = None, hasher=None) -> DataFrame:
    """(src, dst[, weight]) as the options say. Parallel edges keep the smallest weight. An id outside 0 .. num_vertices is an error; edges with a null id are left out."""
    weight = ["weight"] if "weight" in edges.columns else []
    df = edges.where("src is not null and dst is not null")
    if not options.self_loops:
        df = df.where("src <> dst")
    if options.acyclic:
        df = df.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), *weight)
    if options.transpose:
        df = df.select(F.col("dst").alias("src"), F.col("src").alias("dst"), *weight)
    if num_vertices is not None:
        def inside(c):
            # The test may run before a filter of nulls, so it lets them by.
            return F.when(F.col(c).between(0, num_vertices) | F.col(c).isNull(), F.col(c)).otherwise(
                F.raise_error(F.concat(F.lit(f"vertex id outside 0..{num_vertices}: "), F.col(c).cast("string"))).cast("long"))

        df = df.select(inside("src").alias("src"), inside("dst").alias("dst"), *weight)
    if hasher is not None:
        df = df.select(hasher.hash(F.col("src")).alias("src"), hasher.hash(F.col("dst")).alias("dst"), *weight)
    if not options.directed:
        # One pass over the source: each edge is made two, instead of a union of two scans.
        ends = F.array(F.struct(F.col("src").alias("src"), F.col("dst").alias("dst")), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst")))
        df = df.select(F.explode(ends).alias("e"), *weight).select("e.src", "e.dst", *weight)
    if not options.parallel_edges:
        df = df.groupBy("src", "dst").agg(F.min("weight").alias("weight")) if weight else df.distinct()
    return df


def vertex_classes(edges: DataFrame, num_vertices: int) -> DataFrame:
    """(id, class) of every vertex of the domain: regular (sends and receives: in both columns), source (src only), sink (dst only), isolated."""
    spark = edges.sparkSession
    seen = (edges.select(F.explode(F.array(F.struct(F.col("src").alias("id"), F.lit(1).alias("side")), F.struct(F.col("dst").alias("id"), F.lit(2).alias("side")))).alias("v"))
            .groupBy("v.id").agg(F.bit_or("v.side").alias("sides")))
    return spark.range(num_vertices + 1).join(seen, "id", "left").select("id", F.when(F.col("sides") == 3, "regular").when(
        F.col("sides") == 1, "source").when(F.col("sides") == 2, "sink").otherwise("isolated").alias("class"))


def compact_index(edges: DataFrame, column: str, height: int) -> DataFrame:
    """(id, segment, index): the dense numbering, within segments of ``height`` ids, of the ids that occur in ``column``."""
    from pyspark.sql import Window

    ids = edges.select(F.col(column).alias("id")).distinct().withColumn("segment", F.call_function("div", F.col("id"), F.lit(height)))
    return ids.withColumn("index", (F.row_number().over(Window.partitionBy("segment").orderBy("id")) - 1).cast("long"))
