"""Text edge lists as a stream of files, and the running degree of what has arrived."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.edge_files import parse_text


def stream_edges(spark: SparkSession, folder: str, *, weighted: bool = False, mode: str = "FAILFAST") -> DataFrame:
    """A streaming (src, dst[, weight]) over the text files that appear in a folder; the lines' rules are those of read_text."""
    return parse_text(spark.readStream.text(folder), weighted=weighted, mode=mode)


def running_degree(edges: DataFrame, ordering: str = "row") -> DataFrame:
    """(id, degree) so far, for output modes update and complete. The state is one count per vertex that has an edge."""
    return edges.groupBy(F.col("src" if ordering == "row" else "dst").alias("id")).agg((F.sum("weight") if "weight" in edges.columns else F.count(F.lit(1))).alias("degree"))
