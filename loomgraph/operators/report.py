"""What is shown of a result: checksum, first vertices, timings, balance."""

from __future__ import annotations

from statistics import fmean, pstdev

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: How each result column set is written, longest first.
_SHOWN = (
    (("rank", "degree"), lambda: F.concat(F.lit("Rank="), F.format_string("%.6f", "rank"), F.lit(",Degree="), F.col("degree"))),
    (("hops", "parent"), lambda: F.concat(F.lit("Parent="), F.coalesce(F.col("parent").cast("string"), F.lit("0")), F.lit(",Hops="), F.coalesce(F.col("hops").cast("string"), F.lit("INF")))),
    (("distance",), lambda: F.concat(F.lit("Distance="), F.coalesce(F.col("distance").cast("string"), F.lit("INF")))),
    (("label",), lambda: F.concat(F.lit("Label="), F.col("label"))),
    (("degree",), lambda: F.concat(F.lit("Degree="), F.col("degree"))),
)
#: The value that a checksum is over, and the one that it leaves out (null always is).
_SUMMED = {"rank": 0, "hops": None, "distance": None, "label": None, "degree": 0}


def rendered(state: DataFrame) -> Column:
    for names, show in _SHOWN:
        if set(names) <= set(state.columns):
            return show()
    raise ValueError(f"no way to show {state.columns}")


def checksum(state: DataFrame, value: str | None = None) -> DataFrame:
    """(checksum, reachable): the sum of the whole parts of the values, and how many there are; nulls and, for degree and rank, zeros are left out."""
    value = value or next(v for v in _SUMMED if v in state.columns)
    left_out = _SUMMED.get(value)
    kept = state.where(F.col(value).isNotNull() if left_out is None else F.col(value) != left_out)
    return kept.agg(F.coalesce(F.sum(F.floor(value).cast("long")), F.lit(0)).alias("checksum"), F.count(F.lit(1)).alias("reachable"))


def display(state: DataFrame, count: int = 31) -> DataFrame:
    """(id, shown) of the first vertices by id."""
    return state.select("id", F.concat(F.lit("vertex["), F.col("id"), F.lit("]:"), rendered(state)).alias("shown")).orderBy("id").limit(count)


def timing(seconds: list[float]) -> str:
    """Sum, mean and population standard deviation."""
    return f"{sum(seconds):.3f}: {fmean(seconds):.3f} +/- {pstdev(seconds):.3f}" if seconds else "0"


def balance(edges: DataFrame, groups: int, height: int, column: str = "src", limit: float = 0.2) -> DataFrame:
    """(group, edges, ratio, uneven): edges per group of ids against an even share; groups without edges are counted."""
    spark = edges.sparkSession
    own = edges.groupBy(F.call_function("div", F.col(column), F.lit(height)).alias("group")).agg(F.count(F.lit(1)).alias("edges"))
    every = spark.range(groups).select(F.col("id").alias("group")).join(own, "group", "left").select("group", F.coalesce("edges", F.lit(0)).alias("edges"))
    total = own.agg(F.sum("edges").alias("total"))
    ratio = F.col("edges") * groups / F.col("total")
    # One row of totals.
    return every.join(F.broadcast(total)).select("group", "edges", ratio.alias("ratio"), (F.abs(ratio - 1) > limit).alias("uneven"))


def tile_histogram(edges: DataFrame, height: int) -> DataFrame:
    """(row_group, col_group, edges) of the tiles that have any."""
    return edges.groupBy(F.call_function("div", F.col("src"), F.lit(height)).alias("row_group"), F.call_function("div", F.col("dst"), F.lit(height)).alias("col_group")).agg(
        F.count(F.lit(1)).alias("edges"))
