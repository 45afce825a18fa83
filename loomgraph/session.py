"""Session defaults."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(app: str = "loomgraph", master: str | None = None, shuffle_partitions: int | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution and skewed-join splitting on. Memory, master and the shared folder
    (``spark.checkpoint.dir``) are the cluster's to say; arguments here are for machines without a cluster."""
    builder = (SparkSession.builder.appName(app)
               .config("spark.sql.adaptive.enabled", "true")
               .config("spark.sql.adaptive.skewJoin.enabled", "true")
               .config("spark.sql.session.timeZone", "UTC"))
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
