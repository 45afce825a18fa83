"""Tables that cut lineage, stored where every executor can read them."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; where none is set, on one machine, a new temporary one. On a cluster that
    would be another folder for every executor, so there it is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("loomgraph.store", None)
    if not found and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not found:
        found = "file://" + tempfile.mkdtemp(prefix="loomgraph-")
        spark.conf.set("loomgraph.store", found)
    return found.rstrip("/")


class Stored:
    """A written table. It survives lost executors, and its plan is one scan whatever it was made from."""

    def __init__(self, df: DataFrame, name: str):
        self.spark = df.sparkSession
        self.path = f"{shared_dir(self.spark)}/{name}-{uuid.uuid4().hex}"
        df.write.parquet(self.path)
        self.df = self.spark.read.schema(df.schema).parquet(self.path)

    def drop(self) -> None:
        """Delete the files. No plan that still reads the table may run afterwards."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)
