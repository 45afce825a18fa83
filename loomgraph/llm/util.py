"""Shared helpers: durable intermediate tables and small column utilities."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from ``spark.checkpoint.dir``.

    Only where the session names none, on one machine, a temporary folder is
    made and remembered in the session. On a cluster each executor would write
    to its own disk, so there it is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("loomgraph.shared.dir", None)
    if not found and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not found:
        found = "file://" + tempfile.mkdtemp(prefix="loomgraph-")
        spark.conf.set("loomgraph.shared.dir", found)
    return found.rstrip("/")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back.

    This cuts lineage: a lost executor costs a re-read, never a recomputation
    of what came before. Unlike a local checkpoint the copy survives executors.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    # The schema is given, so that reading back costs no inference job.
    out = spark.read.schema(df.schema).parquet(path)
    out._loom_path = path
    return out


def discard(*tables: DataFrame | None) -> None:
    """Delete tables made by materialize() that no later plan reads."""
    for df in tables:
        path = getattr(df, "_loom_path", None)
        if path is None:
            continue
        jvm = df.sparkSession._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(target, True)
        df._loom_path = None


_HELD: dict = {}


def held(key, make):
    """What a Python worker keeps from task to task: one object, of the operator that runs. The next operator's replaces it,
    so what earlier stages remembered does not add up."""
    if key not in _HELD:
        _HELD.clear()
        _HELD[key] = make()
    return _HELD[key]


#: Ids that are broadcast at most; beyond, the join shuffles.
MAX_IDS = 1_000_000


def small(ids: DataFrame, bound: int = MAX_IDS) -> DataFrame:
    """A stored table of ids, marked for broadcast if it has at most ``bound`` rows."""
    return F.broadcast(ids) if ids.limit(bound + 1).count() <= bound else ids


def prepare_python(spark: SparkSession, rows: int = 1000) -> None:
    """For operators with Python code: the package goes to the workers once per application, which need not have it installed,
    and whole texts go to them in batches of ``rows``, where the session has Spark's default of ten times that."""
    context = spark.sparkContext
    if getattr(context, "_loomgraph_shipped", None) is None:
        package = Path(__file__).resolve().parent.parent
        target = Path(tempfile.mkdtemp(prefix="loomgraph-")) / f"{package.name}-code.zip"
        with zipfile.ZipFile(target, "w") as z:
            for f in sorted(package.rglob("*.py")):
                z.write(f, f"{package.name}/{f.relative_to(package)}")
        context.addPyFile(str(target))
        context._loomgraph_shipped = True
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, str(rows))


def crc32_mod(id_col: Column, mod: int) -> Column:
    """crc32 of the id written as text, modulo mod (the fold of a row)."""
    return F.crc32(id_col.cast("string").cast("binary")) % F.lit(mod)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
