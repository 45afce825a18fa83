"""Edge lists in files: text ("row col [weight]" lines) and packed little-endian uint32 records."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: Bytes of a packed record without and with a weight.
RECORD = {False: 8, True: 12}


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())


def _files(spark: SparkSession, path: str) -> list:
    """The data files under a path or glob, as file statuses."""
    p, fs = _fs(spark, path)
    found = fs.globStatus(p)
    if not found:
        raise FileNotFoundError(f"no such edge list: {path}")
    out, todo = [], list(found)
    while todo:
        s = todo.pop()
        if s.getPath().getName().startswith(("_", ".")):
            continue
        todo.extend(fs.listStatus(s.getPath())) if s.isDirectory() else out.append(s)
    return out


def sniff(spark: SparkSession, path: str) -> str:
    """"text" or "binary", by the first bytes of the first file that has any."""
    for s in sorted(_files(spark, path), key=lambda s: s.getPath().toString()):
        if s.getLen():
            _, fs = _fs(spark, s.getPath().toString())
            stream = fs.open(s.getPath())
            try:
                head = bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream, min(4096, s.getLen())))
            finally:
                stream.close()
            return "text" if all(b in (9, 10, 13) or 32 <= b < 127 for b in head) else "binary"
    return "text"


def read_edges(spark: SparkSession, path: str, *, fmt: str = "auto", weighted: bool = False, mode: str = "FAILFAST") -> DataFrame:
    """(src, dst[, weight]) as longs."""
    fmt = sniff(spark, path) if fmt == "auto" else fmt
    if fmt == "text":
        return read_text(spark, path, weighted=weighted, mode=mode)
    if fmt == "binary":
        return read_binary(spark, path, weighted=weighted)
    raise ValueError(f"unknown format {fmt!r}")


def read_text(spark: SparkSession, path: str, *, weighted: bool = False, mode: str = "FAILFAST") -> DataFrame:
    return parse_text(spark.read.text(path), weighted=weighted, mode=mode)


def parse_text(lines: DataFrame, *, weighted: bool = False, mode: str = "FAILFAST") -> DataFrame:
    """Lines (column value) to edges. Empty lines and lines starting with # or % are skipped wherever they are; any other line must
    be two (weighted: three) numbers with one blank between, or it is an error (mode DROPMALFORMED: it is dropped)."""
    if mode not in ("FAILFAST", "DROPMALFORMED"):
        raise ValueError(f"unknown mode {mode!r}")
    n = 3 if weighted else 2
    good = F.col("value").rlike(r"^\d{1,18}( \d{1,18}){%d}$" % (n - 1))
    rows = lines.where("value <> '' and not startswith(value, '#') and not startswith(value, '%')")
    rows = rows.where(good) if mode == "DROPMALFORMED" else rows.select(
        F.when(good, F.col("value")).otherwise(F.raise_error(F.concat(F.lit(f"an edge line must have {n} numbers: "), "value")).cast("string")).alias("value"))
    parts = F.split("value", " ")
    return rows.select(*[parts[k].cast("long").alias(c) for k, c in enumerate(("src", "dst", "weight")[:n])])


def read_binary(spark: SparkSession, path: str, *, weighted: bool = False) -> DataFrame:
    """Fixed-length records through Hadoop's splittable reader, unpacked by expressions. A partial record is an error."""
    size = RECORD[weighted]
    for s in _files(spark, path):
        if s.getLen() % size:
            raise ValueError(f"{s.getPath()} has {s.getLen()} bytes, which is no multiple of {size}")
    context = spark.sparkContext._jsc.sc()
    records = context.binaryRecords(path, size, context.hadoopConfiguration())
    frame = spark._jsparkSession.createDataset(records, spark._jvm.org.apache.spark.sql.Encoders.BINARY()).toDF()
    raw = DataFrame(frame, spark).toDF("value")

    def number(k: int):
        # Bytes in reverse order as one hex number.
        digits = F.concat(*[F.hex(F.substring("value", 4 * k + b + 1, 1)) for b in (3, 2, 1, 0)])
        return F.conv(digits, 16, 10).cast("long")

    return raw.select(*[number(k).alias(c) for k, c in enumerate(("src", "dst", "weight")[: size // 4])])


def reconciled(edges: DataFrame, expected: int) -> DataFrame:
    """The edges, once their number is what was expected; else an error."""
    found = edges.count()
    if found != expected:
        raise ValueError(f"{found} edges were read, {expected} expected")
    return edges


def write_text(edges: DataFrame, path: str) -> None:
    edges.select(F.concat_ws(" ", *_columns(edges)).alias("value")).write.text(path)


def write_binary(edges: DataFrame, path: str) -> None:
    """Part files of packed records, each written by the task that has the rows. The folder must be mounted on every executor
    (file paths only): Spark has no writer of bare bytes."""
    import os
    import uuid
    from urllib.parse import urlparse

    where = urlparse(path)
    if where.scheme not in ("", "file"):
        raise ValueError("packed records can be written to mounted folders only")
    folder = where.path
    os.makedirs(folder)

    def write(batches):
        import numpy as np
        import pandas as pd

        name, n = f"part-{uuid.uuid4().hex}", 0
        with open(os.path.join(folder, f".{name}"), "wb") as f:
            for pdf in batches:
                values = pdf.to_numpy()
                if values.size and (values.min() < 0 or values.max() >= 1 << 32):
                    raise ValueError("a value does not fit 32 bits")
                f.write(np.ascontiguousarray(values, dtype="<u4").tobytes())
                n += len(pdf)
        # A retried task leaves its first try hidden, which readers skip.
        os.replace(os.path.join(folder, f".{name}"), os.path.join(folder, name))
        yield pd.DataFrame({"file": [name], "n": [n]})

    done = edges.select(*[F.col(c).cast("long") for c in _columns(edges)]).mapInPandas(write, "file string, n long").collect()
    # Only files of tasks that were reported stay; a lost executor's were written again under another name.
    kept = {r["file"] for r in done}
    for f in os.listdir(folder):
        if f not in kept:
            os.remove(os.path.join(folder, f))


def _columns(edges: DataFrame) -> list[str]:
    return ["src", "dst", *(["weight"] if "weight" in edges.columns else [])]


# --- converter ----------------------------------------------------------------------------------------------------

#: Largest weight that is made up for unweighted edges.
MAX_WEIGHT = 128


def displace(edges: DataFrame, offset: int) -> DataFrame:
    """Both ids plus offset."""
    return edges.withColumn("src", F.col("src") + offset).withColumn("dst", F.col("dst") + offset)


def with_weights(edges: DataFrame, seed: int = 0) -> DataFrame:
    """Weights of 1 .. 128 that depend on the edge and the seed only."""
    return edges.withColumn("weight", F.pmod(F.xxhash64("src", "dst", F.lit(seed)), F.lit(MAX_WEIGHT)) + 1)


def convert(spark: SparkSession, source: str, target: str, *, source_format: str = "auto", source_weighted: bool = False, target_format: str = "text",
            target_weighted: bool = False, offset: int = 0, seed: int = 0) -> dict[str, int]:
    """Read one format, write another; weights are made up or dropped as needed. Returns comments, max_id, edges and lines."""
    source_format = sniff(spark, source) if source_format == "auto" else source_format
    # Counted on the way to the target, in the one pass that there is.
    marks, found = Observation(), Observation()
    if source_format == "text":
        comment = F.count_if(F.col("value").startswith("#") | F.col("value").startswith("%"))
        edges = parse_text(spark.read.text(source).observe(marks, comment.alias("comments")), weighted=source_weighted)
    else:
        edges = read_edges(spark, source, fmt=source_format, weighted=source_weighted)
    edges = displace(edges, offset) if offset else edges
    if target_weighted and not source_weighted:
        edges = with_weights(edges, seed)
    if not target_weighted:
        edges = edges.select("src", "dst")
    edges = edges.observe(found, F.coalesce(F.max(F.greatest("src", "dst")), F.lit(0)).alias("max_id"), F.count(F.lit(1)).alias("edges"))
    {"text": write_text, "binary": write_binary}[target_format](edges, target)
    out, comments = found.get, marks.get["comments"] if source_format == "text" else 0
    return {"comments": comments, "max_id": out["max_id"], "edges": out["edges"], "lines": out["edges"] + comments}


def stats(edges: DataFrame) -> DataFrame:
    """(max_id, edges) in one row."""
    return edges.agg(F.coalesce(F.max(F.greatest("src", "dst")), F.lit(0)).alias("max_id"), F.count(F.lit(1)).alias("edges"))
