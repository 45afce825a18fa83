"""Exact top-k search by inner product over an impact-ordered index.

Vectors are integers. A shard of up to ``shard_rows`` of them is indexed by
its postings (vector, dimension, value), cut into segments of one quantised
impact, the magnitude of the value rounded up to a power of two, and stored
from the highest impact down. With each segment goes what is then left of
every vector, as the length of its remaining part. A block of queries is
answered score at a time: segments are added to the accumulators by descending
impact. What a vector has not shown yet is at most the length of the query
times the length of what is left of it, so after every segment, from the first
on, there is a lower and an upper bound of each score. Processing stops only
when the bounds, and the exact scores of the shards before, prove that few
vectors can still be members; those are rescored exactly. If nothing can be
proved early, the segments run out, and the accumulators are the scores.

Shards are built where the rows are, without a shuffle, and stored in the
shared folder. Queries are broadcast in blocks of a fixed size; each task
keeps the best k of a query over all its shards before anything is shuffled.

Defined cases: vectors that are null, or have a null or non-finite component,
take no part, nor do rows of a null id; vectors meet only vectors of their
length; a query's own row is left out, other rows of its id are not; ties go
to the smaller id. Nothing saturates: a scaled component or a score of the
result that does not fit into 64 bits is an error.
"""

from __future__ import annotations

from collections.abc import Iterator
from heapq import nsmallest

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .util import materialize, prepare_python

INDEX = "dims int, n int, ids binary, rows binary, counts binary, rests binary, docs binary, columns binary, values binary"
HITS = "query_row long, query_id long, vec_id long, score long"


def scaled(vectors: DataFrame, factor: int = 256, *, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(row, vec_id, v): floor(factor * x) of each component; the rows that take part, numbered and stored."""
    x = F.col(vector_col).cast("array<double>")
    sound = x.isNotNull() & (F.size(x) > 0) & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    v = F.transform(x, lambda c: F.when(F.abs(c * factor) < 2.0**63, F.floor(c * factor)).otherwise(
        F.raise_error(F.lit("a scaled component does not fit into 64 bits")).cast("long")))
    rows = vectors.where(F.col(id_col).isNotNull() & sound).select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v"))
    return materialize(rows.withColumn("row", F.monotonically_increasing_id()), "topk-vectors")


def _shard(ids: list[int], rows: list[int], m: np.ndarray) -> tuple:
    doc, column = np.nonzero(m)
    value = m[doc, column]
    impact = np.frexp(np.abs(value.astype(np.float64)))[1]
    order = np.argsort(-impact, kind="stable")
    _, counts = np.unique(-impact, return_counts=True)
    doc, column, value = doc[order], column[order], value[order]
    # The squares of what is left of each vector, after each segment.
    rests, ends = np.zeros((len(counts), len(m))), np.cumsum(counts)
    for s in range(len(counts) - 1, 0, -1):
        part = slice(ends[s - 1], ends[s])
        rests[s - 1] = rests[s] + np.bincount(doc[part], value[part].astype(np.float64) ** 2, len(m))
    return (m.shape[1], len(m), np.array(ids, "<i8").tobytes(), np.array(rows, "<i8").tobytes(), counts.astype("<i4").tobytes(),
            np.sqrt(rests).astype("<f8").tobytes(), doc.astype("<i4").tobytes(), column.astype("<i4").tobytes(), value.astype("<i8").tobytes())


def build_index(vectors: DataFrame, *, shard_rows: int = 8192) -> DataFrame:
    """The stored index of scaled() vectors, one row per shard."""
    columns = [c.split()[0] for c in INDEX.split(", ")]
    prepare_python(vectors.sparkSession)

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        open_: dict[int, list] = {}
        made = lambda held: pd.DataFrame([_shard([x[0] for x in held], [x[1] for x in held], np.array([x[2] for x in held], np.int64))], columns=columns)
        for pdf in batches:
            for r, i, v in zip(pdf["row"], pdf["vec_id"], pdf["v"]):
                held = open_.setdefault(len(v), [])
                held.append((i, r, v))
                if len(held) == shard_rows:
                    yield made(held)
                    held.clear()
        for held in open_.values():
            if held:
                yield made(held)

    return materialize(vectors.select("row", "vec_id", "v").mapInPandas(build, INDEX), "topk-index")


class _Shard:
    """A shard as read, ready for any number of query batches."""

    def __init__(self, stored):
        take = lambda x, kind: np.frombuffer(x, kind)
        self.n, self.dims = stored.n, stored.dims
        self.ids, self.rows = take(stored.ids, "<i8"), take(stored.rows, "<i8")
        counts = take(stored.counts, "<i4")
        self.rests = take(stored.rests, "<f8").reshape(len(counts), self.n)
        doc, column, value = take(stored.docs, "<i4"), take(stored.columns, "<i4"), take(stored.values, "<i8")
        self.full = np.zeros((self.n, self.dims), np.int64)
        self.full[doc, column] = value
        self.largest = max(map(abs, (int(value.max(initial=0)), int(value.min(initial=0)))))
        self.place = {int(r): p for p, r in enumerate(self.rows)}
        # Each segment as its vectors and their rows of it; the highest impacts are those of few vectors.
        self.segments, ends = [], np.cumsum(counts)
        for s, end in enumerate(ends):
            part = slice(end - counts[s], end)
            own, at = np.unique(doc[part], return_inverse=True)
            self.segments.append((own, at, column[part], value[part]))

    def segment(self, s: int, kind) -> tuple[np.ndarray, np.ndarray]:
        own, at, column, value = self.segments[s]
        block = np.zeros((len(own), self.dims), kind)
        block[at, column] = value
        return own, block

    def possible(self, queries: np.ndarray, query_rows: np.ndarray, k: int, least: np.ndarray, share: float) -> tuple[np.ndarray, int]:
        """Which vectors can be among the best k of this shard and reach ``least``, for each query; and the segments read."""
        biggest = float(np.abs(queries.astype(np.float64)).max(initial=0)) * self.largest * self.dims
        kind = np.float32 if biggest < 1 << 23 else np.float64
        q = queries.T.astype(kind)
        length = np.sqrt((queries.astype(np.float64) ** 2).sum(1))
        score = np.zeros((self.n, len(queries)), kind)
        own = [(self.place[int(r)], j) for j, r in enumerate(query_rows) if int(r) in self.place]
        found, read = np.ones(score.shape, bool), 0
        for s in range(len(self.segments)):
            at, block = self.segment(s, kind)
            if len(at) == self.n:
                score += block @ q
            else:
                score[at] += block @ q
            read = s + 1
            # A hair more than the bound, for rounding; integers below 2^23 and 2^52 are exact.
            rest = (np.outer(self.rests[s] * 1.0001, length) + (biggest * 1e-9 if biggest >= 1 << 52 else 0)).astype(kind)
            low = score - rest
            for p, j in own:
                low[p, j] = -np.inf
            if self.n > k and not np.isfinite(least).all():
                floor = np.maximum(np.partition(low, self.n - k, axis=0)[self.n - k], least.astype(kind))
            else:
                floor = least.astype(kind)
            found = score + rest >= floor
            if found.mean() <= share:
                break
        for p, j in own:
            found[p, j] = False
        return found, read

    def scores(self, at: np.ndarray, query: np.ndarray) -> list[int]:
        """The exact inner products."""
        if float(np.abs(query.astype(np.float64)).max(initial=0)) * self.largest * self.dims < 2.0**62:
            return (self.full[at] @ query).tolist()
        exact = (self.full[at].astype(object) * query.astype(object)).sum(1).tolist() if len(at) else []
        return [int(x) for x in exact]


def search(index: DataFrame, queries: DataFrame, k: int = 5, *, block: int = 16_384, step: int = 256, share: float = 1 / 64) -> DataFrame:
    """(query_id, rank, vec_id, score): the best k of the index for every row of ``queries`` (row, vec_id, v).

    Queries go out in blocks of about ``block``, each answered and released before the next, so a broadcast has a fixed
    bound; ``step`` queries share an accumulator pass. Segments are read until at most ``share`` of a shard's vectors can
    be members.
    """
    spark = index.sparkSession
    total = queries.count()
    blocks = max(1, -(-total // block))
    found = None
    for b in range(blocks):
        part = queries if blocks == 1 else queries.where(F.pmod(F.xxhash64("row"), F.lit(blocks)) == b)
        rows = sorted((r["row"], r["vec_id"], r["v"]) for r in part.select("row", "vec_id", "v").collect())
        sent = spark.sparkContext.broadcast(rows)

        def answer(batches: Iterator[pd.DataFrame], sent=sent) -> Iterator[pd.DataFrame]:
            by: dict[int, list] = {}
            for r in sent.value:
                by.setdefault(len(r[2]), []).append(r)
            sets = {d: [(np.array([r[0] for r in rs[a : a + step]], np.int64), np.array([r[2] for r in rs[a : a + step]], np.int64))
                        for a in range(0, len(rs), step)] for d, rs in by.items()}
            best: dict[int, list[tuple[int, int]]] = {}
            for pdf in batches:
                for stored in pdf.itertuples():
                    if stored.dims not in sets:
                        continue
                    shard = _Shard(stored)
                    for rows, q in sets[stored.dims]:
                        least = np.array([-float(best[r][-1][0]) if len(best.get(r, ())) == k else -np.inf for r in rows.tolist()])
                        least = np.where(np.isfinite(least), least - np.abs(least) * 1e-12, least)
                        found, _ = shard.possible(q, rows, k, least, share)
                        for j, r in enumerate(rows.tolist()):
                            at = np.flatnonzero(found[:, j])
                            new = zip((-s for s in shard.scores(at, q[j])), shard.ids[at].tolist())
                            best[r] = nsmallest(k, (*best.get(r, ()), *new))
            name = {r[0]: r[1] for r in sent.value}
            hits = [(r, name[r], i, -s) for r, own in best.items() for s, i in own]
            if any(abs(h[3]) >= 1 << 63 for h in hits):
                raise OverflowError("a score does not fit into 64 bits")
            yield pd.DataFrame(hits, columns=["query_row", "query_id", "vec_id", "score"])

        hits = materialize(index.mapInPandas(answer, HITS), "topk-hits")
        sent.destroy()
        found = hits if found is None else found.unionByName(hits)
    order = Window.partitionBy("query_row").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
