"""SimHash near-duplicates: pigeonhole blocks, verified by Hamming distance.

A 64-bit fingerprint is the bitwise majority of the 64-bit hashes of a text's
word shingles. With at most ``k`` differing bits, a fingerprint cut into
``k + 2`` blocks leaves two blocks untouched, so close pairs meet on some pair
of blocks. Equal fingerprints are collapsed first: a thousand copies of a text
are one row from there on. Buckets of up to ``pair_bucket`` fingerprints are
joined with themselves and each candidate's distance is checked. Larger
buckets, where all pairs would grow with the square, take an exact way of
linear size: fingerprints within distance 2 share a point at distance at most
1 from both, so each one emits the points around it (over the bits outside the
shared blocks) and is linked with the smallest fingerprint at each point, the
distance being checked again (for distance 1: with the fingerprint that the
point itself is). Links feed connected components.

Defined cases: null and empty texts have fingerprint zero and are linked like
others; a text with fewer words than a shingle is one shingle; ids may repeat
(each row has its result) and a null id is never the component id unless no
other exists.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .util import discard, materialize, prepare_python, small

#: Bytes with A-Z lowered and every ASCII white space made a blank.
_NORM = bytes(b + 32 if 65 <= b <= 90 else 32 if b == 32 or 9 <= b <= 13 else b for b in range(256))
_SLAB = 1 << 16


def fingerprint(text: str | None, shingle: int = 3, seed: int = 42) -> int:
    """Unsigned 64-bit SimHash of the text's word shingles, repeats included."""
    words = text.encode("utf-8", "surrogatepass").translate(_NORM).split() if text else []
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    n = max(1, len(words) - shingle + 1)
    joined = memoryview(b" ".join(words))
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[:n].tolist()
    stops = (ends[shingle - 1 :] if len(words) >= shingle else ends[-1:]).tolist()
    total = np.zeros(64, np.int64)
    for k in range(0, n, _SLAB):
        h = np.array([digest(joined[a:b], seed) for a, b in zip(starts[k : k + _SLAB], stops[k : k + _SLAB])], dtype="<u8")
        bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        total += bits.sum(axis=0, dtype=np.int32)
    return int(np.packbits(total * 2 > n, bitorder="little").view("<u8")[0])


def with_fingerprint(docs: DataFrame, shingle: int = 3, *, text_col: str = "text", out: str = "fp") -> DataFrame:
    """docs with the fingerprint as a signed 64-bit column ``out``."""

    prepare_python(docs.sparkSession)

    @F.pandas_udf("long")
    def simhash(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint(t, shingle) for t in texts], dtype=np.uint64).view(np.int64))

    return docs.withColumn(out, simhash(F.col(text_col)))


def _masks(k: int) -> list[tuple[int, list[int]]]:
    """For every pair of the k + 2 blocks: a mask of its bits, and the bits outside it."""
    cuts = [round(i * 64 / (k + 2)) for i in range(k + 3)]
    out = []
    for pair in combinations(range(k + 2), 2):
        inside = {b for i in pair for b in range(cuts[i], cuts[i + 1])}
        out.append((sum(1 << b for b in inside), [b for b in range(64) if b not in inside]))
    return out


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def links(distinct: DataFrame, k: int = 2, pair_bucket: int = 64) -> DataFrame:
    """Edges (a, b) between distinct fingerprints ``fp``, enough to connect all within distance k <= 2.

    Every edge has a verified distance of at most k, and any two fingerprints within k are connected by edges.
    """
    if k not in (1, 2):
        raise ValueError("k must be 1 or 2")
    masks = _masks(k)
    # Exploding again costs less than storing six rows for each.
    keyed = distinct.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(_signed(m))) for m, _ in masks])).alias("block", "value"))
    buckets = materialize(keyed.groupBy("block", "value").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "simhash-buckets")
    met = keyed.join(buckets, ["block", "value"])
    near = met.where(F.col("n") <= pair_bucket)
    pairs = (near.alias("x").join(near.alias("y"), ["block", "value"])
             .where("x.fp < y.fp").where(f"bit_count(x.fp ^ y.fp) <= {k}")
             .select(F.col("x.fp").alias("a"), F.col("y.fp").alias("b")))
    # Points at distance 0 or 1 over the bits outside the shared blocks.
    flips = F.array(*[F.array(*[F.lit(_signed(1 << b)) for b in free]) for _, free in masks])
    crowd = met.where(F.col("n") > pair_bucket).select("block", "value", "fp", F.explode(F.concat(
        F.array("fp"), F.transform(F.get(flips, F.col("block")), lambda f: F.col("fp").bitwiseXOR(f)))).alias("point"))
    if k == 2:
        heads = crowd.groupBy("block", "point").agg(F.min("fp").alias("head"), F.max("fp").alias("tail")).where("head < tail").select("block", "point", "head")
    else:  # at distance 1, one of the two is a point of the other
        heads = crowd.where("point = fp").select("block", "point", F.col("fp").alias("head"))
    stars = (crowd.join(heads, ["block", "point"]).where("fp > head")
             .where(f"bit_count(fp ^ head) <= {k}").select(F.col("head").alias("a"), F.col("fp").alias("b")))
    out = materialize(pairs.unionByName(stars).distinct(), "simhash-links")
    discard(buckets)
    return out


def near_duplicates(docs: DataFrame, k: int = 2, shingle: int = 3, *, id_col: str = "doc_id", text_col: str = "text",
                    pair_bucket: int = 64) -> DataFrame:
    """One row per document: (doc_id, fp, component_id), component_id the smallest id reachable."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    marked = materialize(with_fingerprint(rows, shingle).select("doc_id", "fp"), "simhash-docs")
    distinct = materialize(marked.groupBy("fp").agg(F.min("doc_id").alias("first")), "simhash-distinct")
    found = links(distinct, k, pair_bucket)
    parts = connected_components(found)
    # Components of one fingerprint have no edges and stand for themselves.
    named = distinct.join(parts.select(F.col("node").alias("fp"), "label"), "fp", "left").select(
        "fp", "first", F.coalesce("label", "fp").alias("label"))
    smallest = named.groupBy("label").agg(F.min("first").alias("component_id"))
    of = named.join(smallest, "label").select("fp", "component_id")
    discard(found)
    return marked.join(of, "fp").select("doc_id", "fp", "component_id")
