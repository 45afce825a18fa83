"""SimHash near-dedup to a similarity of texts: the grouping that the pipeline's near-dedup stage uses.

First comes SimHash, by its operator (simhash.py): a fingerprint of every text, the pigeonhole blocks that bring together
all fingerprints within ``max_bits`` bits, and the exact similarity of the texts, which decides on each link. What these
links connect is one group from there on.

Texts of similarity 0.8 differ in about one SimHash bit of seven. A proof by pigeonhole would need blocks of a few bits,
which select nothing, so for pairs whose fingerprints are further apart a second step takes its candidates from the
shingle sets: ordered by their hashes, two sets as similar as asked share one of the first fifth of each (prefix()),
whatever the number of documents. Before texts are compared, parity bits of the sets are, of which two sets that are as
similar as asked differ in no more than the similarity allows. The exact similarity of the texts decides here too, and
pairs that SimHash has connected are not looked at again.

Hashes of more than ``common_over`` sets (the ``max_common`` most frequent) are put last in the order, which changes the
work, not the result. Of the sets that share a key, no pair is left out but those that are connected already: after
SimHash each set first meets the head of each of its keys, the set whose keys are the most frequent (in a group of copies, the
original); then those of one key that are still apart meet all others, in blocks of about ``pair_bucket``.

Defined cases: null, empty and wordless texts are equal to each other and to nothing else; a text with fewer words than
a shingle is one shingle; equal sets are one set from the start; ties go to the smaller id, then to the text with the
smaller hash; rows of one id and one text are one document; rows of a null id are left as they are; an empty table gives
an empty result; other columns are not looked at.
"""

from __future__ import annotations

from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import simhash
from .components import connected_components
from .simhash import _NORM
from .util import discard, materialize, prepare_python, small

_PARTS = [f"s{k}" for k in range(8)]
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _words(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_NORM).split() if text else []


def shingle_set(text: str | None, shingle: int = 5) -> frozenset[bytes]:
    words = _words(text)
    return frozenset(b" ".join(words[i : i + shingle]) for i in range(max(1, len(words) - shingle + 1))) if words else frozenset()


def similarity(a: str | None, b: str | None, shingle: int = 5, of=shingle_set) -> float:
    """Jaccard similarity of the sets of word shingles; two texts without words are equal."""
    x, y = of(a, shingle), of(b, shingle)
    both = len(x & y)
    return both / (len(x) + len(y) - both) if x or y else 1.0


class Sketch(NamedTuple):
    """Of the set of a text's word shingles: its 64-bit hashes in ascending order, the 128-bit hash of all of them, 512
    bits, each the parity of the hashes that fall on it, and for larger sets as many such bits as it has elements at least
    (signed 64-bit numbers)."""

    hashes: np.ndarray
    f0: int
    f1: int
    parts: list[int]
    bits: np.ndarray


def _parity(h: np.ndarray, bits: int) -> np.ndarray:
    odd = np.bincount((h & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8")


def set_sketch(text: str | None, shingle: int = 5) -> Sketch:
    words = _words(text)
    if not words:
        return Sketch(np.zeros(0, np.uint64), 0, 0, [0] * 8, np.zeros(0, np.int64))
    own = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    size = min(shingle, len(words))
    h = np.full(len(words) - size + 1, size, np.uint64)
    for j in range(size):
        h = (h ^ own[j : j + len(h)]) * _MIX
        h ^= h >> np.uint64(29)
    h.sort()
    h = h[np.concatenate(([True], h[1:] != h[:-1]))]
    f = np.frombuffer(xxhash.xxh3_128_digest(h.astype("<u8").tobytes()), "<i8")
    bits = _parity(h, 1 << (len(h) - 1).bit_length()) if len(h) > 512 else np.zeros(0, np.int64)
    return Sketch(h, int(f[0]), int(f[1]), _parity(h, 512).tolist(), bits)


def prefix(hashes: np.ndarray, min_similarity: float, common: np.ndarray | None = None) -> np.ndarray:
    """The first hashes of a set in an order all sets share, so many that two sets as similar as asked have one of theirs in common.

    Such sets have at least ``min_similarity`` of each in common, so the first common one has at most the rest before it.
    The order is that of the hashes, those in ``common`` (ascending) last.
    """
    n = len(hashes)
    if common is not None and len(common):
        last = common[np.minimum(np.searchsorted(common, hashes), len(common) - 1)] == hashes
        hashes = np.concatenate((hashes[~last], hashes[last]))
    return hashes[: n - int(np.ceil(min_similarity * n - 1e-9)) + 1]


def _sketched(shingle: int, min_similarity: float):
    """The UDF of set_sketch() and prefix(): f0, f1, n, keys, bits, s0 .. s7."""

    @F.pandas_udf("f0 long, f1 long, n int, keys array<long>, bits array<long>, " + ", ".join(f"{p} long" for p in _PARTS))
    def sketch(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for t in texts:
            s = set_sketch(t, shingle)
            rows.append((s.f0, s.f1, len(s.hashes), prefix(s.hashes, min_similarity).view(np.int64), s.bits, *s.parts))
        return pd.DataFrame(rows, columns=["f0", "f1", "n", "keys", "bits", *_PARTS])

    return sketch


def _late_keys(shingle: int, min_similarity: float, common):
    """The UDF of prefix() with the broadcast ``common`` hashes last."""

    @F.pandas_udf("array<long>")
    def keys(texts: pd.Series) -> pd.Series:
        return pd.Series([prefix(set_sketch(t, shingle).hashes, min_similarity, common.value).view(np.int64) for t in texts], dtype=object)

    return keys


def _limit(min_similarity: float) -> str:
    """How many elements two sets as similar as asked have in one of them only, at most; parities that differ count at least."""
    return f"{(1 - min_similarity) / (1 + min_similarity)!r}D * (x.n + y.n) + 1e-6D"


#: Differing bits of x.bits and y.bits; the bits of a set twice as finely cut are folded.
_FINE = """aggregate(zip_with(
    if(size(x.bits) > size(y.bits), zip_with(slice(x.bits, 1, size(y.bits)), slice(x.bits, size(y.bits) + 1, size(y.bits)), (p, q) -> p ^ q), x.bits),
    if(size(y.bits) > size(x.bits), zip_with(slice(y.bits, 1, size(x.bits)), slice(y.bits, size(x.bits) + 1, size(x.bits)), (p, q) -> p ^ q), y.bits),
    (p, q) -> bit_count(p ^ q)), 0, (a, b) -> a + b)"""


def fingerprint_pairs(marked: DataFrame, distinct: DataFrame, max_bits: int, possible: str) -> DataFrame:
    """(a, b): pairs of different sets that SimHash links and that are ``possible``.

    ``marked`` has f0, f1 and the fingerprint fp of each row, ``distinct`` the node of each set. A set has several
    fingerprints where texts differ in repeats only; sets of one fingerprint are linked with the first of them.
    """
    prints = materialize(marked.select("fp", "f0", "f1").distinct().join(distinct.select("f0", "f1", "node"), ["f0", "f1"]).select("fp", "node"), "similar-prints")
    first = materialize(prints.groupBy("fp").agg(F.min("node").alias("first")), "similar-firsts")
    found = simhash.links(first.select("fp"), max_bits)
    same = prints.join(first, "fp").select(F.col("first").alias("a"), F.col("node").alias("b"))
    linked = (found.join(first.select(F.col("fp").alias("a"), F.col("first").alias("x")), "a").join(first.select(F.col("fp").alias("b"), F.col("first").alias("y")), "b")
              .select(F.col("x").alias("a"), F.col("y").alias("b")))
    pairs = same.unionByName(linked).where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    sets = distinct.select("node", "n", *_PARTS)
    out = materialize(pairs.join(sets.alias("x"), F.col("a") == F.col("x.node")).join(sets.alias("y"), F.col("b") == F.col("y.node")).where(possible).select("a", "b"), "similar-close")
    discard(prints, first, found)
    return out


def similar_groups(docs: DataFrame, min_similarity: float = 0.8, shingle: int = 5, *, id_col: str = "doc_id", text_col: str = "text",
                   max_bits: int = 2, print_shingle: int = 3, pair_bucket: int = 1024, first_heads: int = 6, common_over: int = 256,
                   max_common: int = 1 << 16) -> DataFrame:
    """(doc_id, th, label) for copies of a Jaccard similarity of at least ``min_similarity`` (0.5 to 1), and what is linked by them.

    th is the hash of the row's text, label the (doc_id, th) that comes first in the group. Rows of a null id have none.
    SimHash links fingerprints of ``print_shingle``-word shingles within ``max_bits`` bits.
    """
    if not 0.5 <= min_similarity <= 1:
        raise ValueError("min_similarity must be within 0.5 and 1")
    spark = docs.sparkSession
    prepare_python(spark)
    numbers = ["n", *_PARTS]
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).withColumn("th", F.xxhash64("text"))
    marked = materialize(simhash.with_fingerprint(rows.where("doc_id is not null"), print_shingle)
                         .withColumn("f", _sketched(shingle, min_similarity)("text")).select("doc_id", "th", "fp", "f.*"), "similar-sets")
    distinct = materialize(
        marked.groupBy("f0", "f1").agg(F.min(F.struct("doc_id", "th")).alias("of"), *[F.first(c).alias(c) for c in (*numbers, "keys", "bits")])
        .withColumn("node", F.monotonically_increasing_id()), "similar-distinct")

    def texts_of(nodes: DataFrame) -> DataFrame:
        """(node, text) of the given nodes, a row for each row of the text."""
        named = distinct.join(nodes, "node", "left_semi").select("node", F.col("of.doc_id").alias("doc_id"), F.col("of.th").alias("th"))
        return rows.join(small(materialize(named, "similar-named")), ["doc_id", "th"]).select("node", "text")

    @F.pandas_udf("boolean")
    def alike(x: pd.Series, y: pd.Series) -> pd.Series:
        of = lru_cache(16)(shingle_set)  # the pairs of a text come one after the other
        return pd.Series([similarity(a, b, shingle, of) >= min_similarity for a, b in zip(x, y)])

    def verified(pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) whose texts are as similar as asked."""
        pairs = materialize(pairs.distinct(), "similar-pairs")
        fine = distinct.select("node", "n", "bits").where("size(bits) > 0")
        told = (pairs.join(fine.withColumnRenamed("node", "a").alias("x"), "a", "left").join(fine.withColumnRenamed("node", "b").alias("y"), "b", "left")
                .where(f"size(x.bits) is null or size(y.bits) is null or {_FINE} <= {_limit(min_similarity)}").select("a", "b"))
        told = materialize(told, "similar-told")
        paired = materialize(told.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "similar-paired")
        texts = materialize(texts_of(small(paired)).groupBy("node").agg(F.min("text").alias("text")), "similar-texts")
        both = told.join(texts.select(F.col("node").alias("b"), F.col("text").alias("y")), "b").join(texts.select(F.col("node").alias("a"), F.col("text").alias("x")), "a")
        true = materialize(both.where(alike("x", "y")).select("a", "b"), "similar-links")
        discard(pairs, told, paired, texts)
        return true

    parted = " + ".join(f"bit_count(x.{p} ^ y.{p})" for p in _PARTS)
    possible = f"least(x.n, y.n) >= {min_similarity!r}D * greatest(x.n, y.n) - 1e-6D and {parted} <= {_limit(min_similarity)}"

    printed = fingerprint_pairs(marked, distinct, max_bits, possible)
    close = verified(printed)
    near = connected_components(close)

    def counted(keys: DataFrame) -> DataFrame:
        return materialize(keys.groupBy("key").agg(F.count(F.lit(1)).alias("many")).where("many > 1"), "similar-buckets")

    keyed = distinct.select("node", F.explode("keys").alias("key"))
    buckets = counted(keyed)
    often = [r["key"] for r in buckets.where(F.col("many") > common_over).orderBy(F.desc("many"), "key").limit(max_common).select("key").collect()]
    if often:
        # Only sets with such a key have another beginning in the new order.
        common = spark.sparkContext.broadcast(np.sort(np.array(often, np.int64).view(np.uint64)))
        frequent = F.broadcast(buckets.where(F.col("many") > common_over).orderBy(F.desc("many"), "key").limit(max_common).select("key"))
        moved = materialize(keyed.join(frequent, "key", "left_semi").select("node").distinct(), "similar-moved")
        late = texts_of(small(moved)).withColumn("keys", _late_keys(shingle, min_similarity, common)("text")).groupBy("node").agg(F.min("keys").alias("keys"))
        new = materialize(keyed.join(small(moved), "node", "left_anti").unionByName(late.select("node", F.explode("keys").alias("key"))), "similar-keyed")
        discard(moved, buckets)
        keyed, buckets = new, counted(new)
    met = materialize(keyed.join(buckets, "key"), "similar-met")
    weight = met.groupBy("node").agg(F.sum("many").alias("weight"))
    members = materialize(distinct.join(weight, "node").join(near.withColumnRenamed("label", "near"), "node", "left")
                          .select("node", (F.col("weight") / F.size("keys")).alias("weight"), *numbers, F.coalesce("near", "node").alias("near")), "similar-members")
    met = met.select("key", "node").join(members, "node")

    ends = [F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")]

    heads = met.groupBy("key").agg(F.max(F.struct("weight", "node", "near", *numbers)).alias("h")).select("key", "h.*")
    least = (met.alias("x").join(heads.alias("y"), "key").where("x.near <> y.near").where(possible)
             .groupBy(F.col("x.node").alias("node")).agg(F.slice(F.sort_array(F.collect_set(F.struct("y.weight", "y.node")), False), 1, first_heads).alias("heads")))
    first = verified(least.select("node", F.explode("heads.node").alias("head")).select(F.least("node", "head").alias("a"), F.greatest("node", "head").alias("b")))
    label = connected_components(close.unionByName(first))
    known = materialize(met.drop("near").join(label, "node", "left").withColumn("label", F.coalesce("label", "node")), "similar-known")
    # Of one key, all that are not in the head's group meet all others, unless one group has the whole bucket.
    groups = (known.groupBy("key").agg(F.count(F.lit(1)).alias("many"), F.max(F.struct("weight", "node", "label"))["label"].alias("top"),
                                       F.min("label").alias("low"), F.max("label").alias("high"))
              .where("low < high").select("key", "top", F.ceil(F.col("many") / pair_bucket).cast("int").alias("blocks")))
    apart = materialize(known.join(groups, "key").withColumn("block", F.pmod(F.xxhash64("node"), "blocks").cast("int")), "similar-apart")
    every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    x = apart.where("label <> top").withColumn("other", every).withColumnsRenamed({"block": "i", "other": "j"})
    y = apart.withColumn("other", every).withColumnsRenamed({"block": "j", "other": "i"})
    pairs = (x.alias("x").join(y.alias("y"), ["key", "i", "j"])
             .where(f"x.label <> y.label and (y.label = y.top or x.node < y.node) and {possible}").select(*ends))
    second = verified(pairs)
    true = materialize(close.unionByName(first).unionByName(second), "similar-links")
    discard(buckets, printed, close, first, second, known, members, apart)
    parts = connected_components(true)
    named = materialize(distinct.join(parts, "node", "left").select("f0", "f1", "of", F.coalesce("label", "node").alias("group")), "similar-groups")
    smallest = named.groupBy("group").agg(F.min("of").alias("label"))
    discard(true)
    return marked.select("doc_id", "th", "f0", "f1").join(named.join(smallest, "group").select("f0", "f1", "label"), ["f0", "f1"]).select("doc_id", "th", "label")


def drop_near_duplicates(docs: DataFrame, min_similarity: float = 0.8, shingle: int = 5, *, id_col: str = "doc_id",
                         text_col: str = "text") -> DataFrame:
    """docs with the first document of each group of near-duplicates (smallest id), in the input's columns.

    Of rows of one id with similar texts, one stays, and rows of it with other texts are decided on by themselves; rows of
    a null id stay as they are.
    """
    groups = materialize(similar_groups(docs, min_similarity, shingle, id_col=id_col, text_col=text_col), "similar-labels")
    gone = materialize(groups.where("struct(doc_id, th) <> label").select(F.col("doc_id").alias("__id"), F.col("th").alias("__th")).distinct(), "similar-gone")
    twice = materialize(groups.groupBy(F.col("doc_id").alias("__id")).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("__id"), "similar-twice")
    is_ = lambda name: F.col(id_col) == F.col(name)
    kept = docs.join(small(gone), is_("__id") & (F.xxhash64(text_col) == F.col("__th")), "left_anti")
    discard(groups)
    if not twice.limit(1).count():
        return kept
    # Of equal rows of an id, one stays.
    again = kept.join(small(twice), is_("__id"), "left_semi").withColumn("__th", F.xxhash64(text_col)).dropDuplicates([id_col, "__th"])
    return kept.join(small(twice), is_("__id"), "left_anti").unionByName(again.select(*docs.columns))
