"""Packing documents into sequences: linear grouping, configurations, best fit.

All decisions are made on the histogram of piece lengths, which has at most as
many entries as a sequence has tokens, whatever the corpus; documents are never
gathered. Large lengths are rounded up within groups of equal cardinality, a
linear program over the few rounded sizes (solved by column generation with an
integer knapsack) says how often each configuration of a sequence is used,
whole multiples of it are filled with actual pieces, longest first, and what
is left, above all the small pieces, goes by best fit into the tightest place.
The plan is a bounded list of runs: "pieces of length l with ranks r.. go to
sequences s.. at offset o". Each piece finds its place from its rank among
the pieces of its length, counted with salted partial counts.

Defined cases: null text is empty and still ends with the end token; repeated
rows are separate documents; an empty table gives an empty result.
"""

from __future__ import annotations

import os
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .util import held, materialize, prepare_python

PIECES = "doc_id long, piece int, start long, length long, tokens binary"


class Encoder:
    """Token ids of a text as little-endian uint32 bytes, with the words' ids remembered.

    The tokenizer drops white space and never merges over it, so a text is encoded chunk by chunk; a chunk of one
    word of Latin-1 letters and a closing mark is the word's ids and the mark's ids (not so with letters that the
    normaliser takes apart, whose last part goes with the mark). Lower-casing first is left to texts of Latin-1,
    where it does what the tokenizer's own normaliser does. Everything else goes to the tokenizer itself.
    """

    def __init__(self, path: str, remember: int = 300_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.known: dict[str, bytes] = {"": b""}
        self.remember = remember

    def _learn(self, chunk: str) -> bytes:
        known = self.known
        core = chunk[:-1]
        if chunk[-1] in ".," and core.isalpha() and max(core) < "\u0100":
            ids = (known.get(core) or self._learn(core)) + (known.get(chunk[-1]) or self._learn(chunk[-1]))
        elif chunk.isascii() and chunk.isalpha() and chunk.islower():
            ids = np.array([t.id for t in self.tokenizer.model.tokenize(chunk)], "<u4").tobytes()
        else:
            ids = np.array(self.tokenizer.encode(chunk, add_special_tokens=False).ids, "<u4").tobytes()
        if len(known) < self.remember:
            known[chunk] = ids
        return ids

    def __call__(self, text: str) -> bytes:
        try:
            text.encode("latin-1")
            text = text.lower()
        except UnicodeEncodeError:
            pass
        chunks = text.replace("\n", " ").replace("\t", " ").split(" ")
        got = list(map(self.known.get, chunks))
        if None in got:
            got = [self._learn(c) if g is None else g for c, g in zip(chunks, got)]
        return b"".join(got)


def encoder(path: str) -> Encoder:
    return held(("encoder", path), lambda: Encoder(path))


def encode_pieces(docs: DataFrame, tokenizer_path: str, size: int = 4096, end_id: int = 1, *, id_col: str = "doc_id",
                  text_col: str = "text") -> DataFrame:
    """Token pieces of every document: (doc_id, piece, start, length, tokens), tokens little-endian uint32."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode, end = encoder(tokenizer_path), np.array([end_id], "<u4").tobytes()
        for pdf in batches:
            rows, tokens = [], 0
            for i, text in zip(pdf["doc_id"], pdf["text"]):
                ids = (encode(text) if text else b"") + end
                n = len(ids) // 4
                rows += [(i, k, a, min(size, n - a), ids[4 * a : 4 * (a + size)]) for k, a in enumerate(range(0, n, size))]
                tokens += n
                if tokens > 1 << 19:
                    yield pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "tokens"])
                    rows, tokens = [], 0
            if rows:
                yield pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "tokens"])

    prepare_python(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInPandas(cut, PIECES)


# --- the plan, on a histogram -------------------------------------------------------------------------------------


def _knapsack(values: np.ndarray, sizes: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The most valuable multiset of sizes within capacity."""
    best = [0.0] * (capacity + 1)
    take = [-1] * (capacity + 1)
    order = [(int(s), float(v), k) for k, (s, v) in enumerate(zip(sizes, values)) if v > 1e-12]
    for s, v, k in order:
        for c in range(s, capacity + 1):
            if best[c - s] + v > best[c]:
                best[c], take[c] = best[c - s] + v, k
    counts = np.zeros(len(sizes), np.int64)
    c = capacity
    while c > 0:
        if take[c] < 0:
            c -= 1
            continue
        counts[take[c]] += 1
        c -= int(sizes[take[c]])
    return best[capacity], counts


def configurations(sizes: np.ndarray, demand: np.ndarray, capacity: int, rounds: int = 200) -> list[tuple[np.ndarray, int]]:
    """Configurations of a sequence and how often each is used, by column generation; never more than the demand."""
    k = len(sizes)
    basis = np.diag(np.maximum(1, capacity // sizes)).astype(float)
    scale = max(1, capacity // 1024)  # coarser units, sizes rounded up, keep pricing cheap
    units = -(-sizes // scale)
    for _ in range(rounds):
        inverse = np.linalg.inv(basis)
        use = inverse @ demand
        price = np.linalg.solve(basis.T, np.ones(k))
        worth, column = _knapsack(price, units, capacity // scale)
        if worth <= 1 + 1e-9:
            break
        move = inverse @ column
        with np.errstate(divide="ignore", invalid="ignore"):
            ratio = np.where(move > 1e-12, use / move, np.inf)
        basis[:, int(np.argmin(ratio))] = column
    use = np.linalg.solve(basis, demand.astype(float))
    return [(basis[:, j].round().astype(np.int64), int(use[j] + 1e-7)) for j in range(k) if use[j] >= 1]


def plan(histogram: dict[int, int], capacity: int = 4096, groups: int = 24, large: float = 1 / 8) -> np.ndarray:
    """Runs (length, rank, count, sequence, each, offset): the pieces of that length from that rank on go, ``each`` per
    sequence, to consecutive sequences from ``sequence`` on, at ``offset``. Whole histogram in, every piece placed once.
    """
    left = {int(l): int(n) for l, n in histogram.items() if n > 0}
    if any(not 0 < l <= capacity for l in left):
        raise ValueError("lengths must be within 1 and the capacity")
    given = dict.fromkeys(left, 0)
    out: list[tuple[int, int, int, int, int, int]] = []
    free: dict[int, list[tuple[int, int]]] = {}  # room left: [(first sequence, sequences)]
    rooms: list[int] = []
    sequences = 0

    def store(room: int, first: int, count: int) -> None:
        if room and count:
            if room not in free:
                free[room] = []
                insort(rooms, room)
            free[room].append((first, count))

    def put(length: int, first: int, count: int, each: int, offset: int) -> None:
        out.append((length, given[length], count * each, first, each, offset))
        given[length] += count * each
        left[length] -= count * each

    big = sorted((l for l in left if capacity * large < l < capacity), reverse=True)
    total = sum(left[l] for l in big)
    if total:
        # Groups of equal cardinality, the longest first; each is rounded up to its longest.
        members: list[list[list[int]]] = [[]]
        room, share = -(-total // groups), -(-total // groups)
        for l in big:
            n = left[l]
            while n:
                if not room:
                    members.append([])
                    room = share
                q = min(n, room)
                members[-1].append([l, q])
                n, room = n - q, room - q
        sizes = np.array([g[0][0] for g in members])
        # Equal sizes of different groups are one size of the program.
        kinds, kind = np.unique(-sizes, return_inverse=True)
        demand = np.bincount(kind, [sum(q for _, q in g) for g in members])
        pools = [[e for g, j in zip(members, kind) if j == i for e in g] for i in range(len(kinds))]
        for column, count in configurations(-kinds, demand, capacity):
            count = min([count, *(sum(q for _, q in pools[i]) // int(c) for i, c in enumerate(column) if c)])
            if not count:
                continue
            runs = [(sequences, count, 0)]
            sequences += count
            for i in np.repeat(np.arange(len(column)), column):
                filled = []
                for first, m, used in runs:
                    while m:
                        l, q = pools[i][0]
                        q = min(q, m)
                        put(l, first, q, 1, used)
                        filled.append((first, q, used + l))
                        pools[i][0][1] -= q
                        if not pools[i][0][1]:
                            pools[i].pop(0)
                        first, m = first + q, m - q
                runs = filled
            for first, m, used in runs:
                store(capacity - used, first, m)
    for l in sorted(left, reverse=True):
        while left[l]:
            k = bisect_left(rooms, l)
            if k < len(rooms):
                room = rooms[k]
                first, m = free[room].pop()
                if not free[room]:
                    del free[room]
                    rooms.pop(k)
            else:
                room, first = capacity, sequences
                m = -(-left[l] // (capacity // l))
                sequences += m
            each = min(room // l, left[l])
            q = min(m, left[l] // each)
            put(l, first, q, each, capacity - room)
            store(room - each * l, first, q)
            store(room, first + q, m - q)
    return np.array(out, np.int64).reshape(-1, 6)


def assign(pieces: DataFrame, size: int = 4096, *, salt_rows: int = 2000) -> DataFrame:
    """pieces (a stored table with doc_id, piece, start, length and the random number __mixed) with sequence_id and offset;
    other columns stay. Pieces of one length are ranked in groups of about ``salt_rows``, in whatever order they came."""
    spark = pieces.sparkSession
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    runs = plan(histogram, size)
    runs = runs[np.lexsort((runs[:, 1], runs[:, 0]))]
    salts = max(1, -(-max(histogram.values(), default=1) // salt_rows))
    salted = pieces.withColumn("__salt", F.pmod("__mixed", F.lit(salts)))
    counts = salted.groupBy("length", "__salt").agg(F.count(F.lit(1)).alias("__n"))
    before = counts.select("length", "__salt", (F.sum("__n").over(
        Window.partitionBy("length").orderBy("__salt").rowsBetween(Window.unboundedPreceding, 0)) - F.col("__n")).alias("__before"))
    order = Window.partitionBy("length", "__salt").orderBy("doc_id", "piece", "__mixed")
    ranked = (salted.withColumn("__row", F.row_number().over(order) - 1).join(before, ["length", "__salt"])
              .withColumn("__rank", F.col("__row") + F.col("__before")))
    sent = spark.sparkContext.broadcast(runs)  # at most some ten thousand runs, however many pieces there are

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        r = sent.value
        lows = np.searchsorted(r[:, 0], np.arange(size + 2))
        l, k = length.to_numpy(), rank.to_numpy()
        at = np.empty(len(l), np.int64)
        for one in np.unique(l):
            own = l == one
            a, b = lows[one], lows[one + 1]
            at[own] = a + np.searchsorted(r[a:b, 1], k[own], side="right") - 1
        nth = k - r[at, 1]
        each = r[at, 4]
        return pd.DataFrame({"sequence_id": r[at, 3] + nth // each, "offset": r[at, 5] + nth % each * l})

    placed = ranked.withColumn("__at", place("length", "__rank"))
    return placed.select(*[c for c in pieces.columns if c != "__mixed"], F.col("__at.sequence_id").alias("sequence_id"), F.col("__at.offset").alias("offset"))


def pack_documents(docs: DataFrame, tokenizer_path: str, size: int = 4096, end_id: int = 1, *, id_col: str = "doc_id",
                   text_col: str = "text", keep_tokens: bool = True) -> DataFrame:
    """(doc_id, piece, start, length, [tokens,] ids_crc32, sequence_id, offset) for every piece of every document."""
    pieces = encode_pieces(docs, tokenizer_path, size, end_id, id_col=id_col, text_col=text_col)
    # Rows that are equal in all else have different numbers, so a thousand copies of a row are spread as well.
    pieces = pieces.withColumn("ids_crc32", F.crc32("tokens")).withColumn("__mixed", F.xxhash64("doc_id", "piece", F.monotonically_increasing_id()))
    return assign(materialize(pieces if keep_tokens else pieces.drop("tokens"), "pack-pieces"), size)
