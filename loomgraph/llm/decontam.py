"""Benchmark decontamination by a broadcast set of normalised test n-grams.

Benchmark items are cut into windows of ``n`` consecutive words. A bounded
block of distinct windows is broadcast at a time; each document is scanned
once per block by a rolling hash over its word ids, hits are verified word by
word, and the hit words come back as spans. Normally there is one block and
documents are never shuffled. A benchmark beyond ``block_windows`` distinct
windows takes more blocks (more scans), so what is broadcast stays bounded
while the result stays exact.

Defined cases: null text has no words; an empty benchmark hits nothing; an
item of fewer than ``n`` words (but some) is one window of all its words;
items without words have no window; repeated items and documents are kept,
each row with its own result. Ids may repeat.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .util import held, prepare_python

#: Bytes of a normalised text: A-Z lowered, 0-9, a-z and non-ASCII kept, the rest blank.
_NORM = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_MUL = np.uint64(0x9E3779B97F4A7C15)

HIT_SCHEMA = T.StructType([
    T.StructField("n_words", T.LongType()),
    T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))),
    T.StructField("items", T.ArrayType(T.LongType())),
])


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_NORM).split() if text else []


def item_windows(items: DataFrame, n: int = 10, item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """Distinct windows with the ids of the items that have them: (window, items)."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            ids, windows = [], []
            for i, text in zip(pdf["id"], pdf["text"]):
                words = words_of(text)
                for k in range(max(1, len(words) - n + 1) if words else 0):
                    ids.append(i)
                    windows.append(b" ".join(words[k : k + n]))
            yield pd.DataFrame({"item": pd.Series(ids, dtype="int64"), "window": windows})

    prepare_python(items.sparkSession)
    rows = items.where(F.col(item_id).isNotNull()).select(F.col(item_id).cast("long").alias("id"), F.col(item_text).alias("text"))
    return (rows.mapInPandas(cut, "item long, window binary")
            .groupBy("window").agg(F.collect_set("item").alias("items")))


class _Index:
    """The windows of a block, ready for scanning."""

    def __init__(self, windows: list[tuple[bytes, list[int]]]):
        self.vocab: dict[bytes, int] = {}
        self.lengths: dict[int, np.ndarray] = {}
        self.by_hash: dict[tuple[int, int], list[tuple[tuple[int, ...], list[int]]]] = {}
        found: dict[int, list[int]] = {}
        for window, items in windows:
            ids = tuple(self.vocab.setdefault(w, len(self.vocab) + 1) for w in window.split(b" "))
            h = int(_roll(np.array(ids, dtype=np.uint64), len(ids))[0])
            found.setdefault(len(ids), []).append(h)
            self.by_hash.setdefault((len(ids), h), []).append((ids, items))
        for k, hashes in found.items():
            self.lengths[k] = np.unique(np.array(hashes, dtype=np.uint64))

    def scan(self, words: list[bytes]) -> tuple[np.ndarray, set[int]]:
        """A mask of hit words, and the items that have an occurring window."""
        m = len(words)
        ids = np.fromiter(map(self.vocab.get, words, repeat(0)), np.uint64, m)
        mask, items = np.zeros(m, bool), set()
        known = np.concatenate(([0], np.cumsum(ids != 0)))
        for k, hashes in self.lengths.items():
            if m < k:
                continue
            starts = np.flatnonzero(known[k:] - known[:-k] == k)
            if not len(starts):
                continue
            h = np.zeros(len(starts), np.uint64)
            for j in range(k):
                h = h * _MUL + ids[starts + j]
            near = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
            for s, v in zip(starts[hashes[near] == h].tolist(), h[hashes[near] == h].tolist()):
                own = tuple(ids[s : s + k].tolist())
                for window, of in self.by_hash[k, v]:
                    if window == own:
                        mask[s : s + k] = True
                        items.update(of)
        return mask, items


def _roll(ids: np.ndarray, k: int) -> np.ndarray:
    h = np.zeros(len(ids) - k + 1, np.uint64)
    for j in range(k):
        h = h * _MUL + ids[j : j + len(h)]
    return h


def _spans(mask: np.ndarray) -> list[tuple[int, int]]:
    edge = np.flatnonzero(np.diff(np.concatenate(([0], mask.view(np.int8), [0]))))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist()))


def _blocks(benchmark: DataFrame, n: int, item_id: str, item_text: str, block_windows: int) -> list[DataFrame]:
    """The windows in blocks of at most about ``block_windows``, so that what is broadcast at a time is bounded."""
    windows = item_windows(benchmark, n, item_id, item_text)
    blocks = max(1, -(-windows.count() // block_windows))
    return [windows] if blocks == 1 else [windows.where(F.pmod(F.xxhash64("window"), F.lit(blocks)) == b) for b in range(blocks)]


def _sent(windows: DataFrame):
    """The broadcast windows of a block and a key for the workers' index."""
    rows = [(bytes(r["window"]), r["items"]) for r in windows.collect()]
    return windows.sparkSession.sparkContext.broadcast(rows), uuid.uuid4().hex


def _scan_block(df: DataFrame, windows: DataFrame, out: str, text_col: str) -> DataFrame:
    prepare_python(df.sparkSession)
    sent, key = _sent(windows)

    @F.pandas_udf(HIT_SCHEMA)
    def scan(texts: pd.Series) -> pd.DataFrame:
        index = held(key, lambda: _Index(sent.value))
        n, spans, items = [], [], []
        for text in texts:
            words = words_of(text)
            mask, of = index.scan(words)
            n.append(len(words))
            spans.append([{"start": a, "end": b} for a, b in _spans(mask)] if of else [])
            items.append(sorted(of))
        return pd.DataFrame({"n_words": n, "spans": spans, "items": items})

    return df.withColumn(out, scan(F.col(text_col)))


def find_contamination(docs: DataFrame, benchmark: DataFrame, n: int = 10, *, text_col: str = "text",
                       item_id: str = "item_id", item_text: str = "text", out: str = "contamination",
                       block_windows: int = 2_000_000) -> DataFrame:
    """docs with a struct column ``out``: n_words, spans [start, end) of hit words, items.

    An existing column named ``out`` is replaced. At most about ``block_windows`` windows are broadcast
    at a time; further blocks only add map-side scans of the same rows.
    """
    windows = _blocks(benchmark, n, item_id, item_text, block_windows)
    blocks, parts, df = len(windows), [], docs
    for b, part in enumerate(windows):
        col = out if blocks == 1 else f"{out}__{b}"
        df = _scan_block(df, part, col, text_col)
        parts.append(col)
    if blocks == 1:
        return df
    n_words = F.col(parts[0])["n_words"]
    # Spans of different blocks are merged in order of their starts.
    every = F.array_sort(F.flatten(F.array(*[F.col(p)["spans"] for p in parts])))

    def grow(acc, s):
        last = F.element_at(acc, -1)
        joined = F.struct(last["start"].alias("start"), F.greatest(last["end"], s["end"]).alias("end"))
        return F.when((F.size(acc) > 0) & (F.try_element_at(acc, F.lit(-1))["end"] >= s["start"]),
                      F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(joined))).otherwise(F.concat(acc, F.array(s)))

    spans = F.aggregate(every, F.slice(every, 1, 0), grow)
    items = F.array_sort(F.array_distinct(F.flatten(F.array(*[F.col(p)["items"] for p in parts]))))
    return df.withColumn(out, F.struct(n_words.alias("n_words"), spans.alias("spans"), items.alias("items"))).drop(*parts)


def n_hit(out: str = "contamination"):
    return F.aggregate(F.col(out)["spans"], F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])


def remove_contamination(docs: DataFrame, benchmark: DataFrame, n: int = 10, *, text_col: str = "text",
                         action: str = "spans", max_share: float = 0.5, block_windows: int = 2_000_000) -> DataFrame:
    """docs without benchmark passages, in the input's columns.

    action "spans": each hit span is cut from the text, up to the start of the next word, and the rest stays
    byte for byte; a document of which more than ``max_share`` of the words are hit goes. "documents": every
    hit document goes. Untouched documents stay as they are.
    """
    if action not in ("spans", "documents"):
        raise ValueError(f"unknown action {action!r}")
    mark = "__contamination"
    windows = _blocks(benchmark, n, "item_id", "text", block_windows)
    if len(windows) == 1:
        # Finding and cutting in one call: two of them would hold two workers a task.
        prepare_python(docs.sparkSession)
        sent, key = _sent(windows[0])

        @F.pandas_udf("n_words long, n_hit long, rest string")
        def clean(texts: pd.Series) -> pd.DataFrame:
            index, rows = held(key, lambda: _Index(sent.value)), []
            for text in texts:
                words = words_of(text)
                mask, of = index.scan(words)
                rows.append((len(words), int(mask.sum()), _cut(text, _spans(mask)) if of else None))
            return pd.DataFrame(rows, columns=["n_words", "n_hit", "rest"])

        # Else the filter below would move under the projection and the texts be scanned once for each.
        found = docs.withColumn(mark, clean.asNondeterministic()(F.col(text_col)))
        hit, rest = F.col(mark)["n_hit"], F.coalesce(F.col(mark)["rest"], F.col(text_col))
    else:
        found, hit = find_contamination(docs, benchmark, n, text_col=text_col, out=mark, block_windows=block_windows), n_hit(mark)

        @F.pandas_udf("string")
        def cut(texts: pd.Series, spans: pd.Series) -> pd.Series:
            return pd.Series([_cut(t, [(s["start"], s["end"]) for s in x]) if len(x) else t for t, x in zip(texts, spans)], dtype=object)

        rest = cut(F.col(text_col), F.col(mark)["spans"])
    if action == "documents":
        return found.where(hit == 0).drop(mark)
    kept = found.where((hit == 0) | (hit <= F.col(mark)["n_words"] * F.lit(max_share)))
    return kept.withColumn(text_col, rest).drop(mark)


def _cut(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the words of the spans and what stands between them, up to the next word."""
    raw = text.encode("utf-8", "surrogatepass")
    flat = np.frombuffer(raw.translate(_NORM), np.uint8) != 32
    edge = np.flatnonzero(np.diff(np.concatenate(([0], flat.view(np.int8), [0]))))
    starts, ends = edge[::2], edge[1::2]
    out, at = [], 0
    for a, b in spans:
        out.append(raw[at : starts[a]])
        at = int(starts[b]) if b < len(starts) else int(ends[b - 1])
    out.append(raw[at:])
    return b"".join(out).decode("utf-8", "surrogatepass")
