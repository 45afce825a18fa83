"""Removal of repeated line runs, by a suffix array over line ids. DataFrame operations only.

Every document is a sequence of line ids. Ranks of all suffixes by their first
2^k lines come from prefix doubling: level 0 ranks lines, level k + 1 ranks the
pairs (rank of i, rank of i + 2^k). The distinct pairs are sorted by range, so
a rank is a place in sorted order: rows ordered by rank are the suffix array
at that depth, and rows of one rank are an interval whose longest common
prefix is at least 2^k. Suffixes alone in their interval share nothing further
and leave, which also keeps hot lines from carrying their neighbours along.

A run is removed if it has at least ``min_words`` words and the same run occurs
earlier (by document id, then line). Such runs are unions of shortest ones: for
each line, the shortest run that starts there and the shortest that ends there
with enough words. Whether one of those, of length l with 2^k <= l < 2^(k+1),
has an earlier copy is read off the level-k intervals: runs are equal if their
first 2^k and their last 2^k lines are. Doubling stops when no run is left
that long. The union of removed runs is maximal: no line of a repeated run
with enough words stays in a later copy.

Words of a line are counted as the blanks within the trimmed line plus one.

Defined cases: null text stays null; a document of which all lines go keeps an
empty text; documents of equal id and equal text are one document, each row
with its result; equal ids with different texts are ordered by a hash; rows of
a null id count as earliest and keep their lines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .util import discard, materialize, small

_DOC = ["d", "u"]


def _lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.col(text_col)
    rows = docs.select(F.col(id_col).alias("d"), F.xxhash64(text).alias("u"), F.posexplode(F.split(text, "\n", -1)).alias("ln", "line"))
    inner = F.trim("line")
    words = F.when(inner == "", 0).otherwise(F.length(inner) - F.length(F.replace(inner, F.lit(" "), F.lit(""))) + 1)
    return rows.select("d", "u", "ln", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), "line").alias("h2"), words.alias("w"))


def _ranked(keys: DataFrame, by: list[str], name: str) -> DataFrame:
    """The distinct keys with a rank in their sorted order."""
    return materialize(keys.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("rank", F.monotonically_increasing_id()), name)


def _same_doc(a: str, b: str):
    return F.col(f"{a}.d").eqNullSafe(F.col(f"{b}.d")) & (F.col(f"{a}.u") == F.col(f"{b}.u"))


def _shortest_runs(at: DataFrame, min_words: int) -> DataFrame:
    """(d, u, a, n): the shortest runs of n lines from line a that have enough words, among repeated lines only."""
    doc = Window.partitionBy(*_DOC).orderBy("ln")
    island = at.dropDuplicates([*_DOC, "ln"]).withColumn("isle", F.col("ln") - F.row_number().over(doc))
    isle = Window.partitionBy(*_DOC, "isle")
    upto = (island.withColumn("c", F.sum("w").over(isle.orderBy("ln").rowsBetween(Window.unboundedPreceding, 0)))
            .withColumn("p", F.col("c") - F.col("w")))
    whole = isle.orderBy(F.col("p").desc()).rangeBetween(Window.unboundedPreceding, -min_words)
    runs = (upto.withColumn("next", F.min("ln").over(whole))
            .withColumn("before", F.max("ln").over(isle.orderBy("c").rangeBetween(Window.unboundedPreceding, -min_words)))
            .withColumn("low", F.min("ln").over(isle)).withColumn("high", F.max("ln").over(isle)).withColumn("all", F.max("c").over(isle)))
    end = F.coalesce("next", F.when(F.col("all") - F.col("p") >= min_words, F.col("high") + 1))
    start = F.coalesce(F.col("before") + 1, F.when(F.col("c") >= min_words, F.col("low")))
    both = runs.select(*_DOC, F.explode(F.array(
        F.struct(F.col("ln").alias("a"), (end - F.col("ln")).alias("n")),
        F.struct(start.alias("a"), (F.col("ln") + 1 - start).alias("n")))).alias("run")).select(*_DOC, "run.*")
    return both.where("a is not null and n is not null").distinct()


def repeated_runs(docs: DataFrame, min_words: int = 50, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(d, u, a, n): runs of lines that are later copies; d the id, u the hash of the text, a the first line, n how many."""
    lines = _lines(docs, id_col, text_col)
    ids = _ranked(lines.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h1", "h2"), ["h1", "h2"], "lines-ids")
    found = materialize(lines.join(ids, ["h1", "h2"]).select("d", "u", "ln", "w", "rank"), "lines-at")
    runs = materialize(_shortest_runs(found, min_words), "lines-runs")
    level = found.select("d", "u", "ln", "rank").dropDuplicates([*_DOC, "ln"])
    held, later, k = [ids], [], 0
    longest = runs.agg(F.max("n")).first()[0] or 0
    while (1 << k) <= longest:
        reach = 1 << k
        own = runs.where(f"n >= {reach} and n < {2 * reach}")
        head = own.alias("r").join(level.alias("x"), _same_doc("r", "x") & (F.col("r.a") == F.col("x.ln"))).select(
            "r.d", "r.u", "r.a", "r.n", F.col("x.rank").alias("head"))
        full = head.alias("r").join(level.alias("y"), _same_doc("r", "y") & (F.col("r.a") + F.col("r.n") - reach == F.col("y.ln"))).select(
            "r.d", "r.u", "r.a", "r.n", "head", F.col("y.rank").alias("tail"))
        full = materialize(full, f"lines-full{k}")
        held.append(full)
        # Stored before the join: the runs of a very common line then are a skewed side that adaptive execution splits.
        first = full.groupBy("n", "head", "tail").agg(F.min(F.struct("d", "u", "a")).alias("first"), F.count(F.lit(1)).alias("m")).where("m > 1")
        first = materialize(first, f"lines-first{k}")
        held.append(first)
        later.append(full.join(first, ["n", "head", "tail"]).where(F.struct("d", "u", "a") > F.col("first")).select("d", "u", "a", "n"))
        if 2 * reach > longest:
            break
        # Doubling: the rank 2^k lines on, within the document.
        ahead = Window.partitionBy(*_DOC).orderBy("ln").rangeBetween(reach, reach)
        paired = materialize(level.withColumn("next", F.first("rank").over(ahead)).where("next is not null"), f"lines-pairs{k}")
        names = _ranked(paired.groupBy("rank", "next").agg(F.count(F.lit(1)).alias("m")).where("m > 1")
                        .select(F.col("rank").alias("one"), F.col("next").alias("two")), ["one", "two"], f"lines-names{k}")
        level = materialize(paired.alias("p").join(names.alias("q"), (F.col("p.rank") == F.col("q.one")) & (F.col("p.next") == F.col("q.two")))
                            .select("d", "u", "ln", F.col("q.rank").alias("rank")), f"lines-level{k + 1}")
        discard(paired, names)
        held.append(level)
        k += 1
    if not later:
        return runs
    out = later[0]
    for more in later[1:]:
        out = out.unionByName(more)
    out = materialize(out, "lines-later")
    discard(found, runs, *held)
    return out


def remove_repeated_runs(docs: DataFrame, min_words: int = 50, *, id_col: str = "doc_id", text_col: str = "text",
                         removed: str | None = None) -> DataFrame:
    """docs without the lines of later copies, in the input's columns.

    ``removed`` names a further column: the sorted numbers of the removed lines (empty if none).
    """
    later = repeated_runs(docs, min_words, id_col=id_col, text_col=text_col)
    # The union of a document's runs as spans that do not touch.
    doc = Window.partitionBy(*_DOC).orderBy("a", "e")
    spans = (later.select(*_DOC, "a", (F.col("a") + F.col("n")).alias("e")).distinct()
             .withColumn("reached", F.max("e").over(doc.rowsBetween(Window.unboundedPreceding, -1)))
             .withColumn("new", F.when(F.col("reached") >= F.col("a"), 0).otherwise(1)).withColumn("span", F.sum("new").over(doc.rowsBetween(Window.unboundedPreceding, 0)))
             .groupBy(*_DOC, "span").agg(F.min("a").alias("a"), F.max("e").alias("e")))
    gone = materialize(spans.groupBy(F.col("d").alias("__d"), F.col("u").alias("__u")).agg(F.array_sort(F.collect_list(F.struct("a", "e"))).alias("__gone")), "lines-gone")
    discard(later)
    # Texts of documents that keep all their lines are not moved, if the others' ids can be broadcast.
    of = (F.col(id_col) == F.col("__d")) & (F.xxhash64(F.col(text_col)) == F.col("__u"))
    ids = small(materialize(gone.select("__d", "__u"), "lines-gone-ids"))
    whole = docs.join(ids, of, "left_anti")
    hit = docs.join(ids, of, "left_semi").join(gone, of).withColumn("__lines", F.split(F.col(text_col), "\n", -1))
    # What stands between the spans; both ends are read from __lines, which the two uses keep from being split again for each.
    ends = F.transform("__gone", lambda g: g["e"])
    starts = F.transform("__gone", lambda g: g["a"])
    rest = F.zip_with(F.concat(F.array(F.lit(0)), ends), F.concat(starts, F.array(F.size("__lines"))), lambda a, b: F.slice("__lines", a + 1, b - a))
    hit = hit.withColumn(text_col, F.array_join(F.flatten(rest), "\n"))
    if removed:
        hit = hit.withColumn(removed, F.flatten(F.transform("__gone", lambda g: F.sequence(g["a"], g["e"] - 1))))
        whole = whole.withColumn(removed, F.array().cast("array<int>"))
    return whole.unionByName(hit.drop("__d", "__u", "__gone", "__lines"))
