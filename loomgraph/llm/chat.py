"""Chat formatting in budgeted windows. DataFrame operations only.

Prefix sums of turn tokens cut a conversation into turn-aligned windows. A
window has the system turn, a limited history repeated from the window before,
and its own turns; only the text of its own assistant turns is under the loss
mask, so a repeated target is never learned twice, and every turn is some
window's own exactly once.

The room T of a window is the budget less the system turn and the history. A
turn of more than T / 2 tokens is a window of its own; other turns go by the
half rooms their prefix sum falls into, so their windows hold at most T. The
sums have two levels, within runs of ``run`` consecutive turns and over the
runs. Windows do not reach over runs, so everything else happens where a run's
turns are: a very long conversation is spread over tasks, texts are shuffled
once, and what is gathered into one row is a window, bounded by the budget (or
one turn, if that is longer, flagged ``over``). The turns that are history of
the next run go there as well. Places within conversations of more than a run
come from a sort by range of rows without texts, whatever their turn numbers.

A turn is ``<|role|>`` newline, text, ``<|end|>`` newline. Within texts and
roles, ``<``, ``[``, ``\\`` (in roles also ``|``) are followed by a backslash, so
no control string survives: neither this template's nor ``</s>`` or
``[INST]``; unescape() undoes it.

Defined cases: null text and null role are empty; turns of equal number are
ordered by role and a hash of the text, and repeated rows stay repeated, in one
run; a null turn comes first; a null conversation id is a conversation. Only a first turn with the
role ``system`` is retained in later windows.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .util import discard, materialize, small

END = "<|end|>\n"


def escape(c: Column, role: bool = False) -> Column:
    return F.regexp_replace(c, r"([<\[\\|])" if role else r"([<\[\\])", r"$1\\")


def unescape(c: Column, role: bool = False) -> Column:
    return F.regexp_replace(c, r"([<\[\\|])\\" if role else r"([<\[\\])\\", "$1")


def token_count(text: Column) -> Column:
    """An estimate without a tokenizer: a token per four characters, half a token more for every byte that characters beyond
    ASCII have more than one, and four for the marks of a turn. Pass ``tokens`` for counts of one's own."""
    return (F.ceil(F.length(text) / 4 + (F.octet_length(text) - F.length(text)) / 2) + 4).cast("long")


def _places(rows: DataFrame, long: DataFrame, run: int, history: int) -> DataFrame:
    """(c, none, turn, role, th, run, next): the run of every turn of the conversations ``long``, and whether it is also history of the next."""
    conv, key = ["c", "none"], ["c", "none", "turn", "role", "th"]
    light = rows.join(small(long), conv, "left_semi").groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.sum("tokens").alias("t"))
    sorted_ = materialize(light.repartitionByRange(*key).sortWithinPartitions(*key).withColumn("id", F.monotonically_increasing_id()), "chat-sorted")
    at = sorted_.withColumn("part", F.shiftright("id", 33))
    parts = at.groupBy(*conv, "part").agg(F.sum("n").alias("n"), F.sum("t").alias("t"))
    over, within = Window.partitionBy(*conv).orderBy("part"), Window.partitionBy(*conv, "part").orderBy("id")
    parts = parts.select(*conv, "part", (F.sum("n").over(over) - F.col("n")).alias("n0"), (F.sum("t").over(over) - F.col("t")).alias("t0"))
    at = (at.withColumn("nth", F.sum("n").over(within) - F.col("n")).withColumn("sum", F.sum("t").over(within)).join(parts, [*conv, "part"])
          .withColumn("run", F.floor((F.col("n0") + F.col("nth")) / run)).withColumn("upto", F.col("t0") + F.col("sum")))
    end = F.max("upto").over(Window.partitionBy(*conv, "run"))
    out = materialize(at.withColumn("next", F.col("upto") - F.col("t") >= end - history).select(*key, "run", "next"), "chat-places")
    discard(sorted_)
    return out


def format_conversations(turns: DataFrame, budget: int = 2048, history: int = 256, run: int = 256, *, conv_col: str = "conv_id",
                         turn_col: str = "turn", role_col: str = "role", text_col: str = "text", tokens: Column | None = None) -> DataFrame:
    """One row per window: conv_id, window (its first own turn's position), formatted, n_repeated (turns that only repeat),
    loss (array of code point spans [start, end) of formatted), n_tokens, over.

    ``tokens`` is a native expression over the text column, token_count() if none.
    """
    if budget < 4 or not 0 <= history <= budget // 2:
        raise ValueError("history must be at most half of the budget")
    # A null conversation is told by a flag, so that keys are plain equalities and share one partitioning.
    conv, part = ["c", "none"], ["c", "none", "run"]
    rows = turns.select(
        F.coalesce(F.col(conv_col), F.lit(0).cast(turns.schema[conv_col].dataType)).alias("c"), F.col(conv_col).isNull().alias("none"),
        F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text"),
        (token_count(F.coalesce(F.col(text_col), F.lit(""))) if tokens is None else tokens).alias("tokens"))
    rows = rows.withColumn("th", F.xxhash64("text"))
    long = materialize(rows.groupBy(*conv).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > run).select(*conv), "chat-long")
    if long.limit(1).count():
        p = small(_places(rows, long, run, history)).alias("p")
        same = [F.col(f"r.{c}") == F.col(f"p.{c}") for c in (*conv, "role", "th")] + [F.col("r.turn").eqNullSafe(F.col("p.turn"))]
        home = F.coalesce("p.run", F.lit(0).cast("long"))
        rows = (rows.alias("r").join(p, reduce(and_, same), "left")
                .select("r.*", home.alias("home"), F.explode(F.when(F.col("p.next"), F.array(home, home + 1)).otherwise(F.array(home))).alias("run"))
                .withColumn("own", F.col("home") == F.col("run")).drop("home"))
    else:
        rows = rows.withColumns({"run": F.lit(0).cast("long"), "own": F.lit(True)})
    # Over the runs: what came before each, and the conversation's first turn if that is the system's.
    opening = F.min(F.struct(F.col("turn").isNotNull(), "turn", "role", "text", "tokens"))
    over = Window.partitionBy(*conv).orderBy("run")
    every = over.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    runs = rows.where("own").groupBy(*part).agg(F.count(F.lit(1)).alias("n"), F.sum("tokens").alias("t"), opening.alias("opening"))
    head = F.first("opening").over(every)
    told = head["role"] == "system"
    runs = runs.select(*part, (F.sum("n").over(over) - F.col("n")).alias("n0"), (F.sum("t").over(over) - F.col("t")).alias("t0"),
                       F.when(told, head["text"]).alias("system"), F.when(told, head["tokens"]).alias("system_tokens"))
    # Within a run: places, long turns, windows, and the history of each turn.
    # What is there as history only stands before the rest, so its places and sums are taken off.
    inner = Window.partitionBy(*part).orderBy("turn", "role", "th", "text")
    upto = inner.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.partitionBy(*part)
    past_n, past_t = F.sum((~F.col("own")).cast("long")).over(whole), F.sum(F.when(F.col("own"), 0).otherwise(F.col("tokens"))).over(whole)
    at = (rows.withColumn("nth", F.row_number().over(inner) - past_n).withColumn("sum", F.sum("tokens").over(upto) - past_t).join(runs, part)
          .withColumn("pos", F.col("n0") + F.col("nth") - 1).withColumn("before", F.col("t0") + F.col("sum") - F.col("tokens")))
    half = F.greatest(F.lit(1), F.floor((F.lit(budget - history) - F.coalesce("system_tokens", F.lit(0))) / 2))
    by_pos = Window.partitionBy(*part).orderBy("pos")
    at = (at.withColumn("half", half).withColumn("long", (F.col("own") & (F.col("tokens") > F.col("half"))).cast("long"))
          .withColumn("stretch", F.sum("long").over(by_pos))
          .withColumn("span", F.when(F.col("long") == 1, F.lit(-1)).otherwise(F.floor(F.col("before") / F.col("half")))))
    turn = lambda own: F.struct("pos", "role", "text", "tokens", F.lit(own).alias("own"))
    past = Window.partitionBy(*part).orderBy("before").rangeBetween(-history, -1)
    repeated = F.collect_list(F.when((F.col("pos") > 0) | F.col("system").isNull(), turn(False))).over(past) if history else F.array().cast(
        "array<struct<pos:bigint,role:string,text:string,tokens:bigint,own:boolean>>")
    at = at.withColumn("told", repeated)
    spans = at.where("own").groupBy(*part, "stretch", "long", "span").agg(
        F.min("pos").alias("first"), F.min("system").alias("system"), F.max("system_tokens").alias("system_tokens"), F.min_by("told", "pos").alias("told"),
        F.sort_array(F.collect_list(turn(True))).alias("turns"))
    spans = spans.withColumn("conv_id", F.when(~F.col("none"), F.col("c")))
    none = F.filter("turns", lambda _: F.lit(False))
    kept = F.when((F.col("first") > 0) & F.col("system").isNotNull(), F.array(F.struct(
        F.lit(0).cast("long").alias("pos"), F.lit("system").alias("role"), F.col("system").alias("text"), F.col("system_tokens").alias("tokens"), F.lit(False).alias("own")))).otherwise(none)
    spans = spans.withColumn("all", F.concat(kept, F.coalesce("told", none), "turns"))
    parts = F.transform("all", lambda t: F.struct(
        F.concat(F.lit("<|"), escape(t["role"], True), F.lit("|>\n")).alias("open"), escape(t["text"]).alias("text"), (t["own"] & (t["role"] == "assistant")).alias("target")))
    spans = spans.withColumn("parts", parts)
    # Code point offsets of the targets, by a fold over the parts' lengths.
    state = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,end:bigint>>").alias("loss"))

    def step(s: Column, p: Column) -> Column:
        start = s["at"] + F.length(p["open"])
        end = start + F.length(p["text"])
        return F.struct((end + len(END)).cast("long").alias("at"), F.when(p["target"], F.concat(s["loss"], F.array(F.struct(
            start.cast("long").alias("start"), end.cast("long").alias("end"))))).otherwise(s["loss"]).alias("loss"))

    total = F.aggregate("all", F.lit(0).cast("long"), lambda a, t: a + t["tokens"])
    return spans.select(
        "conv_id", F.col("first").alias("window"), F.array_join(F.transform("parts", lambda p: F.concat(p["open"], p["text"], F.lit(END))), "").alias("formatted"),
        (F.size("all") - F.size("turns")).alias("n_repeated"), F.aggregate("parts", state, step)["loss"].alias("loss"),
        total.alias("n_tokens"), (total > budget).alias("over"))


def read_back(windows: DataFrame) -> DataFrame:
    """(conv_id, window, turns, loss_texts): each window's own turns as (role, text), and the texts under its mask, unescaped."""
    pieces = F.split("formatted", r"<\|end\|>\n", -1)
    own = F.slice(pieces, F.col("n_repeated") + 1, F.size(pieces) - 1 - F.col("n_repeated"))
    turns = F.transform(own, lambda p: F.struct(
        unescape(F.substring_index(F.substr(p, F.lit(3)), "|>\n", 1), True).alias("role"),
        unescape(F.substr(p, F.length(F.substring_index(p, "|>\n", 1)) + 4)).alias("text")))
    loss = F.transform("loss", lambda s: unescape(F.substr(F.col("formatted"), (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int"))))
    return windows.select("conv_id", "window", turns.alias("turns"), loss.alias("loss_texts"), F.length("formatted").alias("chars"))
