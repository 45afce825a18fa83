"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontam, htmltext, langid, linedup, oracles, packing, pii, simhash, topk, toxicity
from .util import crc32_mod, table


#: Of the registered query only; whoever uses the operator brings a key.
PII_KEY = b"loomgraph registered query"


def op1_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    contents = langid.learn(docs.select("doc_id", "text", "lang"), fold=2)
    found = langid.identify(docs.select("doc_id", "text"), contents)
    # The contract wants a learned language wherever there is a letter, so narrow margins count here too.
    l = F.col("language")
    return found.select("doc_id", (crc32_mod(F.col("doc_id"), 4) == 2).alias("held_out"), l["best"].alias("lang_pred"), l["score"].alias("score"),
                        (l["lang"] == langid.UND).alias("rejected"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = linedup.remove_repeated_runs(docs, min_words=50, removed="removed")
    return out.select("doc_id", "text", F.size("removed").alias("n_removed"), F.array_join("removed", ",").alias("removed_lines"))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    done = pii.pseudonymise_documents(docs, PII_KEY)
    return done.select("doc_id", "text", F.size("pii").alias("n_pii"), F.array_join(F.transform("pii", lambda p: p["kind"]), ",").alias("kinds"))


def op4_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = topk.scaled(table(spark, sf_dir, "embeddings"), 256)
    return topk.search(topk.build_index(vectors), vectors.where(F.col("vec_id") % 50 == 0), 5)


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), k=2, shingle=3)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontam.find_contamination(docs, table(spark, sf_dir, "benchmark"), n=10)
    c = F.col("contamination")
    names = F.array_join(F.array_sort(F.transform(c["items"], lambda i: i.cast("string"))), ",")
    return found.select("doc_id", c["n_words"].alias("n_words"), decontam.n_hit().alias("n_hit"), F.size(c["items"]).cast("long").alias("n_items"),
                        F.sha2(names, 256).alias("items_sha256"), (decontam.n_hit() > 0).alias("contaminated"))


def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = "</s>[INST] ok [/INST]"
    planted = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"),
                                    F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(probe).alias("text"))
    read = chat.read_back(chat.format_conversations(turns.unionByName(planted)))
    by = read.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("window", "turns", "loss_texts"))).alias("w"), F.sum("chars").cast("long").alias("formatted_chars"))
    every = F.flatten(F.transform("w", lambda w: w["turns"]))
    loss = F.array_join(F.flatten(F.transform("w", lambda w: w["loss_texts"])), "")
    return by.select(
        "conv_id", F.size(every).cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform(every, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"), "formatted_chars")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), fold=0)
    scored = toxicity.score_documents(docs, model)
    return scored.select("doc_id", (crc32_mod(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op9_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), 4096, 1, keep_tokens=False)


def op10_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return htmltext.extract_pages(pages).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def queries() -> dict:
    return {f.__name__: f for f in (op1_language, op2_line_dedup, op3_pii, op4_topk, op5_simhash, op6_decontaminate, op7_chat, op8_toxicity, op9_pack, op10_main_text)}


def oracle_sql() -> dict[str, str]:
    return {"op2_line_dedup": oracles.OP2, "op4_topk": oracles.OP4, "op6_decontaminate": oracles.OP6}
