"""A corpus pipeline of five stages: toxicity, line dedup, near-dedup, decontamination, packing.

Each stage gets the rows its predecessor kept, makes its own decisions on all
of them, and its result is written as Parquet before the next one reads it.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm import decontam, linedup, packing, similar, toxicity
from loomgraph.llm.util import materialize, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _recount(docs: DataFrame) -> DataFrame:
    """The columns of documents, with n_chars of the text as it is now."""
    return docs.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on the labelled ones, gives a score of at least 0.5 go."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.score_documents(docs.select(*COLUMNS), model, out="__toxic").where("__toxic < 0.5").select(*COLUMNS)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Line runs of at least 50 words that occur earlier are cut from later documents."""
    return _recount(linedup.remove_repeated_runs(docs.select(*COLUMNS), min_words=50))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: that of the smallest id."""
    return similar.drop_near_duplicates(docs.select(*COLUMNS), min_similarity=0.8, shingle=5).select(*COLUMNS)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark passages are cut from the texts; documents that mostly consist of them go."""
    return _recount(decontam.remove_contamination(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"), n=10))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 4096 tokens: one row per piece of a document, with its place."""
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), 4096, 1, keep_tokens=False)


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_repeated_lines),
    ("simhash near-dedup", drop_near_duplicates),
    ("decontamination", drop_benchmark),
    ("packing", pack),
]

#: Training, tokenising and packing are beyond SQL; tests/llm holds the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result but the last is stored in the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs, f"pipeline-{k}-{name.replace(' ', '-')}")
    return docs
