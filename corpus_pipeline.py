"""A pipeline over documents: toxicity, near duplicates, repeated strings, benchmark passages, tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trialstream.llm import bpe, decontam, near_dup, suffix_dedup, toxicity
from trialstream.llm.common import scratch, table, tokenizer_path
from trialstream.llm.queries import toxicity_model


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model, trained on labelled ones among all documents, doesn't reject. Rows without a text or an id stay."""
    return toxicity.reject(docs, toxicity_model(spark, table(spark, sf_dir, "documents"), sf_dir))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates by five-word shingles: that with the smallest id."""
    return near_dup.deduplicate(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the 200-byte strings that occur more than once; a character that a cut divides goes too. Null texts stay null."""
    cut = suffix_dedup.remove_repeats(docs, whole_characters=True)
    kept = F.col("kept").cast("string")
    return cut.select(*[(kept if c == "text" else F.length(kept).cast("bigint") if c == "n_chars" else F.col("row")[c]).alias(c) for c in docs.columns])


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, with digests of them and of the decoded text."""
    return bpe.encode_decode(docs, tokenizer_path("byte_bpe_50k.json"), keep=("ids",))


STAGES = [("toxicity", drop_toxic), ("near_duplicates", drop_near_duplicates), ("repeated_strings", cut_repeats), ("decontamination", drop_contaminated), ("tokens", encode)]

#: SQL can't express the trained model, the signatures' pruning or the merges of tokens.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STAGES over the table documents, each written and read again; returns the last one's rows."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
