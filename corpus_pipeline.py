"""Corpus pipeline: toxicity, quality rules, n-gram Jaccard join, suffix-array dedup, best-fit packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each stage's result as
Parquet into the shared folder and rereads it as the next one's docs. All stages but the last
return the columns of documents.

Defined cases of every stage: an empty table gives an empty result; nulls may stand in any column; texts of any length are judged
whole; repeated rows are rows of their own; columns beyond those of documents are carried along (by packing: not passed on), whatever
their names, so none can clash.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm import jaccard, packing, quality, substrings, toxicity
from quillon.llm.common import table, written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.5 or more go. Labels are read for learning alone.

    A null or empty text has no hits and gets the model's score of none; without labels of both kinds nothing goes; terms
    that are equally likely follow by their letters.
    """
    model = toxicity.fit(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic"))
    return toxicity.keep_clean(docs, model)


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or the threshold table go. A null, empty or blank text has under 20 words, so it goes."""
    return quality.keep_good(docs)


def keep_one_of_similar(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of similar documents the one with the least id stays.

    A text without words is like nothing and stays. Rows that share an id stay or go together, as do rows without one: they stay
    if one of them is in a group that names no id.
    """
    named = jaccard.similar(docs).select(F.col("doc_id").alias("__id"), F.col("component_id").alias("__component"))
    # Copies that share the least id are one document; a row without id stays only if nothing names its group.
    keep = named.filter(F.col("__id").eqNullSafe(F.col("__component"))).select("__id").distinct()
    return docs.join(keep, docs["doc_id"].eqNullSafe(keep["__id"]), "left_semi")


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes under strings that an earlier document holds go; the documents stay, even if nothing of their text is left.

    A null text stays null; documents of one id, or of none, are told apart by their texts.
    """
    return substrings.without_repeats(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Whole documents into sequences of at most 2048 tokens; a null or empty text is its end id alone."""
    import public_tokenizers

    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("quality_rules", drop_low_quality),
    ("jaccard_join", keep_one_of_similar),
    ("suffix_array_dedup", cut_repeats),
    ("best_fit_packing", pack),
]

#: Learnt scores and token ids are beyond SQL; tests/llm compares each stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
