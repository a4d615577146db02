"""The corpus pipeline: five operators, each on all that its predecessor kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame.  Between stages the rows are written as
Parquet in the shared folder and read again.  All but the last return the columns of documents.

In every stage a null text counts as empty, texts of any length are taken whole, an empty table gives an
empty table, and columns other than doc_id, text, lang and source may have any name and type and may be null.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from chronolake.llm import decontaminate, exact_dedup, jaccard_join, mixing, scratch, toxicity


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leaves out the documents that the noisy-or model, learned from their labels, predicts toxic.

    Each row is judged by its own text, so repeated rows go or stay together; a score of exactly the
    threshold is toxic; empty texts aren't; rows with a null id stay."""
    return toxicity.drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts equal but for white space, the row with the least doc_id stays.

    Empty texts are equal to each other; of rows that repeat an id and a text one stays; rows with a null id stay."""
    return exact_dedup.drop_copies(docs)


def keep_one_of_similar(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of documents linked by a Jaccard similarity of 0.8 of five-word shingles, the least doc_id stays.

    Empty texts are linked with nothing and stay; rows that repeat an id go or stay together; rows with a null id stay."""
    return jaccard_join.keep_one_of_each(docs, k=5, percent=80)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leaves out the documents that hold a benchmark item.

    Each row is judged by its own text, so repeated rows go or stay together; empty texts and items hold
    nothing; a similarity of exactly the threshold is a leak; rows with a null id stay."""
    return decontaminate.drop_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes documents from the domain-language-source tree by target weights: (doc_id, domain, lang, source, n_tokens, copies).

    A null language or source is a value of its own; repeated rows count each; of rows with the same rank
    the shorter comes first; empty texts are taken with whole epochs, or where they come before the end of a prefix."""
    return mixing.mixed(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("ngram_jaccard_join", keep_one_of_similar),
    ("benchmark_decontamination", drop_leaks),
    ("source_mixing", mix_sources),
]
#: Toxicity and similarity are learned and searched for, which SQL can't express; tests hold the rows against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = scratch.written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
