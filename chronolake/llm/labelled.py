"""What the classifiers share: which labelled rows they may learn from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def held_out(doc_id: Column) -> Column:
    """True where crc32 of the id as text is a multiple of 5; those rows are never learned from."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def to_learn(labels: DataFrame, label: str) -> DataFrame:
    """(doc_id, label) of the rows that have both and aren't held out."""
    known = labels.select("doc_id", F.col(label).cast("int").alias("label"))
    return known.where(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1) & ~held_out(F.col("doc_id")))
