"""Exact deduplication by progressive refinement: length, then prefix hash, then full hash.

Three readings of the texts, each of which does more for fewer rows: lengths of all rows; prefix hashes of
the rows whose length occurs again; full hashes of the rows whose (length, prefix hash) occurs again.  The
keys that occur again reach the next reading as a filter of at most 2**FILTER_BITS bits, so its broadcast
has a fixed bound and no text is shuffled; a bit that also stands for a unique row only makes that row be
hashed in vain.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .groups import bit_words, flagged, joined
from .scratch import written

PREFIX_CHARS = 256


def normalised(text: Column) -> Column:
    """Every run of white space as one space; null as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]{2,}|[\x09-\x0D]", " ")


def _prefix(norm: Column) -> Column:
    return F.xxhash64(F.substring(norm, 1, PREFIX_CHARS))


def _sized(docs: DataFrame, text: Column) -> DataFrame:
    return docs.withColumn("norm", normalised(text)).withColumn("size", F.length("norm").cast("long"))


def survivors(texts: DataFrame) -> DataFrame:
    """The filter of the (length, prefix hash) pairs that several rows of texts(norm, size) have."""
    lengths = texts.groupBy("size").agg(F.count("*").alias("n")).where("n > 1")  # combined before the shuffle, however large a group
    lengths = written(bit_words(lengths, F.col("size")), "lengths")
    heads = flagged(texts, F.col("size"), lengths, "again").where("again").select("size", _prefix(F.col("norm")).alias("prefix"))
    pairs = heads.groupBy("size", "prefix").agg(F.count("*").alias("n")).where("n > 1")
    return written(bit_words(pairs, F.xxhash64("size", "prefix")), "prefixes")


def _refined(texts: DataFrame) -> DataFrame:
    """texts(..., norm, size) with again: whether the row's length and prefix occur again."""
    words = survivors(texts.select("norm", "size"))
    return flagged(texts, F.xxhash64(F.col("size"), _prefix(F.col("norm"))), words, "again")


def exact_dedup(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", digest: bool = False) -> DataFrame:
    """(doc_id, keep_id, group_size, kept), with digest also text_sha256, a row for each row of docs.

    Texts are equal if identical once normalised; null is the empty text, which is a text like others.
    Of equal texts the row with the least id is kept; ids that are null come last, and of rows that
    repeat an id one is kept.  An empty table gives an empty table.  Other columns are not read.
    text_sha256 is the full hash, which is then taken of every row.
    """
    texts = _sized(docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text")), F.col("text")).drop("text")
    rows = _refined(texts)
    full = F.sha2("norm", 256)
    rows = rows.select("doc_id", "size", "again", (full if digest else F.when(F.col("again"), full)).alias("full"))
    rows = written(rows.withColumn("row", F.monotonically_increasing_id()), "hashes")

    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id"), F.col("row"))).alias("first")
    groups = written(rows.where("again").groupBy("size", "full").agg(F.count("*").alias("n"), first).where("n > 1"), "groups")
    out = joined(rows, groups, ["size", "full"], "n", F.col("again"))
    return out.select(
        "doc_id", F.when(F.col("n").isNull(), F.col("doc_id")).otherwise(F.col("first.doc_id")).alias("keep_id"), F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
        F.coalesce(F.col("first.row") == F.col("row"), F.lit(True)).alias("kept"), *([F.col("full").alias("text_sha256")] if digest else []),
    )


def drop_copies(docs: DataFrame) -> DataFrame:
    """The kept rows of docs with all their columns, whatever their names.

    A row whose id is null stays, as no decision can name it; of rows that repeat an id and a text one
    stays.  An empty table gives an empty table.  Rows whose length and prefix are unique stay where they
    are; of the others one row for each text leaves a task, so a large group of copies isn't moved.
    """
    rows = docs.select(F.struct(*docs.columns).alias("whole"), F.col("doc_id").alias("id"), F.col("text").alias("text"))
    rows = _refined(_sized(rows, F.col("text")).drop("text"))
    alone = rows.where(~F.col("again") | F.col("id").isNull()).select("whole.*")
    several = rows.where(F.col("again") & F.col("id").isNotNull())
    first = several.groupBy("size", F.sha2("norm", 256).alias("full")).agg(F.min_by("whole", "id").alias("whole"))
    return alone.union(first.select("whole.*"))
