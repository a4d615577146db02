"""Bounded filters over keys, and joins that no hot group can fill a task with; DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import written

#: Bits of a filter; its table has 2**(FILTER_BITS - 6) rows at most, so its broadcast has a fixed bound.
FILTER_BITS = 24
#: Groups that are joined by broadcast; of the others none has more than 1/HOT_GROUPS of the rows.
HOT_GROUPS = 1024


def bit_words(keys: DataFrame, key: Column) -> DataFrame:
    """(filter_word, filter_bits): a bit for each key (long) modulo 2**FILTER_BITS, 64 to a row."""
    at = F.pmod(key, F.lit(1 << FILTER_BITS))
    bits = keys.select(at.alias("at")).select(F.shiftright("at", 6).alias("filter_word"), F.expr("shiftleft(1L, cast(at % 64 as int))").alias("bit"))
    return bits.groupBy("filter_word").agg(F.bit_or("bit").alias("filter_bits"))


def flagged(rows: DataFrame, key: Column, words: DataFrame, name: str) -> DataFrame:
    """rows with a column name: false only if the key isn't among those of bit_words().  A full filter only lets more through."""
    at = F.pmod(key, F.lit(1 << FILTER_BITS))
    rows = rows.withColumn("filter_at", at).withColumn("filter_word", F.shiftright("filter_at", 6)).join(F.broadcast(words), "filter_word", "left")
    has = F.coalesce(F.getbit("filter_bits", F.expr("cast(filter_at % 64 as int)")) == 1, F.lit(False))
    return rows.withColumn(name, has).drop("filter_at", "filter_word", "filter_bits")


def largest(groups: DataFrame, keys: list[str], size: str) -> DataFrame:
    """The HOT_GROUPS largest of groups, a row for each key."""
    return written(groups.orderBy(F.desc(size), *keys).limit(HOT_GROUPS), "largest")


def joined(rows: DataFrame, groups: DataFrame, keys: list[str], size: str, wanted: Column | None = None) -> DataFrame:
    """rows left-joined with groups (a stored table, a row for each key, size rows each).

    The largest groups are met by broadcast, where the rows lie, and so are rows that aren't wanted; only
    the rest is shuffled by key, so no task gets more than about 1/HOT_GROUPS of the rows for one key."""
    near = rows.join(F.broadcast(largest(groups, keys, size).withColumn("is_hot", F.lit(True))), keys, "left")
    stay = F.coalesce(F.col("is_hot"), F.lit(False)) if wanted is None else F.coalesce(F.col("is_hot"), F.lit(False)) | ~wanted
    far = near.where(~stay).select(rows.columns).join(groups, keys, "left")
    done = near.where(stay).drop("is_hot")
    return done.unionByName(far)
