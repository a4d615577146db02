"""Readers of the text and binary forms that refs, ref logs and objects have outside the lake."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def objects_by_sha(spark: SparkSession, path: str, sha: str) -> DataFrame:
    """Point read of an object; the scan is pruned to four columns and by the statistics of sha."""
    return spark.read.parquet(path).select("sha", "type", "storage", "raw_data").where(F.col("sha") == sha).limit(1)


def packed_refs(spark: SparkSession, path: str) -> DataFrame:
    """(name, sha, peeled) of packed-refs files: `sha SP name` lines, each maybe followed by a `^sha` line.

    The line of a tag and its peeled line are met by their place in the file, which is read whole as one
    row, as such files are small."""
    lines = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.posexplode(F.split("value", "\r?\n")).alias("n", "line")).where("line <> '' and line not like '#%'")
    after = F.lead("line").over(Window.partitionBy("file").orderBy("n"))
    lines = lines.withColumn("next", after).where("line not like '^%'")
    return lines.select(F.substring_index("line", " ", -1).alias("name"), F.substring_index("line", " ", 1).alias("sha"), F.when(F.col("next").startswith("^"), F.substring("next", 2, 40)).alias("peeled"))


def ref_log_lines(lines: DataFrame, line: str = "value") -> DataFrame:
    """(old_sha, new_sha, name, email, seconds, zone, message) of `old new Name <email> seconds zone\\tmessage` lines; others are left out."""
    form = r"^([0-9a-f]{40}) ([0-9a-f]{40}) (.*) <([^>]*)> (\d+) ([+-]\d{4})(?:\t(.*))?$"
    part = lambda i: F.regexp_extract(line, form, i)
    return lines.where(F.col(line).rlike(form)).select(part(1).alias("old_sha"), part(2).alias("new_sha"), part(3).alias("name"), part(4).alias("email"), part(5).cast("long").alias("seconds"), part(6).alias("zone"), part(7).alias("message"))


def loose_objects(spark: SparkSession, path: str) -> DataFrame:
    """(path, type, size, content) of zlib-compressed object files."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import zlib

        for batch in batches:
            rows = []
            for name, content in zip(batch["path"], batch["content"], strict=True):
                head, _, body = zlib.decompress(content).partition(b"\0")
                kind, _, size = head.partition(b" ")
                rows.append((name, kind.decode(), int(size), body))
            yield pd.DataFrame(rows, columns=["path", "type", "size", "content"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "path string, type string, size long, content binary")


def push_events(json: Column) -> Column:
    """Fields of a push webhook: ref, before, after, commits and the repository's name."""
    return F.from_json(json, "ref string, before string, after string, commits array<struct<id:string,message:string>>, repository struct<full_name:string>")
