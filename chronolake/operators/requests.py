"""Pull requests, reviews, checks and merges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def request_rows(requests: DataFrame) -> DataFrame:
    """Requests with their labels, a JSON array, as an array; labels that aren't one are none."""
    labels = F.coalesce(F.from_json("labels", "array<string>"), F.array().cast("array<string>"))
    return requests.select("number", "title", "status", "source_branch", "target_branch", "author", labels.alias("labels"), "source_sha", "merge_commit_sha")


def listed(requests: DataFrame, **wanted: str) -> DataFrame:
    """Requests whose columns have the wanted values."""
    out = requests
    for column, value in wanted.items():
        out = out.where(F.col(column) == value)
    return out


def summaries(requests: DataFrame, files: DataFrame) -> DataFrame:
    """(number, files, additions, deletions) of requests(number, k) by the changes of commit k; lines of binary files count 0."""
    lines = lambda c: F.coalesce(F.sum(F.when(~F.col("is_binary"), F.col(c))), F.lit(0)).alias({"added": "additions", "removed": "deletions"}[c])
    changes = files.groupBy("k").agg(F.count("*").alias("files"), lines("added"), lines("removed"))
    zero = {c: F.coalesce(c, F.lit(0)) for c in ("files", "additions", "deletions")}
    return requests.select("number", "k").join(changes, "k", "left").withColumns(zero).select("number", *zero)


def missing_checks(requests: DataFrame, required: list[str]) -> DataFrame:
    """(number, missing) of requests(number, passed): required checks that haven't passed, in their order."""
    return requests.select("number", F.array_except(F.array(*map(F.lit, required)), F.coalesce("passed", F.array().cast("array<string>"))).alias("missing"))


def merge_totals(merged: DataFrame, keys: list[str]) -> DataFrame:
    """Of a three-way merge(keys, path, result, blob) with the paths' old blobs as base: files added, modified and deleted, and conflicts."""
    has, had = F.col("blob").isNotNull(), F.col("base").isNotNull()
    taken = F.col("result").isin("same", "ours", "theirs")
    count = lambda c, name: F.count_if(c).alias(name)
    return merged.groupBy(*keys).agg(
        count(taken & has & ~had, "added"), count(taken & has & had & (F.col("blob") != F.col("base")), "modified"), count((F.col("result") == "deleted") & had, "deleted"), count(~taken & (F.col("result") != "deleted"), "conflicts")
    )


def after_status_changes(requests: DataFrame, changes: DataFrame) -> DataFrame:
    """requests(number, status) after changes(number, id, status) in order of id: merged is final; a change of a merged one has no effect."""
    end = F.min(F.when(F.col("status") == "merged", F.struct("id", "status")))["status"]
    last = changes.groupBy("number").agg(F.coalesce(end, F.max_by("status", "id")).alias("changed"))
    return requests.select("number", "status").join(last, "number", "left").select("number", F.when(F.col("status") == "merged", F.col("status")).otherwise(F.coalesce("changed", "status")).alias("status"))
