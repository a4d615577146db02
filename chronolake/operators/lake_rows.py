"""The rows of the lake's exported tables, whole: commits, refs, files and repositories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronolake.functions import text


def _ms(c: Column) -> Column:
    return F.unix_millis(c.cast("timestamp"))


def commit_rows(commits: DataFrame, parent_sha) -> DataFrame:
    """14 columns; parent_shas is a JSON array; parent_sha gives the sha of a parent key."""
    return commits.select(
        "sha", "tree_sha", F.to_json(F.transform("parents", parent_sha)).alias("parent_shas"), "author_name", "author_email", _ms(F.col("author_date")).alias("author_date"), "committer_name", "committer_email",
        _ms(F.col("committer_date")).alias("committer_date"), "message", text.subject(F.col("message")).alias("message_subject"), "repository", "gpg_signature", (F.size("parents") > 1).alias("is_merge"),
    )


def ref_rows(refs: DataFrame, snapshot_ms: int, head: str, default: str) -> DataFrame:
    """15 columns; head and default are full names."""
    return refs.select(
        "name", text.short_ref(F.col("name")).alias("short_name"), "target_sha", text.ref_kind(F.col("name")).alias("ref_type"), (F.col("name") == head).alias("is_head"), (F.col("name") == default).alias("is_default"), "upstream",
        "ahead", "behind", "tag_message", "tagger_name", "tagger_email", F.col("tagger_ms").alias("tagger_date"), "repository", F.lit(snapshot_ms).cast("long").alias("snapshot_time"),
    )


def file_rows(files: DataFrame, commits: DataFrame) -> DataFrame:
    """18 columns of files(k, ...) of commits(k, sha, repository); a side that a change doesn't have is null, as are lines of binary files."""
    kind, plain = F.col("change_type"), lambda c: F.when(~F.col("is_binary"), F.col(c))
    old, new = lambda c: F.when(kind != "A", F.col(c)), lambda c: F.when(kind != "D", F.col(c))
    return files.join(commits.select("k", F.col("sha").alias("commit_sha"), "repository"), "k").select(
        "commit_sha", "path", F.when(kind == "R", F.concat("path", F.lit(".orig"))).alias("old_path"), "change_type", "is_binary", plain("added").alias("lines_added"), plain("removed").alias("lines_removed"),
        old("old_size").alias("old_size"), new("new_size").alias("new_size"), old("old_blob_sha").alias("old_blob_sha"), new("new_blob_sha").alias("new_blob_sha"), old("mode").alias("old_mode"), new("mode").alias("new_mode"),
        F.when(kind == "R", (50 + F.col("added") % 50).cast("int")).alias("similarity"), text.extension(F.col("path")).alias("extension"), text.directory(F.col("path")).alias("directory"), "repository", _ms(F.col("commit_date")).alias("commit_date"),
    )


def language_stats(paths: DataFrame, key: str) -> DataFrame:
    """(key, primary_language, languages_json) of paths(key, path): files by language, and the commonest (of several the last by name)."""
    counts = paths.select(key, text.language(F.col("path")).alias("language")).where("language is not null").groupBy(key, "language").agg(F.count("*").alias("n"))
    pairs = F.array_sort(F.collect_list(F.struct("language", "n")))
    return counts.groupBy(key).agg(F.max_by("language", F.struct("n", "language")).alias("primary_language"), F.to_json(F.map_from_entries(pairs)).alias("languages_json"))


REPOSITORY_COLUMNS = (
    "full_name source source_id clone_url html_url default_branch visibility is_fork parent_full_name description owner_name owner_type created_at first_synced_at last_synced_at last_push_at sync_status last_error webhook_active webhook_id "
    "head_sha head_ref commit_count branch_count tag_count contributor_count file_count size_bytes pack_size_bytes primary_language languages_json do_id namespace"
).split()


def repository_rows(repositories: DataFrame) -> DataFrame:
    """33 columns; the namespace and its id follow from source and name, counts that are missing are 0."""
    name = text.namespace(F.col("source"), F.col("full_name"))
    counts = ["commit_count", "branch_count", "tag_count", "contributor_count"]
    return repositories.withColumns({c: F.coalesce(c, F.lit(0)).cast("long") for c in counts} | {"namespace": name, "do_id": F.sha1(name.cast("binary"))}).select(*REPOSITORY_COLUMNS)
