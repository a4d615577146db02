"""Analytics over commits and files: frequency, contributors, languages, hot files, churn, logs."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronolake.functions import text
from chronolake.operators.storage import numbered


def half_up_percent(part: Column, whole: Column) -> Column:
    """Percentage with one digit, half up; 0 of nothing."""
    return F.when(whole == 0, F.lit(0.0)).otherwise(F.floor(part * 1000.0 / whole + 0.5) / 10.0)


def commit_frequency(commits: DataFrame) -> DataFrame:
    return commits.groupBy(F.date_format("author_date", "yyyy-MM-dd").alias("date")).agg(F.count("*").alias("commits"))


def contributors(commits: DataFrame) -> DataFrame:
    """One row for each address in lower case, with the name of its first commit."""
    first = F.struct("author_date", "k")
    return commits.groupBy(F.lower("author_email").alias("email")).agg(
        F.min_by("author_name", first).alias("name"), F.count("*").alias("commits"), F.min("author_date").alias("first_commit"), F.max("author_date").alias("last_commit")
    )


def language_breakdown(paths: DataFrame) -> DataFrame:
    counted = paths.select(text.language(F.col("path")).alias("language")).where("language is not null").groupBy("language").agg(F.count("*").alias("files"))
    return counted.withColumn("percentage", half_up_percent(F.col("files"), F.sum("files").over(Window.partitionBy(F.lit(0)))))  # a row for each language


def hot_files(files: DataFrame, most: int = 50) -> DataFrame:
    return files.groupBy("path").agg(F.count("*").alias("changes")).orderBy(F.desc("changes"), "path").limit(most)


def churn_by_day(files: DataFrame) -> DataFrame:
    return files.groupBy(F.date_format("commit_date", "yyyy-MM-dd").alias("date")).agg(F.count("*").alias("files_changed"))


def churn_by_extension(files: DataFrame) -> DataFrame:
    return files.where("not is_binary").groupBy(text.extension(F.col("path")).alias("extension")).agg(F.sum("added").alias("lines_added"), F.sum("removed").alias("lines_removed"))


def commit_rows(commits: DataFrame) -> DataFrame:
    """The lake's commits table."""
    return commits.select(
        "sha", "tree_sha", F.to_json(F.transform("parents", lambda p: F.sha1(F.concat(F.lit("commit "), p.cast("string")).cast("binary")))).alias("parent_shas"), "author_name", "author_email",
        F.unix_millis(F.col("author_date").cast("timestamp")).alias("author_ms"), text.subject(F.col("message")).alias("message_subject"), text.body(F.col("message")).alias("message_body"), "repository", (F.size("parents") > 1).alias("is_merge"),
    )


def file_rows(files: DataFrame) -> DataFrame:
    """The lake's files table; line counts are null for binary files, old paths only for renames."""
    plain = lambda c: F.when(~F.col("is_binary"), F.col(c))
    return files.select(
        "k", "path", F.when(F.col("change_type") == "R", F.concat("path", F.lit(".orig"))).alias("old_path"), "change_type", "is_binary", plain("added").alias("lines_added"), plain("removed").alias("lines_removed"),
        text.extension(F.col("path")).alias("extension"), text.directory(F.col("path")).alias("directory"), text.language(F.col("path")).alias("language"),
    )


def log(commits: DataFrame, author: str | None = None, since: str | None = None, until: str | None = None, grep: str | None = None, merges: bool | None = None, skip: int = 0, limit: int | None = None) -> DataFrame:
    """Filters, then newest first; a part of name or address for author, inclusive days, a regular expression for grep."""
    out = commits
    if author:
        out = out.where(F.lower("author_name").contains(author.lower()) | F.lower("author_email").contains(author.lower()))
    if since:
        out = out.where(F.col("author_date") >= F.lit(since).cast("timestamp"))
    if until:
        out = out.where(F.col("author_date") < F.date_add(F.lit(until).cast("date"), 1).cast("timestamp"))
    if grep:
        out = out.where(F.col("message").rlike(grep))
    if merges is not None:
        out = out.where((F.size("parents") > 1) == merges)
    out = out.orderBy(F.desc("author_date"), F.desc("k"))
    if skip:
        out = out.offset(skip)
    return out if limit is None else out.limit(limit)


def matching(commits: DataFrame, name: str | None = None, author: str | None = None, committer: str | None = None, after: str | None = None, before: str | None = None, grep: str | None = None, merges: bool | None = None) -> DataFrame:
    """Commits by exact author name; by a part of the author's or committer's name or address, or a pattern where it begins with ^, in any case; after and before are exclusive; grep is a pattern over the message."""

    def person(who: str, wanted: str) -> Column:
        fits = (lambda c: F.col(c).rlike(f"(?i){wanted}")) if wanted.startswith("^") else (lambda c: F.lower(c).contains(wanted.lower()))
        return fits(f"{who}_name") | fits(f"{who}_email")

    tests = [
        None if name is None else F.col("author_name") == name, None if author is None else person("author", author), None if committer is None else person("committer", committer),
        None if after is None else F.col("author_date") > F.lit(after).cast("timestamp"), None if before is None else F.col("author_date") < F.lit(before).cast("timestamp"),
        None if grep is None else F.col("message").rlike(grep), None if merges is None else (F.size("parents") > 1) == merges,
    ]
    out = commits
    for test in tests:
        out = out if test is None else out.where(test)
    return out


def touching(commits: DataFrame, files: DataFrame, include: list[str], exclude: list[str] = ()) -> DataFrame:
    """Commits that change a path that the patterns take in."""
    return commits.join(files.where(text.path_specs(F.col("path"), include, exclude)).select("k"), "k", "left_semi")


def first_met(commits: DataFrame, reached: DataFrame, most: int) -> DataFrame:
    """commits among reached(node, depth), nearest first and of a level the newest key first; the first most of them."""
    return commits.join(reached.groupBy(F.col("node").alias("k")).agg(F.min("depth").alias("depth")), "k").orderBy("depth", F.desc("k")).limit(most)


def limited(commits: DataFrame, reached: DataFrame, most: int) -> DataFrame:
    """The first most commits by distance, then newest first, with has_more: whether there were others."""
    found = first_met(commits, reached, most + 1).withColumn("place", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("depth", F.desc("k"))))  # most + 1 rows
    return found.withColumn("has_more", F.max("place").over(Window.partitionBy(F.lit(0))) > most).where(F.col("place") <= most).drop("place").orderBy(F.desc("author_date"), F.desc("k"))


def topological(commits: DataFrame, levels: DataFrame) -> DataFrame:
    """(k, place): children before parents, as a child's level is above those of its parents; of a level the newest first."""
    rows = commits.select("k", "author_date").join(levels.withColumnRenamed("node", "k"), "k")
    return numbered(rows, [F.desc("level"), F.desc("author_date"), F.desc("k")], "place").select("k", "place")


def formatted(commits: DataFrame, form: str = "%h %s", parent_sha=None) -> DataFrame:
    """(k, line): placeholders %H %h %an %ae %ad %cn %ce %s %b %P, replaced in one pass; the date is the author's; parent_sha gives the sha of a parent key."""
    body = F.regexp_replace(text.body(F.col("message")), r"\A(?:[ \t]*\n)+", "")
    values = {
        "%H": F.col("sha"), "%h": F.left("sha", F.lit(7)), "%an": F.col("author_name"), "%ae": F.col("author_email"), "%ad": F.date_format("author_date", "yyyy-MM-dd HH:mm:ss"), "%cn": F.col("committer_name"), "%ce": F.col("committer_email"),
        "%s": text.subject(F.col("message")), "%b": body,
    }
    if parent_sha:
        values["%P"] = F.array_join(F.transform("parents", parent_sha), " ")
    parts = [values.get(p, F.lit(p)) for p in re.split("(%an|%ae|%ad|%cn|%ce|%H|%h|%s|%b|%P)", form) if p]
    return commits.select("k", F.concat(*parts).alias("line"))


def pair_churn(commits: DataFrame, files: DataFrame) -> DataFrame:
    """(day, files): files of commits that have a parent in the table, by day of the commit."""
    own = commits.where(F.size("parents") > 0).select("k", F.col("parents")[0].alias("p"), "author_date")
    known = own.join(commits.select(F.col("k").alias("p")), "p", "left_semi")
    return known.join(files.select("k"), "k").groupBy(F.date_format("author_date", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("files"))


def empty_commits(commits: DataFrame, tree: str = "tree_sha") -> DataFrame:
    """Commits whose tree is that of their first parent."""
    parent = commits.select(F.col("k").alias("p"), F.col(tree).alias("parent_tree"))
    return commits.where(F.size("parents") > 0).withColumn("p", F.col("parents")[0]).join(parent, "p").where(F.col(tree) == F.col("parent_tree")).select("k")


def graph_columns(rows: list[tuple[object, list[object]]]) -> list[str]:
    """For (commit, parents) from the newest on: a line with * in the commit's column and | in those of other open lines."""
    open_lines: list[object] = []
    out = []
    for commit, parents in rows:
        if commit not in open_lines:
            open_lines.append(commit)
        at = open_lines.index(commit)
        out.append(" ".join("*" if i == at else "|" for i in range(len(open_lines))))
        open_lines[at : at + 1] = [p for p in parents if p not in open_lines]
    return out


def with_graph(commits: DataFrame, most: int) -> DataFrame:
    """(place, k, graph) of the newest commits by key, as a page of a log shows them; a page is walked in order in one task."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        page = pd.concat(batches, ignore_index=True).sort_values("k", ascending=False, ignore_index=True)
        graph = graph_columns([(k, list(p)) for k, p in zip(page["k"], page["parents"], strict=True)])
        yield pd.DataFrame({"place": range(1, len(page) + 1), "k": page["k"], "graph": graph})

    page = commits.select("k", "parents").orderBy(F.desc("k")).limit(most).coalesce(1)
    return page.mapInPandas(run, "place int, k long, graph string")
