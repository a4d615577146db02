"""The versioned ref log: state at a version, forks, three-way merges, rollback and compare-and-swap.

Logs are append-only rows (version, ref_name, new_sha, ...); an empty new_sha deletes the ref."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronolake.operators.storage import numbered


def changes(log: DataFrame) -> DataFrame:
    """(ref_name, new_sha, version): the last entry of each ref, deletions included."""
    return log.groupBy("ref_name").agg(F.max_by("new_sha", "version").alias("new_sha"), F.max("version").alias("version"))


def state(log: DataFrame, version: int | None = None) -> DataFrame:
    """(ref_name, new_sha, version) of the refs that exist after the log, or as of a version."""
    return changes(log if version is None else log.where(F.col("version") <= version)).where("new_sha <> ''")


def rollback(log: DataFrame, version: int) -> DataFrame:
    """The log without entries from version on."""
    return log.where(F.col("version") < version)


def fork_state(parent: DataFrame, base_version: int, own: DataFrame) -> DataFrame:
    """State of a fork: the parent's prefix, then the fork's own entries, which win whatever their numbers."""
    side = lambda df, n: df.select("ref_name", "new_sha", F.struct(F.lit(n).alias("origin"), "version").alias("at"))
    both = side(parent.where(F.col("version") <= base_version), 0).union(side(own, 1))
    return both.groupBy("ref_name").agg(F.max_by("new_sha", "at").alias("new_sha"), F.max("at.origin").alias("from_fork")).where("new_sha <> ''")


def fast_forward(ours: DataFrame, theirs: DataFrame) -> str | None:
    """Which side can be taken whole, if one has no entries."""
    if ours.isEmpty():
        return "theirs"
    return "ours" if theirs.isEmpty() else None


def three_way(base: DataFrame, ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """(ref_name, outcome, new_sha): merged changes of two forks, or a divergent or delete-update conflict without a sha."""
    side = lambda df, n: changes(df).select("ref_name", F.col("new_sha").alias(n))
    rows = side(ours, "o").join(side(theirs, "t"), "ref_name", "full_outer").join(state(base).select("ref_name", F.col("new_sha").alias("b")), "ref_name", "left")
    o, t = F.col("o"), F.col("t")
    outcome = F.when(t.isNull(), "ours").when(o.isNull(), "theirs").when(o == t, "same").when((o == "") | (t == ""), "delete-update").otherwise("divergent")
    rows = rows.withColumn("outcome", outcome)
    return rows.select("ref_name", "outcome", F.when(F.col("outcome").isin("ours", "same"), o).when(F.col("outcome") == "theirs", t).alias("new_sha"), F.col("b").alias("base_sha"))


def linked(log: DataFrame) -> DataFrame:
    """The log with old_sha, the sha of the ref's entry before."""
    return log.withColumn("old_sha", F.lag("new_sha", 1, "").over(Window.partitionBy("ref_name").orderBy("version")))


def nth_newest(log: DataFrame, n: int) -> DataFrame:
    """`ref@{n}` of every ref that has so many entries."""
    nth = F.row_number().over(Window.partitionBy("ref_name").orderBy(F.desc("version")))
    return log.withColumn("nth", nth).where(F.col("nth") == n + 1).select("ref_name", "new_sha", "version")


def compare_and_swap(current: DataFrame, commands: DataFrame, atomic: bool = False) -> DataFrame:
    """commands(ref_name, expected, new_sha) with a verdict; an empty expected means that the ref must not exist; atomic: all or none."""
    rows = commands.join(current.select("ref_name", F.col("new_sha").alias("actual")), "ref_name", "left")
    rows = rows.withColumn("ok", F.coalesce("actual", F.lit("")) == F.coalesce("expected", F.lit("")))
    if atomic:
        failed = rows.where("not ok").limit(1).select(F.lit(True).alias("failed"))
        rows = rows.join(F.broadcast(failed), F.lit(True), "left").withColumn("ok", F.col("ok") & F.col("failed").isNull()).drop("failed")
    return rows.select("ref_name", "expected", "actual", "new_sha", "ok")


def applied(current: DataFrame, verdicts: DataFrame) -> DataFrame:
    """The new state after accepted commands; the old snapshot is left as it is."""
    taken = verdicts.where("ok").select("ref_name", "new_sha")
    return current.select("ref_name", "new_sha").join(taken, "ref_name", "left_anti").union(taken.where("new_sha <> ''"))


def appended(log: DataFrame, entries: DataFrame) -> DataFrame:
    """log(version, ref_name, new_sha) with entries(ref_name, new_sha), numbered on from its last version in order of name."""
    last = log.agg(F.coalesce(F.max("version"), F.lit(0)).alias("last"))  # one row
    rows = numbered(entries.select("ref_name", "new_sha"), [F.col("ref_name")], "nth").join(F.broadcast(last))
    return log.select("version", "ref_name", "new_sha").union(rows.select((F.col("last") + F.col("nth")).cast("long"), "ref_name", "new_sha"))


def merge_status(base: DataFrame, ours: DataFrame, theirs: DataFrame) -> str:
    """What a merge of theirs into ours comes to: up-to-date, fast-forward, merged or conflicted."""
    side = fast_forward(ours, theirs)
    if theirs.isEmpty():
        return "up-to-date"
    if side == "theirs":
        return "fast-forward"
    return "merged" if three_way(base, ours, theirs).where("outcome in ('divergent', 'delete-update')").isEmpty() else "conflicted"


def flushed(log: DataFrame, folder: str) -> str:
    """Writes the whole log below folder, named by its last version; the path."""
    last = log.agg(F.max("version")).first()[0] or 0
    path = f"{folder}/ref-log/{last}.parquet"
    log.write.mode("overwrite").parquet(path)
    return path
