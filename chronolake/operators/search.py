"""Search, status, mirrors, tag peeling and as-of look-ups."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronolake.functions import text
from chronolake.sources.staging import staged_counted

#: A chain of more tags can only be a loop.
MOST_TAGS = 1000


def search(commits: DataFrame, refs: DataFrame, words: str, most: int | None = None) -> DataFrame:
    """(kind, id, title): commits by message or author, branches and tags by name, that contain words in any case; the first most, or all."""
    has = lambda c: F.contains(F.lower(c), F.lit(words.lower()))
    found = commits.where(has("message") | has("author_name")).select(F.lit("commit").alias("kind"), F.left("sha", F.lit(7)).alias("id"), text.subject(F.col("message")).alias("title"))
    named = refs.where(F.col("name").rlike("^refs/(heads|tags)/") & has("name")).select(text.ref_kind(F.col("name")).alias("kind"), text.short_ref(F.col("name")).alias("id"), F.col("name").alias("title"))
    out = found.union(named)
    return out if most is None else out.orderBy("kind", "title", "id").limit(most)


def status(head: DataFrame, index: DataFrame, work: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, path, staged, unstaged) of trees(keys, path, blob): A, M, D against head, and against the index, with ?? for paths that only the work tree has."""
    side = lambda df, n: df.select(*keys, F.lit(n).alias("side"), "path", "blob")
    return status_of(side(head, "head").union(side(index, "index")).union(side(work, "work")), keys)


def status_of(sides: DataFrame, keys: list[str]) -> DataFrame:
    """status of the trees head, index and work as one table (keys, side, path, blob), so a shuffle of it is enough, or none where it is dealt by the keys."""
    blob = lambda side: F.max(F.when(F.col("side") == side, F.col("blob"))).alias(side[0])
    rows = sides.groupBy(*keys, "path").agg(blob("head"), blob("index"), blob("work"))
    change = lambda a, b: F.when(F.col(a).isNull() & F.col(b).isNotNull(), "A").when(F.col(a).isNotNull() & F.col(b).isNull(), "D").when(F.col(a) != F.col(b), "M")
    unstaged = F.when(F.col("h").isNull() & F.col("i").isNull(), "??").otherwise(change("i", "w"))
    return rows.select(*keys, "path", change("h", "i").alias("staged"), unstaged.alias("unstaged")).where("staged is not null or unstaged is not null")


def mirror_plan(remote: DataFrame, local: DataFrame, strategy: str = "source-wins") -> DataFrame:
    """(name, action): what a pull does with each remote ref(name, sha): skip, create, update, or keep and conflict by strategy."""
    rows = remote.select("name", F.col("sha").alias("r")).join(local.select("name", F.col("sha").alias("l")), "name", "left")
    otherwise = {"source-wins": "update", "target-wins": "keep", "error": "conflict"}[strategy]
    return rows.select("name", F.when(F.col("l").isNull(), "create").when(F.col("l") == F.col("r"), "skip").otherwise(otherwise).alias("action"))


def peeled(refs: DataFrame, tags: DataFrame) -> DataFrame:
    """(name, target, peeled): refs(name, target) with what an annotated tag(sha, object) finally names, however long the chain; tags that name each other raise."""
    out = refs.select("name", "target", F.col("target").alias("peeled"))
    steps = tags.select(F.col("sha").alias("at"), "object")
    rounds, open_tags = 0, 1
    while open_tags:
        out, _, _ = staged_counted(out.join(steps, F.col("peeled") == F.col("at"), "left").select("name", "target", F.coalesce("object", "peeled").alias("peeled")), "peeled")
        open_tags = out.join(steps, F.col("peeled") == F.col("at"), "left_semi").limit(1).count()
        rounds += 1
        if rounds > MOST_TAGS:
            raise ValueError("tags name each other")
    return out


def as_of(points: DataFrame, history: DataFrame, key: str, at: str, value: str) -> DataFrame:
    """points(key, at) with the last value of history(key, at, value) at or before it; one union and one window per key, no range join."""
    both = points.select(key, at, F.lit(1).alias("side"), F.lit(None).cast(history.schema[value].dataType).alias(value)).union(history.select(key, at, F.lit(0).alias("side"), value))
    before = Window.partitionBy(key).orderBy(at, "side").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("found", F.last(value, ignorenulls=True).over(before)).where("side = 1").select(key, at, F.col("found").alias(value))


def changes_since(log: DataFrame, version: int, most: int = 1000) -> DataFrame:
    """The next page of a log after a consumer's version."""
    return log.where(F.col("version") > version).orderBy("version").limit(most)

