"""Changes of refs and pull requests as new snapshots: anti-joins and unions of the old one, which stays as it is."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronolake.functions import text
from chronolake.operators.storage import numbered

#: No status follows these.
TERMINAL = ["merged"]


def upserted(refs: DataFrame, rows: DataFrame) -> DataFrame:
    """refs(name, target) with rows put in place of those of the same name."""
    return refs.join(rows, "name", "left_anti").select("name", "target").union(rows.select("name", "target"))


def deleted(refs: DataFrame, names: DataFrame, current: str | None = None) -> DataFrame:
    """refs without names(name); the current branch stays."""
    doomed = names.select("name").where(F.col("name") != F.lit(current)) if current else names.select("name")
    return refs.join(doomed, "name", "left_anti")


def renamed(refs: DataFrame, renames: DataFrame) -> DataFrame:
    """refs after renames(name, new_name); one whose new name is taken or isn't valid is left as it is."""
    ok = renames.where(text.valid_ref_name(F.col("new_name"))).join(refs.select(F.col("name").alias("new_name")), "new_name", "left_anti")
    return refs.join(ok, "name", "left").select(F.coalesce("new_name", "name").alias("name"), "target")


def default_branch(refs: DataFrame, stored: str | None = None) -> DataFrame:
    """(name): the stored branch if there is one, else main, master, or the first by name."""
    rank = F.when(F.col("name") == F.lit(f"refs/heads/{stored}"), 0).when(F.col("name") == "refs/heads/main", 1).when(F.col("name") == "refs/heads/master", 2).otherwise(3)
    return refs.where("name like 'refs/heads/%'").agg(F.min_by("name", F.struct(rank, "name")).alias("name"))


def advertised(refs: DataFrame) -> DataFrame:
    """(place, name): HEAD first, then all refs by name."""
    return numbered(refs.select("name"), [F.col("name") != "HEAD", F.col("name")], "place").select("place", "name")


def request_status(events: DataFrame) -> DataFrame:
    """(pr, status, updates) of events(pr, id, status): the first terminal status, else the last."""
    end = F.min(F.when(F.col("status").isin(TERMINAL), F.struct("id", "status")))
    return events.groupBy("pr").agg(F.coalesce(end["status"], F.max_by("status", "id")).alias("status"), F.count("*").alias("updates"))


def created(refs: DataFrame, new: DataFrame) -> DataFrame:
    """refs with new(name, target, force) whose names are valid; one that is taken is replaced only by force."""
    ok = new.where(text.valid_ref_name(F.col("name"))).join(refs.select("name", F.lit(True).alias("taken")), "name", "left").where("taken is null or force").select("name", "target")
    return upserted(refs, ok)


def loose_over_packed(loose: DataFrame, packed: DataFrame) -> DataFrame:
    """(name, sha) of both, the loose one of a name that both have."""
    both = loose.select("name", "sha", F.lit(1).alias("rank")).union(packed.select("name", "sha", F.lit(0)))
    return both.groupBy("name").agg(F.max_by("sha", "rank").alias("sha"))
