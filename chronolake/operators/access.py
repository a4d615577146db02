"""Verdicts: permissions, branch protection, reviews, rate limits."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronolake.functions import text

#: Levels in order, and the level each operation asks for.
LEVELS = ["none", "read", "write", "admin"]
NEEDED = {"fetch": "read", "clone": "read", "push": "write", "create_branch": "write", "delete_branch": "write", "force_push": "admin", "configure": "admin"}


def level(name: Column) -> Column:
    return F.coalesce(F.array_position(F.array(*map(F.lit, LEVELS)), F.lower(name)), F.lit(1)).cast("int") - 1


def level_name(number: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, LEVELS)), number + 1)


def effective_permissions(requests: DataFrame, grants: DataFrame, defaults: DataFrame, now) -> DataFrame:
    """(user, repository, op, level, allowed): the highest of a grant that hasn't expired, the repository's default, and read if it is public.

    requests(user, repository, op); grants(user, repository, granted, expires_at); defaults(repository, default_level, is_public)."""
    live = grants.where(F.col("expires_at").isNull() | (F.col("expires_at") > F.lit(now).cast("timestamp"))).groupBy("user", "repository").agg(F.max(level(F.col("granted"))).alias("own"))
    rows = requests.join(live, ["user", "repository"], "left").join(defaults, "repository", "left")
    best = F.greatest(F.coalesce("own", F.lit(0)), F.coalesce(level(F.col("default_level")), F.lit(0)), F.when(F.col("is_public"), 1).otherwise(0))
    need = F.lit(3)
    for op, asked in NEEDED.items():
        need = F.when(F.col("op") == op, LEVELS.index(asked)).otherwise(need)
    return rows.select("user", "repository", "op", level_name(best).alias("level"), (best >= need).alias("allowed"))


def protection_verdicts(updates: DataFrame, rules: list[dict]) -> DataFrame:
    """updates(name, is_delete, is_force, approvals) with the most specific fitting rule and the first reason against it.

    rules: pattern, and any of no_delete, no_force, approvals.  Exact names come before globs, fewer * before more."""
    rank = lambda r: (-(r["pattern"].count("*") == 0), r["pattern"].count("*"), -len(r["pattern"]))
    pattern, reason = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=rank, reverse=True):
        fits = F.col("name").rlike(text.ref_glob_regex(r["pattern"]))
        why = F.when(F.col("is_delete") & F.lit(r.get("no_delete", False)), "delete").when(F.col("is_force") & F.lit(r.get("no_force", False)), "force-push").when(F.col("approvals") < r.get("approvals", 0), "reviews")
        pattern, reason = F.when(fits, r["pattern"]).otherwise(pattern), F.when(fits, why).otherwise(reason)
    return updates.select("name", pattern.alias("rule"), F.coalesce(reason, F.lit("ok")).alias("verdict"))


def review_state(reviews: DataFrame) -> DataFrame:
    """(pr, state): of the last review of each reviewer, changes_requested wins, then approved; else pending."""
    last = reviews.groupBy("pr", "reviewer").agg(F.max_by("state", "id").alias("state"))
    any_of = lambda s: F.bool_or(F.col("state") == s)
    return last.groupBy("pr").agg(F.when(any_of("changes_requested"), "changes_requested").when(any_of("approved"), "approved").otherwise("pending").alias("state"))


def page(rows: DataFrame, order: list[Column], limit: int = 50, offset: int = 0) -> DataFrame:
    return rows.orderBy(*order).offset(offset).limit(limit)


def rate_limited(hits: DataFrame, limit: int, window_ms: int) -> DataFrame:
    """hits(key, id, ms) with allowed: a window opens at a key's first hit and again at the first hit after it has passed.

    Where a window opens depends on the one before, so hits are walked in order; the walk streams over sorted
    partitions and holds one batch and the state of one key."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key = start = None
        count = 0
        for pdf in batches:
            allowed = []
            for k, ms in zip(pdf["key"], pdf["ms"], strict=True):
                if k != key or ms - start >= window_ms:
                    key, start, count = k, ms, 0
                count += 1
                allowed.append(count <= limit)
            yield pdf.assign(allowed=allowed)

    rows = hits.select("key", "id", "ms").repartition("key").sortWithinPartitions("key", "ms", "id")
    return rows.mapInPandas(run, "key long, id long, ms long, allowed boolean")


def pattern_regex(pattern: str) -> str:
    """Anchored regular expression of a protection pattern: ** crosses slashes, * doesn't, and * alone is everything."""
    if pattern == "*":
        return "(?s)^.*$"
    return "^" + "".join({"**": ".*", "*": "[^/]*"}.get(part, re.escape(part)) for part in re.split(r"(\*\*|\*)", pattern)) + "$"


def first_block(updates: DataFrame, rules: list[dict]) -> DataFrame:
    """(name, reason) of updates(name, is_delete, is_create, is_force): `pattern: why` of the first enabled rule that stands against one; null if none does.

    rules: pattern, enabled, no_delete, no_force, reviews.  Deletions are barred by no_delete; forced changes by no_force; and what isn't a deletion by reviews."""
    reason = F.lit(None).cast("string")
    for r in reversed([r for r in rules if r["enabled"]]):
        fits = F.col("name").rlike(pattern_regex(r["pattern"]))
        why = F.when(F.col("is_delete") & F.lit(r["no_delete"]), "deletion").when(~F.col("is_delete") & ~F.col("is_create") & F.col("is_force") & F.lit(r["no_force"]), "force push").when(~F.col("is_delete") & F.lit(r["reviews"] > 0), "reviews")
        reason = F.when(fits & why.isNotNull(), F.concat(F.lit(f"{r['pattern']}: "), why)).otherwise(reason)
    return updates.select("name", reason.alias("reason"))


def specificity(pattern: str) -> int:
    """Ten for each character, less 100 for each ** and 10 for each *; names without a * come before all."""
    double = pattern.count("**")
    return len(pattern) * 10 - 100 * double - 10 * (pattern.count("*") - 2 * double)


def specific_rule(refs: DataFrame, patterns: list[str]) -> DataFrame:
    """(name, pattern): the most specific pattern that fits each of refs(name); of equals the first."""
    pattern = F.lit(None).cast("string")
    exact = [p for p in patterns if "*" not in p]
    for p in reversed(sorted((p for p in patterns if "*" in p), key=lambda p: -specificity(p))):  # a stable sort, taken from its end
        pattern = F.when(F.col("name").rlike(pattern_regex(p)), F.lit(p)).otherwise(pattern)
    for p in exact:
        pattern = F.when(F.col("name") == p, F.lit(p)).otherwise(pattern)
    return refs.select("name", pattern.alias("pattern")).where("pattern is not null")
