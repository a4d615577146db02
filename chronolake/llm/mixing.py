"""Mixing sources to target weights by hierarchical budgeting.

The tree is domain - language - source.  A budget of tokens goes down by weights.  A child that can't use
its share (its tokens times MOST_EPOCHS) leaves the rest to its siblings, by their weights; what all of
them can't use goes to the siblings of their parent, as a node never gets more than its leaves can use.
The shares are whole tokens and follow from window sums over siblings in order of capacity by weight.

A share that isn't whole is cut, and the tokens that are over go one each to the first siblings in that
order.  A leaf with a weight of 0 on any level has no capacity, so its share is usable elsewhere.

A leaf takes whole epochs, then the prefix of one more that fits its budget; each epoch has its own
seeded order.  The end of the prefix is found by sums over 256 buckets of a leaf's rows by rank, then over
256 parts of the one bucket in which its budget ends; only the rows of that part are ordered one by one, so
no task holds more than a 65,536th of a leaf.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import written

LEVELS = ["domain", "lang", "source"]
WORD = r"[^\x20\x09-\x0D]+"


@dataclass(frozen=True)
class Mix:
    """Weights by level and value (others weigh 1; 0 takes nothing); the budget as a percentage of all tokens."""

    weights: dict[str, dict[str, int]] = field(default_factory=lambda: {"domain": {"web": 5, "books": 3, "code": 2}, "lang": {"en": 4, "de": 2, "fr": 2, "es": 2}})
    percent: int = 60
    most_epochs: int = 3
    seed: int = 17


def domain_of(source: Column) -> Column:
    """The domain of a source, by the last digit of its name; web if it has none."""
    return F.when(source.rlike("[5-7]$"), "books").when(source.rlike("[89]$"), "code").otherwise("web")


def _weight(level: str, mix: Mix) -> Column:
    out = F.lit(1)
    for value, weight in mix.weights.get(level, {}).items():
        out = F.when(F.col(level) == value, F.lit(weight)).otherwise(out)
    return out.cast("decimal(18,0)")


def _shared_out(nodes: DataFrame, parents: list[str], level: str, mix: Mix) -> DataFrame:
    """nodes(parents, level, cap, given): adds budget, the share of given that each node gets."""
    nodes = nodes.withColumn("weight", _weight(level, mix)).where("weight > 0 and cap > 0")
    siblings = Window.partitionBy(*parents) if parents else Window.partitionBy(F.lit(0))
    order = siblings.orderBy(F.col("cap").cast("double") / F.col("weight").cast("double"), level)
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    whole = nodes.withColumns({
        "use": F.least("given", F.sum("cap").over(siblings)).cast("decimal(20,0)"),
        "below": F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("decimal(20,0)"),
        "rest": F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing)).cast("decimal(18,0)"),
    })
    full = whole.withColumn("full", F.col("cap").cast("decimal(20,0)") * F.col("rest") <= F.col("weight") * (F.col("use") - F.col("below")))
    shares = full.withColumns({
        "left": (F.col("use") - F.sum(F.when(F.col("full"), F.col("cap")).otherwise(0)).over(siblings)).cast("decimal(20,0)"),
        "open": F.sum(F.when(~F.col("full"), F.col("weight")).otherwise(0)).over(siblings).cast("decimal(18,0)"),
    })
    cut = shares.withColumn("share", F.when(~F.col("full"), F.expr("cast(weight * left div nullif(open, 0) as long)")).otherwise(0))
    cut = cut.withColumns({"over": F.col("left") - F.sum("share").over(siblings), "nth": F.sum((~F.col("full")).cast("int")).over(upto)})
    budget = F.when(F.col("full"), F.col("cap")).otherwise(F.col("share") + (F.col("nth") <= F.col("over")).cast("int"))
    return cut.select(*parents, level, "cap", budget.cast("long").alias("budget"))


def leaf_budgets(leaves: DataFrame, mix: Mix) -> DataFrame:
    """leaves(domain, lang, source, tokens) with budget, the tokens to take from each; leaves that get none are left out."""
    usable = F.lit(True)
    for level in LEVELS:
        usable = usable & (_weight(level, mix) > 0)
    leaves = leaves.withColumn("cap", F.when(usable, F.col("tokens") * mix.most_epochs).otherwise(0))
    given = None
    for depth, level in enumerate(LEVELS):
        parents = LEVELS[:depth]
        nodes = leaves.groupBy(*LEVELS[: depth + 1]).agg(F.sum("cap").alias("cap"), F.sum("tokens").alias("tokens"))
        if given is None:
            everything = F.sum("tokens").over(Window.partitionBy(F.lit(0))).cast("decimal(20,0)")  # a row for each domain
            nodes = nodes.withColumn("everything", everything).withColumn("given", F.expr(f"cast(everything * {mix.percent} div 100 as long)"))
        else:
            nodes = nodes.join(given, parents)
        given = _shared_out(nodes, parents, level, mix).select(*LEVELS[: depth + 1], F.col("budget").alias("given"))
    return leaves.join(given.withColumnRenamed("given", "budget"), LEVELS).where("budget > 0").select(*LEVELS, "tokens", "budget")


def _ending(rows: DataFrame, place: str, keep: list[str]) -> DataFrame:
    """For each leaf the place (a bucket of rows(leaf, part, before, place, n_tokens)) in which its prefix ends, and the tokens before it."""
    sums = rows.groupBy(*LEVELS, *keep, place).agg(F.sum("n_tokens").alias("inside"))
    before = Window.partitionBy(*LEVELS).orderBy(place).rowsBetween(Window.unboundedPreceding, -1)  # 256 rows a leaf at most
    sums = sums.withColumn("sofar", F.col("before") + F.coalesce(F.sum("inside").over(before), F.lit(0)))
    return sums.where("sofar <= part and sofar + inside > part")


def mixed(docs: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """(doc_id, domain, lang, source, n_tokens, copies): the rows to take, copies times each.

    Tokens are words between white space.  A null language or source is a value of its own, shown as
    empty; null and empty texts have no tokens and are taken only with whole epochs, or where they come
    before the end of a prefix.  Repeated rows count each; rows with a null id share one place in an
    order.  An empty table gives an empty table.
    """
    source = F.coalesce(F.col("source").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id"), domain_of(source).alias("domain"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("lang"), source.alias("source"), F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD)).cast("long").alias("n_tokens"))
    rows = written(rows, "leaves")
    leaves = rows.groupBy(*LEVELS).agg(F.sum("n_tokens").alias("tokens"))
    budgets = leaf_budgets(leaves, mix).selectExpr(*LEVELS, "budget div tokens as whole", "budget - tokens * (budget div tokens) as part")
    budgets = written(budgets, "budgets")
    rank = F.md5(F.concat_ws(":", F.lit(mix.seed), F.col("whole"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"))
    ranked = lambda leaves: rows.join(leaves, LEVELS).withColumn("rank", rank).withColumns({"bucket": F.substring("rank", 1, 2), "place": F.substring("rank", 1, 4)})
    open_leaves = budgets.where("part > 0").withColumn("before", F.lit(0).cast("long"))
    ends = written(_ending(ranked(open_leaves), "bucket", ["whole", "part", "before"]).select(*LEVELS, "whole", "part", F.col("sofar").alias("before"), F.col("bucket").alias("at")), "buckets")
    ends = _ending(ranked(ends).where("bucket = at"), "place", ["whole", "part", "before"]).select(*LEVELS, F.col("sofar").alias("before"), F.col("place").alias("end"))
    leaves = written(budgets.join(ends, LEVELS, "left"), "ends")
    out = ranked(leaves)
    up_to = Window.partitionBy(*LEVELS).orderBy("rank", "n_tokens").rowsBetween(Window.unboundedPreceding, 0)
    edge = out.where("place = end").withColumn("more", (F.col("before") + F.sum("n_tokens").over(up_to) <= F.col("part")).cast("int"))
    plain = out.where("end is null or place <> end").withColumn("more", F.coalesce(F.col("place") < F.col("end"), F.lit(False)).cast("int"))
    out = plain.unionByName(edge).withColumn("copies", F.col("whole") + F.col("more"))
    return out.where("copies > 0").select("doc_id", *LEVELS, "n_tokens", "copies")
