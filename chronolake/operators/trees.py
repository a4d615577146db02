"""Diffs, renames, copies and three-way merges of trees, for any number of trees at once (key columns first)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronolake.functions.messages import tree_order
from chronolake.functions.text import positional_similarity
from chronolake.operators.dag import reached_from
from chronolake.sources.staging import staged, staged_counted

def _status() -> Column:
    """A, D, T (other mode kind), M or null of old_blob, old_mode, new_blob and new_mode."""
    kind = lambda m: F.substring(m, 1, 3)
    return (
        F.when(F.col("old_blob").isNull(), "A").when(F.col("new_blob").isNull(), "D").when(kind("old_mode") != kind("new_mode"), "T")
        .when((F.col("old_blob") != F.col("new_blob")) | (F.col("old_mode") != F.col("new_mode")), "M")
    )


def tree_diff(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, path, status, old_blob, new_blob) of trees(keys, path, blob, mode): A, D, T (other mode kind), M."""
    side = lambda df, p: df.select(*keys, "path", F.col("blob").alias(f"{p}_blob"), F.col("mode").alias(f"{p}_mode"))
    both = side(old, "old").join(side(new, "new"), [*keys, "path"], "full_outer")
    return both.withColumn("status", _status()).where("status is not null").select(*keys, "path", "status", "old_blob", "new_blob")


def compared(sides: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, path, status, old_blob, new_blob) of two trees as one table sides(keys, path, is_new, blob, mode), paths whose status is null too.

    Unlike tree_diff, it shuffles nothing where they are dealt by the keys.  The old tree has a path once; null keys and paths equal none."""
    apart = F.when(F.greatest(*(F.col(c).isNull() for c in [*keys, "path"])), F.col("is_new")).alias("apart")
    old = lambda c: F.max(F.when(~F.col("is_new"), F.col(c))).alias(f"old_{c}")
    new = F.collect_list(F.when(F.col("is_new"), F.struct("blob", "mode"))).alias("new")
    rows = sides.groupBy(*keys, "path", apart).agg(old("blob"), old("mode"), new).withColumn("new", F.explode_outer("new"))
    rows = rows.select("*", F.col("new.blob").alias("new_blob"), F.col("new.mode").alias("new_mode"))
    return rows.select(*keys, "path", _status().alias("status"), "old_blob", "new_blob")


def diff_stats(diff: DataFrame, keys: list[str]) -> DataFrame:
    one = lambda *s: F.sum(F.col("status").isin(*s).cast("long"))
    return diff.groupBy(*keys).agg(one("A").alias("added"), one("D").alias("deleted"), one("M", "T").alias("modified"))


def exact_renames(diff: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, blob, old_path, new_path): the n-th deleted with the n-th added path of a blob, in path order, so each is used once."""
    order = lambda c: Window.partitionBy(*keys, c).orderBy("path")
    gone = diff.where("status = 'D'").select(*keys, F.col("old_blob").alias("blob"), F.col("path").alias("old_path"), F.row_number().over(order("old_blob")).alias("nth"))
    new = diff.where("status = 'A'").select(*keys, F.col("new_blob").alias("blob"), F.col("path").alias("new_path"), F.row_number().over(order("new_blob")).alias("nth"))
    return gone.join(new, [*keys, "blob", "nth"]).select(*keys, "blob", "old_path", "new_path")


def exact_copies(diff: DataFrame, old: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, new_path, source_path): added paths whose blob the old tree has; its first path with it."""
    source = old.groupBy(*keys, "blob").agg(F.min("path").alias("source_path"))
    return diff.where("status = 'A'").select(*keys, F.col("new_blob").alias("blob"), F.col("path").alias("new_path")).join(source, [*keys, "blob"]).select(*keys, "new_path", "source_path")


def similar_pairs(old: DataFrame, new: DataFrame, key: str, threshold: int = 50) -> DataFrame:
    """(key, old_path, new_path, similarity) of old and new(key, path, content) of a key (a commit) that are similar enough.

    A similarity that rounds to 50 or more needs lengths within a factor of 2.03, so only texts whose lengths
    are in the same or neighbouring powers of 2.1 meet; threshold must be 50 or more."""
    if threshold < 50:
        raise ValueError("texts whose lengths differ by more than a factor of two don't meet")
    power = F.floor(F.log(2.1, F.length("content") + 1)).cast("int")
    left = old.select(key, F.col("path").alias("old_path"), F.col("content").alias("a"), F.explode(F.array(power - 1, power, power + 1)).alias("power"))
    right = new.select(key, F.col("path").alias("new_path"), F.col("content").alias("b"), power.alias("power"))
    pairs = left.join(right, [key, "power"]).where("203 * least(length(a), length(b)) >= 100 * greatest(length(a), length(b))")
    return pairs.select(key, "old_path", "new_path", positional_similarity(F.col("a"), F.col("b")).alias("similarity")).where(F.col("similarity") >= threshold)


def similar_renames(candidates: DataFrame, key: str, threshold: int = 50) -> DataFrame:
    """candidates(key, old_path, new_path, similarity): greedy in order of old path, each side once, best similarity first.

    The pairs of one key (a commit) are decided together, as each choice bars others; the walk streams over
    sorted partitions and holds one batch and the paths that one key has used."""
    columns = [key, "old_path", "new_path", "similarity"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, done, used = None, None, set()
        for pdf in batches:
            taken = []
            for name, old, new in zip(pdf[key], pdf["old_path"], pdf["new_path"], strict=True):
                if name != now:
                    now, done, used = name, None, set()
                free = old != done and new not in used
                if free:
                    done = old
                    used.add(new)
                taken.append(free)
            yield pdf[np.array(taken, bool)]

    rows = candidates.where(F.col("similarity") >= threshold).select(*columns).repartition(key).sortWithinPartitions(key, "old_path", F.desc("similarity"), "new_path")
    return rows.mapInPandas(run, rows.schema)


def renames(old: DataFrame, new: DataFrame, key: str, threshold: int = 50) -> DataFrame:
    """(key, old_path, new_path, similarity) of paths that left old and came to new(key, path, blob, content): equal blobs first, then similar texts."""
    gone = old.join(new.select(key, "path"), [key, "path"], "left_anti")
    come = new.join(old.select(key, "path"), [key, "path"], "left_anti")
    nth = lambda df, c: df.select(key, "blob", F.col("path").alias(c), F.row_number().over(Window.partitionBy(key, "blob").orderBy("path")).alias("nth"))
    exact = nth(gone, "old_path").join(nth(come, "new_path"), [key, "blob", "nth"]).select(key, "old_path", "new_path", F.lit(100).alias("similarity"))
    left = gone.join(exact.select(key, F.col("old_path").alias("path")), [key, "path"], "left_anti")
    right = come.join(exact.select(key, F.col("new_path").alias("path")), [key, "path"], "left_anti")
    return exact.union(similar_renames(similar_pairs(left, right, key, threshold), key, threshold))


def similar_copies(old: DataFrame, new: DataFrame, key: str, threshold: int = 50) -> DataFrame:
    """(key, new_path, source_path, similarity): for each path that came to new, the most similar path of old, the first of equals."""
    come = new.join(old.select(key, "path"), [key, "path"], "left_anti")
    best = F.min_by(F.struct("old_path", "similarity"), F.struct(-F.col("similarity"), "old_path")).alias("best")
    return similar_pairs(old, come, key, threshold).groupBy(key, "new_path").agg(best).select(key, "new_path", F.col("best.old_path").alias("source_path"), "best.similarity")


def followed(starts: DataFrame, parents: DataFrame, renamed: DataFrame) -> DataFrame:
    """(start, start_path, k, path, step): starts(k, path) followed back along first parents(child, parent), by the names that
    renamed(k, old_path, new_path) says a path had before; a commit each round, for all starts at once.

    Rounds join what concerns the commits on the way, by merges, so the driver is sent no table each round."""
    tips = starts.select(F.lit(0).alias("start"), F.col("k").alias("node")).distinct()
    near = reached_from(parents.select("child", "parent", F.lit(0).alias("ord")), tips).select(F.col("node").alias("k")).distinct()
    at = starts.select(F.col("k").alias("start"), F.col("path").alias("start_path"), "k", "path", F.lit(0).alias("step"))
    links = staged(parents.select(F.col("child").alias("k"), F.col("parent").alias("next")).join(near, "k", "left_semi"), "links").hint("merge")
    names = renamed.select("k", F.col("new_path").alias("path"), F.col("old_path").alias("before")).join(near, "k", "left_semi")
    names = staged(names.dropDuplicates(["k", "path"]), "names").hint("merge")
    at, _, left = staged_counted(at, "followed")
    out = at
    while left:
        before = at.join(names, ["k", "path"], "left").join(links, "k").select("start", "start_path", F.col("next").alias("k"), F.coalesce("before", "path").alias("path"), (F.col("step") + 1).alias("step"))
        at, _, left = staged_counted(before, "followed")
        out = out.union(at)
    return out


def three_way(base: DataFrame, ours: DataFrame, theirs: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, path, result, blob): ours, theirs, same or deleted with the merged blob; or add-add, modify-delete, delete-modify, content without one."""
    side = lambda df, n: df.select(*keys, "path", F.col("blob").alias(n))
    on = [*keys, "path"]
    rows = side(base, "b").join(side(ours, "o"), on, "full_outer").join(side(theirs, "t"), on, "full_outer")
    b, o, t = (F.col(c) for c in "bot")
    eq: dict[str, Column] = {"ot": o.eqNullSafe(t), "bo": b.eqNullSafe(o), "bt": b.eqNullSafe(t)}
    result = (
        F.when(eq["ot"], F.when(o.isNull(), "deleted").otherwise("same")).when(eq["bo"], F.when(t.isNull(), "deleted").otherwise("theirs")).when(eq["bt"], F.when(o.isNull(), "deleted").otherwise("ours"))
        .when(b.isNull(), "add-add").when(t.isNull(), "modify-delete").when(o.isNull(), "delete-modify").otherwise("content")
    )
    rows = rows.withColumn("result", result)
    blob = F.when(F.col("result").isin("same", "ours"), o).when(F.col("result") == "theirs", t)
    return rows.select(*on, "result", blob.alias("blob"))


FOLDERS = ["040000", "40000"]


def flatten(trees: DataFrame, roots: DataFrame) -> DataFrame:
    """(root, path, sha, mode) of all blobs below roots(root), from entries trees(tree, name, sha, mode); by level, however many."""
    level = roots.select("root", F.col("root").alias("tree"), F.lit("").alias("prefix"))
    out, left = None, 1
    while left:
        rows, _, left = staged_counted(level.join(trees, "tree").select("root", F.concat("prefix", "name").alias("path"), "sha", "mode"), "level")
        files = rows.where(~F.col("mode").isin(FOLDERS))
        out = files if out is None else out.union(files)
        level = rows.where(F.col("mode").isin(FOLDERS)).select("root", F.col("sha").alias("tree"), F.concat("path", F.lit("/")).alias("prefix"))
    return out


def _beside(first: DataFrame, second: DataFrame, on: list[str]) -> DataFrame:
    """(on, first, second, seen): the rows of first(on, first) and of second(on, second), which have all structs of first with their keys in seen.

    Unlike a join, it shuffles nothing where both are dealt by some of the keys already."""
    none = lambda df, c: F.lit(None).cast(df.schema[c].dataType).alias(c)
    both = first.select(*on, "first", none(second, "second"), F.lit(0).alias("side")).union(second.select(*on, none(first, "first"), "second", F.lit(1).alias("side")))
    return both.withColumn("seen", F.collect_list("first").over(Window.partitionBy(*on).orderBy("side"))).drop("side")


def flatten_within(trees: DataFrame, roots: DataFrame, keys: list[str], depth: int) -> DataFrame:
    """flatten for trees(keys, tree, name, sha, mode) and roots(keys, root) that belong together by keys (a commit), and paths of at most
    depth components, or it raises: all levels are one plan, in which tables dealt by the keys stay where they are."""
    steps = trees.select(*keys, "tree", F.struct("name", "sha", "mode").alias("second"))
    at = roots.select(*keys, F.struct("root", F.lit("").alias("path"), F.col("root").alias("sha"), F.lit(FOLDERS[0]).alias("mode")).alias("first"))
    folder = lambda row: row["mode"].isin(FOLDERS)
    name = F.concat("second.name", F.when(folder(F.col("second")), "/").otherwise(""))
    entered = lambda row: F.struct(row["root"].alias("root"), F.concat(row["path"], name).alias("path"), F.col("second.sha").alias("sha"), F.col("second.mode").alias("mode"))
    for _ in range(depth):  # an entry stands in each folder that was reached, with / after folders; blobs stay
        met = _beside(at.withColumn("tree", F.col("first.sha")), steps, [*keys, "tree"])
        at = met.select(*keys, F.explode(F.when(F.col("second").isNotNull(), F.transform(F.filter("seen", folder), entered)).when(~folder(F.col("first")), F.array("first"))).alias("first"))
    deeper = F.raise_error(F.lit("a tree is deeper than was said")).cast("boolean")
    return at.where(F.when(folder(F.col("first")), deeper).otherwise(True)).select(*keys, "first.*")


def resolve_path(trees: DataFrame, wanted: DataFrame) -> DataFrame:
    """(root, path, sha, mode) of wanted(root, path), component by component; sha and mode are null where there is no such entry."""
    parts = F.split("path", "/")
    found = wanted.select("root", "path", F.col("root").alias("sha"), F.lit("040000").alias("mode"))
    depth = wanted.agg(F.max(F.size(parts))).first()[0] or 0
    steps = trees.select("tree", "name", F.col("sha").alias("next"), F.col("mode").alias("next_mode"))
    for i in range(depth):  # as many as the longest path has components
        here = found.withColumn("name", F.get(parts, F.lit(i)))
        found = here.join(steps, (F.col("sha") == F.col("tree")) & (here["name"] == steps["name"]), "left").select("root", "path", F.when(here["name"].isNull(), F.col("sha")).otherwise(F.col("next")).alias("sha"), F.when(here["name"].isNull(), F.col("mode")).otherwise(F.col("next_mode")).alias("mode"))
    return found


def resolve_within(trees: DataFrame, wanted: DataFrame, keys: list[str], depth: int) -> DataFrame:
    """resolve_path for trees(keys, tree, name, sha, mode) and wanted(keys, root, path) that belong together by keys (a commit), and paths of
    at most depth components, or it raises: all components are one plan, in which tables dealt by the keys stay where they are."""
    longer = F.raise_error(F.lit("a path is longer than was said")).cast("boolean")
    steps = trees.select(*keys, "tree", "name", F.struct("sha", "mode").alias("first"))
    at = wanted.where(F.when(F.size(F.split("path", "/")) > depth, longer).otherwise(True)).select(*keys, "root", "path", F.col("root").alias("sha"), F.lit("040000").alias("mode"))
    for i in range(depth):
        named = at.select(*keys, F.col("sha").alias("tree"), F.get(F.split("path", "/"), F.lit(i)).alias("name"), F.struct("root", "path", "sha", "mode").alias("second"))
        met = _beside(steps, named, [*keys, "tree", "name"]).where("second is not null").select(*keys, "name", "second", F.explode_outer("seen").alias("first"))
        either = lambda c: F.when(F.col("name").isNull(), F.col(f"second.{c}")).otherwise(F.col(f"first.{c}")).alias(c)
        at = met.select(*keys, "second.root", "second.path", either("sha"), either("mode"))
    return at


def _entries(entries: Column) -> Column:
    """The lines of collected (key, entry) structs in the order of tree entries, joined; key is the name, with / for directories."""
    return F.array_join(F.transform(F.array_sort(entries), lambda e: e["entry"]), "\n")


def directory_ids(tree: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, directory, id): a hash of the sorted entries of each directory that holds files."""
    folder = F.when(F.col("path").contains("/"), F.regexp_replace("path", "/[^/]*$", "")).otherwise("")
    name = F.substring_index("path", "/", -1)
    entry = F.struct(tree_order(name, F.col("mode")).alias("key"), F.concat_ws(" ", "mode", name, "blob").alias("entry"))
    return tree.groupBy(*keys, folder.alias("directory")).agg(F.sha1(_entries(F.collect_list(entry)).cast("binary")).alias("id"))


def shared_directories(ids: DataFrame) -> DataFrame:
    """(id, uses): directories with the same entries share an id."""
    return ids.groupBy("id").agg(F.count("*").alias("uses"))



def hierarchy(tree: DataFrame, keys: list[str], depth: int | None = None) -> DataFrame:
    """(keys, directory, id, entries) of every directory of trees(keys, path, blob, mode), '' for the root, from the deepest up.

    A directory's id hashes its sorted entries, subdirectories as `040000 name id`, so equal subtrees share ids.  Trees that are dealt by
    the keys are not shuffled again.  depth is the most components that a path may have, counted unless it is given."""
    parent = lambda p: F.when(p.contains("/"), F.regexp_replace(p, "/[^/]*$", "")).otherwise("")
    line = lambda mode, name, sha: F.struct(tree_order(name, mode).alias("key"), F.concat_ws(" ", mode, name, sha).alias("entry")).alias("entry")
    files = tree.select(*keys, "path", parent(F.col("path")).alias("directory"), line(F.col("mode"), F.substring_index("path", "/", -1), F.col("blob")))
    files = files.withColumn("depth", F.when(F.col("directory") == "", 0).otherwise(F.size(F.split("directory", "/"))))
    deepest = depth - 1 if depth else files.agg(F.max("depth")).first()[0] or 0
    if depth:
        longer = F.raise_error(F.lit("a path is longer than was said")).cast("int")
        files = files.withColumn("depth", F.when(F.col("depth") > deepest, longer).otherwise(F.col("depth")))
    out, below = None, None
    for level in range(deepest, -1, -1):
        entries = files.where(F.col("depth") == level).select(*keys, "directory", "entry")
        if below is not None:
            entries = entries.union(below.select(*keys, parent(F.col("directory")).alias("directory"), line(F.lit("040000"), F.substring_index("directory", "/", -1), F.col("id"))))
        below = entries.groupBy(*keys, "directory").agg(F.sha1(_entries(F.collect_list("entry")).cast("binary")).alias("id"), F.count("*").alias("entries"))
        out = below if out is None else out.union(below)
    return out


def moved_directory(tree: DataFrame, old: str, new: str) -> DataFrame:
    """The tree after a directory was renamed: every path beneath it follows."""
    return tree.withColumn("path", F.when(F.col("path").startswith(f"{old}/"), F.concat(F.lit(new), F.substr("path", F.lit(len(old) + 1)))).otherwise(F.col("path")))


def index_diff(tree: DataFrame, index: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, path, status) of a tree against the entries of index(keys, path, blob, mode, stage) that have no conflict (stage 0): A, D or M."""
    found = tree_diff(tree, index.where("stage = 0"), keys)
    return found.select(*keys, "path", F.when(F.col("status") == "T", "M").otherwise(F.col("status")).alias("status"))


def totals(diff: DataFrame, renames: DataFrame, copies: DataFrame, keys: list[str]) -> DataFrame:
    """Added, deleted, modified, renamed and copied paths of each key; a rename counts once, and no more as added and deleted."""
    mark = lambda df, c, name: df.select(*keys, F.col(c).alias("path"), F.lit(name).alias("mark"))
    gone = mark(renames, "old_path", "gone").withColumn("status", F.lit("D"))
    new = mark(renames, "new_path", "R").withColumn("status", F.lit("A")).union(mark(copies, "new_path", "C").withColumn("status", F.lit("A")))
    marks = gone.union(new).groupBy(*keys, "path", "status").agg(F.max("mark").alias("mark"))  # R comes after C
    kinds = diff.join(marks, [*keys, "path", "status"], "left").withColumn("kind", F.coalesce("mark", "status"))
    one = lambda *s: F.sum(F.col("kind").isin(*s).cast("long"))
    return kinds.groupBy(*keys).agg(one("A").alias("added"), one("D").alias("deleted"), one("M", "T").alias("modified"), one("R").alias("renamed"), one("C").alias("copied"))


def blob_totals(rows: DataFrame, keys: list[str]) -> DataFrame:
    """totals of compared rows with their exact renames and copies, found blob by blob without a join; rows dealt by the keys are not shuffled again.

    Of the deleted and the added paths of a blob the first, as many as there are of either, are renamed; other added ones are copies if
    the old tree has the blob.  An added path that comes twice has its mark in both rows, as in totals."""
    meets = F.least(*(F.col(c).isNotNull() for c in [*keys, "path", "blob"]))
    named = rows.withColumn("blob", F.coalesce("old_blob", "new_blob")).withColumn("meets", meets)
    blob = [*keys, "blob", "meets"]
    whole, nth = Window.partitionBy(*blob), F.row_number().over(Window.partitionBy(*blob, "status").orderBy("path"))
    among = lambda c: F.count_if(c).over(whole)
    pairs = F.least(among(F.col("status") == "A"), among(F.col("status") == "D"))
    named = named.withColumns({"nth": nth, "pairs": pairs, "had": among(F.col("old_blob").isNotNull())})
    mark = F.when(F.col("meets") & F.col("status").isin("A", "D") & (F.col("nth") <= F.col("pairs")), 2).when(F.col("meets") & (F.col("status") == "A") & (F.col("had") > 0), 1).otherwise(0)
    paths = named.where("status is not null").groupBy(*keys, "path", "status").agg(F.max(mark).alias("mark"), F.count("*").alias("n"))
    kind = F.when((F.col("status") == "A") & (F.col("mark") > 0), F.when(F.col("mark") == 2, "R").otherwise("C")).when(F.col("mark") == 2, "gone").otherwise(F.col("status"))
    one = lambda *s: F.sum(F.when(F.col("kind").isin(*s), F.col("n")).otherwise(0))
    paths = paths.withColumn("kind", kind)
    return paths.groupBy(*keys).agg(one("A").alias("added"), one("D").alias("deleted"), one("M", "T").alias("modified"), one("R").alias("renamed"), one("C").alias("copied"))


def beside_children(roots: DataFrame, links: DataFrame) -> DataFrame:
    """The rows of roots(k, ...) under the key of each child of their commit, by links(child, k); shuffles nothing where both are dealt by k."""
    met = _beside(links.where("k is not null").select("k", F.struct("child").alias("first")), roots.select("k", F.struct(*(c for c in roots.columns if c != "k")).alias("second")), ["k"])
    return met.where("second is not null").select(F.explode("seen.child").alias("k"), "second.*")
