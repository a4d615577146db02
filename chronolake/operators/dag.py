"""Graph queries over an edge table (child, parent, ord).

Sets of ancestors are found over chains: every node lies at a place of one line of first parents, so all
ancestors that one line holds are a prefix of it, and a closure keeps one number for each (start, line).
Rounds follow the links between lines, not the commits along them, so a long history needs few.  Lines are
made by pointer doubling, in as many rounds as the logarithm of the longest line.

Depths are found level by level; levels (longest ways down) by peeling segments, whose nodes have one parent
and one child each.  A round is one job that writes the next table to the shared folder and counts it, so
nothing is computed twice and a lost executor loses nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from chronolake.sources.staging import new_path, removed, staged, staged_counted

#: Tables of a loop that are read one by one before they are written together.
MOST_PARTS = 8


def _staged_with(df: DataFrame, name: str, found) -> tuple[DataFrame, str, int, int]:
    """A staged table, its path, an aggregate of its rows (0 without any), and their number."""
    seen, path = Observation(), new_path(df.sparkSession, name)
    df.observe(seen, F.coalesce(found, F.lit(0)).alias("found"), F.count("*").alias("rows")).write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path, seen.get["found"], seen.get["rows"]


def _staged_sum(df: DataFrame, name: str, what) -> tuple[DataFrame, str, int, int]:
    return _staged_with(df, name, F.sum(what))


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.union(part)
    return out


def lines(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(node, line, place) of nodes(node) for links(node, next), at most one to and from each node; a line is
    named after its last node, whose place is 0.  A cycle raises."""
    state = nodes.join(links, "node", "left").select("node", F.coalesce("next", "node").alias("at"), F.col("next").isNotNull().cast("long").alias("place"))
    state, path, far, n = _staged_with(state, "lines", F.max("place"))
    def doubled(state: DataFrame) -> DataFrame:
        ahead = state.where("place > 0").select(F.col("node").alias("at"), F.col("at").alias("beyond"), F.col("place").alias("more"))
        return state.join(ahead, "at", "left").select("node", F.coalesce("beyond", "at").alias("at"), (F.col("place") + F.coalesce("more", F.lit(0))).alias("place"))

    step = 1
    while far == step:  # a place below 2**rounds is final
        last, step = path, 4 * step
        state, path, far, _ = _staged_with(doubled(doubled(state)), "lines", F.max("place"))  # two rounds a job
        removed(nodes.sparkSession, last)
        if far > n:
            raise ValueError("the graph has a cycle")
    return state.select("node", F.col("at").alias("line"), "place")


def _nodes(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("child").alias("node")).union(edges.select(F.col("parent").alias("node"))).distinct()


class Lines:
    """The lines of first parents of a graph, and the links between them; made once for any number of closures."""

    def __init__(self, edges: DataFrame):
        edges = staged(edges.select("child", "parent", "ord"), "edges")
        # a node goes on to its first parent, if it is the greatest of the nodes that would
        links = edges.where("ord = 0").groupBy("parent").agg(F.max("child").alias("node")).select("node", F.col("parent").alias("next")).where("node <> next")
        self.places = lines(_nodes(edges), links)
        end = lambda side: self.places.select(F.col("node").alias(side), F.col("line").alias(f"{side}_line"), F.col("place").alias(f"{side}_place"))
        across = edges.join(end("child"), "child").join(end("parent"), "parent").where("child_line <> parent_line")
        self.links = staged(across.groupBy("child_line", "child_place", "parent_line").agg(F.max("parent_place").alias("parent_place")), "links")

    def reached(self, starts: DataFrame) -> DataFrame:
        """(start, line, upto): the places 0 to upto of a line are ancestors of start, or start itself; starts(start, node)."""
        spark = starts.sparkSession
        first = starts.join(self.places, "node").groupBy("start", "line").agg(F.max("place").alias("upto")).withColumn("below", F.lit(-1).cast("long"))
        state, path, fresh, _ = _staged_sum(first, "reached", (F.col("upto") > F.col("below")).cast("long"))
        while fresh:
            last = path
            state, path, fresh, _ = _staged_sum(self._next(self._next(state)), "reached", (F.col("upto") > F.col("below")).cast("long"))  # two rounds a job
            removed(spark, last)
        return state.select("start", "line", "upto")

    def _next(self, state: DataFrame) -> DataFrame:
        """(start, line, upto, below) after the links from the places above below, which the round before reached, up to upto."""
        at = (F.col("line") == F.col("child_line")) & (F.col("child_place") > F.col("below")) & (F.col("child_place") <= F.col("upto"))
        new = state.where("upto > below").join(self.links, at).select("start", F.col("parent_line").alias("line"), F.lit(None).cast("long").alias("old"), F.col("parent_place").alias("fresh"))
        both = state.select("start", "line", F.col("upto").alias("old"), F.lit(None).cast("long").alias("fresh")).union(new)
        merged = both.groupBy("start", "line").agg(F.max("old").alias("old"), F.max("fresh").alias("fresh"))
        return merged.select("start", "line", F.greatest("old", "fresh").alias("upto"), F.coalesce("old", F.lit(-1)).cast("long").alias("below"))

    def ancestors(self, starts: DataFrame) -> DataFrame:
        """(start, node) of all ancestors of starts(start, node), themselves included."""
        found = self.reached(starts).join(self.places, "line").where("place <= upto").select("start", "node")
        return found.union(starts.select("start", "node")).distinct()  # a start without edges is its own ancestor


def _starts(edges: DataFrame, nodes: list) -> DataFrame:
    kind = edges.schema["child"].dataType.simpleString()
    return edges.sparkSession.createDataFrame([(n, n) for n in nodes], f"start {kind}, node {kind}")


#: Levels that a short search takes in one job, and its jobs; what isn't found by then is found over lines.
LEVELS_A_JOB, SHORT_JOBS = 4, 4


def _short(edges: DataFrame, starts: DataFrame) -> DataFrame | None:
    """(start, node) of all ancestors of starts(start, node), themselves included, if they end within a few levels; else None."""
    steps = staged(edges.select("child", "parent").distinct(), "steps")
    seen, _, _ = staged_counted(starts.select("start", "node").distinct(), "near")
    frontier = seen
    for _ in range(SHORT_JOBS):
        level, levels = frontier, []
        for _ in range(LEVELS_A_JOB):
            level = level.join(steps, F.col("node") == F.col("child")).select("start", F.col("parent").alias("node")).distinct()
            levels.append(level)
        frontier, _, n = staged_counted(_union(levels).distinct().join(seen, ["start", "node"], "left_anti"), "near")
        if not n:
            return seen
        seen = seen.union(frontier)
    return None


def reached_from(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """(start, node) of all ancestors of starts(start, node), themselves included: by a short search, or over lines where history is long."""
    found = _short(edges, starts)
    return staged(Lines(edges).ancestors(starts), "reachable") if found is None else found


def reachable(edges: DataFrame, nodes: list) -> DataFrame:
    """(start, node) of all ancestors of each of nodes, themselves included."""
    return reached_from(edges, _starts(edges, nodes))


def ancestors(edges: DataFrame, starts: DataFrame, max_depth: int | None = None, first_parent: bool = False) -> DataFrame:
    """(start, node, depth) of every ancestor of starts(start, node), itself included at depth 0, for all starts at once.

    Level by level, so there are as many rounds as levels; reachable() needs fewer where depths aren't asked for."""
    steps = staged((edges.where("ord = 0") if first_parent else edges).select("child", "parent").distinct(), "steps")
    frontier, path, n = staged_counted(starts.select("start", "node").distinct().withColumn("depth", F.lit(0)), "closure")
    parts, depth = [(frontier, path)], 0
    while n and (max_depth is None or depth < max_depth):
        depth += 1
        reached = frontier.join(steps, F.col("node") == F.col("child")).select("start", F.col("parent").alias("node")).distinct()
        reached = reached.join(_union([part for part, _ in parts]), ["start", "node"], "left_anti")
        frontier, path, n = staged_counted(reached.withColumn("depth", F.lit(depth)), "closure")
        if len(parts) == MOST_PARTS:  # earlier levels become one table, so a level reads few
            whole, at, _ = staged_counted(_union([part for part, _ in parts]), "closure")
            removed(edges.sparkSession, *(p for _, p in parts))
            parts = [(whole, at)]
        parts.append((frontier, path))
    return _union([part for part, _ in parts])


def ancestors_of(edges: DataFrame, nodes: list, **options) -> DataFrame:
    return ancestors(edges, _starts(edges, nodes), **options)


def is_ancestor(edges: DataFrame, ancestor, of) -> bool:
    return not reachable(edges, [of]).where(F.col("node") == ancestor).isEmpty()


def descends(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """(ancestor, node, holds) for pairs(ancestor, node); a node is its own ancestor.  No ancestor is listed."""
    found = Lines(edges)
    reach = found.reached(pairs.select(F.col("node").alias("start"), "node").distinct()).withColumnRenamed("start", "node")
    at = pairs.join(found.places.select(F.col("node").alias("ancestor"), "line", "place"), "ancestor").join(reach, ["node", "line"]).where("place <= upto")
    hit = at.select("ancestor", "node").distinct().withColumn("hit", F.lit(True))
    return pairs.join(hit, ["ancestor", "node"], "left").select("ancestor", "node", (F.coalesce("hit", F.lit(False)) | (F.col("ancestor") == F.col("node"))).alias("holds"))


def distances(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """(ancestor, node, distance) for pairs(ancestor, node): the fewest steps from node to ancestor, -1 if it is none."""
    reach = ancestors(edges, pairs.select(F.col("node").alias("start"), "node").distinct()).select(F.col("start").alias("node"), F.col("node").alias("ancestor"), "depth")
    return pairs.join(reach, ["node", "ancestor"], "left").select("ancestor", "node", F.coalesce("depth", F.lit(-1)).alias("distance"))


def common_ancestors(edges: DataFrame, nodes: list) -> DataFrame:
    """Nodes that are ancestors-or-self of every one of nodes."""
    found = Lines(edges)
    shared = found.reached(_starts(edges, sorted(set(nodes)))).groupBy("line").agg(F.count("*").alias("n"), F.min("upto").alias("upto")).where(F.col("n") == len(set(nodes)))
    return shared.join(found.places, "line").where("place <= upto").select("node")


def all_related(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """(a, b, related) for pairs(a, b): whether they share an ancestor, themselves included."""
    ends = pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct()
    reach = Lines(edges).reached(ends.withColumn("start", F.col("node")))  # a shared line is a shared ancestor, its last node
    side = lambda c: pairs.select("a", "b").distinct().join(reach.select(F.col("start").alias(c), "line"), c)
    met = side("a").join(side("b"), ["a", "b", "line"], "left_semi").select("a", "b").distinct().withColumn("met", F.lit(True))
    return pairs.join(met, ["a", "b"], "left").select("a", "b", (F.coalesce("met", F.lit(False)) | (F.col("a") == F.col("b"))).alias("related"))


def merge_bases_of(found: Lines, pairs: DataFrame) -> DataFrame:
    """(a, b, node): the common ancestors of each of pairs(a, b) that aren't ancestors of another.

    Common ancestors are closed under parents, so on a line only the last common one can be such; it is
    if no common node of another line has it, or one after it, as a parent."""
    pairs = pairs.select("a", "b").distinct()
    ends = pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct()
    reach = found.reached(ends.withColumn("start", F.col("node")))
    side = lambda c: pairs.join(reach.select(F.col("start").alias(c), "line", F.col("upto").alias(f"{c}_upto")), c)
    common = staged(side("a").join(side("b"), ["a", "b", "line"]).select("a", "b", "line", F.least("a_upto", "b_upto").alias("place")), "common")
    below = common.join(found.links, (F.col("line") == F.col("child_line")) & (F.col("child_place") <= F.col("place"))).groupBy("a", "b", F.col("parent_line").alias("line")).agg(F.max("parent_place").alias("passed"))
    tops = common.join(below, ["a", "b", "line"], "left").where("passed is null or passed < place").join(found.places, ["line", "place"]).select("a", "b", "node")
    return tops.union(pairs.where("a = b").select("a", "b", F.col("a").alias("node"))).distinct()


def merge_bases(edges: DataFrame, a, b) -> DataFrame:
    """(node): common ancestors of a and b that aren't ancestors of another."""
    found = _short(edges, _starts(edges, sorted({a, b})))
    if found is None:
        kind = edges.schema["child"].dataType.simpleString()
        return merge_bases_of(Lines(edges), edges.sparkSession.createDataFrame([(a, b)], f"a {kind}, b {kind}")).select("node")
    common = staged(found.groupBy("node").agg(F.count("*").alias("n")).where(F.col("n") == len({a, b})).select("node"), "common")
    inner = edges.join(common, F.col("child") == F.col("node"), "left_semi").select(F.col("parent").alias("node"))
    return common.join(inner, "node", "left_anti")


def octopus_bases(edges: DataFrame, nodes: list) -> DataFrame:
    """(node): merge bases folded over nodes: those of the bases so far and the next node."""
    found = Lines(edges)
    kind = edges.schema["child"].dataType.simpleString()
    bases = edges.sparkSession.createDataFrame([(nodes[0],)], f"node {kind}")
    for n in nodes[1:]:
        bases = staged(merge_bases_of(found, bases.select(F.col("node").alias("a"), F.lit(n).cast(kind).alias("b"))).select("node").distinct(), "bases")
    return bases


def first_common(edges: DataFrame, a, b) -> DataFrame:
    """(node, depth): the ancestors of a that are nearest to b."""
    near = ancestors_of(edges, [b]).select("node", "depth")
    shared = near.join(reachable(edges, [a]).select("node"), "node", "left_semi")
    return shared.join(F.broadcast(shared.agg(F.min("depth").alias("depth"))), "depth").select("node", "depth")  # one row


def independent(edges: DataFrame, nodes: list) -> DataFrame:
    """Those of nodes that no other of nodes descends from."""
    reach = reachable(edges, nodes).where("node <> start")
    return _starts(edges, nodes).select("node").join(reach, "node", "left_anti")


def revision_range(edges: DataFrame, include: list, exclude: list) -> DataFrame:
    """Ancestors-or-self of include that aren't ancestors-or-self of exclude (`A..B`)."""
    reach = reachable(edges, [*include, *exclude])
    shown = reach.where(F.col("start").isin(include)).select("node").distinct()
    return shown.join(reach.where(F.col("start").isin(exclude)), "node", "left_anti") if exclude else shown


def symmetric_difference(edges: DataFrame, a, b) -> DataFrame:
    """Nodes reached from exactly one of a and b (`A...B`)."""
    return reachable(edges, [a, b]).groupBy("node").agg(F.count("*").alias("n")).where("n = 1").select("node")


def ahead_behind(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """(a, b, ahead, behind) for pairs(a, b): commits that only a, and only b, reaches.

    Counted by lines: of a line that a reaches up to one place and b up to another, the places between are
    reached by one of them alone, so no ancestor is listed."""
    pairs = pairs.select("a", "b").distinct()
    ends = pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct()
    reach = Lines(edges).reached(ends.withColumn("start", F.col("node")))
    side = lambda c: pairs.join(reach.select(F.col("start").alias(c), "line", (F.col("upto") + 1).alias("n")), c)
    rows = side("a").select("a", "b", "line", F.col("n").alias("l"), F.lit(0).cast("long").alias("r")).union(side("b").select("a", "b", "line", F.lit(0).cast("long"), "n"))
    both = rows.groupBy("a", "b", "line").agg(F.max("l").alias("l"), F.max("r").alias("r"))
    count = lambda x, y: F.coalesce(F.sum(F.greatest(F.col(x) - F.col(y), F.lit(0))), F.lit(0)).alias({"l": "ahead", "r": "behind"}[x])
    counted = both.groupBy("a", "b").agg(count("l", "r"), count("r", "l"))
    return pairs.join(counted, ["a", "b"], "left").select("a", "b", F.coalesce("ahead", F.lit(0)).alias("ahead"), F.coalesce("behind", F.lit(0)).alias("behind"))


def generations(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, level): length of the longest way down to a root.  Peels segments whose parents all have a level; a cycle raises."""
    spark = nodes.sparkSession
    nodes = staged(nodes.select("node").distinct(), "nodes")
    known = edges.select("child", "parent").distinct().join(nodes.select(F.col("node").alias("parent")), "parent", "left_semi").join(nodes.select(F.col("node").alias("child")), "child", "left_semi")
    known = staged(known, "known")
    lone = known.groupBy("child").agg(F.count("*").alias("n"), F.max("parent").alias("next")).where("n = 1").select(F.col("child").alias("node"), "next")
    lone = lone.join(known.groupBy("parent").agg(F.count("*").alias("n")).where("n = 1").select(F.col("parent").alias("next")), "next", "left_semi").where("node <> next")
    places = lines(nodes, lone.select("node", "next"))
    # all parents of a segment's last node are the first nodes of theirs
    size = places.groupBy("line").agg(F.max("place").alias("size"))
    links = known.join(places.where("place = 0").select(F.col("node").alias("child"), F.col("line").alias("upper")), "child").join(places.select(F.col("node").alias("parent"), F.col("line").alias("lower")), "parent")
    links = staged(links.groupBy("upper", "lower").agg(F.count("*").alias("times")).select("upper", "lower"), "links")
    # a round has the segments that were reached, ready when by all their parents; links carry what a reached one needs to know
    need = links.groupBy(F.col("upper").alias("line")).agg(F.count("*").alias("need"))
    sizes, _, total = staged_counted(size.join(need, "line", "left").select("line", "size", F.coalesce("need", F.lit(0)).alias("need")), "sizes")
    steps = staged(links.join(sizes.select(F.col("line").alias("upper"), "size", "need"), "upper"), "steps")
    first = sizes.where("need = 0").select("line", "size", "need", F.lit(0).cast("long").alias("met"), F.lit(0).cast("long").alias("level"))
    reached, path, ready, _ = _staged_sum(first, "reached", (F.col("met") == F.col("need")).cast("long"))
    done = []
    while ready:
        total -= ready
        done.append((reached.where("met = need").select("line", "level"), path))
        up = reached.where("met = need").select(F.col("line").alias("lower"), (F.col("level") + F.col("size") + 1).alias("level")).join(steps, "lower").select(F.col("upper").alias("line"), "size", "need", F.lit(1).cast("long").alias("met"), "level")
        both = reached.where("met < need").union(up).groupBy("line").agg(F.max("size").alias("size"), F.max("need").alias("need"), F.sum("met").alias("met"), F.max("level").alias("level"))
        reached, path, ready, _ = _staged_sum(both, "reached", (F.col("met") == F.col("need")).cast("long"))
        if len(done) == MOST_PARTS:  # earlier levels become one table, so few are read in the end
            whole, at, _ = staged_counted(_union([part for part, _ in done]), "levels")
            removed(spark, *(p for _, p in done))
            done = [(whole, at)]
    if total:
        raise ValueError("the graph has a cycle")
    levels = _union([part for part, _ in done]) if done else reached.select("line", "level")
    return places.join(levels, "line").select("node", (F.col("level") + F.col("place")).cast("int").alias("level"))


def resolve_symbolic(refs: DataFrame, max_depth: int = 10) -> DataFrame:
    """refs(name, target): follows targets that name refs; (name, target, hops), target null for cycles, missing refs and chains over max_depth."""
    links = refs.select(F.col("name").alias("at"), F.col("target").alias("to"))
    found = refs.select("name", "target", F.lit(1).alias("hops"))
    for _ in range(max_depth):
        found = found.join(links, F.col("target") == F.col("at"), "left").select("name", F.coalesce("to", "target").alias("target"), (F.col("hops") + F.col("at").isNotNull().cast("int")).alias("hops"))
    return found.select("name", F.when(~F.col("target").startswith("refs/"), F.col("target")).alias("target"), "hops")


def fork_point(edges: DataFrame, log: DataFrame, ref_node, node) -> DataFrame:
    """The newest entry of log(version, node) that node descends from; else the merge bases of node and the ref."""
    reach = reachable(edges, [node]).select("node")
    hit = log.join(reach, "node", "left_semi").orderBy(F.desc("version")).limit(1).select("node")
    return merge_bases(edges, ref_node, node) if hit.isEmpty() else hit


def between(edges: DataFrame, start, end) -> DataFrame:
    """Nodes reached from end without passing start, start left out; none if start isn't reached."""
    reach = reachable(edges.where(F.col("child") != start), [end])
    met = reach.where(F.col("node") == start).select(F.lit(True).alias("met")).limit(1)
    return reach.where(F.col("node") != start).join(F.broadcast(met), F.lit(True), "left_semi").select("node")


def shallow_boundary(edges: DataFrame, nodes: list, depth: int) -> DataFrame:
    """Nodes within depth of nodes that have a parent beyond."""
    near = ancestors_of(edges, nodes, max_depth=depth).select("node").distinct()
    inner = edges.join(near, F.col("child") == F.col("node"), "left_semi").select(F.col("child").alias("node"), "parent")
    return inner.join(near.select(F.col("node").alias("parent")), "parent", "left_anti").select("node").distinct()


def shallow_since(edges: DataFrame, dates: DataFrame, nodes: list, since: str) -> DataFrame:
    """Ancestors-or-self of nodes that are met without passing a commit of dates(node, date) before since."""
    young = dates.where(F.col("date") >= F.lit(since).cast("timestamp")).select("node")
    kept = edges.join(young.withColumnRenamed("node", "child"), "child", "left_semi").join(young.withColumnRenamed("node", "parent"), "parent", "left_semi").select("child", "parent", "ord")
    return reachable(kept, nodes).select("node").distinct().join(young, "node", "left_semi")


def beyond_nearest(edges: DataFrame, a, b) -> DataFrame:
    """Ancestors-or-self of a and b that the nearest common ones (to b) don't reach."""
    near = first_common(edges, a, b).select("node")
    below = Lines(edges).ancestors(near.select(F.col("node").alias("start"), "node")).select("node")
    return reachable(edges, [a, b]).select("node").distinct().join(below, "node", "left_anti")


def recursive_base(edges: DataFrame, a, b) -> DataFrame:
    """(node): the merge bases of a and b folded with each other until one is left, or none; each round folds the least with all others."""
    found = Lines(edges)
    bases = staged(merge_bases(edges, a, b), "bases")
    while bases.limit(2).count() > 1:
        least = bases.agg(F.min("node").alias("a"))
        pairs = bases.join(F.broadcast(least)).where("node <> a").select("a", F.col("node").alias("b"))
        bases = staged(merge_bases_of(found, pairs).select("node").distinct(), "bases")
    return bases
