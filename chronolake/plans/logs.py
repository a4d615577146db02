"""Queries for logs, branches, tags and the graph over the refs of the lake, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from chronolake.functions import text
from chronolake.operators import dag, history, storage
from chronolake.plans.oracle import _BODY, _SHORT, _SUBJECT, COMMITS, EDGES, FILES, REFS, _reach
from chronolake.plans.queries import NODE, OTHER, THIRD
from chronolake.sources import lake


def _known(s, d):
    return lake.read(s, d, "orders").select(F.col("o_orderkey").alias("node"))


def _heads(s, d):
    """(name, node) of the branches whose commit is in the lake."""
    return lake.refs(s, d).where("name like 'refs/heads/%'").select("name", F.col("target").alias("node")).join(_known(s, d), "node", "left_semi")


def _shown(df):
    return df.select("k", "author_name", "author_date")


def log_all(s, d):
    """Commits that any branch or tag reaches."""
    ends = lake.refs(s, d).where("name like 'refs/heads/%' or name like 'refs/tags/%'").select(F.col("target").alias("node")).join(_known(s, d), "node", "left_semi").distinct()
    reach = dag.Lines(lake.commit_parents(s, d)).ancestors(ends.select(F.lit(0).cast("long").alias("start"), "node"))
    return _shown(lake.commits(s, d).join(reach.select(F.col("node").alias("k")), "k", "left_semi"))


def branches_containing(s, d):
    """For the commits 0 to 9: the branches that reach them."""
    pairs = _heads(s, d).select("node").distinct().select("node", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(9).cast("long"))).alias("ancestor"))
    return dag.descends(lake.commit_parents(s, d), pairs).where("holds").join(_heads(s, d), "node").select("ancestor", "name")


def branches_merged(s, d):
    """For each branch whether NODE reaches its tip."""
    tips = _heads(s, d)
    holds = dag.descends(lake.commit_parents(s, d), tips.select(F.col("node").alias("ancestor"), F.lit(NODE).cast("long").alias("node")).distinct())
    return tips.join(holds.select(F.col("ancestor").alias("node"), "holds"), "node").select("name", F.col("holds").alias("merged"))


def branches_ahead_behind(s, d):
    tips = _heads(s, d)
    found = dag.ahead_behind(lake.commit_parents(s, d), tips.select(F.col("node").alias("a"), F.lit(NODE).cast("long").alias("b")))
    return tips.join(found.select(F.col("a").alias("node"), "ahead", "behind"), "node").select("name", "ahead", "behind")


def fast_forwards(s, d):
    """Updates of branches from the commit of a third of their number (0 for none) to their tip: whether they only go forward."""
    updates = _heads(s, d).select("name", F.col("node").alias("new"), F.floor(F.col("node") / 3).alias("old"))
    holds = dag.descends(lake.commit_parents(s, d), updates.select(F.col("old").alias("ancestor"), F.col("new").alias("node")).distinct()).select(F.col("ancestor").alias("old"), F.col("node").alias("new"), "holds")
    return updates.join(holds, ["old", "new"]).select("name", ((F.col("old") == 0) | F.col("holds")).alias("ok"))


def _asked(s):
    return s.createDataFrame([(a, b) for a in (0, 3, 7, 87, OTHER, THIRD) for b in (NODE, OTHER)], "ancestor long, node long")


def topo_order(s, d):
    levels = dag.generations(lake.commit_parents(s, d), _known(s, d))
    return history.topological(lake.commits(s, d), levels)


QUERIES = {
    "log_exact_author": lambda s, d: _shown(history.matching(lake.commits(s, d), name="Customer#000000007", after="1995-06-01", before="2000-01-01")),
    "log_author_pattern": lambda s, d: _shown(history.matching(lake.commits(s, d), author="^customer#00000000[1-3]", merges=False)),
    "log_committer": lambda s, d: _shown(history.matching(lake.commits(s, d), committer="committer#1", grep="URGENT")),
    "log_paths": lambda s, d: _shown(history.touching(lake.commits(s, d), lake.files(s, d), ["economy/**/*.ts"], ["**/red_*"])),
    "log_all": log_all,
    "log_nearest": lambda s, d: history.first_met(lake.commits(s, d), dag.ancestors_of(lake.commit_parents(s, d), [NODE, OTHER]), 20).select("k", "depth"),
    "log_limited": lambda s, d: history.limited(lake.commits(s, d), dag.ancestors_of(lake.commit_parents(s, d), [NODE]), 7).select("k", "author_date", "has_more"),
    "log_full_format": lambda s, d: history.formatted(lake.commits(s, d), "%H (%P) %cn <%ce> %s: %b", lake.commit_sha),
    "topo_order": topo_order,
    "commit_count": lambda s, d: dag.ancestors_of(lake.commit_parents(s, d), [NODE, OTHER], max_depth=5).groupBy("start").agg(F.count_distinct("node").alias("commits")),
    "branches_containing": branches_containing,
    "branches_merged": branches_merged,
    "branches_ahead_behind": branches_ahead_behind,
    "fast_forwards": fast_forwards,
    "tags_pointing_at": lambda s, d: lake.refs(s, d).where(F.col("name").startswith("refs/tags/") & F.col("target_sha").isin([r for r in map(_sha, (7, 35, 63))])).select(text.short_ref(F.col("name")).alias("tag")),
    "commit_distances": lambda s, d: dag.distances(lake.commit_parents(s, d), _asked(s)),
    "related_commits": lambda s, d: dag.all_related(lake.commit_parents(s, d), _asked(s).toDF("a", "b")),
    "nearest_common": lambda s, d: dag.first_common(lake.commit_parents(s, d), NODE, OTHER),
    "octopus_base": lambda s, d: dag.octopus_bases(lake.commit_parents(s, d), [NODE, OTHER, THIRD]),
    "tags_by_date": lambda s, d: storage.numbered(lake.ref_details(s, d).where("tagger_ms is not null").select(text.short_ref(F.col("name")).alias("tag"), "tagger_ms"), [F.desc("tagger_ms"), F.col("tag")], "place"),
    "branches_by_name": lambda s, d: storage.numbered(lake.refs(s, d).where("name like 'refs/heads/%'").select(text.short_ref(F.col("name")).alias("branch")), [F.desc("branch")], "place"),
    "sequence_numbers": lambda s, d: storage.numbered(lake.read(s, d, "events").select("event_id", "ts"), [F.col("ts"), F.col("event_id")], "sequence"),
    "pack_orders": lambda s, d: storage.numbered(lake.read(s, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_size").alias("size"), F.col("p_name").alias("path")), [F.desc("size"), F.col("id")], "by_size").join(
        storage.numbered(lake.read(s, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("path")), [F.col("path"), F.col("id")], "by_path").select("id", "by_path"), "id").select("id", "by_size", "by_path"),
    "top_contributors": lambda s, d: history.contributors(lake.commits(s, d)).orderBy(F.desc("commits"), "email").limit(30).select("email", "commits"),
}


def _sha(k: int) -> str:
    import hashlib

    return hashlib.sha1(f"commit {k}".encode()).hexdigest()


_HEADS = f"{REFS}, heads AS (SELECT name, target AS node FROM refs JOIN orders ON o_orderkey = target WHERE name LIKE 'refs/heads/%')"
_FROM_HEADS = f"WITH RECURSIVE {_HEADS}, {EDGES}, walk(start, node) AS (SELECT DISTINCT node, node FROM heads UNION SELECT start, parent FROM walk JOIN edges ON node = child)"
_ONE = "own(node) AS (SELECT {n}::BIGINT UNION SELECT parent FROM own JOIN edges ON own.node = child)"
_PAIRS = f"p AS (SELECT * FROM (VALUES {', '.join(f'({a}::BIGINT, {b}::BIGINT)' for a in (0, 3, 7, 87, OTHER, THIRD) for b in (NODE, OTHER))}) v(a, b))"
_ROW = "SELECT k, author_name, author_date FROM commits"

ORACLE = {
    "log_exact_author": f"WITH {COMMITS} {_ROW} WHERE author_name = 'Customer#000000007' AND author_date > TIMESTAMP '1995-06-01' AND author_date < TIMESTAMP '2000-01-01'",
    "log_author_pattern": f"WITH {COMMITS} {_ROW} WHERE (regexp_matches(author_name, '(?i)^customer#00000000[1-3]') OR regexp_matches(author_email, '(?i)^customer#00000000[1-3]')) AND len(parents) < 2",
    "log_committer": f"WITH {COMMITS} {_ROW} WHERE (contains(lower(committer_name), 'committer#1') OR contains(lower(committer_email), 'committer#1')) AND contains(message, 'URGENT')",
    "log_paths": f"WITH {COMMITS}, {FILES} {_ROW} WHERE k IN (SELECT k FROM files WHERE regexp_matches(path, '^economy/(.*/)?[^/]*\\.ts$') AND NOT regexp_matches(path, '^(.*/)?red_[^/]*$'))",
    "log_all": f"WITH RECURSIVE {REFS}, {EDGES}, {COMMITS}, walk(node) AS (SELECT target FROM refs JOIN orders ON o_orderkey = target WHERE name LIKE 'refs/heads/%' OR name LIKE 'refs/tags/%' UNION SELECT parent FROM walk JOIN edges ON node = child) {_ROW} WHERE k IN (SELECT node FROM walk)",
    "log_nearest": _reach(NODE, OTHER) + " SELECT node AS k, min(depth)::INT AS depth FROM reach GROUP BY 1 ORDER BY depth, k DESC LIMIT 20",
    "log_limited": _reach(NODE) + f", f AS (SELECT node FROM reach ORDER BY depth, node DESC LIMIT 7) SELECT node AS k, o_orderdate AS author_date, (SELECT count(*) FROM reach) > 7 AS has_more FROM f JOIN orders ON o_orderkey = node",
    "log_full_format": f"WITH {COMMITS} SELECT k, sha || ' (' || array_to_string(list_transform(parents, lambda p: sha1('commit ' || p)), ' ') || ') ' || committer_name || ' <' || committer_email || '> ' || {_SUBJECT} || ': ' || {_BODY} AS line FROM commits",
    "topo_order": f"WITH RECURSIVE {EDGES}, down(node, level) AS (SELECT 0::BIGINT, 0 UNION SELECT child, level + 1 FROM down JOIN edges ON parent = node), l AS (SELECT node, max(level) AS level FROM down GROUP BY node), {COMMITS} SELECT k, row_number() OVER (ORDER BY level DESC, author_date DESC, k DESC)::INT AS place FROM commits JOIN l ON k = node",
    "commit_count": _reach(NODE, OTHER, depth="depth < 5") + " SELECT start, count(DISTINCT node) AS commits FROM reach GROUP BY 1",
    "branches_containing": _FROM_HEADS + " SELECT walk.node AS ancestor, name FROM walk JOIN heads ON heads.node = start WHERE walk.node < 10",
    "branches_merged": f"WITH RECURSIVE {_HEADS}, {EDGES}, {_ONE.format(n=NODE)} SELECT name, node IN (SELECT node FROM own) AS merged FROM heads",
    "branches_ahead_behind": f"{_FROM_HEADS}, {_ONE.format(n=NODE)} SELECT name, (SELECT count(*) FROM walk w WHERE w.start = heads.node AND w.node NOT IN (SELECT node FROM own)) AS ahead, (SELECT count(*) FROM own) - (SELECT count(*) FROM walk w WHERE w.start = heads.node AND w.node IN (SELECT node FROM own)) AS behind FROM heads",
    "fast_forwards": _FROM_HEADS + " SELECT name, node // 3 = 0 OR EXISTS (SELECT 1 FROM walk w WHERE w.start = heads.node AND w.node = heads.node // 3) AS ok FROM heads",
    "tags_pointing_at": f"WITH {REFS} SELECT {_SHORT} AS tag FROM refs WHERE name LIKE 'refs/tags/%' AND target IN (7, 35, 63)",
    "commit_distances": _reach(NODE, OTHER) + f", {_PAIRS} SELECT a AS ancestor, b AS node, coalesce(depth, -1)::INT AS distance FROM p LEFT JOIN reach ON start = b AND reach.node = a",
    "related_commits": f"WITH {_PAIRS} SELECT a, b, TRUE AS related FROM p",
    "nearest_common": _reach(NODE, OTHER) + f", c AS (SELECT node, depth FROM reach WHERE start = {OTHER} AND node IN (SELECT node FROM reach WHERE start = {NODE})) SELECT node, depth::INT AS depth FROM c WHERE depth = (SELECT min(depth) FROM c)",
    "octopus_base": _reach(NODE, OTHER, THIRD) + f""", c AS (SELECT node FROM reach WHERE start <> {THIRD} GROUP BY node HAVING count(*) = 2), b AS (SELECT node FROM c WHERE node NOT IN (SELECT parent FROM edges JOIN c ON child = node)),
 w2(start, node) AS (SELECT node, node FROM b UNION SELECT start, parent FROM w2 JOIN edges ON node = child), c2 AS (SELECT * FROM w2 WHERE node IN (SELECT node FROM reach WHERE start = {THIRD}))
 SELECT DISTINCT node FROM c2 WHERE NOT EXISTS (SELECT 1 FROM edges JOIN c2 x ON x.start = c2.start AND child = x.node WHERE parent = c2.node)""",
    "tags_by_date": f"WITH {REFS}, t AS (SELECT {_SHORT} AS tag, 1600000000000 + target // 7 % 13 * 86400000 AS tagger_ms FROM refs WHERE name LIKE 'refs/tags/%' AND target // 7 % 3 = 0) SELECT tag, tagger_ms, row_number() OVER (ORDER BY tagger_ms DESC, tag)::INT AS place FROM t",
    "branches_by_name": f"WITH {REFS}, b AS (SELECT {_SHORT} AS branch FROM refs WHERE name LIKE 'refs/heads/%') SELECT branch, row_number() OVER (ORDER BY branch DESC)::INT AS place FROM b",
    "sequence_numbers": "SELECT event_id, ts, row_number() OVER (ORDER BY ts, event_id)::INT AS sequence FROM events",
    "pack_orders": "SELECT p_partkey AS id, row_number() OVER (ORDER BY p_size DESC, p_partkey)::INT AS by_size, row_number() OVER (ORDER BY p_name, p_partkey)::INT AS by_path FROM part",
    "top_contributors": f"WITH {COMMITS} SELECT lower(author_email) AS email, count(*) AS commits FROM commits GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 30",
}
