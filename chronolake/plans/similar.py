"""Queries for renames and copies by similarity, followed paths, and blame over versions with several parents, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from chronolake.functions import lines, text
from chronolake.operators import trees
from chronolake.plans.oracle import EDGES, FILES, REFS
from chronolake.plans.queries import _versions
from chronolake.sources import lake


def _moved_contents(s, d):
    """Two trees with contents, ten paths to a commit: all paths move; a third of the contents stay, a third are edited, a third are turned round."""
    n, content = F.col("p_partkey"), F.concat_ws(" ", "p_name", "p_type", "p_brand")
    edited = F.when(n % 3 == 1, F.concat_ws(" ", "p_name", F.regexp_replace("p_type", "^[A-Z]+", "XXXXX"), "p_brand")).when(n % 3 == 2, F.reverse(content)).otherwise(content)
    side = lambda folder, c: lake.read(s, d, "part").select(F.floor(n / 10).alias("k"), F.concat(F.lit(folder), n.cast("string")).alias("path"), F.sha1(c.cast("binary")).alias("blob"), c.alias("content"))
    return side("old/", content), side("new/", edited)


def path_history(s, d):
    """The files of the commits that branches name, back along first parents, under the names that they had."""
    tips = lake.refs(s, d).where("name like 'refs/heads/%'").select(F.col("target").alias("k")).distinct()
    starts = lake.trees(s, d).join(tips, "k", "left_semi").select("k", "path")
    renamed = lake.files(s, d).where("change_type = 'R'").select("k", F.concat("path", F.lit(".orig")).alias("old_path"), F.col("path").alias("new_path"))
    return trees.followed(starts, lake.commit_parents(s, d).where("ord = 0"), renamed).select("start", "start_path", "k", "path")


def _graph_versions(s, d):
    """Four versions of each document: 2 and 3 change 1 in other places, and 4 merges them."""
    t = F.col("text")
    ours = F.regexp_replace(t, "(?m)^(The|De) .*$", "$1 ours")
    theirs = F.concat(t, F.lit("\nlast"))
    rows = F.array(*(F.struct(F.lit(v).alias("version"), F.array(*map(F.lit, p)).cast("array<int>").alias("parents"), c.alias("content")) for v, p, c in ((1, [], t), (2, [1], ours), (3, [1], theirs), (4, [2, 3], F.concat(ours, F.lit("\nlast\nmerged"))))))
    return _versions(s, d).select("doc_id", F.explode(rows).alias("v")).select("doc_id", "v.*")


def blame_graph(s, d):
    return lines.blame_graph(_graph_versions(s, d), "doc_id", "version", "parents", "content")


def blame_porcelain(s, d):
    """Lines 1 to 3 of each document in the porcelain form, with the commits of the versions' numbers, read back."""
    c = lake.commits(s, d).where("k between 1 and 4").select(F.col("k").cast("int").alias("version"), "sha", "author_name", "author_email", "author_date", F.substring_index("message", "\n", 1).alias("summary"))
    shown = lines.blame_text(lines.blame_range(blame_graph(s, d), 1, 3), "doc_id", c, porcelain=True)
    return shown.select("doc_id", lines.parse_porcelain(F.col("text")).alias("e")).select("doc_id", "e.*")


QUERIES = {
    "block_similarity": lambda s, d: lake.read(s, d, "part").select("p_partkey", text.block_similarity(F.lit("small red widget"), F.col("p_name")).alias("similarity")),
    "renames": lambda s, d: trees.renames(*_moved_contents(s, d), "k"),
    "similar_copies": lambda s, d: trees.similar_copies(*_moved_contents(s, d), "k"),
    "path_history": path_history,
    "blame_graph": blame_graph,
    "blame_porcelain": blame_porcelain,
}

_H = "ascii({0}[{1}]) * 29791 + ascii({0}[{1} + 1]) * 961 + ascii({0}[{1} + 2]) * 31 + ascii({0}[{1} + 3])"
_CONTENT = "p_name || ' ' || p_type || ' ' || p_brand"
_SIDES = f"""o AS (SELECT p_partkey // 10 AS k, 'old/' || p_partkey AS path, {_CONTENT} AS c FROM part), n AS (SELECT p_partkey // 10 AS k, 'new/' || p_partkey AS path,
 CASE p_partkey % 3 WHEN 1 THEN p_name || ' ' || regexp_replace(p_type, '^[A-Z]+', 'XXXXX') || ' ' || p_brand WHEN 2 THEN reverse({_CONTENT}) ELSE {_CONTENT} END AS c FROM part),
 s AS (SELECT o.k AS k, o.path AS old_path, n.path AS new_path, floor(100 * len(list_filter(range(1, 1 + least(length(o.c), length(n.c))), lambda i: o.c[i] = n.c[i])) / greatest(length(o.c), length(n.c)) + 0.5)::INT AS similarity FROM o JOIN n ON o.k = n.k)"""

ORACLE = {
    "block_similarity": f"""WITH p AS (SELECT p_partkey, 'small red widget' AS a, p_name AS b FROM part), h AS (SELECT p_partkey, a, b, list_transform(range(1, length(a) - 2), lambda i: {_H.format('a', 'i')}) AS x, list_transform(range(1, length(b) - 2), lambda i: {_H.format('b', 'i')}) AS y FROM p)
 SELECT p_partkey, len(list_filter(y, lambda v: list_contains(x, v)))::DOUBLE / (greatest(length(a), length(b)) - 3)::DOUBLE AS similarity FROM h""",
    "similar_copies": f"WITH {_SIDES} SELECT k, new_path, arg_min(old_path, (-similarity, old_path)) AS source_path, max(similarity) AS similarity FROM s WHERE similarity >= 50 GROUP BY k, new_path",
    "path_history": f"""WITH RECURSIVE {REFS}, {EDGES}, {FILES}, r AS (SELECT DISTINCT k, path FROM files WHERE change_type = 'R'), w(start, start_path, k, path) AS (SELECT DISTINCT k, path, k, path FROM files WHERE k IN (SELECT target FROM refs WHERE name LIKE 'refs/heads/%')
 UNION ALL SELECT w.start, w.start_path, parent, CASE WHEN r.k IS NULL THEN w.path ELSE w.path || '.orig' END FROM w JOIN edges ON child = w.k AND ord = 0 LEFT JOIN r ON r.k = w.k AND r.path = w.path) SELECT * FROM w""",
}
