"""Queries for stored payloads, signatures, tags, pages, repacking, tiers and ranges of history, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from chronolake.functions import lines, messages, text
from chronolake.operators import dag, history, ref_log, search, storage, trees
from chronolake.plans.oracle import _HEADER, COMMITS, EDGES, FILES, LOG, REFS, TREES, _reach
from chronolake.plans.queries import NODE, OTHER, THIRD, _pairs
from chronolake.sources import lake

INLINE = 2000


def _stored(s, d):
    rows = lake.objects(s, d)
    return rows.select(text.object_id("blob", F.col("raw")).alias("sha"), "raw").dropDuplicates(["sha"])


def _payloads(s, d):
    """Events with a sha and bytes in their payload."""
    n = F.col("event_id")
    payload = F.concat(F.lit('{"sha": "'), F.sha1(n.cast("string").cast("binary")), F.lit('", "data": [104, 105, '), (n % 200).cast("string"), F.lit("]}"))
    return lake.read(s, d, "events").select("event_id", payload.alias("payload"))


def event_payloads(s, d):
    """The sha of each event as a column, and its bytes restored from their numbers."""
    p = F.from_json("payload", "sha string, data array<int>")
    code = lambda x: F.lpad(F.lower(F.hex(x)), 2, "0")
    return _payloads(s, d).select("event_id", p.alias("p")).select("event_id", "p.sha", F.array_join(F.transform("p.data", code), "").alias("data"))


def _tags(s, d):
    t = lake.refs(s, d).where("name like 'refs/tags/%'")
    name = text.short_ref(F.col("name"))
    kind = F.when(F.col("target") % 2 == 0, "commit").otherwise("tree")
    broken = F.when(F.col("target") / 7 % 5 == 1, "nothing").otherwise(kind)
    return t.select(name.alias("tag"), messages.tag_text(F.col("target_sha"), broken, name, F.lit("T <t@example.org> 1600000000 +0000"), F.concat(F.lit("Release\n"), name)).alias("raw"))


def _signed(s, d):
    c = lake.commits(s, d)
    person = F.concat("author_name", F.lit(" <"), "author_email", F.lit("> "), F.unix_timestamp(F.col("author_date").cast("timestamp")).cast("string"), F.lit(" +0000"))
    raw = messages.commit_text(F.col("tree_sha"), F.transform("parents", lake.commit_sha), person, person, F.col("message"))
    return c.select("k", messages.signed(raw, F.when(F.col("gpg_signature").isNotNull(), F.concat(F.lit("-----BEGIN\n"), "gpg_signature", F.lit("\n-----END")))).alias("raw"))


def _bundled(s, d):
    n = F.col("p_partkey")
    return lake.read(s, d, "part").select(F.col("p_brand").alias("brand"), F.floor(n / 200).alias("pack"), n.alias("id"), F.col("p_size").cast("long").alias("size"), (n % 5 == 0).alias("is_deleted"))


def _index(s, d):
    return lake.read(s, d, "part").select(F.col("p_partkey").alias("key"), lake.pick(["hot", "warm", "cold"], F.col("p_partkey") % 3).alias("tier"), F.col("p_size").alias("size"))


def visible_objects(s, d):
    """Objects before a delete, hidden by it, and left after a compaction."""
    rows = storage.encoded(lake.objects(s, d)).select("sha").distinct()
    gone = rows.where("sha < '4'")
    count = lambda df, name: df.agg(F.count("*").alias("objects")).select(F.lit(name).alias("stage"), "objects")
    return count(rows, "before").union(count(rows.join(gone, "sha", "left_anti"), "hidden")).union(count(storage.compacted(storage.encoded(lake.objects(s, d)), gone), "purged"))


def mirrored_both_ways(s, d):
    """What a sync in both directions does with the names of either side."""
    refs = lake.refs(s, d).select("name", "target", F.col("target_sha").alias("sha"))
    remote, local = refs.where("target % 5 > 0").select("name", "sha"), refs.where("target % 5 < 4").select("name", F.when(F.col("target") % 5 == 2, "other").otherwise(F.col("sha")).alias("sha"))
    pull = search.mirror_plan(remote, local, "error").withColumnRenamed("action", "pull")
    push = search.mirror_plan(local, remote, "error").withColumnRenamed("action", "push")
    return pull.join(push, "name", "full_outer").select("name", "pull", "push")


def branch_diff(s, d):
    """The tree of each branch's commit against that of NODE."""
    t = lake.trees(s, d)
    tips = lake.refs(s, d).where("name like 'refs/heads/%'").select(F.col("name").alias("branch"), F.col("target").alias("k"))
    base = tips.select("branch", F.lit(NODE).cast("long").alias("k")).join(t, "k").drop("k")
    return trees.tree_diff(base, t.join(tips, "k").drop("k"), ["branch"])


def bundle_catalog(s, d):
    op = F.when(F.col("event_type") == "signup", "record").when(F.col("event_type") == "error", "delete").when((F.col("event_type") == "click") & (F.col("event_id") % 40 == 0), "seal").otherwise("add")
    return storage.bundle_catalog(lake.read(s, d, "events").select(F.floor(F.col("event_id") / 12).alias("bundle"), F.col("event_id").alias("id"), op.alias("op")))


QUERIES = {
    "branch_diff": branch_diff,
    "bundle_catalog": bundle_catalog,
    "log_graph": lambda s, d: history.with_graph(lake.commits(s, d), 60),
    "event_payloads": event_payloads,
    "storage_variants": lambda s, d: storage.decoded_payloads(storage.variant_payloads(_stored(s, d), INLINE)).select("sha", "key", "size", F.octet_length("raw").cast("long").alias("inline_bytes")),
    "author_lines": lambda s, d: lake.commits(s, d).select("k", messages.author_line(F.concat("author_name", F.lit(" <"), "author_email", F.when(F.col("k") % 7 == 0, "").otherwise("> "), F.unix_timestamp(F.col("author_date").cast("timestamp")).cast("string"), F.when(F.col("k") % 2 == 0, " +0000").otherwise(""))).alias("a")).select("k", "a.*"),
    "log_entries": lambda s, d: lake.commits(s, d).select("sha", F.left("sha", F.lit(7)).alias("short_sha"), "author_name", "author_date", "committer_name", "committer_date", text.subject(F.col("message")).alias("subject"), (F.size("parents") > 1).alias("is_merge")),
    "tag_objects": lambda s, d: _tags(s, d).select("tag", text.object_id("tag", F.col("raw").cast("binary")).alias("id"), messages.tag_fields(F.col("raw")).alias("f")).select("tag", "id", "f.target", "f.kind", F.col("f.tagger.ms").alias("tagger_ms"), "f.message"),
    "commit_signatures": lambda s, d: _signed(s, d).select("k", messages.signature(F.col("raw")).alias("signature"), text.object_id("commit", F.col("raw").cast("binary")).alias("id")),
    "hot_top_entries": lambda s, d: lake.files(s, d).groupBy(F.substring_index("path", "/", 1).alias("entry")).agg(F.count_distinct("k").alias("commits")).orderBy(F.desc("commits"), "entry").limit(50),
    "pack_page": lambda s, d: storage.listed_after(lake.read(s, d, "part").select(F.concat(F.lit("pack-"), F.sha1(F.col("p_partkey").cast("string").cast("binary"))).alias("pack"), F.col("p_size").alias("size")), "pack", "pack-5", 100),
    "hunk_lines": lambda s, d: _pairs(s, d).select("doc_id", F.explode(lines.hunks("text", "new")).alias("h")).select("doc_id", "h.start", "h.count", F.size("h.lines").alias("lines")),
    "bundle_repacking": lambda s, d: storage.repacked(_bundled(s, d), "brand", 180, 120),
    "promotions": lambda s, d: storage.promotions(_index(s, d), "aggressive", 20),
    "migrated_index": lambda s, d: storage.migrated(_index(s, d).select("key", "tier"), _index(s, d).where("tier = 'hot' and size > 40").select("key"), "warm").groupBy("tier").agg(F.count("*").alias("objects")),
    "visible_objects": visible_objects,
    "mirrored_both_ways": mirrored_both_ways,
    "state_at_lsn": lambda s, d: ref_log.state(lake.ref_log(s, d).withColumn("lsn", messages.lsn(F.col("ts"), F.col("version"))).where(F.col("lsn") <= F.lit(1_705_000_000_000 << 16))).select("ref_name", "new_sha"),
    "resources": lambda s, d: lake.refs(s, d).select(F.concat("name", F.when(F.col("target") % 4 == 0, "..main").when(F.col("target") % 4 == 1, "...main").when(F.col("target") % 4 == 2, ":src/a:b.ts").otherwise("")).alias("name")).select("name", messages.resource(F.col("name")).alias("r")).select("name", "r.*"),
    "shallow_since": lambda s, d: dag.shallow_since(lake.commit_parents(s, d), lake.read(s, d, "orders").select(F.col("o_orderkey").alias("node"), F.col("o_orderdate").alias("date")), [NODE, OTHER, THIRD], "1995-06-01"),
    "range_beyond_nearest": lambda s, d: dag.beyond_nearest(lake.commit_parents(s, d), NODE, OTHER),
    "recursive_base": lambda s, d: dag.recursive_base(lake.commit_parents(s, d), NODE, OTHER),
    "branch_tracking": lambda s, d: lake.ref_details(s, d).where("upstream is not null").select(text.short_ref(F.col("name")).alias("branch"), F.split(F.regexp_replace("upstream", "^refs/remotes/", ""), "/", 2)[0].alias("remote"), "ahead", "behind"),
    "commit_walk_stats": lambda s, d: history.matching(lake.commits(s, d), merges=True).groupBy("repository").agg(F.count("*").alias("merges")),
}

_RAWS = f"raws AS (SELECT raw, sha1({_HEADER.format(r='raw')}) AS sha FROM (SELECT encode(text) AS raw FROM documents UNION ALL SELECT encode(html) FROM pages))"
_PERSON = "author_name || ' <' || author_email || '> ' || epoch(author_date)::BIGINT || ' +0000'"
_SIGNED = f"""s AS (SELECT k, '-----BEGIN' || chr(10) || gpg_signature || chr(10) || '-----END' AS signature, 'tree ' || tree_sha || chr(10) || array_to_string(list_transform(parents, lambda p: 'parent ' || sha1('commit ' || p) || chr(10)), '') || 'author ' || {_PERSON} || chr(10) || 'committer ' || {_PERSON} AS head, message FROM commits),
 r AS (SELECT k, signature, head || coalesce(chr(10) || 'gpgsig ' || replace(signature, chr(10), chr(10) || ' '), '') || chr(10) || chr(10) || message AS raw FROM s)"""
_TAG = """t AS (SELECT regexp_replace(name, '^refs/tags/', '') AS tag, target_sha, CASE WHEN target // 7 % 5 = 1 THEN 'nothing' WHEN target % 2 = 0 THEN 'commit' ELSE 'tree' END AS kind FROM refs WHERE name LIKE 'refs/tags/%'),
 r AS (SELECT *, 'object ' || target_sha || chr(10) || 'type ' || kind || chr(10) || 'tag ' || tag || chr(10) || 'tagger T <t@example.org> 1600000000 +0000' || chr(10) || chr(10) || 'Release' || chr(10) || tag AS raw FROM t)"""

ORACLE = {
    "branch_diff": f"""WITH {TREES}, {REFS}, b AS (SELECT name AS branch, target FROM refs WHERE name LIKE 'refs/heads/%'), o AS (SELECT branch, path, blob, mode FROM b JOIN trees ON k = {NODE}), n AS (SELECT branch, path, blob, mode FROM b JOIN trees ON k = target),
 j AS (SELECT branch, path, CASE WHEN o.blob IS NULL THEN 'A' WHEN n.blob IS NULL THEN 'D' WHEN o.blob <> n.blob OR o.mode <> n.mode THEN 'M' END AS status, o.blob AS old_blob, n.blob AS new_blob FROM o FULL JOIN n USING (branch, path)) SELECT * FROM j WHERE status IS NOT NULL""",
    "bundle_catalog": """WITH e AS (SELECT event_id // 12 AS bundle, event_id AS id, CASE WHEN event_type = 'signup' THEN 'record' WHEN event_type = 'error' THEN 'delete' WHEN event_type = 'click' AND event_id % 40 = 0 THEN 'seal' ELSE 'add' END AS op FROM events),
 c AS (SELECT bundle, min(id) FILTER (op IN ('seal', 'delete')) AS closed, bool_or(op = 'seal') AS is_sealed, bool_or(op = 'delete') AS is_deleted FROM e GROUP BY 1)
 SELECT c.bundle AS bundle, (SELECT count(*) FROM e WHERE e.bundle = c.bundle AND op = 'add' AND (closed IS NULL OR id < closed)) AS objects, is_sealed, is_deleted FROM c""",
    "event_payloads": "SELECT event_id, sha1(event_id::VARCHAR) AS sha, '6869' || lpad(lower(hex(event_id % 200)), 2, '0') AS data FROM events",
    "storage_variants": f"WITH {_RAWS}, o AS (SELECT DISTINCT sha, octet_length(raw)::BIGINT AS n FROM raws) SELECT sha, CASE WHEN n > {INLINE} THEN 'objects/' || left(sha, 2) || '/' || substring(sha, 3) END AS key, CASE WHEN n > {INLINE} THEN n END AS size, CASE WHEN n <= {INLINE} THEN n END AS inline_bytes FROM o",
    "author_lines": f"WITH {COMMITS} SELECT k, CASE WHEN k % 7 > 0 THEN author_name ELSE '' END AS name, CASE WHEN k % 7 > 0 THEN author_email ELSE '' END AS email, CASE WHEN k % 7 > 0 THEN epoch(author_date)::BIGINT * 1000 ELSE 0 END AS ms FROM commits",
    "log_entries": f"WITH {COMMITS} SELECT sha, left(sha, 7) AS short_sha, author_name, author_date, committer_name, committer_date, trim(split_part(message, chr(10), 1)) AS subject, len(parents) > 1 AS is_merge FROM commits",
    "tag_objects": f"WITH {REFS}, {_TAG} SELECT tag, sha1(encode('tag ' || strlen(raw)) || '\\x00'::BLOB || encode(raw)) AS id, CASE WHEN kind <> 'nothing' THEN target_sha END AS target, nullif(kind, 'nothing') AS kind, CASE WHEN kind <> 'nothing' THEN 1600000000000 END AS tagger_ms, CASE WHEN kind <> 'nothing' THEN 'Release' || chr(10) || tag END AS message FROM r",
    "commit_signatures": f"WITH {COMMITS}, {_SIGNED} SELECT k, signature, sha1(encode('commit ' || strlen(raw)) || '\\x00'::BLOB || encode(raw)) AS id FROM r",
    "hot_top_entries": f"WITH {FILES} SELECT split_part(path, '/', 1) AS entry, count(DISTINCT k) AS commits FROM files GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 50",
    "pack_page": "SELECT 'pack-' || sha1(p_partkey::VARCHAR) AS pack, p_size AS size FROM part WHERE 'pack-' || sha1(p_partkey::VARCHAR) > 'pack-5' ORDER BY 1 LIMIT 100",
    "bundle_repacking": """WITH RECURSIVE b AS (SELECT p_brand AS brand, p_partkey // 200 AS pack, p_partkey AS id, p_size::BIGINT AS size FROM part), small AS (SELECT brand, pack FROM b GROUP BY 1, 2 HAVING sum(size) < 180),
 n AS (SELECT brand, id, size, row_number() OVER (PARTITION BY brand ORDER BY id) AS nth FROM b JOIN small USING (brand, pack) WHERE id % 5 > 0),
 w AS (SELECT brand, id, size, nth, size AS used, 0::BIGINT AS pack FROM n WHERE nth = 1 UNION ALL SELECT n.brand, n.id, n.size, n.nth, CASE WHEN w.used + n.size > 120 THEN n.size ELSE w.used + n.size END, w.pack + CASE WHEN w.used + n.size > 120 THEN 1 ELSE 0 END FROM w JOIN n ON n.brand = w.brand AND n.nth = w.nth + 1)
 SELECT brand, id, size, pack FROM w""",
    "promotions": "SELECT p_partkey AS key FROM part WHERE p_partkey % 3 > 0 AND p_size <= 20",
    "migrated_index": "SELECT CASE WHEN p_partkey % 3 = 0 AND p_size > 40 THEN 'warm' ELSE ['hot', 'warm', 'cold'][p_partkey % 3 + 1] END AS tier, count(*) AS objects FROM part GROUP BY 1",
    "visible_objects": f"WITH {_RAWS}, o AS (SELECT DISTINCT sha FROM raws) SELECT 'before' AS stage, count(*) AS objects FROM o UNION ALL SELECT 'hidden', count(*) FILTER (sha >= '4') FROM o UNION ALL SELECT 'purged', count(*) FILTER (sha >= '4') FROM o",
    "mirrored_both_ways": f"WITH {REFS} SELECT name, CASE target % 5 WHEN 0 THEN NULL WHEN 4 THEN 'create' WHEN 2 THEN 'conflict' ELSE 'skip' END AS pull, CASE target % 5 WHEN 4 THEN NULL WHEN 0 THEN 'create' WHEN 2 THEN 'conflict' ELSE 'skip' END AS push FROM refs",
    "state_at_lsn": f"WITH {LOG}, l AS (SELECT ref_name, arg_max(new_sha, version) AS new_sha FROM log WHERE (epoch_us(ts) // 1000) * 65536 + version % 65536 <= 1705000000000 * 65536 GROUP BY 1) SELECT * FROM l WHERE new_sha <> ''",
    "resources": f"WITH {REFS} SELECT name || ['..main', '...main', ':src/a:b.ts', ''][target % 4 + 1] AS name, ['diff', 'diff', 'file', 'commit'][target % 4 + 1] AS kind, refs.name AS \"left\", ['main', 'main', 'src/a:b.ts', NULL][target % 4 + 1] AS \"right\" FROM refs",
    "shallow_since": f"WITH RECURSIVE {EDGES}, young AS (SELECT o_orderkey AS n FROM orders WHERE o_orderdate >= TIMESTAMP '1995-06-01'), w(node) AS (SELECT n FROM young WHERE n IN ({NODE}, {OTHER}, {THIRD}) UNION SELECT parent FROM w JOIN edges ON node = child WHERE parent IN (SELECT n FROM young)) SELECT node FROM w",
    "range_beyond_nearest": _reach(NODE, OTHER) + f", c AS (SELECT node, depth FROM reach WHERE start = {OTHER} AND node IN (SELECT node FROM reach WHERE start = {NODE})), b(node) AS (SELECT node FROM c WHERE depth = (SELECT min(depth) FROM c) UNION SELECT parent FROM b JOIN edges ON node = child) SELECT DISTINCT node FROM reach WHERE node NOT IN (SELECT node FROM b)",
    "branch_tracking": f"WITH {REFS} SELECT replace(name, 'refs/heads/', '') AS branch, 'origin' AS remote, ahead, behind FROM refs WHERE name LIKE 'refs/heads/%'",
    "commit_walk_stats": f"WITH {COMMITS} SELECT repository, count(*) AS merges FROM commits WHERE len(parents) > 1 GROUP BY 1",
}
