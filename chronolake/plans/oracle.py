"""SQL for DuckDB that gives the rows of the registered queries, over the same tables."""

from __future__ import annotations

from chronolake.functions import text
from chronolake.operators import access
from chronolake.plans import queries as q
from chronolake.sources import lake


def _list(values: list[str]) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


def _map(table: dict[str, str]) -> str:
    return "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in table.items()) + "}"


_PARENTS = "CASE WHEN {k} = 0 THEN [] WHEN {k} % 3 = 0 AND {k} // 2 <> {k} // 3 THEN [{k} // 2, {k} // 3] ELSE [{k} // 2] END"
COMMITS = f"""commits AS (SELECT o_orderkey k, sha1('commit ' || o_orderkey) sha, sha1('tree ' || o_orderkey) tree_sha, c_name author_name,
  (CASE WHEN o_orderkey % 2 = 0 THEN upper(c_name) ELSE lower(c_name) END) || '@example.com' author_email, o_orderdate author_date,
  o_orderpriority || chr(10) || 'order ' || o_orderkey message, o_orderstatus repository, {_PARENTS.format(k='o_orderkey')} parents,
  'Committer#' || (o_orderkey % 97) committer_name, 'committer' || (o_orderkey % 97) || '@example.org' committer_email, o_orderdate + to_hours(o_orderkey % 5) committer_date, CASE WHEN o_orderkey % 11 = 0 THEN 'sig ' || o_orderkey END gpg_signature
  FROM orders JOIN customer ON o_custkey = c_custkey)"""
EDGES = """edges AS (SELECT o_orderkey child, o_orderkey // 2 parent, 0 ord FROM orders WHERE o_orderkey > 0
  UNION ALL SELECT o_orderkey, o_orderkey // 3, 1 FROM orders WHERE o_orderkey > 0 AND o_orderkey % 3 = 0 AND o_orderkey // 2 <> o_orderkey // 3)"""
FILES = f"""files AS (SELECT l_orderkey k, (CASE WHEN p_size = 50 THEN '' ELSE lower(p_type) || '/' || replace(lower(p_brand), '#', '') || '/' END) || replace(p_name, ' ', '_') || {_list(lake.EXTENSIONS)}[p_size % 8 + 1] AS path,
  CASE WHEN l_returnflag = 'A' THEN 'A' WHEN l_returnflag = 'N' THEN 'M' WHEN l_linestatus = 'F' THEN 'D' ELSE 'R' END change_type, p_size % 10 = 9 is_binary, l_quantity::INT added, floor(l_tax * 100)::INT removed,
  p_size::BIGINT * 100 old_size, sha1('blob ' || l_partkey || ':0') old_blob_sha, p_size::BIGINT * 100 + l_quantity::BIGINT new_size, sha1('blob ' || l_partkey || ':' || l_suppkey) new_blob_sha, CASE WHEN l_suppkey % 7 = 0 THEN '100755' ELSE '100644' END AS mode, l_shipdate commit_date
  FROM lineitem JOIN part ON l_partkey = p_partkey)"""
TREES = FILES + ", trees AS (SELECT k, path, min(new_blob_sha) AS blob, min(mode) AS mode FROM files GROUP BY ALL)"
REFS = """refs AS (SELECT CASE s_suppkey % 4 WHEN 0 THEN 'refs/heads/' || lower(n_name) || '-' || s_suppkey WHEN 1 THEN 'refs/tags/v' || (s_suppkey % 3) || '.' || (s_suppkey % 11) || '.' || s_suppkey
  WHEN 2 THEN 'refs/remotes/origin/' || lower(n_name) || '-' || s_suppkey ELSE 'refs/notes/' || lower(n_name) || '-' || s_suppkey END AS name, s_suppkey * 7 AS target, sha1('commit ' || (s_suppkey * 7)) target_sha,
  (floor(abs(s_acctbal))::BIGINT % 10)::INT ahead, (floor(abs(s_acctbal))::BIGINT // 10 % 10)::INT behind FROM supplier JOIN nation ON s_nationkey = n_nationkey)"""
REPOS = f"""people AS (SELECT c_nationkey n, count(*) c FROM customer GROUP BY 1), work AS (SELECT c_nationkey n, count(*) c FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1),
 repos AS (SELECT lower(r_name) || '/' || lower(n_name) full_name, {_list(lake.HOSTS)}[n_nationkey % 5 + 1] AS source, {_list(lake.SYNC)}[n_nationkey % 4 + 1] AS sync_status, CASE WHEN n_nationkey % 4 = 1 THEN 'timeout ' || n_nationkey END last_error,
 coalesce(w.c, 0) commit_count, coalesce(p.c, 0) contributor_count FROM nation JOIN region ON n_regionkey = r_regionkey LEFT JOIN people p ON p.n = n_nationkey LEFT JOIN work w ON w.n = n_nationkey)"""
LOG = "log AS (SELECT event_id + 1 AS version, 'refs/heads/u' || user_id ref_name, CASE WHEN event_type = 'error' THEN '' ELSE sha1(event_id::VARCHAR) END new_sha, ts FROM events)"
CDC = f"""cdc AS (SELECT 'evt-' || event_id AS event_id, ({_map(lake.EVENT_KINDS)})[event_type] AS event_type, {_list(lake.HOSTS)}[event_id % 5 + 1] AS source, ts, event_id AS sequence, props payload, user_id, value FROM events)"""
_HEADER = "encode('blob ' || octet_length({r})) || '\\x00'::BLOB || {r}"
OBJECTS = f"""raws AS (SELECT 'd' origin, doc_id id, encode(text) raw FROM documents UNION ALL SELECT 'p', page_id, encode(html) FROM pages),
 objects AS (SELECT origin, id, sha1({_HEADER.format(r='raw')}) sha, octet_length(raw) AS size, CASE WHEN octet_length(raw) > 1048576 THEN 'external' ELSE 'inline' END AS storage FROM raws)"""
REVIEWS = f"reviews AS (SELECT conv_id pr, turn id, role reviewer, {_list(lake.REVIEW_STATES)}[(conv_id + turn) % 3 + 1] AS state FROM conversations)"
_STATE = "SELECT ref_name, arg_max(new_sha, version) new_sha, max(version) AS version FROM {log} GROUP BY ref_name"
_EXT = r"nullif(regexp_extract({p}, '(\.[^./]*)$', 1), '')"
_REST = r"regexp_replace(regexp_extract(path, '[^/]*$'), '^\.', '')"
_LANG = f"coalesce(({_map(text.LANGUAGES)})[lower(regexp_extract({_REST}, '^.+\\.([^.]*)$', 1))], CASE WHEN starts_with(regexp_extract(path, '[^/]*$'), '.') THEN ({_map(text.DOTFILES)})[lower({_REST})] END)"
_SUBJECT = "trim(split_part(message, chr(10), 1))"
_BODY = r"trim(regexp_extract(message, '^[^\n]*\n((?s:.*))$', 1))"
_SHORT = "regexp_replace(name, '^refs/(heads|tags|remotes|notes)/', '')"
_KIND = "CASE WHEN name LIKE 'refs/heads/%' THEN 'branch' WHEN name LIKE 'refs/tags/%' THEN 'tag' WHEN name LIKE 'refs/remotes/%' THEN 'remote' WHEN name LIKE 'refs/notes/%' THEN 'notes' ELSE 'other' END"


def _day(ts: str) -> str:
    return f"strftime({ts}, '%Y-%m-%d')"


def _reach(*starts: int, where: str = "TRUE", depth: str = "TRUE") -> str:
    values = ", ".join(f"({n}::BIGINT)" for n in starts)
    return f"""WITH RECURSIVE {EDGES}, walk(start, node, depth) AS (SELECT n, n, 0 FROM (VALUES {values}) v(n) UNION SELECT start, parent, depth + 1 FROM walk JOIN edges ON node = child WHERE {where} AND {depth}),
 reach AS (SELECT start, node, min(depth) depth FROM walk GROUP BY ALL)"""


def _both(old: str, new: str) -> str:
    return f"""SELECT k, path, CASE WHEN o.blob IS NULL THEN 'A' WHEN n.blob IS NULL THEN 'D' WHEN left(o.mode, 3) <> left(n.mode, 3) THEN 'T' WHEN o.blob <> n.blob OR o.mode <> n.mode THEN 'M' END status,
  o.blob old_blob, n.blob new_blob FROM {old} o FULL JOIN {new} n USING (k, path)"""


_OLD = "old AS (SELECT child k, path, blob, mode FROM trees JOIN edges ON k = parent AND ord = 0)"
_DIFF = f"WITH {TREES}, {EDGES}, {_OLD}, diff AS (SELECT * FROM ({_both('old', 'trees')}) WHERE status IS NOT NULL)"
_MOVED = f"""WITH {TREES}, moved AS (SELECT k, CASE WHEN path LIKE '%.ts' THEN 'moved/' || path ELSE path END AS path, blob, mode FROM trees UNION ALL SELECT k, 'copy/' || path, blob, mode FROM trees WHERE path LIKE '%.go'),
 diff AS (SELECT * FROM ({_both('trees', 'moved')}) WHERE status IS NOT NULL)"""
N, M, T = q.NODE, q.OTHER, q.THIRD


def _protection() -> str:
    rank = lambda r: (-(r["pattern"].count("*") == 0), r["pattern"].count("*"), -len(r["pattern"]))
    rules = sorted(q.RULES, key=rank)
    fits = lambda r: f"regexp_matches(name, '{text.ref_glob_regex(r['pattern'])}')"
    why = lambda r: f"CASE WHEN is_delete AND {r.get('no_delete', False)} THEN 'delete' WHEN is_force AND {r.get('no_force', False)} THEN 'force-push' WHEN approvals < {r.get('approvals', 0)} THEN 'reviews' ELSE 'ok' END"
    u = f"SELECT {_SHORT} AS name, ahead > 6 is_delete, behind > 4 is_force, target % 3 approvals FROM refs WHERE name LIKE 'refs/heads/%'"
    patterns = " ".join(f"WHEN {fits(r)} THEN '{r['pattern']}'" for r in rules)
    return f"WITH {REFS}, u AS ({u}) SELECT name, CASE {patterns} END AS rule, CASE {' '.join(f'WHEN {fits(r)} THEN {why(r)}' for r in rules)} ELSE 'ok' END AS verdict FROM u"


def _permissions() -> str:
    level = lambda c: f"coalesce(list_position({_list(access.LEVELS)}, {c}), 1) - 1"
    ops = list(access.NEEDED)
    need = f"list_position({_list(access.LEVELS)}, ({_map(access.NEEDED)})[op]) - 1"
    return f"""WITH g AS (SELECT c_custkey u, c_nationkey r, {level(f"{_list(access.LEVELS)}[c_custkey % 4 + 1]")} own FROM customer WHERE c_acctbal > 3000 AND c_custkey % 5 <> 0),
 x AS (SELECT c_custkey AS "user", c_nationkey AS repository, {_list(ops)}[c_custkey % 7 + 1] AS op, greatest(coalesce(own, 0), n_nationkey % 3, CASE WHEN n_nationkey % 2 = 0 THEN 1 ELSE 0 END) best
 FROM customer JOIN nation ON c_nationkey = n_nationkey LEFT JOIN g ON u = c_custkey AND r = c_nationkey) SELECT "user", repository, op, {_list(access.LEVELS)}[best + 1] AS level, best >= {need} AS allowed FROM x"""


def _sparse() -> str:
    out = "FALSE"
    for p in q.SPARSE:
        negated, p = p.startswith("!"), p.lstrip("!")
        anchored, beneath, p = p.startswith("/"), p.endswith("/"), p.strip("/")
        out = f"CASE WHEN regexp_matches(path, '{'^' if anchored else '(^|/)'}{text.glob_regex(p)[1:-1]}{'/' if beneath else '(/|$)'}') THEN {not negated} ELSE {out} END"
    return out


def _globs() -> str:
    one = lambda p: f"regexp_matches(path, '{text.glob_regex(p)}')"
    return f"({one('economy/**/*.{ts,py}')} OR {one('*/brand1?/*.md')}) AND NOT {one('**/red_*')}"


_FORKS = f"base AS (SELECT * FROM log WHERE version <= {q.FORK}), o AS (SELECT ref_name, arg_max(new_sha, version) o FROM log WHERE version > {q.FORK} AND version % 5 IN (0, 1) GROUP BY 1), t AS (SELECT ref_name, arg_max(new_sha, version) t FROM log WHERE version > {q.FORK} AND version % 5 IN (1, 2) GROUP BY 1), b AS (SELECT * FROM ({_STATE.format(log='base')}) WHERE new_sha <> '')"
_NAMES = "regexp_replace(name, '^v', '')"

ORACLE: dict[str, str] = {
    "commits_per_author": f"WITH {COMMITS} SELECT author_name, count(*) AS commits FROM commits GROUP BY 1",
    "commit_frequency": f"WITH {COMMITS} SELECT {_day('author_date')} AS date, count(*) AS commits FROM commits GROUP BY 1",
    "contributors": f"WITH {COMMITS} SELECT lower(author_email) AS email, arg_min(author_name, (author_date, k)) AS name, count(*) AS commits, min(author_date) AS first_commit, max(author_date) AS last_commit FROM commits GROUP BY 1",
    "language_breakdown": f"WITH {FILES}, p AS (SELECT DISTINCT path FROM files), l AS (SELECT {_LANG} AS language, count(*) files FROM p GROUP BY 1) SELECT language, files, floor(files * 1000.0::DOUBLE / sum(files) OVER () + 0.5) / 10.0::DOUBLE AS percentage FROM l WHERE language IS NOT NULL",
    "hot_files": f"WITH {FILES} SELECT path, count(*) AS changes FROM files GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 50",
    "churn_by_day": f"WITH {FILES} SELECT {_day('commit_date')} AS date, count(*) AS files_changed FROM files GROUP BY 1",
    "churn_by_extension": f"WITH {FILES} SELECT {_EXT.format(p='path')} AS extension, sum(added)::BIGINT AS lines_added, sum(removed)::BIGINT AS lines_removed FROM files WHERE NOT is_binary GROUP BY 1",
    "large_additions": f"WITH {FILES} SELECT k, path, added AS lines_added FROM files WHERE NOT is_binary AND added > 45",
    "merge_commits": f"WITH {COMMITS} SELECT k, sha, len(parents)::INT AS n_parents FROM commits WHERE len(parents) > 1",
    "latest_commits": f"WITH {COMMITS} SELECT k, sha, author_name, author_date FROM commits ORDER BY author_date DESC, k DESC LIMIT 10",
    "commit_projection": f"WITH {COMMITS} SELECT sha, tree_sha, '[' || array_to_string(list_transform(parents, lambda p: '\"' || sha1('commit ' || p) || '\"'), ',') || ']' AS parent_shas, author_name, author_email, (epoch_us(author_date) // 1000) AS author_ms, {_SUBJECT} AS message_subject, {_BODY} AS message_body, repository, len(parents) > 1 AS is_merge FROM commits",
    "file_projection": f"WITH {FILES} SELECT k, path, CASE WHEN change_type = 'R' THEN path || '.orig' END AS old_path, change_type, is_binary, CASE WHEN NOT is_binary THEN added END AS lines_added, CASE WHEN NOT is_binary THEN removed END AS lines_removed, {_EXT.format(p='path')} AS extension, CASE WHEN contains(path, '/') THEN regexp_replace(path, '/[^/]*$', '') ELSE '.' END AS directory, {_LANG} AS language FROM files",
    "commit_totals": f"WITH {COMMITS} SELECT count(*) AS commits, count(DISTINCT lower(author_email)) AS contributors FROM commits",
    "files_per_path": f"WITH {FILES} SELECT path, count(*) AS files FROM files GROUP BY 1",
    "log_filtered": f"WITH {COMMITS} SELECT k, author_name, author_date FROM commits WHERE contains(lower(author_name), 'customer#00000001') AND author_date >= DATE '1996-01-01' AND author_date < DATE '1999-01-01'",
    "log_grep": f"WITH {COMMITS} SELECT k, author_date FROM commits WHERE regexp_matches(message, 'URGENT\\norder [0-9]*7$') ORDER BY author_date DESC, k DESC LIMIT 100 OFFSET 5",
    "log_format": f"WITH {COMMITS} SELECT k, left(sha, 7) || ' ' || author_name || ' <' || author_email || '> ' || strftime(author_date, '%Y-%m-%d %H:%M:%S') || ' ' || {_SUBJECT} || ' | ' || {_BODY} AS line FROM commits",
    "pair_churn": f"WITH {COMMITS}, {FILES} SELECT {_day('c.author_date')} AS day, count(*) AS files FROM commits c JOIN commits p ON c.parents[1] = p.k JOIN files f ON f.k = c.k WHERE len(c.parents) > 0 GROUP BY 1",
    "empty_commits": f"WITH {COMMITS} SELECT c.k FROM commits c JOIN commits p ON c.parents[1] = p.k WHERE len(c.parents) > 0 AND c.k % 7 = p.k % 7",
    "path_glob_filter": f"WITH {FILES} SELECT path, count(*) AS n FROM files WHERE {_globs()} GROUP BY 1",
    "sparse_filter": f"WITH {FILES} SELECT DISTINCT path FROM files WHERE {_sparse()}",
    "identity_parse": f"WITH {COMMITS} SELECT k, author_name AS name, author_email AS email, epoch(author_date)::BIGINT AS seconds, '+0000' AS zone FROM commits",
    "repo_totals": f"WITH {REPOS} SELECT count(*) AS repositories, sum(commit_count)::BIGINT AS commits, sum(contributor_count)::BIGINT AS contributors FROM repos WHERE sync_status = 'synced'",
    "failed_syncs": f"WITH {REPOS} SELECT full_name, last_error FROM repos WHERE sync_status = 'failed'",
    "sync_rollup": f"WITH {REPOS} SELECT coalesce(source, 'all') AS source, count(*) AS repositories, sum(commit_count)::BIGINT AS commits FROM repos GROUP BY ROLLUP (source)",
    "branches_behind": f"WITH {REFS} SELECT name, ahead, behind FROM refs WHERE name LIKE 'refs/heads/%' AND behind > 0",
    "release_tags": f"WITH {REFS} SELECT {_SHORT} AS tag, target_sha FROM refs WHERE name LIKE 'refs/tags/v%'",
    "ref_types": f"WITH {REFS} SELECT {_KIND} AS ref_type, count(*) AS refs FROM refs GROUP BY 1",
    "ref_projection": f"WITH {REFS} SELECT name, {_SHORT} AS short_name, {_KIND} AS ref_type, target_sha, TRUE AS valid FROM refs",
    "namespace_roundtrip": f"WITH {REPOS} SELECT source || ':' || full_name AS namespace, source, full_name AS path FROM repos",
    "protection_verdicts": _protection(),
    "tags_version_sort": f"WITH {REFS}, t AS (SELECT {_SHORT} AS name FROM refs WHERE name LIKE 'refs/tags/%') SELECT name AS tag, row_number() OVER (ORDER BY split_part({_NAMES}, '.', 1)::INT, split_part({_NAMES}, '.', 2)::INT, split_part({_NAMES}, '.', 3)::INT)::INT AS place FROM t",
    "permission_verdicts": _permissions(),
    "reflog_state": f"WITH {LOG} SELECT * FROM ({_STATE.format(log='log')}) WHERE new_sha <> ''",
    "reflog_time_travel": f"WITH {LOG}, cut AS (SELECT * FROM log WHERE version <= {q.VERSION}) SELECT * FROM ({_STATE.format(log='cut')}) WHERE new_sha <> ''",
    "reflog_rollback": f"WITH {LOG}, cut AS (SELECT * FROM log WHERE version < {q.VERSION}) SELECT * FROM ({_STATE.format(log='cut')}) WHERE new_sha <> ''",
    "reflog_fork_state": f"WITH {LOG}, b AS (SELECT ref_name, new_sha, 0 origin, version FROM log WHERE version <= {q.FORK} UNION ALL SELECT ref_name, new_sha, 1, version FROM log WHERE version % 7 = 0 AND version < {q.VERSION}) SELECT * FROM (SELECT ref_name, arg_max(new_sha, (origin, version)) AS new_sha, max(origin)::INT AS from_fork FROM b GROUP BY 1) WHERE new_sha <> ''",
    "reflog_nth": f"WITH {LOG} SELECT ref_name, new_sha, version FROM (SELECT *, row_number() OVER (PARTITION BY ref_name ORDER BY version DESC) nth FROM log) WHERE nth = 3",
    "reflog_linked": f"WITH {LOG} SELECT version, ref_name, lag(new_sha, 1, '') OVER (PARTITION BY ref_name ORDER BY version) AS old_sha, new_sha FROM log",
    "reflog_three_way_merge": f"WITH {LOG}, {_FORKS}, r AS (SELECT ref_name, o, t, new_sha base_sha, CASE WHEN t IS NULL THEN 'ours' WHEN o IS NULL THEN 'theirs' WHEN o = t THEN 'same' WHEN o = '' OR t = '' THEN 'delete-update' ELSE 'divergent' END AS outcome FROM o FULL JOIN t USING (ref_name) LEFT JOIN b USING (ref_name)) SELECT ref_name, outcome, CASE WHEN outcome IN ('ours', 'same') THEN o WHEN outcome = 'theirs' THEN t END AS new_sha, base_sha FROM r",
    "reflog_fast_forward": "SELECT * FROM (VALUES ('ours_moved', 'ours'), ('theirs_moved', 'theirs'), ('both_moved', NULL)) v(\"case\", side)",
    "reflog_cas": f"WITH {LOG}, cut AS (SELECT * FROM log WHERE version <= {q.VERSION}), s AS ({_STATE.format(log='cut')}) SELECT ref_name, CASE WHEN version % 3 = 0 THEN 'stale' ELSE new_sha END AS expected, nullif(new_sha, '') AS actual, 'next' AS new_sha, version % 3 <> 0 AS ok FROM s",
    "ancestors": _reach(N) + " SELECT node FROM reach",
    "bfs_depth": _reach(N, M) + " SELECT start, node, depth FROM reach",
    "first_parent_log": _reach(N, where="ord = 0") + " SELECT node, depth FROM reach",
    "shallow_log": _reach(N, depth="depth < 3") + " SELECT node, depth FROM reach",
    "merge_base": _reach(N, M) + ", c AS (SELECT node FROM reach GROUP BY node HAVING count(DISTINCT start) = 2) SELECT node FROM c WHERE node NOT IN (SELECT parent FROM edges JOIN c ON child = node)",
    "common_history": _reach(N, M, T) + " SELECT node FROM reach GROUP BY node HAVING count(DISTINCT start) = 3",
    "independent_commits": _reach(N, M, N // 2, M // 4, 7) + " SELECT DISTINCT start AS node FROM reach WHERE start NOT IN (SELECT node FROM reach WHERE node <> start)",
    "rev_range_two_dot": _reach(N, M) + f" SELECT node FROM reach WHERE start = {N} AND node NOT IN (SELECT node FROM reach WHERE start = {M})",
    "rev_range_three_dot": _reach(N, T) + " SELECT node FROM reach GROUP BY node HAVING count(*) = 1",
    "ahead_behind": _reach(N, M, T) + f", p AS (SELECT * FROM (VALUES ({N}::BIGINT, {M}::BIGINT), ({N}, {T}), ({M}, {T}), ({N}, {N})) v(a, b)) SELECT a, b, (SELECT count(*) FROM reach x WHERE x.start = a AND x.node NOT IN (SELECT node FROM reach y WHERE y.start = b)) AS ahead, (SELECT count(*) FROM reach x WHERE x.start = b AND x.node NOT IN (SELECT node FROM reach y WHERE y.start = a)) AS behind FROM p",
    "topo_levels": f"WITH RECURSIVE {EDGES}, down(node, level) AS (SELECT 0::BIGINT, 0 UNION SELECT child, level + 1 FROM down JOIN edges ON parent = node) SELECT node, max(level)::INT AS level FROM down GROUP BY node",
    "symbolic_refs": f"WITH {REFS}, h AS (SELECT * FROM refs WHERE name LIKE 'refs/heads/%') SELECT name, target_sha AS target FROM h UNION ALL SELECT 'refs/remotes/alias/' || {_SHORT}, target_sha FROM h UNION ALL SELECT * FROM (VALUES ('refs/a', NULL), ('refs/b', NULL), ('refs/c', NULL)) v(name, target)",
    "tree_diff": _DIFF + " SELECT k, path, status, old_blob, new_blob FROM diff",
    "tree_diff_stats": _DIFF + " SELECT k, count(*) FILTER (status = 'A') AS added, count(*) FILTER (status = 'D') AS deleted, count(*) FILTER (status IN ('M', 'T')) AS modified FROM diff GROUP BY k",
    "exact_renames": _MOVED + ", g AS (SELECT k, old_blob AS blob, path, row_number() OVER (PARTITION BY k, old_blob ORDER BY path) nth FROM diff WHERE status = 'D'), n AS (SELECT k, new_blob AS blob, path, row_number() OVER (PARTITION BY k, new_blob ORDER BY path) nth FROM diff WHERE status = 'A') SELECT k, blob, g.path AS old_path, n.path AS new_path FROM g JOIN n USING (k, blob, nth)",
    "copy_detection": _MOVED + ", s AS (SELECT k, blob, min(path) source_path FROM trees GROUP BY ALL) SELECT k, path AS new_path, source_path FROM diff JOIN s USING (k) WHERE status = 'A' AND s.blob = new_blob",
    "tree_three_way_merge": f"""WITH {COMMITS}, {TREES}, m AS (SELECT k, parents[1] ours, parents[2] theirs, k // 6 base FROM commits WHERE len(parents) > 1), b AS (SELECT m.k, path, blob FROM m JOIN trees t ON t.k = base), o AS (SELECT m.k, path, blob FROM m JOIN trees t ON t.k = ours),
 t AS (SELECT m.k, path, blob FROM m JOIN trees t ON t.k = theirs), j AS (SELECT k, path, b.blob b, o.blob o, t.blob t FROM b FULL JOIN o USING (k, path) FULL JOIN t USING (k, path)),
 r AS (SELECT *, CASE WHEN o IS NOT DISTINCT FROM t THEN CASE WHEN o IS NULL THEN 'deleted' ELSE 'same' END WHEN b IS NOT DISTINCT FROM o THEN CASE WHEN t IS NULL THEN 'deleted' ELSE 'theirs' END
 WHEN b IS NOT DISTINCT FROM t THEN CASE WHEN o IS NULL THEN 'deleted' ELSE 'ours' END WHEN b IS NULL THEN 'add-add' WHEN t IS NULL THEN 'modify-delete' WHEN o IS NULL THEN 'delete-modify' ELSE 'content' END AS result FROM j)
 SELECT k, path, result, CASE WHEN result IN ('same', 'ours') THEN o WHEN result = 'theirs' THEN t END AS blob FROM r""",
    "object_ids": f"WITH {OBJECTS} SELECT origin, id, sha, size::BIGINT AS size FROM objects",
    "objects_storage_mode": f"WITH {OBJECTS} SELECT storage, count(*) AS objects, sum(size)::BIGINT AS bytes FROM objects GROUP BY 1",
    "objects_dedup_compact": f"WITH {OBJECTS} SELECT sha, arg_min(origin, (origin, id)) AS origin, arg_min(id, (origin, id)) AS id, any_value(size)::BIGINT AS size, count(*) AS copies FROM objects WHERE sha NOT IN (SELECT sha FROM objects WHERE id % 50 = 7) GROUP BY sha",
    "binary_objects": "SELECT FALSE AS is_binary, (SELECT count(*) FROM documents) + (SELECT count(*) FROM pages) AS objects",
    "sha_prefix_resolve": f"WITH {OBJECTS} SELECT DISTINCT sha FROM objects WHERE starts_with(sha, '0a') ORDER BY sha LIMIT 2",
    "gc_sweep": "WITH dead AS (SELECT o_orderkey id, o_custkey AS size, CASE WHEN o_orderdate > TIMESTAMP '2001-08-01' - INTERVAL 400 DAY THEN 'grace' ELSE 'delete' END AS action FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 10)), n AS (SELECT *, row_number() OVER (PARTITION BY action ORDER BY id) r FROM dead) SELECT id, size, CASE WHEN action = 'delete' AND r > 20 THEN 'later' ELSE action END AS action FROM n",
    "access_patterns": "SELECT user_id AS key, count(*) FILTER (event_type <> 'purchase') AS reads, count(*) FILTER (event_type = 'purchase') AS writes, max(ts) AS last_access, (sum(value::DECIMAL(18,2))::DOUBLE / count(*)) AS mean_latency FROM events GROUP BY 1",
    "tier_candidates": "SELECT o_orderkey AS key, o_orderdate AS created, coalesce(n, 0) AS accesses FROM orders LEFT JOIN (SELECT user_id u, count(*) n FROM events GROUP BY 1) ON u = o_orderkey WHERE o_orderdate < DATE '1998-01-01' AND coalesce(n, 0) <= 70 ORDER BY 2, 1 LIMIT 100",
    "tier_stats": "SELECT coalesce(tier, 'all') AS tier, count(*) AS objects, sum(size)::BIGINT AS bytes FROM (SELECT ['hot', 'warm', 'cold'][p_partkey % 3 + 1] AS tier, p_size AS size FROM part) GROUP BY ROLLUP (tier)",
    "tier_fallback_lookup": "WITH w AS (SELECT p_partkey * 2 AS key FROM part) SELECT w.key AS key, CASE WHEN p_partkey IS NULL THEN NULL WHEN w.key % 7 = 0 THEN 'hot' WHEN w.key % 3 = 0 THEN 'warm' ELSE 'cold' END AS tier, p_name || CASE WHEN w.key % 7 = 0 THEN ' 7' WHEN w.key % 3 = 0 THEN ' 3' ELSE ' 2' END AS value FROM w LEFT JOIN part ON p_partkey = w.key",
    "index_batch_lookup": "SELECT a.p_partkey * 3 AS key, b.p_size IS NOT NULL AS found, b.p_size AS size FROM part a LEFT JOIN part b ON b.p_partkey = a.p_partkey * 3",
    "chunk_ranges": "WITH p AS (SELECT p_partkey id, p_size::BIGINT * 300000 AS size FROM part), c AS (SELECT id, size, unnest(range(0, greatest(ceil(size / 2097152.0)::BIGINT, 1))) c FROM p) SELECT id, c::INT AS chunk, c * 2097152 AS start, least(2097152, size - c * 2097152) AS length FROM c",
    "variant_shred": f"WITH {CDC} SELECT event_id, json_extract(payload, '$.k')::INT AS k FROM cdc",
    "manifest_totals": f"WITH {FILES} SELECT change_type, count(*) AS files, sum(new_size)::BIGINT AS bytes, min(path) AS first_path, max(path) AS last_path FROM files GROUP BY 1",
    "snapshot_chain": f"WITH {CDC}, b AS (SELECT sequence // 100 AS batch, count(*) AS events, max((epoch_us(ts) // 1000)) * 1000 + sequence // 100 % 1000 AS snapshot_id FROM cdc GROUP BY sequence // 100) SELECT *, lag(snapshot_id) OVER (ORDER BY batch) AS parent_id FROM b",
    "review_state": f"WITH {REVIEWS}, l AS (SELECT pr, reviewer, arg_max(state, id) AS state FROM reviews GROUP BY ALL) SELECT pr, CASE WHEN bool_or(state = 'changes_requested') THEN 'changes_requested' WHEN bool_or(state = 'approved') THEN 'approved' ELSE 'pending' END AS state FROM l GROUP BY pr",
    "cdc_rows": f"WITH {CDC} SELECT event_id, event_type, source, (epoch_us(ts) // 1000) AS timestamp_ms, sequence, payload, json_extract(payload, '$.k')::INT AS k FROM cdc",
    "cdc_batches": f"WITH {CDC} SELECT sequence // 100 AS batch, count(*) AS events, min(sequence) AS first_sequence, max(sequence) AS last_sequence, min((epoch_us(ts) // 1000)) AS first_ms, max((epoch_us(ts) // 1000)) AS last_ms FROM cdc GROUP BY 1",
    "cdc_tumbling": f"WITH {CDC} SELECT time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01') AS start, event_type, count(*) AS events, sum(value::DECIMAL(18,2))::DOUBLE AS total FROM cdc GROUP BY 1, 2",
    "cdc_sliding": f"WITH {CDC}, w AS (SELECT time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01') - o.x * INTERVAL 6 HOUR AS start, event_type, value FROM cdc, (VALUES (0), (1)) o(x)) SELECT start, event_type, count(*) AS events, sum(value::DECIMAL(18,2))::DOUBLE AS total FROM w GROUP BY 1, 2",
    "cdc_session": f"WITH {CDC}, g AS (SELECT *, CASE WHEN ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 2 HOUR THEN 1 ELSE 0 END AS cut FROM cdc), n AS (SELECT *, sum(cut) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM g) SELECT user_id, min(ts) AS start, count(*) AS events FROM n GROUP BY user_id, s",
    "cdc_invalid_dlq": f"WITH {CDC} SELECT sequence, CASE WHEN sequence % 89 = 0 THEN '' ELSE event_id END AS event_id, CASE WHEN sequence % 97 = 0 THEN 'UNKNOWN' ELSE event_type END AS event_type FROM cdc WHERE sequence % 97 = 0 OR sequence % 89 = 0",
    "cdc_rolling_latency": f"WITH {CDC} SELECT user_id, sequence, round(avg(value) OVER (PARTITION BY user_id ORDER BY sequence ROWS BETWEEN 9 PRECEDING AND CURRENT ROW), 6) AS mean FROM cdc",
}
_SWEEP = ORACLE["gc_sweep"]
ORACLE["gc_summary"] = f"SELECT count(*) AS unreferenced, count(*) FILTER (action = 'delete') AS deleted, coalesce(sum(size) FILTER (action = 'delete'), 0)::BIGINT AS freed_bytes, count(*) FILTER (action = 'grace') AS skipped_grace FROM ({_SWEEP})"
ORACLE["missing_objects"] = _reach(N, T, M) + f" SELECT DISTINCT node FROM reach JOIN orders ON o_orderkey = node AND o_orderstatus = 'O' WHERE start IN ({N}, {T}) AND node NOT IN (SELECT node FROM reach WHERE start = {M})"
ORACLE["pr_page"] = f"SELECT * FROM ({ORACLE['review_state']}) ORDER BY pr DESC LIMIT 20 OFFSET 10"
_DIRECTORY = f"WITH {TREES} SELECT k, CASE WHEN contains(path, '/') THEN regexp_replace(path, '/[^/]*$', '') ELSE '' END AS directory, sha1(array_to_string(list(mode || ' ' || regexp_extract(path, '[^/]*$') || ' ' || blob ORDER BY regexp_extract(path, '[^/]*$')), chr(10))) AS id FROM trees GROUP BY 1, 2"
ORACLE["directory_ids"] = _DIRECTORY
ORACLE["shared_directories"] = f"SELECT id, count(*) AS uses FROM ({_DIRECTORY}) GROUP BY 1"
ORACLE["similarity_scores"] = "WITH p AS (SELECT p_partkey, p_name n, 'small red widget' w FROM part) SELECT p_partkey, floor(100 * len(list_filter(range(1, 1 + least(length(n), length(w))), lambda i: n[i] = w[i])) / greatest(length(n), length(w)) + 0.5)::INT AS similarity FROM p"

_TEXTS = f"""{COMMITS}, texts AS (SELECT k, tree_sha, parents, author_name, author_email, epoch(author_date)::BIGINT s, message, 'tree ' || tree_sha || chr(10) || array_to_string(list_transform(parents, lambda p: 'parent ' || sha1('commit ' || p) || chr(10)), '') ||
 'author ' || author_name || ' <' || author_email || '> ' || epoch(author_date)::BIGINT || ' +0000' || chr(10) || 'committer ' || author_name || ' <' || author_email || '> ' || epoch(author_date)::BIGINT || ' +0000' || chr(10) || chr(10) || message AS raw FROM commits)"""
_COMMIT_HEADER = "encode('commit ' || strlen(raw)) || '\\x00'::BLOB || encode(raw)"
ORACLE |= {
    "commit_ids": f"WITH {_TEXTS} SELECT k, sha1({_COMMIT_HEADER}) AS id FROM texts",
    "commit_shred": f"WITH {_TEXTS} SELECT k, tree_sha AS tree, array_to_string(list_transform(parents, lambda p: sha1('commit ' || p)), ',') AS parents, author_name, author_email, s * 1000 AS author_ms, message, FALSE AS is_signed FROM texts",
    "message_check": "SELECT 'no-blank-line' AS fault, count(*) AS commits FROM orders",
    "message_cleanup": f"WITH {COMMITS} SELECT k, replace(message, chr(10), chr(10) || chr(10)) AS message FROM commits",
    "message_trailers": f"WITH {COMMITS} SELECT k, author_name AS reviewer, k::VARCHAR AS issue FROM commits",
    "refspec_expand": f"WITH {REFS} SELECT name, 'refs/remotes/up/' || substring(name, 12) AS mapped FROM refs WHERE name LIKE 'refs/heads/%'",
    "lsn_order": f"WITH {LOG} SELECT version, (epoch_us(ts) // 1000) * 65536 + version % 65536 AS lsn FROM log",
    "search_all": f"WITH {COMMITS}, {REFS}, x AS (SELECT 'commit' AS kind, left(sha, 7) AS id, {_SUBJECT} AS title FROM commits WHERE contains(lower(message), 'nation_1') OR contains(lower(author_name), 'nation_1') UNION ALL SELECT {_KIND}, {_SHORT}, name FROM refs WHERE regexp_matches(name, '^refs/(heads|tags)/') AND contains(lower(name), 'nation_1')) SELECT * FROM x",
    "mirror_plan": f"WITH {REFS} SELECT name, CASE target % 3 WHEN 0 THEN 'create' WHEN 1 THEN 'skip' ELSE 'update' END AS action FROM refs",
    "log_page": f"WITH {LOG} SELECT version, ref_name, new_sha FROM log WHERE version > {q.VERSION} ORDER BY version LIMIT 50",
    "working_tree_status": f"WITH {TREES} SELECT k, path, CASE WHEN path LIKE '%.go' THEN 'D' WHEN path LIKE '%.py' THEN 'M' END AS staged, CASE WHEN path LIKE '%.md' THEN 'D' WHEN path LIKE '%.ts' THEN 'M' END AS unstaged FROM trees WHERE regexp_matches(path, '\\.(go|py|md|ts)$') UNION ALL SELECT k, 'new/' || path, NULL, '??' FROM trees WHERE path LIKE '%.rs'",
    "tag_peel": f"WITH {REFS} SELECT name, 'tag-' || target_sha AS target, target_sha AS peeled FROM refs WHERE name LIKE 'refs/tags/%'",
    "ref_as_of": f"WITH {LOG} SELECT 'refs/heads/u' || e.user_id AS ref_name, e.event_id + 1 AS version, l.new_sha FROM events e ASOF JOIN log l ON l.ref_name = 'refs/heads/u' || e.user_id AND e.event_id + 1 >= l.version WHERE e.event_type = 'click'",
    "bloom_candidates": f"WITH {FILES} SELECT path, count(*) AS files FROM files GROUP BY path HAVING count(*) > 20",
}

ORACLE |= {
    "commits_between": _reach(N, where=f"child <> {N // 8}") + f" SELECT DISTINCT node FROM reach WHERE node <> {N // 8} AND EXISTS (SELECT 1 FROM reach WHERE node = {N // 8})",
    "shallow_boundary": _reach(N, M, depth="depth < 4") + " SELECT DISTINCT node FROM reach JOIN edges ON child = node WHERE parent NOT IN (SELECT node FROM reach)",
    "fork_point": _reach(N) + " SELECT node FROM reach JOIN supplier ON s_suppkey = node ORDER BY s_suppkey DESC LIMIT 1",
    "tree_hierarchy": f"""WITH {TREES}, f AS (SELECT k, CASE WHEN contains(path, '/') THEN regexp_replace(path, '/[^/]*$', '') ELSE '' END AS directory, regexp_extract(path, '[^/]*$') AS key, mode || ' ' || regexp_extract(path, '[^/]*$') || ' ' || blob AS entry FROM trees),
 two AS (SELECT k, directory, sha1(array_to_string(list(entry ORDER BY key), chr(10))) AS id, count(*) AS entries FROM f WHERE directory <> '' GROUP BY ALL),
 one AS (SELECT k, split_part(directory, '/', 1) AS directory, sha1(array_to_string(list('040000 ' || split_part(directory, '/', 2) || ' ' || id ORDER BY split_part(directory, '/', 2) || '/'), chr(10))) AS id, count(*) AS entries FROM two GROUP BY 1, 2),
 top AS (SELECT k, key, entry FROM f WHERE directory = '' UNION ALL SELECT k, directory || '/', '040000 ' || directory || ' ' || id FROM one)
 SELECT * FROM two UNION ALL SELECT * FROM one UNION ALL SELECT k, '' AS directory, sha1(array_to_string(list(entry ORDER BY key), chr(10))) AS id, count(*) AS entries FROM top GROUP BY k""",
    "moved_directory": f"WITH {TREES} SELECT k, CASE WHEN path LIKE 'economy/%' THEN 'archive/' || path ELSE path END AS path FROM trees",
    "pack_order": "SELECT lower(p_type) AS kind, p_partkey AS id, p_size::BIGINT AS size, row_number() OVER (PARTITION BY p_type ORDER BY p_size DESC, p_partkey)::INT AS place FROM part",
    "default_branch": f"WITH {REFS} SELECT min(name) AS name FROM refs WHERE name LIKE 'refs/heads/%'",
    "advertised_refs": f"WITH {REFS} SELECT 1 AS place, 'HEAD' AS name UNION ALL SELECT 1 + row_number() OVER (ORDER BY name)::INT, name FROM refs",
    "refs_after_changes": f"WITH {REFS} SELECT CASE WHEN name LIKE 'refs/heads/nation_1%' AND name <> 'refs/heads/nation_1-0' THEN replace(name, 'nation', 'country') ELSE name END AS name, target_sha AS target FROM refs WHERE name NOT LIKE 'refs/tags/v0.%' UNION ALL SELECT 'refs/heads/main', 'x'",
    "request_status": "SELECT conv_id AS pr, coalesce(arg_min(CASE WHEN turn % 4 = 3 THEN 'merged' END, turn) FILTER (turn % 4 = 3), arg_max(CASE WHEN turn % 4 = 3 THEN 'merged' WHEN turn % 2 = 1 THEN 'closed' ELSE 'open' END, turn)) AS status, count(*) AS updates FROM conversations GROUP BY 1",
}

ORACLE |= {
    "size_packing": """WITH RECURSIVE n AS (SELECT p_brand AS brand, p_partkey AS id, p_size::BIGINT AS size, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS nth FROM part),
 w AS (SELECT brand, id, size, nth, size AS used, 0::BIGINT AS pack FROM n WHERE nth = 1
 UNION ALL SELECT n.brand, n.id, n.size, n.nth, CASE WHEN w.used + n.size > 120 THEN n.size ELSE w.used + n.size END, w.pack + CASE WHEN w.used + n.size > 120 THEN 1 ELSE 0 END FROM w JOIN n ON n.brand = w.brand AND n.nth = w.nth + 1)
 SELECT brand, id, size, pack FROM w""",
    "rate_limit_window": """WITH RECURSIVE h AS (SELECT user_id AS key, event_id AS id, epoch_us(ts) // 1000 AS ms, row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts) // 1000, event_id) AS nth FROM events),
 w AS (SELECT key, id, ms, nth, ms AS opened, 1 AS hits FROM h WHERE nth = 1
 UNION ALL SELECT h.key, h.id, h.ms, h.nth, CASE WHEN h.ms - w.opened >= 3600000 THEN h.ms ELSE w.opened END, CASE WHEN h.ms - w.opened >= 3600000 THEN 1 ELSE w.hits + 1 END FROM w JOIN h ON h.key = w.key AND h.nth = w.nth + 1)
 SELECT key, id, ms, hits <= 2 AS allowed FROM w""",
}
