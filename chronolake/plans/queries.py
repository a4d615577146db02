"""The registered queries of the version-history engine, each over its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronolake.functions import lines, messages, text
from chronolake.operators import access, dag, history, ref_changes, ref_log, search, storage, trees
from chronolake.sources import lake
from chronolake.streaming import changes

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

#: Nodes and versions that the parametrised queries ask for; present at every scale.
NODE, OTHER, THIRD = 1401, 1286, 972
VERSION, FORK = 700, 500
MODES = ["*.md", "src/*.ts"]
RULES = [
    {"pattern": "main", "no_delete": True, "no_force": True, "approvals": 2}, {"pattern": "nation_1*", "no_force": True, "approvals": 1}, {"pattern": "nation_*", "no_delete": True}, {"pattern": "*", "approvals": 0},
]
SPARSE = ["economy/", "!*.md", "/small/brand?/*", "promo/**/*.json"]


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def simple(name: str, run: Query) -> None:
    QUERIES[name] = run


# commits and files
simple("commits_per_author", lambda s, d: lake.commits(s, d).groupBy("author_name").agg(F.count("*").alias("commits")))
simple("commit_frequency", lambda s, d: history.commit_frequency(lake.commits(s, d)))
simple("contributors", lambda s, d: history.contributors(lake.commits(s, d)))
simple("language_breakdown", lambda s, d: history.language_breakdown(lake.files(s, d).select("path").distinct()))
simple("hot_files", lambda s, d: history.hot_files(lake.files(s, d)))
simple("churn_by_day", lambda s, d: history.churn_by_day(lake.files(s, d)))
simple("churn_by_extension", lambda s, d: history.churn_by_extension(lake.files(s, d)))
simple("large_additions", lambda s, d: lake.files(s, d).where("not is_binary and added > 45").select("k", "path", F.col("added").alias("lines_added")))
simple("merge_commits", lambda s, d: lake.commits(s, d).where(F.size("parents") > 1).select("k", "sha", F.size("parents").alias("n_parents")))
simple("latest_commits", lambda s, d: history.log(lake.commits(s, d), limit=10).select("k", "sha", "author_name", "author_date"))
simple("commit_projection", lambda s, d: history.commit_rows(lake.commits(s, d)))
simple("file_projection", lambda s, d: history.file_rows(lake.files(s, d)))
simple("commit_totals", lambda s, d: lake.commits(s, d).agg(F.count("*").alias("commits"), F.count_distinct(F.lower("author_email")).alias("contributors")))
simple("files_per_path", lambda s, d: lake.files(s, d).groupBy("path").agg(F.count("*").alias("files")))
simple("log_filtered", lambda s, d: history.log(lake.commits(s, d), author="customer#00000001", since="1996-01-01", until="1998-12-31").select("k", "author_name", "author_date"))
simple("log_grep", lambda s, d: history.log(lake.commits(s, d), grep="URGENT\\norder [0-9]*7$", skip=5, limit=100).select("k", "author_date"))
simple("log_format", lambda s, d: history.formatted(lake.commits(s, d), "%h %an <%ae> %ad %s | %b"))
simple("pair_churn", lambda s, d: history.pair_churn(lake.commits(s, d), lake.files(s, d)))
simple("empty_commits", lambda s, d: history.empty_commits(lake.commits(s, d).withColumn("tree_sha", F.sha1((F.col("k") % 7).cast("string").cast("binary")))))
simple("path_glob_filter", lambda s, d: lake.files(s, d).where(text.path_specs(F.col("path"), ["economy/**/*.{ts,py}", "*/brand1?/*.md"], ["**/red_*"])).groupBy("path").agg(F.count("*").alias("n")))
simple("sparse_filter", lambda s, d: lake.files(s, d).select("path").distinct().where(text.sparse_match(F.col("path"), SPARSE)))
simple("identity_parse", lambda s, d: lake.commits(s, d).select("k", text.identity(F.concat("author_name", F.lit(" <"), "author_email", F.lit("> "), F.unix_timestamp("author_date").cast("string"), F.lit(" +0000"))).alias("i")).select("k", "i.name", "i.email", "i.seconds", "i.zone"))


# repositories and refs
simple("repo_totals", lambda s, d: lake.repositories(s, d).where("sync_status = 'synced'").agg(F.count("*").alias("repositories"), F.sum("commit_count").alias("commits"), F.sum("contributor_count").alias("contributors")))
simple("failed_syncs", lambda s, d: lake.repositories(s, d).where("sync_status = 'failed'").select("full_name", "last_error"))
simple("sync_rollup", lambda s, d: lake.repositories(s, d).rollup("source").agg(F.count("*").alias("repositories"), F.sum("commit_count").alias("commits")).select(F.coalesce("source", F.lit("all")).alias("source"), "repositories", "commits"))
simple("branches_behind", lambda s, d: lake.refs(s, d).where("name like 'refs/heads/%' and behind > 0").select("name", "ahead", "behind"))
simple("release_tags", lambda s, d: lake.refs(s, d).where("name like 'refs/tags/v%'").select(text.short_ref(F.col("name")).alias("tag"), "target_sha"))
simple("ref_types", lambda s, d: lake.refs(s, d).groupBy(text.ref_kind(F.col("name")).alias("ref_type")).agg(F.count("*").alias("refs")))
simple("ref_projection", lambda s, d: lake.refs(s, d).select("name", text.short_ref(F.col("name")).alias("short_name"), text.ref_kind(F.col("name")).alias("ref_type"), "target_sha", text.valid_ref_name(F.col("name")).alias("valid")))
simple("namespace_roundtrip", lambda s, d: lake.repositories(s, d).withColumn("namespace", text.namespace(F.col("source"), F.col("full_name"))).select("namespace", text.namespace_source(F.col("namespace")).alias("source"), text.namespace_path(F.col("namespace")).alias("path")))
simple("protection_verdicts", lambda s, d: access.protection_verdicts(lake.refs(s, d).where("name like 'refs/heads/%'").select(text.short_ref(F.col("name")).alias("name"), (F.col("ahead") > 6).alias("is_delete"), (F.col("behind") > 4).alias("is_force"), (F.col("target") % 3).alias("approvals")), RULES))


@query
def tags_version_sort(s, d):
    """Tags with their place in version order; names that are equal as versions go by name."""
    tags = lake.refs(s, d).where("name like 'refs/tags/%'").select(text.short_ref(F.col("name")).alias("tag"))
    return storage.numbered(tags, [text.version_key(F.col("tag")), F.col("tag")], "place")


@query
def permission_verdicts(s, d):
    users = lake.read(s, d, "customer")
    op = lake.pick(list(access.NEEDED), F.col("c_custkey") % 7)
    repo = F.col("c_nationkey")
    requests = users.select(F.col("c_custkey").alias("user"), repo.alias("repository"), op.alias("op"))
    grants = users.where("c_acctbal > 3000").select(F.col("c_custkey").alias("user"), repo.alias("repository"), lake.pick(access.LEVELS, F.col("c_custkey") % 4).alias("granted"), F.when(F.col("c_custkey") % 5 == 0, F.lit("2020-01-01").cast("timestamp")).alias("expires_at"))
    defaults = lake.read(s, d, "nation").select(F.col("n_nationkey").alias("repository"), lake.pick(["none", "read", "write"], F.col("n_nationkey") % 3).alias("default_level"), (F.col("n_nationkey") % 2 == 0).alias("is_public"))
    return access.effective_permissions(requests, grants, defaults, "2024-01-01")


# ref log
simple("reflog_state", lambda s, d: ref_log.state(lake.ref_log(s, d)))
simple("reflog_time_travel", lambda s, d: ref_log.state(lake.ref_log(s, d), VERSION))
simple("reflog_rollback", lambda s, d: ref_log.state(ref_log.rollback(lake.ref_log(s, d), VERSION)))
simple("reflog_fork_state", lambda s, d: ref_log.fork_state(lake.ref_log(s, d), FORK, lake.ref_log(s, d).where(f"version % 7 = 0 and version < {VERSION}")))
simple("reflog_nth", lambda s, d: ref_log.nth_newest(lake.ref_log(s, d), 2))
simple("reflog_linked", lambda s, d: ref_log.linked(lake.ref_log(s, d)).select("version", "ref_name", "old_sha", "new_sha"))


def _forks(s, d):
    log = lake.ref_log(s, d)
    after = log.where(F.col("version") > FORK)
    return log.where(F.col("version") <= FORK), after.where("version % 5 in (0, 1)"), after.where("version % 5 in (1, 2)")


simple("reflog_three_way_merge", lambda s, d: ref_log.three_way(*_forks(s, d)))


@query
def reflog_fast_forward(s, d):
    log = lake.ref_log(s, d)
    base, ours, _ = _forks(s, d)
    cases = [("ours_moved", ours, log.limit(0)), ("theirs_moved", log.limit(0), ours), ("both_moved", ours, base)]
    return s.createDataFrame([(name, ref_log.fast_forward(a, b)) for name, a, b in cases], "case string, side string")


@query
def reflog_cas(s, d):
    current = ref_log.state(lake.ref_log(s, d), VERSION)
    wanted = ref_log.changes(ref_log.rollback(lake.ref_log(s, d), VERSION + 1)).select("ref_name", F.when(F.col("version") % 3 == 0, "stale").otherwise(F.col("new_sha")).alias("expected"), F.lit("next").alias("new_sha"))
    return ref_log.compare_and_swap(current, wanted)


# graph
simple("ancestors", lambda s, d: dag.reachable(lake.commit_parents(s, d), [NODE]).select("node"))
simple("bfs_depth", lambda s, d: dag.ancestors_of(lake.commit_parents(s, d), [NODE, OTHER]))
simple("first_parent_log", lambda s, d: dag.ancestors_of(lake.commit_parents(s, d), [NODE], first_parent=True).select("node", "depth"))
simple("shallow_log", lambda s, d: dag.ancestors_of(lake.commit_parents(s, d), [NODE], max_depth=3).select("node", "depth"))
simple("merge_base", lambda s, d: dag.merge_bases(lake.commit_parents(s, d), NODE, OTHER))
simple("independent_commits", lambda s, d: dag.independent(lake.commit_parents(s, d), [NODE, OTHER, NODE // 2, OTHER // 4, 7]))
simple("rev_range_two_dot", lambda s, d: dag.revision_range(lake.commit_parents(s, d), [NODE], [OTHER]))
simple("rev_range_three_dot", lambda s, d: dag.symmetric_difference(lake.commit_parents(s, d), NODE, THIRD))
simple("ahead_behind", lambda s, d: dag.ahead_behind(lake.commit_parents(s, d), s.createDataFrame([(NODE, OTHER), (NODE, THIRD), (OTHER, THIRD), (NODE, NODE)], "a long, b long")))
simple("topo_levels", lambda s, d: dag.generations(lake.commit_parents(s, d), lake.read(s, d, "orders").select(F.col("o_orderkey").alias("node"))))


@query
def common_history(s, d):
    return dag.common_ancestors(lake.commit_parents(s, d), [NODE, OTHER, THIRD])


@query
def symbolic_refs(s, d):
    refs = lake.refs(s, d)
    heads = refs.where("name like 'refs/heads/%'")
    links = heads.select(F.concat(F.lit("refs/remotes/alias/"), text.short_ref(F.col("name"))).alias("name"), F.col("name").alias("target"))
    loop = s.createDataFrame([("refs/a", "refs/b"), ("refs/b", "refs/a"), ("refs/c", "refs/none")], "name string, target string")
    return dag.resolve_symbolic(heads.select("name", F.col("target_sha").alias("target")).union(links).union(loop)).select("name", "target")


# trees
def _sides(s, d):
    """Trees of every commit and of its first parent, keyed by the commit."""
    firsts = lake.commit_parents(s, d).where("ord = 0").select(F.col("child").alias("k"), F.col("parent").alias("at"))
    return lake.trees(s, d, firsts), lake.trees(s, d)


simple("tree_diff", lambda s, d: trees.tree_diff(*_sides(s, d), ["k"]))
simple("tree_diff_stats", lambda s, d: trees.diff_stats(trees.tree_diff(*_sides(s, d), ["k"]), ["k"]))


def _moved(s, d):
    """A tree and one in which some paths have moved, some blobs have changed and some copies have come."""
    t = lake.trees(s, d)
    moved = t.withColumn("path", F.when(F.col("path").endswith(".ts"), F.concat(F.lit("moved/"), "path")).otherwise(F.col("path")))
    copies = t.where("path like '%.go'").withColumn("path", F.concat(F.lit("copy/"), "path"))
    return t, moved.union(copies)


simple("exact_renames", lambda s, d: trees.exact_renames(trees.tree_diff(*_moved(s, d), ["k"]), ["k"]))
simple("copy_detection", lambda s, d: trees.exact_copies(trees.tree_diff(*_moved(s, d), ["k"]), _moved(s, d)[0], ["k"]))


@query
def tree_three_way_merge(s, d):
    """The trees of a merge's two parents against that of their common ancestor, for every merge."""
    merges = lake.commits(s, d).where(F.size("parents") > 1).select("k", F.col("parents")[0].alias("ours"), F.col("parents")[1].alias("theirs"), F.floor(F.col("k") / 6).alias("base"))
    side = lambda name: lake.trees(s, d, merges.select("k", F.col(name).alias("at"))).select("k", "path", "blob")
    return trees.three_way(side("base"), side("ours"), side("theirs"), ["k"])


simple("directory_ids", lambda s, d: trees.directory_ids(lake.trees(s, d), ["k"]))
simple("shared_directories", lambda s, d: trees.shared_directories(trees.directory_ids(lake.trees(s, d), ["k"])))


# storage
simple("object_ids", lambda s, d: storage.encoded(lake.objects(s, d)).select("origin", "id", "sha", "size"))
simple("objects_storage_mode", lambda s, d: storage.encoded(lake.objects(s, d)).groupBy("storage").agg(F.count("*").alias("objects"), F.sum("size").alias("bytes")))
simple("objects_dedup_compact", lambda s, d: storage.compacted(storage.encoded(lake.objects(s, d)), storage.encoded(lake.objects(s, d)).where("id % 50 = 7").select("sha").distinct()).select("sha", "origin", "id", "size", "copies"))
simple("binary_objects", lambda s, d: lake.objects(s, d).groupBy(text.is_binary(F.col("raw")).alias("is_binary")).agg(F.count("*").alias("objects")))
simple("sha_prefix_resolve", lambda s, d: storage.by_prefix(storage.encoded(lake.objects(s, d)), "0a"))


@query
def gc_sweep(s, d):
    """Orders as objects, of which those that commits of lines name are reachable."""
    objects = lake.read(s, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("size"), F.col("o_orderdate").alias("created"))
    live = lake.read(s, d, "lineitem").where("l_quantity > 10").select(F.col("l_orderkey").alias("id"))
    return storage.sweep(objects, live, "2001-08-01", grace_days=400, most=20)


simple("gc_summary", lambda s, d: storage.sweep_summary(gc_sweep(s, d)))
simple("missing_objects", lambda s, d: dag.revision_range(lake.commit_parents(s, d), [NODE, THIRD], [OTHER]).join(lake.read(s, d, "orders").where("o_orderstatus = 'O'").select(F.col("o_orderkey").alias("node")), "node", "left_semi"))


def _accesses(s, d):
    e = lake.read(s, d, "events")
    return e.select(F.col("user_id").alias("key"), (F.col("event_type") == "purchase").alias("is_write"), F.col("value").alias("latency"), "ts")


simple("access_patterns", lambda s, d: storage.access_patterns(_accesses(s, d)))
simple("tier_candidates", lambda s, d: storage.tier_candidates(lake.read(s, d, "orders").select(F.col("o_orderkey").alias("key"), F.col("o_orderdate").alias("created")), _accesses(s, d), "1998-01-01", 70))
simple("tier_stats", lambda s, d: storage.tier_stats(lake.read(s, d, "part").select(lake.pick(["hot", "warm", "cold"], F.col("p_partkey") % 3).alias("tier"), F.col("p_size").cast("long").alias("size"))))


@query
def tier_fallback_lookup(s, d):
    part = lake.read(s, d, "part").select(F.col("p_partkey").alias("key"), F.col("p_name").alias("value"))
    tier = lambda n: part.where(f"key % {n} = 0").withColumn("value", F.concat("value", F.lit(f" {n}")))
    return storage.first_tier(part.select((F.col("key") * 2).alias("key")), [("hot", tier(7)), ("warm", tier(3)), ("cold", tier(2))])


simple("index_batch_lookup", lambda s, d: storage.looked_up(lake.read(s, d, "part").select((F.col("p_partkey") * 3).alias("key")), lake.read(s, d, "part").select(F.col("p_partkey").alias("key"), F.col("p_size").alias("size"))))
simple("size_packing", lambda s, d: storage.packed(lake.read(s, d, "part").select(F.col("p_brand").alias("brand"), F.col("p_partkey").alias("id"), F.col("p_size").cast("long").alias("size")), "brand", 120))
simple("chunk_ranges", lambda s, d: storage.chunk_ranges(lake.read(s, d, "part").select(F.col("p_partkey").alias("id"), (F.col("p_size").cast("long") * 300_000).alias("size"))))
simple("variant_shred", lambda s, d: lake.change_events(s, d).select("event_id", F.variant_get(F.parse_json("payload"), "$.k", "int").alias("k")))
simple("manifest_totals", lambda s, d: lake.files(s, d).groupBy("change_type").agg(F.count("*").alias("files"), F.sum("new_size").alias("bytes"), F.min("path").alias("first_path"), F.max("path").alias("last_path")))


@query
def snapshot_chain(s, d):
    """A snapshot for each batch of changes, with that of the batch before; batch numbers have no gaps, so an equi-join links them."""
    batches = changes.batches(lake.change_events(s, d), 100)
    rows = batches.select("batch", "events", (F.col("last_ms") * 1000 + F.col("batch") % 1000).alias("snapshot_id"))
    return rows.join(rows.select((F.col("batch") + 1).alias("batch"), F.col("snapshot_id").alias("parent_id")), "batch", "left")


# reviews and requests
simple("review_state", lambda s, d: access.review_state(lake.reviews(s, d)))
simple("pr_page", lambda s, d: access.page(access.review_state(lake.reviews(s, d)), [F.desc("pr")], 20, 10))


@query
def rate_limit_window(s, d):
    hits = lake.read(s, d, "events").select(F.col("user_id").alias("key"), F.col("event_id").alias("id"), F.unix_millis(F.col("ts").cast("timestamp")).alias("ms"))
    return access.rate_limited(hits, 2, 3_600_000)


# change events
simple("cdc_rows", lambda s, d: changes.rows(lake.change_events(s, d)))
simple("cdc_batches", lambda s, d: changes.batches(lake.change_events(s, d), 100))
simple("cdc_tumbling", lambda s, d: changes.windowed(lake.change_events(s, d), "6 hours"))
simple("cdc_sliding", lambda s, d: changes.windowed(lake.change_events(s, d), "12 hours", "6 hours"))
simple("cdc_session", lambda s, d: changes.sessions(lake.change_events(s, d), "2 hours"))
simple("cdc_rolling_latency", lambda s, d: lake.change_events(s, d).select("user_id", "sequence", F.avg("value").over(Window.partitionBy("user_id").orderBy("sequence").rowsBetween(-9, 0)).alias("mean")).select("user_id", "sequence", F.round("mean", 6).alias("mean")))


@query
def cdc_invalid_dlq(s, d):
    events = lake.change_events(s, d).withColumn("event_type", F.when(F.col("sequence") % 97 == 0, "UNKNOWN").otherwise(F.col("event_type"))).withColumn("event_id", F.when(F.col("sequence") % 89 == 0, "").otherwise(F.col("event_id")))
    return events.where(~changes.valid()).select("sequence", "event_id", "event_type")


# lines; neighbours by key are compared as versions of a text
def _versions(s, d):
    return lake.read(s, d, "documents").select("doc_id", F.replace("text", F.lit(". "), F.lit(".\n")).alias("text"))


def _pairs(s, d):
    return _versions(s, d).withColumn("new", F.regexp_replace("text", "(?m)^(The|De|Der|El) .*$", "$1 changed"))


simple("similarity_scores", lambda s, d: lake.read(s, d, "part").select("p_partkey", text.positional_similarity(F.col("p_name"), F.lit("small red widget")).alias("similarity")))
simple("line_similarity", lambda s, d: _pairs(s, d).select("doc_id", lines.line_similarity("text", "new").alias("similarity")))
simple("unified_diff", lambda s, d: _pairs(s, d).select("doc_id", lines.unified_diff("text", "new").alias("diff")))
simple("word_diff", lambda s, d: _pairs(s, d).select("doc_id", lines.words_diff("text", "new").alias("diff")))
simple("content_merge", lambda s, d: _pairs(s, d).select("doc_id", lines.merged("text", "new", F.concat("text", F.lit("\nlast"))).alias("m")).select("doc_id", "m.merged", "m.conflict"))
simple("blame_lines", lambda s, d: lines.blame(_pairs(s, d).select("doc_id", F.lit(1).alias("version"), "text").union(_pairs(s, d).select("doc_id", F.lit(2).alias("version"), F.col("new").alias("text"))), "doc_id", "version", "text"))


# commit texts and messages
def _texts(s, d):
    """Each commit as its text."""
    c = lake.commits(s, d)
    person = F.concat("author_name", F.lit(" <"), "author_email", F.lit("> "), F.unix_timestamp(F.col("author_date").cast("timestamp")).cast("string"), F.lit(" +0000"))
    shas = F.transform("parents", lambda p: F.sha1(F.concat(F.lit("commit "), p.cast("string")).cast("binary")))
    return c.select("k", messages.commit_text(F.col("tree_sha"), shas, person, person, F.col("message")).alias("raw"))


simple("commit_ids", lambda s, d: _texts(s, d).select("k", text.object_id("commit", F.col("raw").cast("binary")).alias("id")))
simple("commit_shred", lambda s, d: _texts(s, d).select("k", messages.commit_fields(F.col("raw")).alias("f")).select("k", "f.tree", F.array_join("f.parents", ",").alias("parents"), "f.author_name", "f.author_email", "f.author_ms", "f.message", "f.is_signed"))
simple("message_check", lambda s, d: lake.commits(s, d).groupBy(messages.valid_message(F.col("message")).alias("fault")).agg(F.count("*").alias("commits")))
simple("message_cleanup", lambda s, d: lake.commits(s, d).select("k", messages.cleaned(F.concat(F.lit("\n# note\n"), F.regexp_replace("message", "\n", "  \n\n\n\n"), F.lit("\n\n"))).alias("message")))
simple("message_trailers", lambda s, d: lake.commits(s, d).select("k", messages.trailers(F.concat("message", F.lit("\n\nReviewed-by: "), "author_name", F.lit("\nIssue: "), F.col("k").cast("string"))).alias("t")).select("k", F.col("t")[0]["value"].alias("reviewer"), F.col("t")[1]["value"].alias("issue")))
simple("refspec_expand", lambda s, d: lake.refs(s, d).select("name", messages.refspec("+refs/heads/*:refs/remotes/up/*", F.col("name")).alias("mapped")).where("mapped is not null"))
simple("lsn_order", lambda s, d: lake.ref_log(s, d).select("version", messages.lsn(F.col("ts"), F.col("version")).alias("lsn")))
simple("search_all", lambda s, d: search.search(lake.commits(s, d), lake.refs(s, d), "nation_1"))
simple("mirror_plan", lambda s, d: search.mirror_plan(lake.refs(s, d).select("name", F.col("target_sha").alias("sha")), lake.refs(s, d).where("target % 3 > 0").select("name", F.when(F.col("target") % 3 == 1, F.col("target_sha")).otherwise("old").alias("sha"))))
simple("log_page", lambda s, d: search.changes_since(lake.ref_log(s, d), VERSION, 50).select("version", "ref_name", "new_sha"))


@query
def working_tree_status(s, d):
    """A tree as head; the index drops .go and changes .py paths; the work tree drops .md, changes .ts and adds paths."""
    blob, on = F.col("blob"), F.col("path").endswith
    index = F.when(~on(".go"), F.when(on(".py"), F.concat("blob", F.lit("i"))).otherwise(blob))
    work = F.when(~on(".go") & ~on(".md"), F.when(on(".ts"), F.concat(index, F.lit("w"))).otherwise(index))
    new = F.when(on(".rs"), blob)
    row = lambda name, path, blob: F.struct(F.lit(name).alias("side"), path.alias("path"), blob.alias("blob"))
    rows = F.array(row("head", F.col("path"), blob), row("index", F.col("path"), index), row("work", F.col("path"), work), row("work", F.concat(F.lit("new/"), "path"), new))
    sides = lake.whole_trees(s, d).select("k", F.explode(rows).alias("row")).select("k", "row.*").where("blob is not null")
    return search.status_of(sides, ["k"])


@query
def tag_peel(s, d):
    """Every tag names a tag object, which names another for even targets, which names the commit."""
    tags = lake.refs(s, d).where("name like 'refs/tags/%'")
    inner = F.concat(F.lit("inner-"), F.col("target_sha"))
    one = tags.select(F.concat(F.lit("tag-"), F.col("target_sha")).alias("sha"), F.when(F.col("target") % 2 == 0, inner).otherwise(F.col("target_sha")).alias("object"))
    two = tags.select(inner.alias("sha"), F.col("target_sha").alias("object"))
    return search.peeled(tags.select("name", F.concat(F.lit("tag-"), F.col("target_sha")).alias("target")), one.union(two))


@query
def ref_as_of(s, d):
    """The sha of a user's ref at each of the user's clicks."""
    log = lake.ref_log(s, d)
    clicks = lake.read(s, d, "events").where("event_type = 'click'").select(F.concat(F.lit("refs/heads/u"), F.col("user_id").cast("string")).alias("ref_name"), (F.col("event_id") + 1).alias("version"))
    return search.as_of(clicks, log, "ref_name", "version", "new_sha")


@query
def bloom_candidates(s, d):
    """Files of the paths that are hot; Spark may put a run-time filter before the semi-join."""
    hot = lake.files(s, d).groupBy("path").count().where("count > 20").select("path")
    return lake.files(s, d).select("k", "path").join(hot, "path", "left_semi").groupBy("path").agg(F.count("*").alias("files"))


# more of the graph, trees, refs and requests
simple("commits_between", lambda s, d: dag.between(lake.commit_parents(s, d), NODE // 8, NODE))
simple("shallow_boundary", lambda s, d: dag.shallow_boundary(lake.commit_parents(s, d), [NODE, OTHER], 4))
simple("fork_point", lambda s, d: dag.fork_point(lake.commit_parents(s, d), lake.read(s, d, "supplier").select(F.col("s_suppkey").alias("version"), F.col("s_suppkey").alias("node")), OTHER, NODE))
simple("tree_hierarchy", lambda s, d: trees.hierarchy(lake.whole_trees(s, d), ["k"], lake.path_depth(s, d)))
simple("moved_directory", lambda s, d: trees.moved_directory(lake.trees(s, d).select("k", "path"), "economy", "archive/economy"))
simple("pack_order", lambda s, d: storage.pack_order(lake.read(s, d, "part").select(F.lower("p_type").alias("kind"), F.col("p_partkey").alias("id"), F.col("p_size").cast("long").alias("size"))))
simple("default_branch", lambda s, d: ref_changes.default_branch(lake.refs(s, d)))
simple("advertised_refs", lambda s, d: ref_changes.advertised(lake.refs(s, d).select("name").union(s.createDataFrame([("HEAD",)], "name string"))))


@query
def refs_after_changes(s, d):
    """Tags of version 0 deleted, branches of nation_1 renamed (one onto a name that isn't valid), and one ref put."""
    refs = lake.refs(s, d).select("name", F.col("target_sha").alias("target"))
    rows = ref_changes.deleted(refs, refs.where("name like 'refs/tags/v0.%'"))
    moved = rows.where("name like 'refs/heads/nation_1%'").select("name", F.concat(F.replace("name", F.lit("nation"), F.lit("country")), F.when(F.col("name") == F.lit("refs/heads/nation_1-0"), "..").otherwise("")).alias("new_name"))
    return ref_changes.upserted(ref_changes.renamed(rows, moved), s.createDataFrame([("refs/heads/main", "x")], "name string, target string"))


@query
def request_status(s, d):
    turns = lake.read(s, d, "conversations")
    status = F.when(F.col("turn") % 4 == 3, "merged").when(F.col("turn") % 2 == 1, "closed").otherwise("open")
    return ref_changes.request_status(turns.select(F.col("conv_id").alias("pr"), F.col("turn").alias("id"), status.alias("status")))
