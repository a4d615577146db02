"""Renames by similarity, blame over several parents, merges that touch, sinks and tables with snapshots."""

import random

import pytest
from pyspark.sql import functions as F

from chronolake.functions import lines, messages, text
from chronolake.operators import history, ref_log, search, storage, trees
from chronolake.plans.registry import QUERIES
from chronolake.sources import files, lake, sinks, staging
from chronolake.streaming import changes


def similarity(a, b):
    return int(100 * sum(x == y for x, y in zip(a, b, strict=False)) / max(len(a), len(b)) + 0.5) if a or b else 100


def test_renames_equal_a_greedy_walk(spark):
    r = random.Random(5)
    word = lambda: "".join(r.choice("abc") for _ in range(r.randint(1, 30)))
    old, new = [], []
    for k in range(4):
        texts = [word() for _ in range(8)]
        old += [(k, f"o{i}", f"b{t}", t) for i, t in enumerate(texts)]
        edited = [t if r.random() < 0.3 else "".join(c if r.random() < 0.7 else "z" for c in t) + "y" * r.randint(0, 3) for t in texts]
        new += [(k, f"n{i}", f"b{t}", t) for i, t in enumerate(edited)] + [(k, "o7", "same", "same")]
    sides = [spark.createDataFrame(rows, "k int, path string, blob string, content string") for rows in (old, new)]
    got = {(r.k, r.old_path): (r.new_path, r.similarity) for r in trees.renames(*sides, "k").collect()}
    want = {}
    for k in range(4):
        gone = sorted((p, b, t) for q, p, b, t in old if q == k and p != "o7")
        come = sorted((p, b, t) for q, p, b, t in new if q == k and p != "o7")
        used = set()
        for p, b, _ in gone:
            hit = next((x for x, y, _ in come if y == b and x not in used), None)
            if hit:
                used.add(hit)
                want[k, p] = (hit, 100)
        for p, _, t in gone:
            best = [(-similarity(t, u), x) for x, _, u in come if x not in used and similarity(t, u) >= 50]
            if (k, p) not in want and best:
                s, x = min(best)
                used.add(x)
                want[k, p] = (x, -s)
    assert got == want and len(want) > 15
    with pytest.raises(ValueError, match="factor"):
        trees.similar_pairs(*sides, "k", 40)


def test_blame_over_parents():
    versions = [(1, [], ["a", "b", "c"]), (2, [1], ["a", "x", "c"]), (3, [1], ["a", "b", "c", "d"]), (4, [2, 3], ["a", "x", "c", "d", "m"])]
    owners = lines.blamed_graph(versions)
    assert owners[4] == [1, 2, 1, 3, 4] and owners[3] == [1, 1, 1, 3]
    assert lines.blamed_graph(versions, ignore={2})[2] == [1, 1, 1]
    assert lines.blamed_graph([(1, [], ["a b"]), (2, [1], ["a  b "])], strip=True)[2] == [1]


def test_blame_of_a_graph_and_its_forms(spark):
    rows = [("f", 1, [], "a\nb"), ("f", 2, [1], "a\nx"), ("f", 3, [1], "a\nb\nd"), ("f", 4, [2, 3], "a\nx\nd")]
    got = lines.blame_graph(spark.createDataFrame(rows, "path string, version int, parents array<int>, content string"), "path", "version", "parents", "content")
    assert sorted((r.line_no, r.version) for r in got.collect()) == [(1, 1), (2, 2), (3, 3)]
    assert lines.blame_range(got, 2, 3).count() == 2
    with pytest.raises(ValueError, match="no such lines"):
        lines.blame_range(got, 3, 2)
    c = spark.createDataFrame([(v, f"{v}" * 40, f"N{v}", f"e{v}", 86400 * v, f"s{v}") for v in (1, 2, 3)], "version int, sha string, author_name string, author_email string, t long, summary string").withColumn("author_date", F.timestamp_seconds("t"))
    shown = sorted(r.text for r in lines.blame_text(got, "path", c).collect())
    assert shown[0] == "11111111 (N1 1970-01-02 1) a"
    back = lines.blame_text(got, "path", c, porcelain=True).select(lines.parse_porcelain(F.col("text")).alias("e")).select("e.*").collect()
    assert sorted((r.line_no, r.author, r.email, r.seconds, r.summary, r.line) for r in back) == [(1, "N1", "e1", 86400, "s1", "a"), (2, "N2", "e2", 172800, "s2", "x"), (3, "N3", "e3", 259200, "s3", "d")]


def test_changes_that_touch_are_merged_and_empty_sides_have_no_lines(spark):
    assert lines.merge3(["a", "b"], ["A", "b"], ["a", "B"]) == (["A", "B"], False)
    assert lines.merge3(["a"], ["a", "x"], ["a", "y"])[1]
    df = spark.createDataFrame([("", "a\nb"), ("a\nb", ""), (None, ""), ("a", "a")], "x string, y string")
    assert [r[0] for r in df.select(lines.unified_diff("x", "y")).collect()] == ["@@ -0,0 +1,2 @@\n+a\n+b", "@@ -1,2 +0,0 @@\n-a\n-b", "", ""]


def test_versions_and_names(spark):
    names = ["v1.2.3.4.6", "1.2.3.4.5", "v1.2", "1.2.0", "v20240101123456", "v1.10"]
    got = [r.n for r in spark.createDataFrame([(n,) for n in names], "n string").orderBy(text.version_key(F.col("n")), "n").collect()]
    assert got == ["1.2.0", "v1.2", "1.2.3.4.5", "v1.2.3.4.6", "v1.10", "v20240101123456"]
    df = spark.createDataFrame([("feature/x",), ("-x",), ("refs/heads/x",), ("a@b",), ("HEAD",), ("",), (None,), ("x" * 256,)], "n string")
    assert [tuple(r) for r in df.select(text.valid_branch_name(F.col("n")), text.valid_tag_name(F.col("n")), text.valid_remote_name(F.col("n"))).collect()] == [(True, True, False), (False, True, True), (False, False, False), (False, True, True), (False, True, True), (False, False, False), (False, False, False), (False, True, True)]
    wide = "subject that is long and stays\n\n" + "word " * 10 + "x" * 30
    assert all(len(x) <= 30 for x in spark.range(1).select(messages.wrapped(F.lit(wide), 20)).first()[0].split("\n")[1:])
    import hashlib
    import hmac

    for key in (b"k", b"x" * 100):
        assert spark.range(1).select(text.hmac_sha256(key, F.lit("message").cast("binary"))).first()[0] == hmac.new(key, b"message", hashlib.sha256).hexdigest()


def test_trees_of_any_depth_and_long_chains_of_tags(spark):
    deep = [(f"t{i}", "d", f"t{i + 1}", "040000") for i in range(70)] + [("t70", "leaf", "b", "100644")]
    got = trees.flatten(spark.createDataFrame(deep, "tree string, name string, sha string, mode string"), spark.createDataFrame([("t0",)], "root string")).collect()
    assert [r.path for r in got] == ["d/" * 70 + "leaf"]
    refs = spark.createDataFrame([("a", "t0"), ("b", "c")], "name string, target string")
    tags = spark.createDataFrame([(f"t{i}", f"t{i + 1}") for i in range(6)], "sha string, object string")
    assert {r.name: r.peeled for r in search.peeled(refs, tags).collect()} == {"a": "t6", "b": "c"}


def test_numbers_over_ranges(spark):
    rows = [(i, r) for i, r in enumerate(random.Random(1).choices(range(50), k=500))]
    df = spark.createDataFrame(rows, "id long, x int").repartition(7)
    got = sorted((r.n, r.id) for r in storage.numbered(df, [F.desc("x"), F.col("id")], "n").collect())
    assert got == list(enumerate([i for i, _ in sorted(rows, key=lambda r: (-r[1], r[0]))], 1))
    by = storage.numbered(df.withColumn("g", F.col("id") % 3), [F.col("id")], "n", ["g"]).collect()
    assert all(r.n == r.id // 3 + 1 for r in by)


def test_export_bundles_and_objects(spark, tmp_path):
    df = spark.createDataFrame([(i, f"g{i % 2}", 10 * i, f"{i:040x}") for i in range(20)], "id long, g string, size long, sha string")
    assert sinks.export({"commits": df, "refs": df.limit(3)}, str(tmp_path / "out"), codec="zstd") == {"commits": 20, "refs": 3}
    assert spark.read.parquet(str(tmp_path / "out" / "commits")).count() == 20
    with pytest.raises(ValueError, match="cannot export"):
        sinks.export({"commits": df}, str(tmp_path / "x"), names=["files"])
    catalog = sinks.write_bundles(df, "g", str(tmp_path / "bundles"), 100).collect()
    assert sum(r.objects for r in catalog) == 20 and all(r.bytes <= 100 or r.objects == 1 for r in catalog)
    assert spark.read.parquet(str(tmp_path / "bundles")).count() == 20
    assert sinks.write_objects(df, str(tmp_path)) == sinks.write_objects(df.repartition(5), str(tmp_path))
    sinks.write_ref_snapshot(df.selectExpr("sha as name", "g as target"), str(tmp_path / "refs"))
    assert spark.read.json(str(tmp_path / "refs")).count() == 20
    path = ref_log.flushed(df.selectExpr("id as version", "g as ref_name", "sha as new_sha"), str(tmp_path))
    assert path.endswith("/ref-log/19.parquet") and spark.read.parquet(path).count() == 20
    assert files.objects_by_sha(spark, sinks.write_objects(df.selectExpr("sha", "'blob' as type", "'inline' as storage", "g as raw_data"), str(tmp_path)), f"{3:040x}").first().raw_data == "g1"


def test_snapshots_keep_earlier_manifests(spark, tmp_path):
    table = str(tmp_path / "t")
    for i in (1, 2):
        sinks.write_table(spark.range(10 * i), f"{table}/data{i}")
        meta = sinks.append_files(spark, table, f"{table}/data{i}", i, expected=None if i == 1 else 1000)
    assert [len(s["manifests"]) for s in meta["snapshots"]] == [1, 2] and meta["snapshots"][1]["summary"]["added-records"] == "20"
    assert sinks.read_metadata(spark, table) == meta
    assert sum(r.record_count for m in meta["snapshots"][1]["manifests"] for r in spark.read.parquet(m).collect()) == 30
    with pytest.raises(ValueError, match="current snapshot"):
        sinks.append_files(spark, table, f"{table}/data2", 3, expected=1000)
    sinks.register(spark, "chrono_test", "numbers", f"{table}/data1")
    assert spark.table("chrono_test.numbers").count() == 10
    sinks.dropped(spark, "chrono_test", "numbers", purge=True)
    assert not (tmp_path / "t" / "data1").exists()


def test_small_functions(spark):
    df = spark.createDataFrame([('{"ref": "refs/heads/x", "before": "0", "after": "1", "commits": [{"id": "a", "message": "m"}]}',), ("nonsense",)], "j string")
    assert [r.e.ref if r.e else None for r in df.select(files.push_events(F.col("j")).alias("e")).collect()] == ["refs/heads/x", None]
    row = spark.range(1).select(messages.bloom_false_positive_rate(F.lit(8_000_000), F.lit(7), F.lit(100_000)).alias("p"), messages.back_off_ms(F.lit(3)).alias("w"), messages.back_off_ms(F.lit(9)).alias("m"), messages.tree_order(F.lit("a"), F.lit("040000")).alias("o")).first()
    assert row.p < 1e-6 and (row.w, row.m, row.o) == (800.0, 5000.0, "a/")
    assert staging.staged_counted(spark.range(7), "seven")[2] == 7


def test_graph_columns():
    rows = [("m", ["b", "c"]), ("c", ["a"]), ("b", ["a"]), ("a", [])]
    assert history.graph_columns(rows) == ["*", "| *", "* |", "*"]


def test_stream_export_takes_each_row_once(spark, tmp_path):
    spark.range(20).repartition(4).write.parquet(str(tmp_path / "in"))
    for _ in range(2):
        stream = spark.readStream.schema("id long").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        changes.export_stream(stream, str(tmp_path / "out"), str(tmp_path / "c"), lambda df: df.withColumn("twice", F.col("id") * 2)).awaitTermination()
    assert sorted(r.twice for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [2 * i for i in range(20)]


def test_renames_of_many_commits_are_walked_in_one_pass(spark):
    """Many small commits are decided in sorted partitions; no commit starts a group of its own in Python."""
    rows = spark.range(3000).selectExpr("id as k", "explode(array(named_struct('o', 'a', 'n', 'x', 's', 60), named_struct('o', 'a', 'n', 'y', 's', 90), named_struct('o', 'b', 'n', 'y', 's', 95), named_struct('o', 'c', 'n', 'x', 's', 40))) as p").selectExpr("k", "p.o as old_path", "p.n as new_path", "p.s as similarity")
    out = trees.similar_renames(rows, "k")
    assert out.count() == 3000 and out.select("old_path", "new_path", "similarity").distinct().collect() == [("a", "y", 90)]
    assert "FlatMapGroupsInPandas" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_objects_are_marked_by_keys_and_named_last(spark):
    commits = spark.createDataFrame([(1, 10, True), (2, 5, False), (3, 7, False)], "k long, day int, is_live boolean").selectExpr("k", "timestamp_seconds(day * 86400) as created", "is_live")
    entries = spark.createDataFrame([(1, 8, 9), (2, 8, 9), (2, 8, 7), (4, 1, 1)], "k long, a long, b long")
    live = storage.reachable_keys(commits.where("is_live").select("k"), entries)
    assert {tuple(r) for r in live.collect()} == {("commit", 1, 0), ("tree", 1, 0), ("blob", 8, 9)}
    swept = {(r.type, r.a, r.b): r.action for r in storage.swept(storage.marked_keys(commits, entries), "1970-01-10", 3).collect()}
    assert swept == {("commit", 1, 0): "live", ("tree", 1, 0): "live", ("blob", 8, 9): "live", ("commit", 2, 0): "delete", ("tree", 2, 0): "delete", ("blob", 8, 7): "delete", ("commit", 3, 0): "grace", ("tree", 3, 0): "grace"}
    plan = QUERIES["missing_with_objects"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString().split("\n")
    assert not any("Join " in line and "sha" in line for line in plan)


def test_trees_come_under_other_keys_before_paths_are_made(spark):
    """A tree under another key is grouped once, by that key and the path, and its shas are shuffled as bytes."""
    d = "/root/testdata/sf0.001"
    wanted = spark.createDataFrame([(-1, 5), (-2, 5), (-3, 6)], "k long, at long")
    want = {(k, r.path, r.blob, r.mode) for r in lake.trees(spark, d).where("k in (5, 6)").collect() for k in {5: (-1, -2), 6: (-3,)}[r.k]}
    assert {tuple(r) for r in lake.trees(spark, d, wanted).collect()} == want and want
    first = lake.files(spark, d).where("k = 5").groupBy("path").agg(F.min("new_blob_sha").alias("blob"))
    assert {(r.path, r.blob) for r in first.collect()} == {(p, b) for k, p, b, _ in want if k == -1}
    plan = QUERIES["tree_diff"](spark, d)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate [") == 2 and plan.count("min(unhex(") == 2


def test_blame_streams_over_keys(spark):
    """No group of pandas for each key, the rows of plain walks, keys across batches and a null key."""
    texts = {k: [f"a{k}\nb\nc\nb", f"a{k}\nx\nb\nc", f"x\nb\nnew{k}\nc\nb"] for k in [None, *range(40)]}
    rows = [(k, v, t) for k, ts in texts.items() for v, t in enumerate(ts, 1)]
    got = lines.blame(spark.createDataFrame(rows, "key int, version int, text string"), "key", "version", "text")
    assert "FlatMapGroupsInPandas" not in got._jdf.queryExecution().toString()
    want = {(k, i, s, o) for k, ts in texts.items() for i, (s, o) in enumerate(zip(ts[-1].split("\n"), lines.blamed([(v, t.split("\n")) for v, t in enumerate(ts, 1)]), strict=True), 1)}
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        assert {tuple(r) for r in got.collect()} == want
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)


def test_only_match_is_that_of_the_table():
    import random

    import numpy as np

    r = random.Random(5)
    for _ in range(500):
        x, y = ([r.choice("abcdefghijkl") for _ in range(r.randrange(8))] for _ in range(2))
        found = lines._only_match(x, y, 0)
        assert found is None or found == lines._common(np.array([ord(c) for c in x]), np.array([ord(c) for c in y]), 0, 0)


def _exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_trees_dealt_by_commit_are_not_shuffled_again(spark):
    from chronolake.plans.registry import QUERIES

    data = "/root/testdata/sf0.01"
    assert _exchanges(QUERIES["working_tree_status"](spark, data)) == 1  # that of the commits
    for name in ("walked_trees", "resolved_paths", "tree_hierarchy"):
        plan = QUERIES[name](spark, data)._jdf.queryExecution().executedPlan().toString()
        assert "hashpartitioning(k#" in plan and "ENSURE_REQUIREMENTS" not in "".join(x for x in plan.splitlines() if "Exchange hashpartitioning" in x), name


def test_trees_within_keys_equal_walks_by_level(spark):
    from chronolake.operators import trees

    folder, blob = "040000", "100644"
    rows = [("r", "a", "t", folder), ("r", "b", "t", folder), ("r", "f", "1", blob), ("t", "x", "2", blob), ("t", "y", "u", folder), ("u", "z", "3", blob)]
    entries = spark.createDataFrame(rows, "tree string, name string, sha string, mode string")
    roots = spark.createDataFrame([("r",)], "root string")
    keyed = lambda df: df.selectExpr("1 as k", "*")
    within = trees.flatten_within(keyed(entries), keyed(roots), ["k"], 3).drop("k")
    assert sorted(map(tuple, within.collect())) == sorted(map(tuple, trees.flatten(entries, roots).collect()))
    wanted = spark.createDataFrame([("r", p) for p in ("a/y/z", "b", "f", "f/x", "none", "a/none/z")], "root string, path string")
    within = trees.resolve_within(keyed(entries), keyed(wanted), ["k"], 3).drop("k")
    assert set(map(tuple, within.collect())) == set(map(tuple, trees.resolve_path(entries, wanted).collect()))
    with pytest.raises(Exception, match="deeper"):
        trees.flatten_within(keyed(entries), keyed(roots), ["k"], 2).collect()


def test_followed_rounds_send_no_table_to_the_driver(spark, monkeypatch):
    plans, plain = [], trees.staged_counted

    def seen(df, name):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return plain(df, name)

    monkeypatch.setattr(trees, "staged_counted", seen)
    parents = spark.createDataFrame([(k, k - 1) for k in range(1, 4)], "child long, parent long")
    starts = spark.createDataFrame([(3, "a"), (2, "b")], "k long, path string")
    renamed = spark.createDataFrame([(3, "old", "a"), (1, "older", "old")], "k long, old_path string, new_path string")
    got = trees.followed(starts, parents, renamed)
    assert {(r.start, r.k, r.path) for r in got.collect()} == {(3, 3, "a"), (3, 2, "old"), (3, 1, "old"), (3, 0, "older"), (2, 2, "b"), (2, 1, "b"), (2, 0, "b")}
    assert plans and not any("BroadcastHashJoin" in p for p in plans)
