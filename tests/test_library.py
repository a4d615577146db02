"""Functions and operators on small examples: lines, names, graphs, trees, packing, files, and a stream."""

import random
import zlib

import pytest
from pyspark.sql import functions as F

from chronolake.functions import lines, text
from chronolake.operators import access, dag, ref_log, storage, trees
from chronolake.sources import files, sinks
from chronolake.streaming import changes


def longest(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(max(new[-1], row[j + 1], row[j] + 1 if x == y else 0))
        row = new
    return row[-1]


@pytest.mark.parametrize("cells", [1 << 22, 8])
def test_matches_are_a_longest_common_subsequence(monkeypatch, cells):
    monkeypatch.setattr(lines, "TABLE_CELLS", cells)
    r = random.Random(1)
    for _ in range(200):
        a, b = ([r.choice("abcd") for _ in range(r.randint(0, 12))] for _ in range(2))
        found = lines.matches(a, b)
        assert all(a[i] == b[j] for i, j in found)
        assert all(p < q and s < t for (p, s), (q, t) in zip(found, found[1:], strict=False))
        assert len(found) == longest(a, b)


def test_unified_diff_applies():
    r = random.Random(2)
    for _ in range(100):
        a, b = ([r.choice("abcde") for _ in range(r.randint(0, 20))] for _ in range(2))
        out, at = [], 0
        for line in lines.unified(a, b, context=2):
            if line.startswith("@@"):
                start, size = (line.split()[1][1:] + ",1").split(",")[:2]
                first = int(start) - (int(size) > 0)
                out, at = out + a[at:first], first
            elif line[0] in " -":
                assert a[at] == line[1:]
                at += 1
                out += [line[1:]] if line[0] == " " else []
            else:
                out.append(line[1:])
        assert out + a[at:] == b


def test_word_diff_and_merge():
    assert lines.word_diff("one two three", "one 2 three") == "one [-two-]{+2+} three"
    base = ["a", "b", "c", "d"]
    assert lines.merge3(base, ["A", "b", "c", "d"], ["a", "b", "c", "D"]) == (["A", "b", "c", "D"], False)
    assert lines.merge3(base, base, ["a", "x"]) == (["a", "x"], False)
    merged, conflict = lines.merge3(base, ["a", "1", "c", "d"], ["a", "2", "c", "d"])
    assert conflict and merged == ["a", "<<<<<<< ours", "1", "=======", "2", ">>>>>>> theirs", "c", "d"]
    assert lines.merge3(base, ["a", "1", "c", "d"], ["a", "1", "c", "d"]) == (["a", "1", "c", "d"], False)


def test_blame(spark):
    rows = [("f", 1, "a\nb"), ("f", 2, "a\nx\nb"), ("f", 3, "x\nb\nc"), ("g", 1, "only")]
    got = lines.blame(spark.createDataFrame(rows, "path string, version int, content string"), "path", "version", "content")
    assert sorted(map(tuple, got.collect())) == [("f", 1, "x", 2), ("f", 2, "b", 1), ("f", 3, "c", 3), ("g", 1, "only", 1)]


def test_names_and_paths(spark):
    df = spark.createDataFrame([("src/a.TS",), ("Makefile",), (".gitignore",), ("x/.env",), ("a.b/c",)], "path string")
    got = {r.path: (r.e, r.d, r.lang) for r in df.select("path", text.extension(F.col("path")).alias("e"), text.directory(F.col("path")).alias("d"), text.language(F.col("path")).alias("lang")).collect()}
    assert got["src/a.TS"] == (".TS", "src", "TypeScript")
    assert got["Makefile"] == (None, ".", None) and got["a.b/c"] == (None, "a.b", None)
    assert got[".gitignore"][2] == "gitignore" and got["x/.env"][2] == "dotenv"
    names = ["refs/heads/a", "refs/heads/a..b", "refs/heads/.x", "refs/heads/x.lock", "a b", "x/", "@", "a@{1}", ""]
    ok = [r.v for r in spark.createDataFrame([(n,) for n in names], "n string").select(text.valid_ref_name(F.col("n")).alias("v")).collect()]
    assert ok == [True] + [False] * 8
    blob = spark.range(1).select(text.object_id("blob", F.lit("hello").cast("binary")).alias("s")).first().s
    assert blob == "b6fc4c620b67d95f953a5c1c1230aaab5db5a1b0"
    versions = spark.createDataFrame([("v1.10",), ("v1.2.1",), ("1.2",)], "n string").orderBy(text.version_key(F.col("n")))
    assert [r.n for r in versions.collect()] == ["1.2", "v1.2.1", "v1.10"]


def test_graph(spark):
    edges = spark.createDataFrame([(2, 1, 0), (3, 1, 0), (4, 2, 0), (4, 3, 1), (5, 3, 0), (5, 2, 1)], "child long, parent long, ord int")
    assert {r.node for r in dag.merge_bases(edges, 4, 5).collect()} == {2, 3}
    assert sorted(r.node for r in dag.octopus_bases(edges, [4, 5, 2]).collect()) == [1, 2]
    assert dag.is_ancestor(edges, 1, 5) and not dag.is_ancestor(edges, 4, 5)
    cycle = spark.createDataFrame([(1, 2, 0), (2, 1, 0)], "child long, parent long, ord int")
    with pytest.raises(ValueError, match="cycle"):
        dag.generations(cycle, spark.createDataFrame([(1,), (2,)], "node long"))


def test_trees(spark):
    entries = spark.createDataFrame([("r", "a", "1", "100644"), ("r", "d", "t", "040000"), ("t", "b", "2", "100644"), ("t", "e", "u", "040000"), ("u", "c", "3", "100755")], "tree string, name string, sha string, mode string")
    assert {r.path: r.sha for r in trees.flatten(entries, spark.createDataFrame([("r",)], "root string")).collect()} == {"a": "1", "d/b": "2", "d/e/c": "3"}
    pairs = [(1, "a", "x", 90), (1, "a", "y", 80), (1, "b", "x", 95), (1, "b", "y", 60), (1, "c", "y", 40)]
    got = trees.similar_renames(spark.createDataFrame(pairs, "k long, old_path string, new_path string, similarity int"), "k")
    assert sorted(map(tuple, got.collect())) == [(1, "a", "x", 90), (1, "b", "y", 60)]


def test_packs_are_cut_in_order(spark):
    rows = [("g", i, s) for i, s in enumerate([50, 60, 10, 200, 5, 90, 6])]
    got = storage.packed(spark.createDataFrame(rows, "g string, id long, size long"), "g", 100).orderBy("id").collect()
    assert [r.pack for r in got] == [0, 1, 1, 2, 3, 3, 4]


def test_rate_limit_opens_a_window_at_the_first_hit(spark):
    rows = [(1, i, ms) for i, ms in enumerate([0, 10, 20, 99, 100, 150, 201])]
    got = access.rate_limited(spark.createDataFrame(rows, "key long, id long, ms long"), 2, 100).orderBy("id").collect()
    assert [r.allowed for r in got] == [True, True, False, False, True, True, True]


def test_compare_and_swap(spark):
    current = spark.createDataFrame([("a", "1"), ("b", "2")], "ref_name string, new_sha string")
    commands = spark.createDataFrame([("a", "1", "3"), ("b", "9", "3"), ("c", "", "4")], "ref_name string, expected string, new_sha string")
    verdicts = ref_log.compare_and_swap(current, commands)
    assert {r.ref_name: r.ok for r in verdicts.collect()} == {"a": True, "b": False, "c": True}
    assert {tuple(r) for r in ref_log.applied(current, verdicts).collect()} == {("a", "3"), ("b", "2"), ("c", "4")}
    assert not ref_log.compare_and_swap(current, commands, atomic=True).where("ok").count()


def test_files(spark, tmp_path):
    (tmp_path / "packed-refs").write_text("# pack-refs\n" + "a" * 40 + " refs/tags/v1\n^" + "b" * 40 + "\n" + "c" * 40 + " refs/heads/main\n")
    got = {r.name: (r.sha, r.peeled) for r in files.packed_refs(spark, str(tmp_path / "packed-refs")).collect()}
    assert got == {"refs/tags/v1": ("a" * 40, "b" * 40), "refs/heads/main": ("c" * 40, None)}
    (tmp_path / "objects").mkdir()
    (tmp_path / "objects" / "x").write_bytes(zlib.compress(b"blob 5\0hello"))
    assert [(r.type, r.size, bytes(r.content)) for r in files.loose_objects(spark, str(tmp_path / "objects")).collect()] == [("blob", 5, b"hello")]
    log = spark.createDataFrame([("0" * 40 + " " + "1" * 40 + " A B <a@b> 12 +0000\tmsg",), ("bad",)], "value string")
    assert [tuple(r) for r in files.ref_log_lines(log).collect()] == [("0" * 40, "1" * 40, "A B", "a@b", 12, "+0000", "msg")]


def test_sinks(spark, tmp_path):
    df = spark.range(100).withColumn("part", F.col("id") % 2)
    sinks.write_table(df, str(tmp_path / "t"), codec="zstd", sort_by=["id"], partition_by=["part"])
    stats = sinks.file_statistics(spark.read.parquet(str(tmp_path / "t")), ["id"]).collect()
    assert sum(r.record_count for r in stats) == 100 and all(r.id_nulls == 0 for r in stats)
    meta = sinks.append_snapshot({}, {"added-records": 1}, 5)
    meta = sinks.append_snapshot(meta, {"added-records": 2}, 6)
    assert [s["parent-snapshot-id"] for s in meta["snapshots"]] == [None, 5000]
    with pytest.raises(ValueError, match="exists"):
        sinks.append_snapshot(meta, {}, 6)


def test_change_stream(spark, tmp_path):
    rows = [(f"e{i}" if i % 5 else "", "REF_UPDATED" if i % 7 else "ODD", "github", i, '{"k": 1}') for i in range(50)]
    df = spark.createDataFrame(rows, "event_id string, event_type string, source string, sequence long, payload string").withColumn("ts", F.timestamp_seconds(F.col("sequence") + 1))
    df.repartition(4).write.parquet(str(tmp_path / "in"))
    for _ in range(2):  # the second run finds nothing new
        stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        changes.pipeline(stream, str(tmp_path / "table"), str(tmp_path / "dead"), str(tmp_path / "checkpoint")).awaitTermination()
    good = spark.read.parquet(str(tmp_path / "table"))
    dead = spark.read.parquet(*[str(p) for p in sorted((tmp_path / "dead").glob("batch=*"))])
    assert good.count() + dead.count() == 50
    assert {r.sequence for r in dead.collect()} == {i for i in range(50) if i % 5 == 0 or i % 7 == 0}
