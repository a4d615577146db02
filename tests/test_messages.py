"""Texts of commits and pointers, message rules, and membership filters on small examples."""

from pyspark.sql import functions as F

from chronolake.functions import messages
from chronolake.operators import search


def one(spark, text, expression):
    return spark.createDataFrame([(text,)], "m string").select(expression(F.col("m")).alias("x")).first().x


def test_commit_fields(spark):
    raw = f"tree {'a' * 40}\nparent {'b' * 40}\nparent {'c' * 40}\nauthor A B <a@b> 12 +0100\ncommitter C <c@d> 13 -0200\ngpgsig x\n\nsubject\n\nbody\nauthor fake <x> 1 +0000"
    x = one(spark, raw, messages.commit_fields)
    assert (x.tree, x.parents, x.author_name, x.author_email, x.author_ms, x.committer_name, x.is_signed) == ("a" * 40, ["b" * 40, "c" * 40], "A B", "a@b", 12000, "C", True)
    assert x.message.startswith("subject\n\nbody")
    assert one(spark, "not a commit", messages.commit_fields) is None


def test_pointers_and_messages(spark):
    pointer = f"version https://git-lfs.github.com/spec/v1\noid sha256:{'0' * 64}\nsize 77\n"
    assert tuple(one(spark, pointer, messages.lfs_pointer)) == ("0" * 64, 77)
    assert one(spark, pointer[:60], messages.lfs_pointer) is None
    assert one(spark, "\n# c\na  \n\n\n\nb\n\n", messages.cleaned) == "a\n\nb"
    assert [tuple(t) for t in one(spark, "s\n\nbody\n\nKey: v\nOther-Key: w", messages.trailers)] == [("Key", "v"), ("Other-Key", "w")]
    assert one(spark, "s\n\nKey: v\nno trailer", messages.trailers) is None
    faults = [one(spark, m, messages.valid_message) for m in ("", "x" * 80, "a\nb", "a\n\nb", "a")]
    assert faults == ["empty", "long-subject", "no-blank-line", "ok", "ok"]
    assert one(spark, "refs/heads/x", lambda c: messages.refspec("+refs/heads/*:refs/remotes/o/*", c)) == "refs/remotes/o/x"
    assert one(spark, "refs/tags/x", lambda c: messages.refspec("refs/heads/*:refs/remotes/o/*", c)) is None


def test_bloom_filter_loses_nothing(spark):
    keys, rows = spark.range(0, 1000, 7), spark.range(20000)
    kept = search.maybe_in(rows, "id", search.bloom_words(keys, "id"))
    assert keys.join(kept, "id", "left_anti").count() == 0
    assert kept.count() < 1000


def test_as_of(spark):
    points = spark.createDataFrame([("a", 5), ("a", 1), ("b", 9)], "k string, t int")
    history = spark.createDataFrame([("a", 2, "x"), ("a", 5, "y"), ("c", 1, "z")], "k string, t int, v string")
    assert {(r.k, r.t): r.v for r in search.as_of(points, history, "k", "t", "v").collect()} == {("a", 5): "y", ("a", 1): None, ("b", 9): None}


def test_commit_fields_compute_the_text_once(spark):
    """A text that is made in the plan is made and cut into its header once, however many fields are read."""
    raw = messages.commit_text(F.repeat(F.lit("a"), F.lit(40)), F.array(F.sha1(F.col("m").cast("binary"))), F.col("m"), F.col("m"), F.concat("m", F.lit("\n\nbody")))
    rows = spark.createDataFrame([("A <a@b> 12 +0100",)], "m string").select(messages.commit_fields(raw).alias("f")).select("f.*")
    assert rows.first().message == "A <a@b> 12 +0100\n\nbody"
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("sha1(") == 1
    for end in ("", "\n", "\n\n", "\n\n\n"):
        x = one(spark, f"tree {'a' * 40}\nauthor A <a> 1 +0000{end}", messages.commit_fields)
        assert (x.tree, x.author_ms, x.message) == ("a" * 40, 1000, "\n" if end == "\n\n\n" else "")
    assert one(spark, None, messages.commit_fields) is None
