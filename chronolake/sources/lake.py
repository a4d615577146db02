"""The lake's tables, derived from the driver's tables: commits, their parents, files, trees, refs, repositories, ref log, change events, objects, reviews and accesses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

EXTENSIONS = [".ts", ".py", ".md", ".json", ".go", ".rs", "", ".TXT"]
HOSTS = ["github", "gitlab", "bitbucket", "gitea", "local"]
SYNC = ["synced", "failed", "pending", "syncing"]
EVENT_KINDS = {"signup": "BRANCH_CREATED", "purchase": "COMMIT_CREATED", "error": "OBJECT_DELETED", "view": "OBJECT_CREATED", "click": "REF_UPDATED"}
REVIEW_STATES = ["commented", "approved", "changes_requested"]
#: Lines of whole trees in a partition, on average: few enough that several sorts of their entries fit a task.
LINES_A_PARTITION = 100_000


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(values: list[str], index: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (index + 1).cast("int"))


def commit_sha(key: Column) -> Column:
    return F.sha1(F.concat(F.lit("commit "), key.cast("string")).cast("binary"))


def commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    rows = read(spark, sf_dir, "orders").join(read(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    name = F.col("c_name")
    return rows.select(
        k.alias("k"), commit_sha(k).alias("sha"), F.sha1(F.concat(F.lit("tree "), k.cast("string")).cast("binary")).alias("tree_sha"), name.alias("author_name"),
        F.concat(F.when(k % 2 == 0, F.upper(name)).otherwise(F.lower(name)), F.lit("@example.com")).alias("author_email"), F.col("o_orderdate").alias("author_date"),
        F.concat(F.col("o_orderpriority"), F.lit("\norder "), k.cast("string")).alias("message"), F.col("o_orderstatus").alias("repository"), parents(k).alias("parents"),
        F.concat(F.lit("Committer#"), (k % 97).cast("string")).alias("committer_name"), F.concat(F.lit("committer"), (k % 97).cast("string"), F.lit("@example.org")).alias("committer_email"),
        (F.col("o_orderdate") + F.make_dt_interval(hours=(k % 5).cast("int"))).alias("committer_date"), F.when(k % 11 == 0, F.concat(F.lit("sig "), k.cast("string"))).alias("gpg_signature"),
    )


def parents(k: Column) -> Column:
    """Keys of the parents of commit k, in order."""
    first, second = F.floor(k / 2), F.floor(k / 3)
    return F.when(k == 0, F.array().cast("array<bigint>")).when((k % 3 == 0) & (first != second), F.array(first, second)).otherwise(F.array(first))


def commit_parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(child, parent, ord) by commit key."""
    k = F.col("o_orderkey")
    return read(spark, sf_dir, "orders").select(k.alias("child"), F.posexplode(parents(k)).alias("ord", "parent")).select("child", "parent", "ord")


def _path() -> Column:
    """The path of a part."""
    name = F.concat(F.replace(F.col("p_name"), F.lit(" "), F.lit("_")), pick(EXTENSIONS, F.col("p_size") % 8))
    folder = F.concat(F.lower("p_type"), F.lit("/"), F.replace(F.lower("p_brand"), F.lit("#"), F.lit("")), F.lit("/"))
    return F.concat(F.when(F.col("p_size") == 50, "").otherwise(folder), name)


def _blob(second: Column) -> Column:
    return F.sha1(F.concat(F.lit("blob "), F.col("l_partkey").cast("string"), F.lit(":"), second).cast("binary"))


def _mode() -> Column:
    return F.when(F.col("l_suppkey") % 7 == 0, "100755").otherwise("100644")


def path_depth(spark: SparkSession, sf_dir: str) -> int:
    """The most components that a path of the lake may have."""
    return read(spark, sf_dir, "part").agg(F.max(F.size(F.split(_path(), "/")))).first()[0] or 0


def files(spark: SparkSession, sf_dir: str, lines: DataFrame | None = None) -> DataFrame:
    """The files of all lines, or of some, which may have come under other keys."""
    rows = (read(spark, sf_dir, "lineitem") if lines is None else lines).join(read(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    size = F.col("p_size")
    kind = F.when(F.col("l_returnflag") == "A", "A").when(F.col("l_returnflag") == "N", "M").when(F.col("l_linestatus") == "F", "D").otherwise("R")
    return rows.select(
        F.col("l_orderkey").alias("k"), _path().alias("path"), kind.alias("change_type"), (size % 10 == 9).alias("is_binary"),
        F.col("l_quantity").cast("int").alias("added"), F.floor(F.col("l_tax") * 100).cast("int").alias("removed"), (size.cast("long") * 100).alias("old_size"),
        (size.cast("long") * 100 + F.col("l_quantity").cast("long")).alias("new_size"), _blob(F.lit("0")).alias("old_blob_sha"), _blob(F.col("l_suppkey").cast("string")).alias("new_blob_sha"),
        _mode().alias("mode"), F.col("l_shipdate").alias("commit_date"),
    )


def trees(spark: SparkSession, sf_dir: str, wanted: DataFrame | None = None) -> DataFrame:
    """(k, path, blob, mode): one entry for each path of a commit; with wanted(k, at), whose k come once, the trees of the commits at under the keys k.

    Keys are changed while lines are numbers, before paths are made, and shas are compared as bytes, which have the order of their digits."""
    lines = None
    if wanted is not None:
        lines = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey").join(wanted.select(F.col("k").alias("key"), "at"), F.col("l_orderkey") == F.col("at")).select(F.col("key").alias("l_orderkey"), "l_partkey", "l_suppkey")
        rest = [f for f in read(spark, sf_dir, "lineitem").schema if f.name not in lines.columns]
        lines = lines.select("*", *(F.lit(None).cast(f.dataType).alias(f.name) for f in rest))
    found = files(spark, sf_dir, lines).groupBy("k", "path").agg(F.min(F.unhex("new_blob_sha")).alias("blob"), F.min("mode").alias("mode"))
    return found.select("k", "path", F.lower(F.hex("blob")).alias("blob"), "mode")


def line_partitions(spark: SparkSession, sf_dir: str, each: int = LINES_A_PARTITION) -> int:
    """How many partitions hold some `each` lines."""
    return read(spark, sf_dir, "lineitem").count() // each + 2


def whole_lines(spark: SparkSession, sf_dir: str, partitions: int) -> DataFrame:
    """(k, path, l_partkey, l_suppkey) of every line, all of a commit in one partition by k; its blob and mode are made from the numbers, after the shuffle."""
    lines = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey")
    rows = lines.join(read(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_orderkey").alias("k"), _path().alias("path"), "l_partkey", "l_suppkey")
    return rows.repartition(partitions, "k")


def whole_trees(spark: SparkSession, sf_dir: str, partitions: int | None = None) -> DataFrame:
    """The rows of trees, all of a commit in one partition by k, so what groups or joins them by k and more shuffles nothing again.

    Blobs are made after the shuffle, from their numbers."""
    dealt = whole_lines(spark, sf_dir, partitions or line_partitions(spark, sf_dir))
    found = dealt.groupBy("k", "path").agg(F.min(F.unhex(_blob(F.col("l_suppkey").cast("string")))).alias("blob"), F.min(_mode()).alias("mode"))
    return found.select("k", "path", F.lower(F.hex("blob")).alias("blob"), "mode")


def whole_roots(spark: SparkSession, sf_dir: str, partitions: int) -> DataFrame:
    """(k, path, l_partkey, l_suppkey, mode): the entries of the root of every commit, dealt as whole_lines; a folder's numbers are those of its least path that has a blob.

    root_blobs names them, so that no sha is shuffled if they are dealt again."""
    sha = F.unhex(_blob(F.col("l_suppkey").cast("string")))
    least = F.min(F.when(F.col("path").isNotNull() & sha.isNotNull(), F.struct("path", sha.alias("sha"), "l_partkey", "l_suppkey"))).alias("least")
    mode = F.when(F.max(F.col("path").contains("/").cast("int")) == 1, "040000").otherwise(F.min(_mode())).alias("mode")
    found = whole_lines(spark, sf_dir, partitions).groupBy("k", F.substring_index("path", "/", 1).alias("top")).agg(least, mode)
    return found.select("k", F.col("top").alias("path"), "least.l_partkey", "least.l_suppkey", "mode")


def root_blobs(roots: DataFrame) -> DataFrame:
    """Entries of whole_roots with blobs in the place of their numbers."""
    return roots.withColumn("blob", _blob(F.col("l_suppkey").cast("string"))).drop("l_partkey", "l_suppkey")


def refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, nation = F.col("s_suppkey"), F.lower("n_name")
    rows = read(spark, sf_dir, "supplier").join(read(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    tag = F.concat(F.lit("refs/tags/v"), (s % 3).cast("string"), F.lit("."), (s % 11).cast("string"), F.lit("."), s.cast("string"))
    named = lambda prefix: F.concat(F.lit(prefix), nation, F.lit("-"), s.cast("string"))
    name = F.when(s % 4 == 0, named("refs/heads/")).when(s % 4 == 1, tag).when(s % 4 == 2, named("refs/remotes/origin/")).otherwise(named("refs/notes/"))
    balance = F.floor(F.abs("s_acctbal")).cast("long")
    return rows.select(name.alias("name"), (s * 7).alias("target"), commit_sha(s * 7).alias("target_sha"), (balance % 10).cast("int").alias("ahead"), (F.floor(balance / 10) % 10).cast("int").alias("behind"))


def ref_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    """refs with upstreams of branches, and messages and taggers of annotated tags (every third)."""
    s = (F.col("target") / 7).cast("long")
    annotated = F.col("name").startswith("refs/tags/") & (s % 3 == 0)
    return refs(spark, sf_dir).select(
        "*", F.when(F.col("name").startswith("refs/heads/"), F.regexp_replace("name", "^refs/heads/", "refs/remotes/origin/")).alias("upstream"), F.when(annotated, F.concat(F.lit("Release "), s.cast("string"))).alias("tag_message"),
        F.when(annotated, F.concat(F.lit("Tagger "), (s % 5).cast("string"))).alias("tagger_name"), F.when(annotated, F.concat(F.lit("tagger"), (s % 5).cast("string"), F.lit("@example.org"))).alias("tagger_email"),
        F.when(annotated, 1_600_000_000_000 + s % 13 * 86_400_000).alias("tagger_ms"), F.concat(F.lit("repo-"), (s % 4).cast("string")).alias("repository"),
    )


def object_edges(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Links of objects by sha: (commit, tree) of commits, (tree, blob) of trees, and (tag, object) of tags."""
    tree_sha = lambda k: F.sha1(F.concat(F.lit("tree "), k.cast("string")).cast("binary"))
    tops = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), commit_sha(F.col("o_orderkey")).alias("commit"), tree_sha(F.col("o_orderkey")).alias("tree"))
    entries = files(spark, sf_dir).select(tree_sha(F.col("k")).alias("tree"), F.col("new_blob_sha").alias("blob")).distinct()
    tags = refs(spark, sf_dir).where("name like 'refs/tags/%'").select(F.sha1(F.concat(F.lit("tag "), "name").cast("binary")).alias("tag"), F.col("target_sha").alias("object"))
    return tops, entries, tags


def commit_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"))


def entry_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(k, a, b): the commits of blobs by the two numbers that a blob's sha is made of; object_sha names them."""
    rows = read(spark, sf_dir, "lineitem").join(read(spark, sf_dir, "part").select("p_partkey"), F.col("l_partkey") == F.col("p_partkey"))
    return rows.select(F.col("l_orderkey").alias("k"), F.col("l_partkey").alias("a"), F.col("l_suppkey").alias("b"))


def object_sha(kind: str, a: str, b: str) -> Column:
    """The sha of an object of a kind (commit, tree or blob) by its numbers; b counts for blobs."""
    text = F.concat(F.col(kind), F.lit(" "), F.col(a).cast("string"), F.when(F.col(kind) == "blob", F.concat(F.lit(":"), F.col(b).cast("string"))).otherwise(""))
    return F.sha1(text.cast("binary"))


def pull_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A request for each conversation, with its labels as JSON and the files of the commit with its number."""
    n = F.col("number")
    rows = read(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("number")).agg(F.count("*").alias("turns"), F.min_by("role", "turn").alias("author"))
    status = F.when(n % 5 == 0, "merged").when(n % 5 == 1, "closed").otherwise("open")
    labels = F.concat(F.lit('["size-'), (F.col("turns") % 3).cast("string"), F.lit('"'), F.when(n % 2 == 0, ',"bug"').otherwise(""), F.lit("]"))
    return rows.select(
        "number", F.concat(F.lit("Request "), n.cast("string")).alias("title"), status.alias("status"), F.concat(F.lit("topic-"), n.cast("string")).alias("source_branch"), F.when(n % 3 == 0, "release").otherwise("main").alias("target_branch"),
        "author", labels.alias("labels"), commit_sha(n).alias("source_sha"), F.when(n % 5 == 0, commit_sha(n + 1)).alias("merge_commit_sha"), (n % 50).alias("k"), "turns",
    )


def repositories(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("n_nationkey")
    people = read(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.count("*").alias("contributor_count"))
    work = read(spark, sf_dir, "orders").join(read(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).groupBy(F.col("c_nationkey").alias("w")).agg(F.count("*").alias("commit_count"))
    rows = read(spark, sf_dir, "nation").join(read(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).join(people, n == F.col("c_nationkey"), "left").join(work, n == F.col("w"), "left")
    return rows.select(
        F.concat_ws("/", F.lower("r_name"), F.lower("n_name")).alias("full_name"), pick(HOSTS, n % 5).alias("source"), pick(SYNC, n % 4).alias("sync_status"),
        F.when(n % 4 == 1, F.concat(F.lit("timeout "), n.cast("string"))).alias("last_error"), F.coalesce("commit_count", F.lit(0)).alias("commit_count"), F.coalesce("contributor_count", F.lit(0)).alias("contributor_count"),
    )


def ref_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(version, ref_name, new_sha, ts); an empty new_sha deletes the ref."""
    e = F.col("event_id")
    new = F.when(F.col("event_type") == "error", "").otherwise(F.sha1(e.cast("string").cast("binary")))
    return read(spark, sf_dir, "events").select((e + 1).alias("version"), F.concat(F.lit("refs/heads/u"), F.col("user_id").cast("string")).alias("ref_name"), new.alias("new_sha"), "ts")


def change_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.lit(None).cast("string")
    for name, mapped in EVENT_KINDS.items():
        kind = F.when(F.col("event_type") == name, mapped).otherwise(kind)
    number = F.col("event_id")
    return read(spark, sf_dir, "events").select(
        F.concat(F.lit("evt-"), number.cast("string")).alias("event_id"), kind.alias("event_type"), pick(HOSTS, number % 5).alias("source"), "ts", number.alias("sequence"), F.col("props").alias("payload"), "user_id", "value"
    )


def objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(origin, id, raw): blobs from documents and pages."""
    docs = read(spark, sf_dir, "documents").select(F.lit("d").alias("origin"), F.col("doc_id").alias("id"), F.col("text").cast("binary").alias("raw"))
    pages = read(spark, sf_dir, "pages").select(F.lit("p").alias("origin"), F.col("page_id").alias("id"), F.col("html").cast("binary").alias("raw"))
    return docs.union(pages)


def reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    turn = F.col("turn")
    return read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("pr"), turn.alias("id"), F.col("role").alias("reviewer"), pick(REVIEW_STATES, (F.col("conv_id") + turn) % 3).alias("state"))
