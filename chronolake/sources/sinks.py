"""Writers: lake tables, ref snapshots, objects, size-bounded bundles, and tables with snapshots and manifests."""

from __future__ import annotations

import json
import time

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from chronolake.operators import storage
from chronolake.sources.staging import removed

CODECS = {"lz4": "lz4_raw", "snappy": "snappy", "gzip": "gzip", "zstd": "zstd", "none": "uncompressed"}


def write_table(df: DataFrame, path: str, codec: str = "lz4", sort_by: list[str] = (), partition_by: list[str] = (), rows_per_file: int = 0, mode: str = "errorifexists") -> None:
    """Parquet with real sorting within files and real partitions."""
    if sort_by:
        df = df.sortWithinPartitions(*sort_by)
    writer = df.write.mode(mode).option("compression", CODECS[codec])
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if rows_per_file:
        writer = writer.option("maxRecordsPerFile", rows_per_file)
    writer.parquet(path)


def write_ref_snapshot(refs: DataFrame, path: str) -> None:
    """JSON lines of refs(name, target) in order of name, from one file to the next."""
    refs.select("name", "target").repartitionByRange("name").sortWithinPartitions("name").write.mode("overwrite").json(path)


def export(tables: dict[str, DataFrame], folder: str, names: list[str] = ("commits", "refs"), codec: str = "lz4", form: str = "parquet") -> dict[str, int]:
    """Writes the named tables below folder, as Parquet or as snapshots of tables with metadata; the rows of each."""
    if form not in ("parquet", "snapshot") or codec not in CODECS or not set(names) <= tables.keys():
        raise ValueError(f"cannot export {list(names)} as {form} with {codec}")
    rows = {}
    for name in names:
        seen, path = Observation(), f"{folder}/{name}"
        write_table(tables[name].observe(seen, F.count("*").alias("n")), f"{path}/data" if form == "snapshot" else path, codec)
        rows[name] = seen.get["n"]
        if form == "snapshot":
            append_files(tables[name].sparkSession, path, f"{path}/data", int(time.time() * 1000))
    return rows


def write_objects(objects: DataFrame, folder: str, codec: str = "snappy") -> str:
    """Writes objects(sha, type, size, storage, path, ...) below a name that follows from their shas, so that writing the same objects again replaces them; the path."""
    digest = objects.agg(F.sha2(F.concat_ws(",", F.count("*").cast("string"), F.coalesce(F.bit_xor(F.xxhash64("sha")), F.lit(0)).cast("string"), F.coalesce(F.sum(F.xxhash64("sha").cast("decimal(38,0)")), F.lit(0)).cast("string")), 256)).first()[0]
    path = f"{folder}/objects/{digest[:32]}"
    objects.write.mode("overwrite").option("compression", CODECS[codec]).parquet(path)
    return path


def write_bundles(objects: DataFrame, group: str, folder: str, max_bytes: int) -> DataFrame:
    """Writes objects(group, id, size, ...) by group and pack, a pack of at most max_bytes or one larger object; the catalog (group, pack, objects, bytes)."""
    packs = storage.packed(objects, group, max_bytes)
    objects.drop("size").join(packs, [group, "id"]).write.partitionBy(group, "pack").parquet(folder)
    return packs.groupBy(group, "pack").agg(F.count("*").alias("objects"), F.sum("size").alias("bytes"))


def manifest_counts(entries: DataFrame, keys: list[str]) -> DataFrame:
    """Files and rows that were added, existed, and were deleted, of entries(keys, status, record_count); status is 1, 0 or 2."""
    names = {1: "added", 0: "existing", 2: "deleted"}
    parts = []
    for status, name in names.items():
        parts += [F.count_if(F.col("status") == status).alias(f"{name}_files"), F.coalesce(F.sum(F.when(F.col("status") == status, F.col("record_count"))), F.lit(0)).alias(f"{name}_rows")]
    return entries.groupBy(*keys).agg(*parts)


def file_statistics(df: DataFrame, columns: list[str]) -> DataFrame:
    """A row for each data file of df: rows, bytes, and least, greatest and nulls of each column."""
    parts = [F.count("*").alias("record_count"), F.max("_metadata.file_size").alias("file_size_in_bytes")]
    for c in columns:
        parts += [F.min(c).cast("string").alias(f"{c}_min"), F.max(c).cast("string").alias(f"{c}_max"), F.count_if(F.col(c).isNull()).alias(f"{c}_nulls")]
    return df.groupBy(F.col("_metadata.file_path").alias("file_path")).agg(*parts)


def append_snapshot(metadata: dict, manifest_totals: dict, timestamp_ms: int, counter: int = 0) -> dict:
    """Table metadata with one more snapshot; earlier snapshots and manifests stay.  A snapshot id can't come twice."""
    number = timestamp_ms * 1000 + counter % 1000
    if any(s["snapshot-id"] == number for s in metadata.get("snapshots", [])):
        raise ValueError(f"snapshot {number} exists")
    snapshot = {"snapshot-id": number, "parent-snapshot-id": metadata.get("current-snapshot-id"), "timestamp-ms": timestamp_ms, "summary": {"operation": "append", **{k: str(v) for k, v in manifest_totals.items()}}}
    log = [*metadata.get("snapshot-log", []), {"snapshot-id": number, "timestamp-ms": timestamp_ms}]
    return json.loads(json.dumps({**metadata, "format-version": 2, "snapshots": [*metadata.get("snapshots", []), snapshot], "snapshot-log": log, "current-snapshot-id": number}))


def create_metadata(location: str, columns: dict[str, str]) -> dict:
    """Metadata of a table without snapshots; columns are numbered in order."""
    fields = [{"id": i, "name": name, "type": kind, "required": False} for i, (name, kind) in enumerate(columns.items(), 1)]
    return {"format-version": 2, "location": location, "last-column-id": len(fields), "schemas": [{"schema-id": 0, "fields": fields}], "current-schema-id": 0, "snapshots": [], "snapshot-log": []}


def read_metadata(spark: SparkSession, table: str) -> dict | None:
    """The newest metadata of a table's folder, the one of the greatest version; None if there is none."""
    versions = f"{table}/metadata/v*"
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(versions)
    if not len(path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path)):
        return None
    text = spark.read.text(versions, wholetext=True).select("value", F.regexp_extract(F.col("_metadata.file_path"), r"/v(\d+)/", 1).cast("int").alias("v")).orderBy(F.desc("v")).limit(1).first()
    return json.loads(text["value"]) if text else None


def append_files(spark: SparkSession, table: str, data: str, timestamp_ms: int, counter: int = 0, expected: int | None = None) -> dict:
    """A new snapshot of the files in data: a manifest with the statistics of each file, then metadata whose list
    holds all earlier manifests too.  With expected, raises if another snapshot is current."""
    files = file_statistics(spark.read.parquet(data), []).withColumn("status", F.lit(1))
    before = read_metadata(spark, table) or create_metadata(table, {f.name: f.dataType.simpleString() for f in spark.read.parquet(data).schema})
    if expected is not None and before.get("current-snapshot-id") != expected:
        raise ValueError(f"the current snapshot is {before.get('current-snapshot-id')}")
    version = len(before["snapshots"]) + 1
    manifest = f"{table}/metadata/manifest-{version}"
    files.write.mode("errorifexists").parquet(manifest)
    total = files.agg(F.count("*").alias("added-data-files"), F.sum("record_count").alias("added-records"), F.sum("file_size_in_bytes").alias("added-files-size")).first().asDict()
    after = append_snapshot(before, total, timestamp_ms, counter)
    after["snapshots"][-1]["manifests"] = [*(before["snapshots"][-1]["manifests"] if before["snapshots"] else []), manifest]
    spark.createDataFrame([(json.dumps(after),)], "value string").coalesce(1).write.mode("errorifexists").text(f"{table}/metadata/v{version}")
    return after


def register(spark: SparkSession, namespace: str, name: str, path: str) -> None:
    """Makes a folder of Parquet known as namespace.name; raises if that is taken."""
    spark.sql(f"CREATE DATABASE IF NOT EXISTS `{namespace}`")
    spark.sql(f"CREATE TABLE `{namespace}`.`{name}` USING parquet LOCATION '{path}'")


def dropped(spark: SparkSession, namespace: str, name: str, purge: bool = False) -> None:
    """Forgets namespace.name; with purge its files go as well."""
    location = spark.sql(f"DESCRIBE TABLE EXTENDED `{namespace}`.`{name}`").where("col_name = 'Location'").first()["data_type"]
    spark.sql(f"DROP TABLE `{namespace}`.`{name}`")
    if purge:
        removed(spark, location)
