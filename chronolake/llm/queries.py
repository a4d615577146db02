"""The registered queries of the training-data operators: thin views of what each operator returns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .decontaminate import benchmark_leaks
from .exact_dedup import exact_dedup
from .jaccard_join import jaccard_components
from .licenses import scan_licenses
from .mixing import Mix, mixed
from .oracle import MIXING, SQL
from .pii import find_personal_data
from .quality import score_quality
from .toxicity import score_toxicity
from .url_filter import url_verdicts
from .warc import archived


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"), k=3, percent=90)


def op2_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed(table(spark, sf_dir, "documents"), Mix())


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return benchmark_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"), digest=True)


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archived(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_verdicts(table(spark, sf_dir, "pages"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_personal_data(table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (op1_ngram_jaccard_join, op2_source_mixing, op3_license_scan, op4_quality_classifier, op5_decontamination, op6_exact_dedup, op7_warc, op8_url_filter, op9_toxicity, op10_personal_data)
}
ORACLE = {"op2_source_mixing": MIXING, **SQL}
