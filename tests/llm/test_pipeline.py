"""The pipeline, stage by stage, against plain models and SQL."""

from __future__ import annotations

import re

import duckdb
import pytest

import corpus_pipeline
from chronolake.llm import oracle, toxicity

from . import brute

DATA = "/root/testdata/sf0.01"


def test_stages_one_after_the_other(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    rows = {r.doc_id: r for r in docs.collect()}
    left = set(rows)
    columns = docs.columns
    seen = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, DATA).cache()
        assert docs.columns == columns
        got = {r.doc_id for r in docs.select("doc_id").collect()}
        seen.append(name)
        if name == "toxicity":
            scored = toxicity.score_toxicity(spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet"))
            want = {r.doc_id for r in scored.where("predicted = 0").collect()}
            labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
            assert sum(labels.get(d) == 0 for d in left - got) <= 2
        elif name == "exact_dedup":
            first = {}
            for d in sorted(left):
                first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", rows[d].text), d)
            want = set(first.values())
        elif name == "ngram_jaccard_join":
            found = brute.jaccard([(d, rows[d].text) for d in left], 5, 80)
            want = {d for d in left if found[d][1] == d}
        else:
            items = [tuple(r) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").select("item_id", "text").collect()]
            leaks = {d for d, _ in brute.leaks([(d, rows[d].text) for d in left], items)}
            want = left - leaks
        assert got == want, name
        left = got
    assert seen == ["toxicity", "exact_dedup", "ngram_jaccard_join", "benchmark_decontamination"]
    kept = docs.toArrow()
    con = duckdb.connect()
    con.register("documents", kept)
    want = con.sql(f"SELECT doc_id, domain, lang, source, n_tokens, copies FROM ({oracle.MIXING})").fetchall()
    got = [tuple(r) for r in corpus_pipeline.STAGES[-1][1](spark, docs, DATA).select("doc_id", "domain", "lang", "source", "n_tokens", "copies").collect()]
    assert sorted(got) == sorted(want)


@pytest.mark.parametrize("stage", corpus_pipeline.STAGES, ids=lambda s: s[0])
def test_stages_take_an_empty_table(spark, stage):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").limit(0)
    assert stage[1](spark, docs, DATA).count() == 0
