"""Every model against a plain one: densities, noisy-or and Viterbi; and odd tables for the other operators."""

from __future__ import annotations

import itertools
import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from chronolake.llm import decontaminate, exact_dedup, groups, jaccard_join, labelled, licenses, pii, quality, queries, tokens, toxicity, url_filter, warc

from . import brute
from .test_operators import DATA, odd_documents, pairs, prose

PUNCTUATION = re.escape(tokens.PUNCTUATION.decode())


def plain_statistics(text):
    """The statistics of a text, by characters and words."""
    share = lambda part, whole: math.log((part + 0.5) / (whole + 1))
    words = brute.WORD.findall(brute.lowered(text))
    chars = text or ""
    inside = sum(c not in " \t\n\x0b\x0c\r" for c in chars)
    letters = sum("a" <= c <= "z" or "A" <= c <= "Z" or ord(c) > 127 for c in chars)
    lines, triples = [], {tuple(words[i : i + 3]) for i in range(max(1, len(words) - 2))} if words else set()
    for line in chars.split("\n"):
        own = brute.WORD.findall(brute.lowered(line))
        lines += [tuple(sorted(own))] if own else []
    n = len(words)
    shared = (len(triples) / (max(1, n - 2))) if n else 0
    return [
        math.log1p(n), math.log((inside + 1) / (n + 1)), share(abs(inside - 5 * n), n), share(sum("A" <= c <= "Z" for c in chars), letters),
        share(sum(c in tokens.PUNCTUATION.decode() and c not in ".," for c in chars), inside), share(sum("0" <= c <= "9" for c in chars), inside), share(len(lines), n), share(sum(ord(c) > 127 for c in chars), inside),
        share(len(set(words)), n), math.log(1.02 - shared), share(len(lines) - len(set(lines)), len(lines)), share(max(Counter(words).values(), default=0), n),
    ]


def learnable(spark, label):
    """{doc_id: label} of the rows that may be learned from, by zlib."""
    import zlib

    rows = spark.read.parquet(f"{DATA}/labels.parquet").select("doc_id", label).collect()
    return {r.doc_id: r[label] for r in rows if zlib.crc32(str(r.doc_id).encode()) % 5 and r[label] in (0, 1)}


def test_quality_equals_plain_discriminant(spark):
    """Statistics by characters, covariances by numpy, densities with inverses and determinants."""
    texts = dict(pairs(spark.read.parquet(f"{DATA}/documents.parquet"), "doc_id", "text"))
    x = {d: np.array(plain_statistics(t)) for d, t in texts.items()}
    label = learnable(spark, "quality")
    sides = [np.array([x[d] for d, y in label.items() if y == c and d in x]) for c in (0, 1)]
    n = [len(s) for s in sides]
    scatter = [(s - s.mean(0)).T @ (s - s.mean(0)) for s in sides]
    pooled = sum(scatter) / (sum(n) - 2)
    size = len(quality.FEATURES)
    covs = []
    for c in (0, 1):
        a = quality.TO_POOLED
        weight = (1 - a) * n[c] / ((1 - a) * n[c] + a * sum(n))
        cov = weight * scatter[c] / (n[c] - 1) + (1 - weight) * pooled
        covs.append((1 - quality.TO_IDENTITY) * cov + quality.TO_IDENTITY * (np.trace(cov) / size + 1e-9) * np.eye(size))

    def density(c, v):
        d = v - sides[c].mean(0)
        return math.log(n[c] / sum(n)) - 0.5 * np.linalg.slogdet(covs[c])[1] - 0.5 * d @ np.linalg.inv(covs[c]) @ d

    got = {r.doc_id: r.score for r in queries.QUERIES["op4_quality_classifier"](spark, DATA).collect()}
    assert got.keys() == texts.keys()
    for d, score in got.items():
        assert score == pytest.approx(1 / (1 + math.exp(min(500, max(-500, density(0, x[d]) - density(1, x[d]))))), abs=1e-6)


def plain_bag(text):
    """The words and stems of each sentence that has words."""
    out = []
    for sentence in re.split(r"[.!?\n]", brute.lowered(text)):
        words = [w for w in re.split(rf"[\s{PUNCTUATION}]+", sentence) if w]
        if words:
            out.append([w.encode() for w in words])
    return out


def word_hash(word):
    return int(next(iter(tokens.words(pa.array([word.decode("utf-8")]))))[2][0])


def plain_score(model, text, known):
    harmless = 0.0
    for words in plain_bag(text):
        logit = model.bias + sum(known.get(w, 0) + known.get(("stem", w[: toxicity.STEM]), 0) for w in words)
        harmless -= np.logaddexp(0, logit)
    return -math.expm1(harmless)


def test_toxicity_equals_plain_noisy_or(spark):
    """The vocabulary by counting, every score by sentences, and weights that no small change betters."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    texts = dict(pairs(docs, "doc_id", "text"))
    label = learnable(spark, "toxic")
    model = toxicity.fit(docs.select("doc_id", "text"), labelled.to_learn(spark.read.parquet(f"{DATA}/labels.parquet"), "toxic"))
    rows = {(texts[d], y) for d, y in label.items() if d in texts and len(texts[d] or "") <= toxicity.LEARN_CHARS}
    counts = [Counter(), Counter()]
    for text, y in rows:
        bag = [w for words in plain_bag(text) for w in words]
        counts[y].update({*bag, *(("stem", w[: toxicity.STEM]) for w in bag)})
    n = [sum(y == c for _, y in rows) for c in (0, 1)]
    tells = {}
    for w, t in counts[1].items():
        share = (t + 0.5) / (n[1] + 1)
        ratio = share / ((counts[0][w] + 0.5) / (n[0] + 1))
        if t >= toxicity.LEAST_DOCUMENTS and ratio >= toxicity.LEAST_RATIO:
            tells[w] = share * math.log(ratio)
    least = sorted(tells.values(), reverse=True)[: toxicity.VOCABULARY][-1]
    place = {int(h): i for i, h in enumerate(model.lexicon.words)}
    code = lambda w: (word_hash(w[1]) ^ int(toxicity.AS_STEM)) if isinstance(w, tuple) else word_hash(w)
    known = {}
    for w in {w for c in counts for w in c}:
        try:
            if code(w) in place:
                known[w] = model.weights[place[code(w)]]
        except UnicodeError:  # a stem that ends within a character
            continue
    assert {w for w, x in tells.items() if x > least * (1 + 1e-9)} <= known.keys() | {w for w in tells if isinstance(w, tuple)}
    assert all(tells.get(w, 0) >= least * (1 - 1e-9) for w in known)
    got = {r.doc_id: r for r in toxicity.score_toxicity(docs, spark.read.parquet(f"{DATA}/labels.parquet"), model).collect()}
    ascii_ids = [d for d, t in texts.items() if (t or "").isascii()]
    assert len(ascii_ids) > 200
    for d in ascii_ids:
        assert got[d].score == pytest.approx(plain_score(model, texts[d], known), abs=1e-9)
        assert got[d].predicted == (got[d].score >= 0.5) and bool(got[d].offending) == bool(got[d].predicted)
        for span in filter(None, got[d].offending.split(",")):
            a, b = map(int, span.split(":"))
            assert plain_score(model, texts[d][a:b], known) > 0.01


def test_fit_reaches_the_most_likely_weights():
    """On a few documents: no small change of any weight betters the penalised likelihood, written plainly."""
    rng = np.random.default_rng(2)
    bags = [[[int(w) for w in rng.integers(0, 3, rng.integers(0, 3))] for _ in range(rng.integers(1, 4))] for _ in range(40)]
    label = np.array([int(any(0 in s or s.count(1) > 1 for s in bag)) for bag in bags])
    label[::9] ^= 1
    lexicon = toxicity.Lexicon.of(np.arange(3, dtype=np.uint64))
    hits = [(r, s, w) for r, bag in enumerate(bags) for s, words in enumerate(bag) for w in words]
    number, sentence = {}, []
    for r, s, _ in hits:
        sentence.append(number.setdefault((r, s), len(number) + 1))
    of_row, word = np.array([r for r, _, _ in hits]), np.array([w for _, _, w in hits])
    ridge = 0.5
    model = toxicity.fit_noisy_or(lexicon, label, np.array([len(b) for b in bags]), of_row, np.array(sentence), word, np.ones(len(bags)), steps=4000, ridge=ridge)

    def likelihood(weights, bias):
        total = -ridge / 2 * float(np.square(weights).sum())
        for bag, y in zip(bags, label, strict=True):
            p = 1 - np.prod([1 - 1 / (1 + math.exp(-(bias + sum(weights[w] for w in words)))) for words in bag])
            total += math.log(p if y else 1 - p)
        return total

    best = likelihood(model.weights, model.bias)
    for i in range(3):
        for step in (-0.1, 0.1):
            assert likelihood(model.weights + step * np.eye(3)[i], model.bias) <= best + 1e-3


def test_viterbi_finds_the_best_of_all_paths():
    model = pii.train(pii.labelled_table(60), steps=30)
    rng = np.random.default_rng(5)
    for _ in range(30):
        shape = rng.choice(np.unique(rng.integers(0, pii.SHAPES, 40)), 4)
        chain = np.array([0, 0, 0, 1])[: len(shape)]
        scores = model.emissions(shape, chain)
        total = lambda path: sum(scores[i, y] for i, y in enumerate(path)) + sum(model.moves[a, b] for i, (a, b) in enumerate(zip(path, path[1:], strict=False)) if chain[i] == chain[i + 1])  # noqa: E731, B023
        best = max(map(total, itertools.product(range(len(pii.LABELS)), repeat=len(shape))))
        assert total(model.decode(shape, chain).tolist()) == pytest.approx(best)


def odd_pages(spark):
    page = "<p>" + "x" * 1200 + "</p>"
    rows = [(1, "http://a.net/x", page), (2, "http://b.io/", page), (2, "http://b.io/", page), (3, None, None), (4, "", ""), (None, "http://c.io/", page), (5, "http://d.io/" + "y" * 100_000, "<b>" * 400_000), (6, "no scheme", "é" * 600), (7, "no scheme", "é" * 600)]
    return spark.createDataFrame([(*r, 1, "x", "y", 2) for r in rows], "page_id long, url string, html string, keeper long, rule string, again string, n int")


def test_archives_of_odd_pages(spark):
    pages = odd_pages(spark)
    got = sorted((tuple(r) for r in warc.archived(pages).select("page_id", "payload_bytes", "record_type", "refers_to").collect()), key=str)
    assert got == sorted([(1, 1207, "revisit", 2), (2, 1207, "response", None), (2, 1207, "response", None), (3, 0, "response", None), (4, 0, "response", None), (None, 1207, "response", None), (5, 1_200_000, "response", None), (6, 1200, "revisit", 7), (7, 1200, "response", None)], key=str)


def test_verdicts_of_odd_pages(spark):
    got = {(r.page_id, r.host, r.rule, r.verdict) for r in url_filter.url_verdicts(odd_pages(spark)).collect()}
    assert got == {(1, "a.net", "net/", "block"), (2, "b.io", None, "allow"), (3, "", None, "allow"), (4, "", None, "allow"), (None, "c.io", None, "allow"), (5, "d.io", None, "allow"), (6, "", None, "allow"), (7, "", None, "allow")}


def test_licenses_of_odd_documents(spark):
    docs = odd_documents(spark)
    more = spark.createDataFrame([(20, "word " * 300_000 + "\nReleased under the MIT License.", "en", "s", 0, "x", 1), (21, "Released under the MIT License", None, None, 0, "x", 1), (21, "Released under the MIT License", None, None, 0, "x", 1)], docs.schema)
    got = sorted(((r.doc_id, r.sentence_ids, r.licenses) for r in licenses.scan_licenses(docs.union(more)).collect()), key=str)
    assert len(got) == 17 and [g for g in got if g[1]] == [(20, "mit-ref", "MIT"), (21, "mit-ref", "MIT"), (21, "mit-ref", "MIT")]


def test_personal_data_of_odd_documents(spark):
    docs = odd_documents(spark)
    long = "word " * 300_000 + "a@b.com " + "0" * 6000 + ".1.1.1 and " + "9" * 6000 + ".1.1.1 " + "no-break" * 200_000
    more = spark.createDataFrame([(20, long, "en", "s", 0, "x", 1), (21, "a@b.com", None, None, 0, "x", 1), (21, "a@b.com", None, None, 0, "x", 1)], docs.schema)
    got = [r for r in pii.find_personal_data(docs.union(more)).collect() if r.spans]
    assert sorted((r.doc_id, r.n_email, r.n_ip) for r in got) == [(20, 1, 1), (21, 1, 0), (21, 1, 0)]


def test_joins_with_hot_groups_keep_every_row(spark, monkeypatch):
    monkeypatch.setattr(groups, "HOT_GROUPS", 2)
    rows = spark.createDataFrame([(i, None if i % 50 == 0 else "a" if i % 3 else f"k{i % 7}") for i in range(300)], "id long, key string").repartition(5)
    sizes = rows.where("key is not null").groupBy("key").agg(F.count("*").alias("n"))
    got = {r.id: r.n for r in groups.joined(rows, sizes, ["key"], "n").collect()}
    counts = Counter(r.key for r in rows.collect())
    assert got == {r.id: None if r.key is None else counts[r.key] for r in rows.collect()}


def test_full_filters_change_nothing(spark, monkeypatch):
    """Filters of 64 bits, which are full: more rows are looked at, and the results are the same."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    want = sorted(pairs(exact_dedup.exact_dedup(docs, digest=True), "doc_id", "keep_id", "group_size", "kept", "text_sha256"))
    monkeypatch.setattr(groups, "FILTER_BITS", 6)
    assert sorted(pairs(exact_dedup.exact_dedup(docs, digest=True), "doc_id", "keep_id", "group_size", "kept", "text_sha256")) == want
    assert {d for (d,) in pairs(exact_dedup.drop_copies(docs), "doc_id")} == {d for d, _, _, kept, _ in want if kept}


def test_shared_places():
    rng = np.random.default_rng(9)
    for n, words in ((12, 30), (40, 700)):
        own = [rng.choice(words, rng.integers(0, 30), replace=False) for _ in range(n)]
        room = [rng.integers(1, 50, len(x)) for x in own]
        x, y = (a.ravel() for a in np.mgrid[:n, :n])
        need = rng.integers(1, 30, len(x))
        want = [sum(min(room[i][own[i] == t][0], room[j][own[j] == t][0]) >= k for t in set(own[i]) & set(own[j])) for i, j, k in zip(x, y, need, strict=True)]
        got = jaccard_join._places_shared(np.concatenate(own), np.repeat(np.arange(n), [len(a) for a in own]), np.concatenate(room), x, y, need)
        assert got.tolist() == want


@pytest.mark.parametrize("stage", corpus_pipeline.STAGES, ids=lambda s: s[0])
def test_stages_take_odd_documents(spark, stage):
    """Nulls, empty and long texts, copies, repeated rows and clashing names: the columns and the clean rows stay."""
    docs = odd_documents(spark).withColumns({"whole": F.lit(1), "again": F.lit("x"), "size": F.lit(2), "text_sha256": F.lit("y"), "gone": F.lit(0)})
    got = stage[1](spark, docs, DATA)
    ids = sorted(r.doc_id or 0 for r in got.select("doc_id").collect())
    if stage[0] == "source_mixing":
        assert got.columns == ["doc_id", "domain", "lang", "source", "n_tokens", "copies"] and len(set(ids)) >= 3
        return
    assert got.columns == docs.columns
    want = {"exact_dedup": [0, 1, 3, 4, 6, 7, 8, 9, 10, 11, 12], "ngram_jaccard_join": [0, 1, 4, 5, 6, 7, 9, 11, 11, 12]}
    assert ids == want.get(stage[0], [0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 11, 12])


def test_leaks_dropped_by_parts(spark, monkeypatch):
    docs = odd_documents(spark)
    items = spark.createDataFrame([(i, prose(50 + i, 40)) for i in range(6)] + [(9, prose(2, 300)), (10, "two words")], "item_id long, text string")
    want = sorted(r.doc_id or 0 for r in decontaminate.drop_leaks(docs, items).collect())
    assert want == [0, 4, 5, 6, 7, 8, 9, 10, 11, 11]
    monkeypatch.setattr(decontaminate, "PART_ITEMS", 3)
    assert sorted(r.doc_id or 0 for r in decontaminate.drop_leaks(docs, items).collect()) == want
