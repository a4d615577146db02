"""Every operator against a plain model or SQL, and on nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

from __future__ import annotations

import hashlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from chronolake.llm import components, decontaminate, exact_dedup, jaccard_join, licenses, mixing, pii, quality, queries, scratch, tokens, toxicity, url_filter, warc

from . import brute

DATA = "/root/testdata/sf0.01"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def prose(seed, n):
    return " ".join(np.random.default_rng(seed).choice(WORDS, n))


def odd_documents(spark):
    """Nulls in every column, empty and blank and long texts, copies, a repeated row, and names that clash with the operators' own."""
    long = prose(1, 60_000)
    rows = [
        (1, prose(2, 300), "en", "src1"), (2, prose(2, 300), "en", "src1"), (3, prose(2, 300) + " more", None, "src7"), (4, None, "de", None), (5, "", None, None),
        (6, " \n\t ", "de", "src8"), (7, long, "en", "src9"), (8, long + " end", "en", "src9"), (None, prose(2, 300), "en", "src1"), (9, "one", "fr", "src2"), (10, "One", "fr", "src2"),
        (11, prose(3, 80), "en", "src1"), (11, prose(3, 80), "en", "src1"), (12, "two words", "fr", "src2"),
    ]
    return spark.createDataFrame([(*r, 0, "x", 1) for r in rows], "doc_id long, text string, lang string, source string, n int, token string, component int")


def pairs(df, *columns):
    return [tuple(r) for r in df.select(*columns).collect()]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("documents", "pages", "labels", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS FROM read_parquet('{DATA}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_queries_equal_sql(spark, duck, name):
    df = queries.QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    assert sorted(duck.sql(queries.ORACLE[name]).columns) == columns
    want = duck.sql(f"SELECT {', '.join(columns)} FROM ({queries.ORACLE[name]})").fetchall()
    assert sorted(map(repr, pairs(df, *columns))) == sorted(map(repr, want))


def test_words_and_shingles_of_long_texts_equal_those_of_short_ones(monkeypatch):
    texts = pa.array([prose(5, 400), None, "", "Ünïcode WORDS\x0band more", prose(6, 50)])
    whole = [(h[a:b].tolist()) for _, _, h, at in tokens.words(texts) for a, b in zip(at[:-1], at[1:], strict=True)]
    monkeypatch.setattr(tokens, "PIECE_BYTES", 64)
    cut = [(h[a:b].tolist()) for _, _, h, at in tokens.words(texts) for a, b in zip(at[:-1], at[1:], strict=True)]
    assert whole == cut
    assert [len(w) for w in whole] == [400, 0, 0, 4, 50]
    assert next(iter(tokens.words(pa.array(["ABC"]))))[2] == next(iter(tokens.words(pa.array(["abc"]))))[2]


def test_components(spark):
    links = [(5, 4), (4, 3), (3, 2), (10, 11), (2, 2), (None, 1), (5, 4)]
    got = dict(pairs(components.connected_components(spark.createDataFrame(links, "u long, v long")), "node", "component"))
    assert got == {2: 2, 3: 2, 4: 2, 5: 2, 10: 10, 11: 10}
    assert components.connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def stored_names(monkeypatch, *modules):
    """The names of the tables that the modules store from now on, in order."""
    names = []

    def put(df, name):
        names.append(name)
        return scratch.written(df, name)

    for module in modules:
        monkeypatch.setattr(module, "written", put)
    return names


def test_components_stop_when_edges_are_stars(spark, monkeypatch):
    """Each step is a plan of its own, and no round runs only to see that nothing changes."""
    links = lambda rows: spark.createDataFrame(rows, "u long, v long")
    found = lambda rows: dict(pairs(components.connected_components(links(rows)), "node", "component"))
    names = stored_names(monkeypatch, components)
    assert found([(1, 2), (3, 1), (8, 7), (7, 9)]) == {1: 1, 2: 1, 3: 1, 7: 7, 8: 7, 9: 7}
    assert names == ["links"]
    names.clear()
    assert found([(1, 3), (2, 3)]) == {1: 1, 2: 1, 3: 1}
    assert names == ["links", "large", "links"]
    chain = np.random.default_rng(3).permutation(200).tolist()
    assert found(list(zip(chain, chain[1:], strict=False))) == dict.fromkeys(range(200), 0)


def test_jaccard_finds_components_once_where_no_links_cross(spark, monkeypatch):
    names = stored_names(monkeypatch, components, jaccard_join)
    rows = [(0, prose(1, 60)), (1, prose(1, 60) + " x"), (2, prose(2, 60)), (3, prose(2, 60) + " y"), (4, prose(3, 60))]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), 3, 90).collect()}
    assert got == brute.jaccard(rows, 3, 90)
    assert {d: c for d, (_, c) in got.items()} == {0: 0, 1: 0, 2: 2, 3: 2, 4: 4}
    assert names.count("links") == 1


@pytest.mark.parametrize(("k", "percent"), [(3, 90), (5, 80)])
def test_jaccard_components_equal_brute_force(spark, k, percent):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.jaccard_components(docs, k, percent).collect()}
    assert got == brute.jaccard(pairs(docs, "doc_id", "text"), k, percent)


def test_jaccard_blocks_and_matches(spark, monkeypatch):
    """A group of near copies across many blocks, with every number of matches."""
    monkeypatch.setattr(jaccard_join, "BLOCK", 4)
    rng = np.random.default_rng(4)
    base = rng.choice(WORDS, 120).tolist()
    rows = []
    for d in range(60):
        text = list(base)
        for at in rng.choice(120, rng.integers(0, 9), replace=False):
            text[at] = f"w{rng.integers(1000)}"
        rows.append((d, " ".join(text)))
    rows += [(100 + d, prose(d, 60)) for d in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.jaccard_components(docs, 3, 90).collect()}
    assert got == brute.jaccard(rows, 3, 90)


def test_jaccard_odd_documents(spark):
    docs = odd_documents(spark)
    got = jaccard_join.jaccard_components(docs, 3, 90).collect()
    want = brute.jaccard(pairs(docs, "doc_id", "text"), 3, 90)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got if r.doc_id is not None} == want
    assert [r.component_id for r in got if r.doc_id is None] == [None]
    assert len(got) == 13
    kept = jaccard_join.keep_one_of_each(docs, 3, 90)
    assert kept.columns == docs.columns
    assert jaccard_join.jaccard_components(docs.limit(0), 3, 90).count() == 0


def test_a_map_never_rules_out_a_similar_pair():
    rng = np.random.default_rng(0)
    for n in (1, 5, 40, 300, 2000):
        a = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2))
        for share in (0.8, 0.9, 0.95, 1.0):
            b = np.sort(np.concatenate((a[: int(len(a) * share)], rng.integers(0, 1 << 63, int(n * (1 - share)), dtype=np.uint64))))
            if jaccard_join.similar(len(a), a.tobytes(), len(b), b.tobytes(), 80):
                assert jaccard_join.maybe_similar(len(a), jaccard_join.as_bits(a), len(b), jaccard_join.as_bits(b), 80)


def test_exact_dedup_odd_documents(spark):
    docs = odd_documents(spark)
    rows = exact_dedup.exact_dedup(docs).collect()
    assert len(rows) == 14
    got = {(r.doc_id, r.keep_id, r.group_size) for r in rows}
    assert {(1, 1, 3), (2, 1, 3), (None, 1, 3), (4, 4, 2), (5, 4, 2), (6, 6, 1), (9, 9, 1), (10, 10, 1), (11, 11, 2)} <= got
    assert sum(r.kept for r in rows) == 14 - 2 - 1 - 1
    kept = exact_dedup.drop_copies(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 3, 4, 6, 7, 8, 9, 10, 11, 12]
    assert exact_dedup.exact_dedup(docs.limit(0)).count() == 0


def test_mixing_shares_shortages_among_siblings_first(spark):
    rows = [("web", "en", "a1", 100), ("web", "en", "a2", 1000), ("web", "de", "a3", 50), ("books", "en", "b5", 10)]
    leaves = spark.createDataFrame(rows, "domain string, lang string, source string, tokens long")
    mix = mixing.Mix(weights={"domain": {"books": 1, "web": 1}}, percent=50, most_epochs=1)
    got = {r.source: r.budget for r in mixing.leaf_budgets(leaves, mix).collect()}
    # 580 tokens: books can use 10 of its 290, web gets 570; de can use 50 of 285, en gets 520; a1 can use 100 of 260
    assert got == {"b5": 10, "a3": 50, "a1": 100, "a2": 420}


def plain_budgets(leaves, mix):
    """{leaf: tokens}, node by node: the child with the least capacity by weight is filled first, and the others share what is left."""
    weight = lambda level, value: mix.weights.get(mixing.LEVELS[level], {}).get(value, 1)
    caps = {leaf: n * mix.most_epochs for leaf, n in leaves.items() if n and all(weight(i, v) for i, v in enumerate(leaf))}

    def shared(prefix, given):
        depth = len(prefix)
        if depth == len(mixing.LEVELS):
            return {prefix: given}
        children = {}
        for leaf, cap in caps.items():
            if leaf[:depth] == prefix:
                children[leaf[depth]] = children.get(leaf[depth], 0) + cap
        given, out = min(given, sum(children.values())), {}
        left = sorted(children, key=lambda c: (children[c] / weight(depth, c), c))
        while left and children[left[0]] * sum(weight(depth, c) for c in left) <= given * weight(depth, left[0]):
            out[left[0]] = children[left[0]]
            given -= children[left.pop(0)]
        open_weight = sum(weight(depth, c) for c in left)
        out |= {c: given * weight(depth, c) // open_weight for c in left}
        for c in left[: given - sum(out[c] for c in left)]:
            out[c] += 1
        return {leaf: n for c, own in out.items() for leaf, n in shared((*prefix, c), own).items()}

    return {leaf: n for leaf, n in shared((), sum(leaves.values()) * mix.percent // 100).items() if n}


def test_mixing_spends_what_it_can(spark):
    """Weights of 0 on every level; the whole budget is spent while any leaf that weighs more has tokens left."""
    rng = np.random.default_rng(3)
    for seed in range(4):
        names = [("web", "books", "code"), ("en", "de", "fr"), tuple(f"s{i}" for i in range(4))]
        leaves = {(d, g, s): int(rng.integers(0, 900)) for d in names[0] for g in names[1] for s in names[2] if rng.random() < 0.7}
        weights = {"domain": {"web": 5, "books": 3, "code": int(seed > 1)}, "lang": {"en": 4, "de": 0, "fr": 3}, "source": {"s0": 0, "s1": 7}}
        mix = mixing.Mix(weights=weights, percent=[30, 60, 90, 300][seed], most_epochs=3)
        table = spark.createDataFrame([(*leaf, n) for leaf, n in leaves.items()], "domain string, lang string, source string, tokens long").coalesce(1)
        got = {(r.domain, r.lang, r.source): r.budget for r in mixing.leaf_budgets(table, mix).collect()}
        assert got == plain_budgets(leaves, mix)
        usable = sum(3 * n for (d, g, s), n in leaves.items() if g != "de" and s != "s0" and (d != "code" or seed > 1))
        assert sum(got.values()) == min(usable, sum(leaves.values()) * mix.percent // 100)


def test_mixing_takes_the_prefix_of_each_leaf(spark):
    rng = np.random.default_rng(8)
    rows = [(i, " ".join(["w"] * int(rng.integers(0, 40))), ["en", "de"][i % 2], f"src{i % 3 + 5}") for i in range(600)]
    docs, mix = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(4), mixing.Mix(percent=110)
    got = {r.doc_id: r.copies for r in mixing.mixed(docs, mix).collect()}
    domain = lambda s: "books" if s[-1] in "567" else "code" if s[-1] in "89" else "web"
    leaves = {}
    for _, text, lang, source in rows:
        leaves[domain(source), lang, source] = leaves.get((domain(source), lang, source), 0) + len(text.split())
    want = {}
    for leaf, budget in plain_budgets(leaves, mix).items():
        whole, part = divmod(budget, leaves[leaf])
        own = sorted((hashlib.md5(f"{mix.seed}:{whole}:{d}".encode()).hexdigest(), len(t.split()), d) for d, t, lang, s in rows if (domain(s), lang, s) == leaf)
        used = 0
        for _, n, d in own:
            used += n
            want[d] = whole + (used <= part and part > 0)
    assert got == {d: n for d, n in want.items() if n}


def test_mixing_odd_documents(spark):
    docs = odd_documents(spark)
    got = mixing.mixed(docs, mixing.Mix(percent=250, most_epochs=3)).collect()
    assert all(r.copies >= 1 for r in got)
    assert sum(r.copies * r.n_tokens for r in got) <= 2.5 * sum(len(brute.WORD.findall(r.text or "")) for r in docs.collect())
    assert mixing.mixed(docs.limit(0)).count() == 0


def test_licenses(spark):
    mit = "\n".join(s for n, s in licenses.SENTENCES if n in ("mit-grant", "mit-notice", "as-is"))
    rows = [(1, "x. Released under the MIT License.\nLicensed under CC BY-NC 4.0. y"), (2, mit), (3, None), (4, ""), (5, "a licensed plumber"), (6, "Released under the MIT License\nreleased under THE mit license.")]
    got = {r.doc_id: (r.n_sentences, r.sentence_ids, r.licenses) for r in licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1] == (2, "mit-ref,cc-by-nc4-ref", "MIT,CC-BY-NC-4.0")
    assert got[2][0] == 3 and got[2][2] == "MIT"
    assert got[3] == got[4] == got[5] == (0, "", "")
    assert got[6] == (2, "mit-ref,mit-ref", "MIT,MIT")
    assert licenses.scan_licenses(odd_documents(spark).limit(0)).count() == 0


def auc(label, score):
    order = np.argsort(score, kind="stable")
    rank = np.empty(len(score))
    rank[order] = np.arange(1, len(score) + 1)
    ones = label == 1
    return (rank[ones].sum() - ones.sum() * (ones.sum() + 1) / 2) / (ones.sum() * (~ones).sum())


@pytest.mark.parametrize(("name", "label"), [("op4_quality_classifier", "quality"), ("op9_toxicity", "toxic")])
def test_classifiers_on_held_out_rows(spark, name, label):
    got = queries.QUERIES[name](spark, DATA).toPandas()
    assert len(got) == 1000 and got["score"].between(0, 1).all()
    rows = got.merge(spark.read.parquet(f"{DATA}/labels.parquet").toPandas(), on="doc_id")
    rows = rows[rows["held_out"]]
    assert auc(rows[label].to_numpy(), rows["score"].to_numpy()) > 0.95


@pytest.mark.parametrize(("score", "label"), [(quality.score_quality, "quality"), (toxicity.score_toxicity, "toxic")])
def test_classifiers_odd_documents(spark, score, label):
    docs = odd_documents(spark)
    labels = spark.createDataFrame([(1, 1), (3, 0), (4, None), (None, 1), (9, 7)], f"doc_id long, {label} int")
    for learned in (labels, labels.limit(0)):
        got = score(docs, learned).collect()
        assert len(got) == 14 and all(0 <= r.score <= 1 for r in got)
    assert score(docs.limit(0), labels).count() == 0


def test_toxic_sentences_are_located(spark):
    rows = [(d, "A fine day. " + ("You are an idiot! " if d % 2 else "You are a friend! ") + f"Word {d} ends.") for d in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(d, d % 2) for d in range(200)], "doc_id long, toxic int")
    got = toxicity.toxic_sentences(docs, labels).collect()
    assert {r.doc_id for r in got} == {d for d in range(200) if d % 2}
    assert {rows[r.doc_id][1][r.start : r.end] for r in got} == {" You are an idiot"}
    kept = toxicity.drop_toxic(docs, labels)
    assert {r.doc_id for r in kept.collect()} == {d for d in range(200) if not d % 2}


def test_simhash_index_meets_all_within_radius():
    rng = np.random.default_rng(1)
    index = decontaminate.ItemIndex(list(range(30)), [prose(s, 30) for s in range(30)])
    prints = index.prints.copy()
    flips = np.array([sum(1 << int(b) for b in rng.choice(64, decontaminate.RADIUS, replace=False)) for _ in prints], np.uint64)
    met = {(item, w) for item, windows in index.within(prints ^ flips, 30) for w in windows.tolist()}
    assert {(i, i) for i in range(30)} <= met


def test_leaks_against_brute_force(spark):
    docs, items = spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/benchmark.parquet")
    want = brute.leaks(pairs(docs, "doc_id", "text"), pairs(items, "item_id", "text"))
    got = {(r.doc_id, r.item_id): r.similarity for r in decontaminate.benchmark_leaks(docs, items).collect()}
    assert want and len(got.keys() & want.keys()) >= 0.95 * len(want)
    assert got.keys() <= want.keys()


def test_leaks_odd_tables(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "PART_ITEMS", 3)
    item = prose(2, 300)
    items = spark.createDataFrame([(1, item), (2, None), (3, ""), (4, "two words"), (5, item), (None, prose(8, 20)), (6, prose(9, 12))], "item_id long, text string")
    docs = odd_documents(spark)
    got = {(r.doc_id, r.item_id) for r in decontaminate.benchmark_leaks(docs, items).collect()}
    assert {(1, 1), (2, 5), (3, 1), (None, 1), (12, 4)} <= got
    assert not {d for d, _ in got} & {4, 5, 6, 7, 9, 11}
    assert decontaminate.benchmark_leaks(docs.limit(0), items).count() == 0
    assert decontaminate.benchmark_leaks(docs, items.limit(0)).count() == 0
    assert {r.doc_id for r in decontaminate.drop_leaks(docs, items).collect()} == {4, 5, 6, 7, 8, 9, 10, 11, None}


def test_warc_round_trip(spark):
    big, same = "x\r\n\r\n" * 3000, "é" * 700
    rows = [(1, "http://a/1", big), (2, "http://a/2", same), (3, "http://a/3", same), (9, None, same), (4, "http://a/\r\nX: y", "short"), (5, "u", "short"), (6, "u", None), (7, "u", ""), (None, "u", same)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    folder = warc.new_path(spark, "test-archives")
    chunks = warc.read_archives(warc.write_archives(warc.with_revisits(pages), folder), chunk_bytes=1000).cache()
    whole = {r.page_id: b"".join(bytes(c.data) for c in sorted(r.c, key=lambda c: c.chunk)) for r in chunks.groupBy("page_id", "archive", "offset").agg(F.collect_list(F.struct("chunk", "data")).alias("c")).collect() if r.page_id}
    assert whole[1] == big.encode() and whole[9] == same.encode() and whole[2] == b""
    assert chunks.where("page_id = 1").count() >= 15
    got = {r.page_id: r for r in warc.records(chunks).collect()}
    assert len(got) == 9
    assert (got[2].refers_to, got[3].refers_to, got[9].refers_to, got[4].refers_to) == (9, 9, None, None)
    assert got[2].payload_digest == hashlib.sha1(same.encode()).hexdigest() and got[2].payload_bytes == 1400
    assert got[6].payload_bytes == 0 and got[6].record_type == "response"
    assert warc.archived(pages.limit(0)).count() == 0


def test_url_verdicts(spark):
    link = '<link rel="canonical" href="%s">'
    rows = [
        (1, "http://a.net/x", ""), (2, "http://b.org/de/1", link % "http://a.net/x"), (3, "http://c.org/fr/1", link % "http://b.org/de/1"), (4, "http://EXAMPLE.net/en/1#f", ""),
        (5, None, None), (6, "no scheme", "x"), (7, "http://d.io/q?u=http://a.net/", '<meta http-equiv="refresh" content="0; url=/next">'), (8, "http://e.io", ""), (9, "http://mynet/", ""), (10, "x" * 200_000 + "://A.net/" + "y" * 200_000, ""), (11, "a://b://c.net/d", ""), (1, "http://a.net/x", ""),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.url_verdicts(pages).collect()}
    assert got[1] == ("a.net", "/x", "net/", "block")
    assert got[2] == ("b.org", "/de/1", None, "block")
    assert got[3] == ("c.org", "/fr/1", "org/fr/", "allow")
    assert got[4] == ("example.net", "/en/1", "example.net/en/", "allow")
    assert got[5] == got[6] == ("", "", None, "allow")
    assert got[7] == ("d.io", "/q", None, "allow") and got[8] == ("e.io", "", None, "allow") and got[9][3] == "allow"
    assert got[10][0] == "a.net" and got[10][3] == "block" and got[11][:2] == ("b:", "//c.net/d")
    more = spark.createDataFrame([("http://e.io", "http://d.io/next"), ("http://d.io/next", "https://a.net/x")], "source string, target string")
    got = {r.page_id: r.verdict for r in url_filter.url_verdicts(pages, edges=more).collect()}
    assert got[7] == got[8] == "block"
    assert url_filter.url_verdicts(pages.limit(0)).count() == 0


def test_base_spans_equal_plain_patterns(spark):
    texts = [r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").select("text").collect()]
    rng = np.random.default_rng(3)
    texts += ["".join(rng.choice(list("a1@.-+ ()0é2"), 200)) for _ in range(500)]
    texts += ["a@b.c@d.e", "x@a.b@c.d", "@a.b@c.d", "1.2.3.4.5.6.7.8", "4111 1111 1111 1111", "0" * 5000, "a" * 5000 + "@", "", *(".".join("0" * 5000 + "1" if i == j else "1" for j in range(4)) for i in range(4)), "9" * 5000 + ".1.1.1", "+" + "1" * 5000, "1 " * 5000]
    for text in texts:
        assert pii.base_spans(text) == brute.base_spans(text)


def test_chain_finds_what_patterns_miss(spark):
    rows = [(1, "Write to anna.lee(at)mail.example.com or call (988) 555-2485 today.\nBye"), (2, None), (3, ""), (4, "In 2024 we sold 1,250.00 of 3 items (12 pages)."), (5, "é +1 (988) 555-2485.")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in pii.find_personal_data(docs).collect()}
    found = [rows[0][1][int(a) : int(b)] for _, a, b in (s.split(":") for s in got[1].spans.split(","))]
    assert found == ["anna.lee(at)mail.example.com", "(988) 555-2485"] and got[1].n_phone == 0
    assert got[2].spans == got[3].spans == got[4].spans == ""
    assert got[2].base_sha256 == hashlib.sha256(b"").hexdigest()
    assert got[5].spans == "phone:2:19" and got[5].n_phone == 1
    assert pii.find_personal_data(docs.limit(0)).count() == 0


def test_chain_on_held_out_sentences_and_plain_lines():
    model = pii.train(pii.labelled_table())
    wrong = total = 0
    for sentence in pii.labelled_table(200, seed=99):
        data = np.frombuffer(" ".join(w for w, _ in sentence).encode(), np.uint8)
        starts, ends = pii.word_places(data, np.zeros(0, np.int64))
        label = model.decode(pii.shapes(data, starts, ends), np.zeros(len(starts), np.int64))
        wrong += sum(pii.LABELS[x] != y for x, (_, y) in zip(label, sentence, strict=True))
        total += len(sentence)
    assert wrong <= 0.01 * total
    assert model.plain_is_outside(np.flatnonzero(pii._plain_shapes()))
