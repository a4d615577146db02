"""Cases in which operators once did less than the whole job."""

from __future__ import annotations

import textwrap

import numpy as np
import pyarrow as pa

from chronolake.llm import decontaminate, jaccard_join, licenses, pii, tokens, url_filter

from . import brute
from .test_operators import DATA, WORDS, odd_documents, pairs, prose

MIT = [s for n, s in licenses.SENTENCES if n in ("mit-grant", "mit-notice", "as-is")]
BSD = [s for n, s in licenses.SENTENCES if n in ("bsd-grant", "bsd-source", "bsd-binary")]
GPL = [s for n, s in licenses.SENTENCES if n in ("gpl-grant", "gpl-copy")]
APACHE = '''Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software'''


def test_wrapped_and_commented_licenses(spark):
    mit = "\n\n".join(textwrap.fill(s if s.endswith(":") else s + ".", 70) for s in MIT)
    bsd = textwrap.fill(BSD[0], 60) + "\n\n" + "\n".join(textwrap.fill(f"{i}. {s}.", 60, subsequent_indent="   ") for i, s in enumerate(BSD[1:], 1))
    gpl = "\n\n".join(textwrap.fill(s + ".", 64) for s in GPL) + "  If not, see <https://www.gnu.org/licenses/>."
    texts = {"MIT": mit, "BSD-2-Clause": bsd, "GPL-3.0-or-later": gpl, "Apache-2.0": APACHE}
    want, rows = {}, []
    for name, text in texts.items():
        for prefix in ("", "# ", "// ", " * ", "; ", "! ", "-- ", "rem ", "dnl "):
            for end in ("\n", "\r\n"):
                want[len(rows)] = name
                rows.append((len(rows), f"Some code{end}{end}" + end.join(prefix + line for line in text.split("\n")) + f"{end}more"))
    got = {r.doc_id: r for r in licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {d: r.licenses for d, r in got.items()} == want
    assert {r.sentence_ids for d, r in got.items() if want[d] == "Apache-2.0"} == {"apache-ref,apache-copy"}
    assert {r.sentence_ids for d, r in got.items() if want[d] == "MIT"} == {"mit-grant,mit-notice,as-is"}


def test_every_known_sentence_is_found_wrapped_and_whole(spark):
    rows, want = [], []
    for name, sentence in licenses.SENTENCES:
        for text in (sentence, textwrap.fill(sentence + ".", 40), "\n".join("# " + line for line in textwrap.wrap(sentence, 50))):
            want.append((len(rows), name))
            rows.append((len(rows), f"First line.\n{text}\nLast line."))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(pairs(licenses.scan_licenses(docs), "doc_id", "sentence_ids")) == want


def test_rules_name_the_licenses_of_sequences(spark):
    sentence = {name: s for name, s in reversed(licenses.SENTENCES)}
    rows = [(i, ".\n".join(sentence[x] for x in sequence) + ".") for i, (_, sequence) in enumerate(licenses.RULES)]
    got = dict(pairs(licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")), "doc_id", "licenses"))
    assert got == {i: name for i, (name, _) in enumerate(licenses.RULES)}
    texts = [(1, "SPDX-License-Identifier: MPL-2.0\n"), (2, "/* This Source Code Form is subject to the terms of the Mozilla Public\n * License, v. 2.0. If a copy of the MPL was not distributed. */"), (3, "Licensed under CC BY-SA 4.0. Licensed under the MIT License.")]
    got = dict(pairs(licenses.scan_licenses(spark.createDataFrame(texts, "doc_id long, text string")), "doc_id", "licenses"))
    assert got == {1: "MPL-2.0", 2: "MPL-2.0", 3: "MIT,CC-BY-SA-4.0"}


def test_license_sentences_on_one_line_and_cut_ones(spark):
    rows = [(1, APACHE.replace("\n", " ")), (2, "Released under the. MIT License"), (3, "Not released under\nthe MIT License."), (4, "Released under\nthe MIT License too.")]
    got = {r.doc_id: r.sentence_ids for r in licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: "apache-ref", 2: "", 3: "", 4: ""}


def chain_spans(model, text):
    plain = np.flatnonzero(pii._plain_shapes())
    assert model.plain_is_settled(plain)
    raw = text.encode()
    both = [[(k, raw[a:b].decode()) for _, k, a, b in pii._found(model, settled, settled, pa.array([text]))] for settled in (True, False)]
    assert both[0] == both[1]  # only words near others, or all words of the line
    return both[0]


def test_a_span_is_found_at_every_place_of_a_line_and_of_a_text(monkeypatch):
    model = pii.train(pii.labelled_table())
    for before in (0, 1, *range(120, 136), 255, 256):
        text = "alpha " * before + "(988) 555-2485 " + "beta " * 140
        assert chain_spans(model, text) == [("phone", "(988) 555-2485")]
    monkeypatch.setattr(tokens, "PIECE_BYTES", 256)
    for before in range(230, 262):
        for end in (" ", "\n"):
            text = "a" * 20 + end + "b" * (before - 22) + " (988) 555-2485 gamma" + end + "delta " * 60
            assert chain_spans(model, text) == [("phone", "(988) 555-2485")]


def test_words_near_others_have_the_labels_of_the_whole_line():
    model, rng = pii.train(pii.labelled_table()), np.random.default_rng(4)
    forms = ["word", "of", "x.y", "a.b.c", "(988)", "555-2485", "+49", "030", "1234567", "4111", "1.2.3.4", "a@b.c", "a(at)b.c", "[1]", "12/10/2020", "-", "end."]
    lines = [" ".join(rng.choice(forms, 300, p=[0.3, 0.2, *[0.5 / 15] * 15])) for _ in range(40)]
    for text in ("\n".join(lines), " ".join(lines), "", "word", "(988)"):
        chain_spans(model, text)


def links_of(rows, k, percent):
    """{doc_id: links of its class to other classes}, over all pairs of different sets."""
    sets = {d: brute.shingle_set(t, k) for d, t in rows if d is not None}
    classes = [s for s in set(sets.values()) if s]
    holders = {}
    for i, s in enumerate(classes):
        for x in s:
            holders.setdefault(x, []).append(i)
    count = {frozenset(): 0}
    for s in classes:
        shared = np.bincount([j for x in s for j in holders[x]], minlength=len(classes))
        count[s] = sum(100 * n >= percent * (len(s) + len(o) - n) for n, o in zip(shared.tolist(), classes, strict=True)) - 1
    return {d: count[s] for d, s in sets.items()}


def got_links(docs, k, percent):
    return {r.doc_id: r.n_links for r in jaccard_join.jaccard_components(docs, k, percent).collect() if r.doc_id is not None}


def test_links_within_a_component_are_counted(spark, monkeypatch):
    rng = np.random.default_rng(4)
    base = rng.choice(WORDS, 120).tolist()
    rows = [(1, "a b c d e f g h i j k l m n o p q r s t u v w x"), (2, "a b c d e f g h i j k l m n o p q r s t u v w y"), (3, "a b c d e f g h i j k l m n o p q r s t u v w z"), (4, "only two"), (5, None)]
    for d in range(60):
        text = list(base)
        for at in rng.choice(120, rng.integers(0, 9), replace=False):
            text[at] = f"w{rng.integers(1000)}"
        rows.append((10 + d, " ".join(text)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    want = links_of(rows, 3, 90)
    assert [want[d] for d in (1, 2, 3, 4, 5)] == [2, 2, 2, 0, 0] and max(want.values()) > 5
    assert got_links(docs, 3, 90) == want
    monkeypatch.setattr(jaccard_join, "LINK_BLOCK", 4)
    assert got_links(docs, 3, 90) == want


def test_links_equal_brute_force(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    assert got_links(docs, 5, 80) == links_of(pairs(docs, "doc_id", "text"), 5, 80)
    assert got_links(odd_documents(spark), 3, 90) == links_of(pairs(odd_documents(spark), "doc_id", "text"), 3, 90)


def test_shared_counts():
    rng = np.random.default_rng(5)
    a, b = ([np.unique(rng.integers(0, top, rng.integers(1, 300)).astype(np.uint64)) for _ in range(n) for top in (50, 400, 90_000)] for n in (30, 20))
    assert jaccard_join.shared_counts(a, b).tolist() == [[len(np.intersect1d(x, y)) for y in b] for x in a]


def near_leaks():
    """Items that share phrases, and texts with passages of them of which some words are changed, to similarities around 0.8."""
    rng = np.random.default_rng(6)
    phrases = [prose(100 + i, 8) for i in range(4)]
    items = [(i, " ".join((phrases[i % 4], prose(i, int(rng.integers(30, 60))), phrases[(i + 1) % 4]))) for i in range(40)]
    docs = []
    for d in range(400):
        words = items[d % 40][1].split()
        for at in rng.choice(len(words), rng.integers(0, 3), replace=False):
            words[at] = f"x{d}"
        docs.append((d, " ".join((prose(1000 + d, 30), *words, prose(2000 + d, 30)))))
    return items, docs


def test_all_leaks_are_found_whatever_the_parts(spark, monkeypatch):
    items, docs = near_leaks()
    tables = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    want = brute.leaks(docs, items)
    assert sum(v < 0.85 for v in want.values()) > 20
    got = []
    for size in (3, 1024):
        monkeypatch.setattr(decontaminate, "PART_ITEMS", size)
        got.append(sorted(pairs(decontaminate.benchmark_leaks(*tables), "doc_id", "item_id", "similarity", "first_word", "n_words")))
    assert got[0] == got[1]
    assert {(d, i): s for d, i, s, *_ in got[1]} == want


def test_given_leaks_are_all_found(spark):
    docs, items = spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/benchmark.parquet")
    got = {(r.doc_id, r.item_id): r.similarity for r in decontaminate.benchmark_leaks(docs, items).collect()}
    assert got == brute.leaks(pairs(docs, "doc_id", "text"), pairs(items, "item_id", "text"))


def test_references_are_resolved(spark):
    link, refresh = '<link rel="%s" href="%s">', '<meta http-equiv="refresh" content="0; url=%s">'
    page = "http://a.io/x/y.html?q=1"
    forms = [
        (page, refresh % "moved.html", "a.io/x/moved.html"), (page, refresh % "../z", "a.io/z"), (page, refresh % "?id=3", "a.io/x/y.html?id=3"), (page, refresh % "./", "a.io/x/"),
        (page, refresh % "../../../z/./w/..", "a.io/z/"), (page, refresh % "/p;v=1;w", "a.io/p;v=1;w"), (page, refresh % "/go?u=http://b.io/", "a.io/go?u=http://b.io/"), (page, refresh % "//B.io/c", "b.io/c"),
        (page, link % ("alternate canonical", "c"), "a.io/x/c"), (page, link % ("canonical", "https://b.io/?a=1&amp;b"), "b.io/?a=1&b"), (page, "<link href=c rel=canonical>", "a.io/x/c"), (page, "<link rel='canonical nofollow' href='c'>", "a.io/x/c"),
        (page, '<base href="/b/c/">' + refresh % "d", "a.io/b/c/d"), (page, '<base href="http://h.io/b/">' + refresh % "../d", "h.io/d"), ("http://a.io", refresh % "x", "a.io/x"),
        (page, link % ("canonical-x", "c"), None), (page, link % ("canonical", "#top"), None), (page, refresh % "mailto:a@b.io", None), (page, "canonical", None),
    ]
    pages = spark.createDataFrame([(url.replace("a.io", f"a{i}.io"), html) for i, (url, html, _) in enumerate(forms)], "url string, html string")
    got = {source.split("/")[0].split("?")[0]: target for source, target in pairs(url_filter.alias_edges(pages), "source", "target")}
    assert got == {f"a{i}.io": want.replace("a.io", f"a{i}.io", 1) if want.startswith("a.io") else want for i, (_, _, want) in enumerate(forms) if want}
    rows = [(1, "http://a.io/x/old", refresh % "../new"), (2, "http://a.io/new", link % ("canonical", "http://b.net/"))]
    got = pairs(url_filter.url_verdicts(spark.createDataFrame(rows, "page_id long, url string, html string")), "page_id", "verdict")
    assert sorted(got) == [(1, "block"), (2, "block")]
