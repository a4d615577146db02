"""Plain models of the operators, for small tables."""

from __future__ import annotations

import re
from collections import Counter, defaultdict

import numpy as np

from chronolake.llm import decontaminate, tokens

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def components(nodes, links):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def shingle_set(text, k):
    w = WORD.findall(lowered(text))
    return frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset()


def jaccard(rows, k, percent):
    """{doc_id: (size, component)} by counting the shared shingles of every pair that shares one."""
    sets = {d: shingle_set(t, k) for d, t in rows if d is not None}
    by_shingle, shared = defaultdict(list), Counter()
    for d in sorted(sets):
        for s in sets[d]:
            shared.update((e, d) for e in by_shingle[s])
            by_shingle[s].append(d)
    links = [p for p, n in shared.items() if 100 * n >= percent * (len(sets[p[0]]) + len(sets[p[1]]) - n)]
    found = components(sets, links)
    return {d: (len(sets[d]), found[d]) for d in sets}


def leaks(docs, items):
    """{(doc_id, item_id): similarity} over every window of every text, without fingerprints."""
    index = decontaminate.ItemIndex([i for i, _ in items], [t for _, t in items])
    import pyarrow as pa

    out = {}
    for doc_id, text in docs:
        for _, _, words, _ in tokens.words(pa.array([text or ""]), tokens.BY_PUNCTUATION):
            for i, item in enumerate(index.ids):
                size = min(int(index.lengths[i]), len(words))
                k = min(decontaminate.K, int(index.lengths[i]))
                if size < k:
                    continue
                shingles = tokens.shingles(words, k)
                if not np.isin(shingles, index.sets[i][0]).any():
                    continue
                best = max(index.similarity(i, shingles[w : w + size - k + 1]) for w in range(len(words) - size + 1))
                if best >= decontaminate.SIMILARITY:
                    out[doc_id, item] = best
    return out


_PII = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def base_spans(text):
    from chronolake.llm.pii import luhn

    ok = {
        "email": lambda s: True,
        "ip": lambda s: all(len(p) <= 3 and int(p or 0) <= 255 for p in (p.lstrip("0") for p in s.split("."))),
        "card": lambda s: 13 <= len(re.sub("[^0-9]", "", s)) <= 19 and luhn(re.sub("[^0-9]", "", s)),
        "phone": lambda s: 9 <= len(re.sub("[^0-9]", "", s)) <= 15,
    }
    return [(kind, *m.span()) for kind, p in _PII.items() for m in re.finditer(p, text or "") if ok[kind](m[0])]
