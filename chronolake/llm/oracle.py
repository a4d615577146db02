"""SQL for DuckDB that gives the rows of the queries that SQL can express."""

from __future__ import annotations

from .licenses import ANCHORS, RULES, SENTENCE_END, known_sentences
from .mixing import LEVELS, WORD, Mix
from .url_filter import CANONICAL, HREF, REFRESH, REFRESH_URL
from .url_filter import RULES as URL_RULES


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _case(column: str, weights: dict[str, int]) -> str:
    return "1" if not weights else f"CASE {column} {' '.join(f'WHEN {_quoted(k)} THEN {v}' for k, v in weights.items())} ELSE 1 END"


def mixing_sql(mix: Mix) -> str:
    steps = [
        f"""docs AS (SELECT doc_id, coalesce(lang, '') lang, coalesce(source, '') source, len(regexp_extract_all(coalesce(text, ''), '{WORD}')) n_tokens,
            CASE WHEN regexp_matches(coalesce(source, ''), '[5-7]$') THEN 'books' WHEN regexp_matches(coalesce(source, ''), '[89]$') THEN 'code' ELSE 'web' END AS domain FROM documents)""",
        f"leaves AS (SELECT domain, lang, source, sum(n_tokens)::HUGEINT tokens, sum(n_tokens)::HUGEINT * {mix.most_epochs} cap FROM docs GROUP BY ALL)",
    ]
    before = "total"
    usable = " AND ".join(f"({_case(level, mix.weights.get(level, {}))}) > 0" for level in LEVELS)
    for depth, level in enumerate(LEVELS):
        keys, parents = LEVELS[: depth + 1], LEVELS[:depth]
        own = f"SELECT {', '.join(keys)}, sum(cap) cap, {_case(level, mix.weights.get(level, {}))}::HUGEINT weight FROM leaves WHERE {usable} GROUP BY {', '.join(keys)}"
        given = f"(SELECT sum(tokens) * {mix.percent} // 100 FROM leaves)" if not depth else "p.budget"
        source = f"({own}) n" if not depth else f"({own}) n JOIN {before} p USING ({', '.join(parents)})"
        part = f"PARTITION BY {', '.join(parents)}" if parents else ""
        order = f"{part} ORDER BY cap::DOUBLE / weight::DOUBLE, {level}"
        steps += [
            f"a{depth} AS (SELECT {', '.join(keys)}, n.cap cap, weight, {given} given FROM {source} WHERE weight > 0 AND n.cap > 0)",
            f"""b{depth} AS (SELECT *, least(given, sum(cap) OVER ({part})) used, coalesce(sum(cap) OVER ({order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) below,
                sum(weight) OVER ({order} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) rest FROM a{depth})""",
            f"c{depth} AS (SELECT *, cap * rest <= weight * (used - below) filled FROM b{depth})",
            f"""s{depth} AS (SELECT *, used - sum(CASE WHEN filled THEN cap ELSE 0 END) OVER ({part}) AS remaining, CASE WHEN NOT filled THEN weight * (used - sum(CASE WHEN filled THEN cap ELSE 0 END) OVER ({part}))
                // nullif(sum(CASE WHEN filled THEN 0 ELSE weight END) OVER ({part}), 0) ELSE 0 END share FROM c{depth})""",
            f"""d{depth} AS (SELECT {', '.join(keys)}, CASE WHEN filled THEN cap ELSE share + CASE WHEN sum(CASE WHEN filled THEN 0 ELSE 1 END) OVER ({order} ROWS UNBOUNDED PRECEDING)
                <= remaining - sum(share) OVER ({part}) THEN 1 ELSE 0 END END budget FROM s{depth})""",
        ]
        before = f"d{depth}"
    keys = ", ".join(LEVELS)
    steps += [
        f"budgets AS (SELECT {keys}, (budget // tokens)::BIGINT epochs, (budget % tokens)::BIGINT part FROM leaves JOIN {before} USING ({keys}) WHERE budget > 0)",
        f"ranked AS (SELECT docs.*, epochs, part, md5('{mix.seed}:' || epochs || ':' || coalesce(doc_id::VARCHAR, '')) AS rank FROM docs JOIN budgets USING ({keys}))",
        f"summed AS (SELECT *, sum(n_tokens) OVER (PARTITION BY {keys} ORDER BY rank, n_tokens ROWS UNBOUNDED PRECEDING) upto FROM ranked)",
    ]
    return f"WITH {', '.join(steps)} SELECT doc_id, {keys}, n_tokens::BIGINT n_tokens, (epochs + CASE WHEN part > 0 AND upto <= part THEN 1 ELSE 0 END)::BIGINT copies FROM summed WHERE epochs + CASE WHEN part > 0 AND upto <= part THEN 1 ELSE 0 END > 0"


def license_sql() -> str:
    known = ", ".join(f"{_quoted(k)}: {_quoted(v)}" for k, v in known_sentences().items())
    end = _quoted(SENTENCE_END.replace("$", r"\z"))
    ids = f"list_filter(list_transform(regexp_split_to_array(coalesce(text, ''), {end}), lambda s: map_extract_value(MAP {{{known}}}, trim(regexp_replace(lower(s), '[^a-z0-9]+', ' ', 'g')))), lambda i: i IS NOT NULL)"
    steps = [f"s0 AS (SELECT doc_id, CASE WHEN regexp_matches(lower(coalesce(text, '')), '{ANCHORS}') THEN {ids} ELSE [] END ids FROM documents)"]
    steps.append("r0 AS (SELECT doc_id, len(ids) n, array_to_string(ids, ',') sids, '|' || replace(array_to_string(ids, ','), ',', '||') || '|' AS rest, '' AS names FROM s0)")
    for i, (name, sequence) in enumerate(RULES):
        found = "".join(f"|{s}|" for s in sequence)
        steps.append(f"r{i + 1} AS (SELECT doc_id, n, sids, replace(rest, '{found}', '/') rest, names || repeat(',{name}', (length(rest) - length(replace(rest, '{found}', ''))) // {len(found)}) AS names FROM r{i})")
    return f"WITH {', '.join(steps)} SELECT doc_id, n::BIGINT n_sentences, coalesce(sids, '') sentence_ids, substring(names, 2) licenses FROM r{len(RULES)}"


DEDUP = r"""
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY norm) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY norm) AS kept, sha256(norm) AS text_sha256 FROM t"""

WARC = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
     k AS (SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_bytes, payload_digest) END AS keeper FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id <> keeper THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id <> keeper THEN keeper END AS refers_to FROM k"""


def url_sql() -> str:
    after = r"regexp_extract({0}, '^(?:[^:]|:[^/]|:/[^/])*?://([^/?#]*)([^?#]*)', {1})"
    host = lambda u: f"translate({after.format(u, 1)}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    path = lambda u: after.format(u, 2)
    node = lambda u: f"CASE WHEN {host(u)} <> '' THEN {host(u)} || {path(u)} || regexp_extract({u}, '^[^?#]*(\\?[^#]*)?', 1) END"

    def fitting(h: str, p: str, value) -> str:
        rules = sorted(URL_RULES, key=lambda r: -len(r[1] + r[2]))
        return "CASE " + " ".join(f"WHEN ({h} = '{r[1]}' OR ends_with({h}, '.{r[1]}')) AND starts_with({p}, '{r[2]}') THEN '{value(r)}'" for r in rules) + " END"

    regex = lambda r: _quoted(r)
    tags = f"list_concat(list_transform(regexp_extract_all(html, {regex(CANONICAL)}), lambda t: regexp_extract(t, {regex(HREF)}, 1)), list_transform(regexp_extract_all(html, {regex(REFRESH)}), lambda t: regexp_extract(t, {regex(REFRESH_URL)}, 1)))"
    absolute = "CASE WHEN contains(dest, '://') THEN dest WHEN starts_with(dest, '//') THEN 'http:' || dest WHEN starts_with(dest, '/') THEN regexp_extract(url, '^(.*?://[^/?#]*)', 1) || dest END"
    as_url = "('http://' || b)"
    return f"""
WITH RECURSIVE p AS (SELECT page_id, coalesce(url, '') url, {host("coalesce(url, '')")} host, {path("coalesce(url, '')")} path, {node("coalesce(url, '')")} node FROM pages),
raw AS (SELECT url, replace(unnest({tags}), '&amp;', '&') dest FROM pages WHERE url IS NOT NULL AND html IS NOT NULL),
target AS (SELECT {node('url')} a, url, {absolute} dest FROM raw),
e AS (SELECT a, {node('dest')} b FROM target), edges AS (SELECT a, b FROM e WHERE a <> b UNION SELECT b, a FROM e WHERE a <> b),
reach AS (SELECT DISTINCT a, a AS b FROM edges UNION SELECT r.a, g.b FROM reach r JOIN edges g ON r.b = g.a),
bad AS (SELECT DISTINCT a FROM reach WHERE {fitting(host(as_url), path(as_url), lambda r: r[0])} = 'block')
SELECT page_id, host, path, {fitting('host', 'path', lambda r: r[1] + r[2])} AS rule,
       coalesce({fitting('host', 'path', lambda r: r[0])}, CASE WHEN node IN (SELECT a FROM bad) THEN 'block' END, 'allow') AS verdict FROM p"""


MIXING = mixing_sql(Mix())
SQL = {"op3_license_scan": license_sql(), "op6_exact_dedup": DEDUP, "op7_warc": WARC, "op8_url_filter": url_sql()}
