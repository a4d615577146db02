"""Sequence functions over lines and words: common subsequences, diffs, merges and blame, as Arrow-batched UDFs.

Each works on one pair or history of texts; Spark deals the pairs out.  A common start and end is cut off
before the table of a longest common subsequence is filled.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


#: Cells of a table that is filled at once; larger ones are halved first.
TABLE_CELLS = 1 << 22


def _lengths(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Length of a longest common subsequence of p and each start of q."""
    row = np.zeros(len(q) + 1, np.int32)
    for c in p:
        row[1:] = np.maximum.accumulate(np.maximum(row[1:], np.where(q == c, row[:-1] + 1, 0)))
    return row


def _common(p: np.ndarray, q: np.ndarray, at: int, to: int) -> list[tuple[int, int]]:
    if not len(p) or not len(q):
        return []
    if len(p) * len(q) > TABLE_CELLS and len(p) > 1:  # Hirschberg's halves: memory stays linear
        half = len(p) // 2
        cut = int(np.argmax(_lengths(p[:half], q) + _lengths(p[half:][::-1], q[::-1])[::-1]))
        return _common(p[:half], q[:cut], at, to) + _common(p[half:], q[cut:], at + half, to + cut)
    table = np.zeros((len(p) + 1, len(q) + 1), np.int32)
    for i in range(len(p) - 1, -1, -1):
        row = np.maximum(table[i + 1, :-1], np.where(q == p[i], table[i + 1, 1:] + 1, 0))
        table[i, :-1] = np.maximum.accumulate(row[::-1])[::-1]
    out, i, j = [], 0, 0
    while i < len(p) and j < len(q):
        if p[i] == q[j]:
            out.append((at + i, to + j))
            i, j = i + 1, j + 1
        elif table[i + 1, j] >= table[i, j + 1]:
            i += 1
        else:
            j += 1
    return out


def _only_match(x: list[str], y: list[str], at: int) -> list[tuple[int, int]] | None:
    """The index pairs if all of x that y has comes once in y and in its order, so that no other choice is as long; else None."""
    places: dict[str, int] = {}
    for j, s in enumerate(y):
        places[s] = -1 if s in places else j
    out, last = [], -1
    for i, s in enumerate(x):
        j = places.get(s)
        if j is None:
            continue
        if j <= last:
            return None
        out.append((at + i, at + j))
        last = j
    return out


def matches(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Index pairs of a longest common subsequence."""
    lo = 0
    while lo < min(len(a), len(b)) and a[lo] == b[lo]:
        lo += 1
    hi = 0
    while hi < min(len(a), len(b)) - lo and a[-1 - hi] == b[-1 - hi]:
        hi += 1
    x, y = a[lo : len(a) - hi], b[lo : len(b) - hi]
    middle = _only_match(x, y, lo)
    if middle is None:
        codes = {s: i for i, s in enumerate(dict.fromkeys(x + y))}
        middle = _common(np.array([codes[s] for s in x], np.int64), np.array([codes[s] for s in y], np.int64), lo, lo)
    return [(i, i) for i in range(lo)] + middle + [(len(a) - hi + i, len(b) - hi + i) for i in range(hi)]


def edits(a: list[str], b: list[str]) -> list[tuple[int, int, int, int]]:
    """Changed regions (a start, a end, b start, b end)."""
    out, i, j = [], 0, 0
    for x, y in [*matches(a, b), (len(a), len(b))]:
        if x > i or y > j:
            out.append((i, x, j, y))
        i, j = x + 1, y + 1
    return out


def unified(a: list[str], b: list[str], context: int = 3) -> list[str]:
    """Hunks with context; regions whose contexts touch share a hunk."""
    groups: list[list[tuple[int, int, int, int]]] = []
    for e in edits(a, b):
        if groups and e[0] - groups[-1][-1][1] <= 2 * context:
            groups[-1].append(e)
        else:
            groups.append([e])
    out = []
    for g in groups:
        start, stop = max(0, g[0][0] - context), min(len(a), g[-1][1] + context)
        left, right = g[0][0] - start, stop - g[-1][1]
        first, size = g[0][2] - left, (g[-1][3] + right) - (g[0][2] - left)
        out.append(f"@@ -{start + (stop > start)},{stop - start} +{first + (size > 0)},{size} @@")
        at = start
        for i, x, j, y in g:
            out += [f" {s}" for s in a[at:i]] + [f"-{s}" for s in a[i:x]] + [f"+{s}" for s in b[j:y]]
            at = x
        out += [f" {s}" for s in a[at:stop]]
    return out


def word_diff(a: str, b: str) -> str:
    """Words, spaces and symbols, with [-removed-] and {+added+} runs; lines are matched before the words of changed lines."""
    p, q = a.split("\n"), b.split("\n")
    out, at = [], 0
    for i, x, j, y in edits(p, q):
        out += p[at:i] + [_changed_words("\n".join(p[i:x]), "\n".join(q[j:y]))]
        at = x
    return "\n".join(out + p[at:])


def _changed_words(a: str, b: str) -> str:
    x, y = (re.findall(r"\s+|\w+|[^\w\s]", t) for t in (a, b))
    out, at = [], 0
    for i, p, j, q in edits(x, y):
        out += x[at:i]
        out += [f"[-{''.join(x[i:p])}-]"] * (p > i) + [f"{{+{''.join(y[j:q])}+}}"] * (q > j)
        at = p
    return "".join(out + x[at:])


def merge3(base: list[str], ours: list[str], theirs: list[str]) -> tuple[list[str], bool]:
    """Three-way merge of lines; changes that overlap or start together, and differ, are put between conflict markers.  Changes that only touch are both taken."""
    sides = [edits(base, ours), edits(base, theirs)]
    out, conflict, at, i, j = [], False, 0, 0, 0
    while i < len(sides[0]) or j < len(sides[1]):
        starts = [s[k][0] if k < len(s) else len(base) + 1 for s, k in zip(sides, (i, j), strict=True)]
        lo = min(starts)
        hi, a, b = lo, [], []
        grown = True
        while grown:  # takes in all changes of both sides that overlap or start together
            grown = False
            while i < len(sides[0]) and (sides[0][i][0] < hi or sides[0][i][0] == lo):
                hi, grown = max(hi, sides[0][i][1]), True
                a.append(sides[0][i])
                i += 1
            while j < len(sides[1]) and (sides[1][j][0] < hi or sides[1][j][0] == lo):
                hi, grown = max(hi, sides[1][j][1]), True
                b.append(sides[1][j])
                j += 1
        out += base[at:lo]

        def side(lines: list[str], own: list[tuple[int, int, int, int]], lo: int = lo, hi: int = hi) -> list[str]:
            return base[lo:hi] if not own else lines[own[0][2] - (own[0][0] - lo) : own[-1][3] + (hi - own[-1][1])]

        x, y = side(ours, a), side(theirs, b)
        if not b or x == y:
            out += x
        elif not a:
            out += y
        else:
            conflict = True
            out += ["<<<<<<< ours", *x, "=======", *y, ">>>>>>> theirs"]
        at = hi
    return out + base[at:], conflict


def blamed(versions: list[tuple[object, list[str]]]) -> list[object]:
    """The version that brought each line of the last text, from texts in order."""
    owner: list[object] = []
    before: list[str] = []
    for name, lines in versions:
        kept = {j: owner[i] for i, j in matches(before, lines)}
        owner = [kept.get(j, name) for j in range(len(lines))]
        before = lines
    return owner


def _split(text: str | None) -> list[str]:
    return (text or "").split("\n")


@F.pandas_udf(T.StringType())
def unified_diff(a: pd.Series, b: pd.Series) -> pd.Series:
    """Without a text there are no lines, rather than one that is empty."""
    own = lambda t: _split(t) if t else []
    return pd.Series(["\n".join(unified(own(x), own(y))) for x, y in zip(a, b, strict=True)])


@F.pandas_udf(T.StringType())
def words_diff(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([word_diff(x or "", y or "") for x, y in zip(a, b, strict=True)])


@F.pandas_udf(T.StructType([T.StructField("merged", T.StringType()), T.StructField("conflict", T.BooleanType())]))
def merged(base: pd.Series, ours: pd.Series, theirs: pd.Series) -> pd.DataFrame:
    rows = [merge3(_split(b), _split(o), _split(t)) for b, o, t in zip(base, ours, theirs, strict=True)]
    return pd.DataFrame([("\n".join(lines), conflict) for lines, conflict in rows], columns=["merged", "conflict"])


@F.pandas_udf(T.IntegerType())
def line_similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """Percentage of common lines of the longer text."""
    pairs = [(_split(x), _split(y)) for x, y in zip(a, b, strict=True)]
    return pd.Series([int(100 * len(matches(x, y)) / max(len(x), len(y)) + 0.5) for x, y in pairs])


def _blame_rows(rows: DataFrame, key: str, version: str, content: str, owners: Callable[[list[tuple]], tuple[list[str], list]]) -> DataFrame:
    """(key, line_no, line, version): owners gives the lines of a key's last version, and the version that brought each, for the rows of a key after the key.

    The versions of a key are walked in order in one task, which streams over sorted rows and holds one batch and one key."""
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, names, out, types = None, [], [key, "line_no", "line", "version"], ([], [], [], []), None

        def finish() -> None:
            last, own = owners(held)
            for column, values in zip(out, ([now] * len(last), range(1, len(last) + 1), last, own), strict=True):
                column.extend(values)
            held.clear()

        def taken() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, types, strict=True)], names)
            for column in out:
                column.clear()
            return made

        for batch in batches:
            kind = lambda c: batch.schema.field(c).type  # noqa: B023, E731
            types = [kind(key), pa.int32(), kind(content), kind(version)]
            for name, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and name != now:
                    finish()
                now = name
                held.append(row)
            yield taken()
        if held:
            finish()
            yield taken()

    return rows.repartition(key).sortWithinPartitions(key, version).mapInArrow(run, f"{key} {kinds[key]}, line_no int, line string, version {kinds[version]}")


def blame(history: DataFrame, key: str, order: str, content: str) -> DataFrame:
    """(key, line_no, line, version): the version (a value of order) that brought each line of a key's last text."""

    def owners(rows: list[tuple]) -> tuple[list[str], list]:
        versions = [(v, _split(t)) for v, t in rows]
        return versions[-1][1], blamed(versions)

    return _blame_rows(history.select(key, order, content), key, order, content, owners)


def blamed_graph(versions: list[tuple[object, list[object], list[str]]], ignore: set = frozenset(), strip: bool = False) -> dict[object, list[object]]:
    """{version: the version that brought each of its lines} for (version, its parents in order, lines), parents first.

    A line that several parents have is that of the first.  Lines of an ignored version are blamed on the
    line of its first parent at the same place, if there is one; strip leaves white space out of account."""
    plain = (lambda t: ["".join(x.split()) for x in t]) if strip else list
    texts, owners = {}, {}
    for name, parents, lines in versions:
        own: list[object] = [None] * len(lines)
        known = [p for p in parents if p in texts]
        for p in known:
            for i, j in matches(plain(texts[p]), plain(lines)):
                own[j] = owners[p][i] if own[j] is None else own[j]
        if name in ignore and known:
            first = owners[known[0]]
            own = [first[j] if x is None and j < len(first) else x for j, x in enumerate(own)]
        texts[name], owners[name] = lines, [name if x is None else x for x in own]
    return owners


def blame_graph(history: DataFrame, key: str, version: str, parents: str, content: str, ignore: list = (), strip: bool = False) -> DataFrame:
    """(key, line_no, line, version) of the last version (by number) of each key; history has the numbers of each version's parents, which are smaller."""

    def owners(rows: list[tuple]) -> tuple[list[str], list]:
        versions = [(v, p, _split(t)) for v, p, t in rows]
        return versions[-1][2], blamed_graph(versions, set(ignore), strip)[versions[-1][0]]

    return _blame_rows(history.select(key, version, parents, content), key, version, content, owners)


def blame_range(blame: DataFrame, first: int, last: int) -> DataFrame:
    """Lines first to last of a blame; raises unless 1 <= first <= last."""
    if not 1 <= first <= last:
        raise ValueError(f"no such lines: {first},{last}")
    return blame.where(F.col("line_no").between(first, last))


def blame_text(blame: DataFrame, key: str, commits: DataFrame, porcelain: bool = False) -> DataFrame:
    """(key, line_no, text) of blame lines with commits(version, sha, author_name, author_email, author_date, summary): `sha (author date line) text`, or the porcelain form."""
    rows = blame.join(commits, "version")
    seconds = F.unix_timestamp(F.col("author_date").cast("timestamp")).cast("string")
    number = F.col("line_no").cast("string")
    short = F.concat(F.left("sha", F.lit(8)), F.lit(" ("), "author_name", F.lit(" "), F.date_format("author_date", "yyyy-MM-dd"), F.lit(" "), number, F.lit(") "), "line")
    head = F.concat("sha", F.lit(" "), number, F.lit(" "), number, F.lit(" 1\nauthor "), "author_name", F.lit("\nauthor-mail <"), "author_email", F.lit(">\nauthor-time "), seconds, F.lit("\nsummary "), "summary", F.lit("\n\t"), "line")
    return rows.select(key, "line_no", (head if porcelain else short).alias("text"))


def parse_porcelain(text) -> object:
    """sha, line_no, author, email, seconds, summary and line of one entry of the porcelain form."""
    part = lambda form, i=1: F.regexp_extract(text, form, i)
    return F.struct(
        part("^([0-9a-f]{40}) ").alias("sha"), part(r"^[0-9a-f]{40} \d+ (\d+)").cast("int").alias("line_no"), part("(?m)^author (.*)$").alias("author"), part("(?m)^author-mail <(.*)>$").alias("email"),
        part(r"(?m)^author-time (\d+)$").cast("long").alias("seconds"), part("(?m)^summary (.*)$").alias("summary"), part(r"\n\t([\s\S]*)$").alias("line"),
    )


HUNKS = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("count", T.IntegerType()), T.StructField("lines", T.ArrayType(T.StringType()))]))


@F.pandas_udf(HUNKS)
def hunks(a: pd.Series, b: pd.Series) -> pd.Series:
    """Changed regions of the first text: where each starts (from 0), its lines, and the lines in their place."""
    found = []
    for x, y in zip(a, b, strict=True):
        x, y = _split(x), _split(y)
        found.append([{"start": i, "count": j - i, "lines": y[p:q]} for i, j, p, q in edits(x, y)])
    return pd.Series(found)
