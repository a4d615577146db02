"""N-gram Jaccard self-join with adaptive multi-match prefixes (after Wang, Li and Feng, 2012).

A document is the set of its distinct word shingles.  Under one global order of shingles, two sets of
sizes n and m with Jaccard similarity t or more share at least l of the first n - ceil(t n) + l and
m - ceil(t m) + l shingles.  Every document picks its own l: a longer prefix costs more postings, but a
candidate then needs more shared prefix shingles before it is verified.  A pair needs the smaller l of
its two documents, which is exact, as prefixes for a smaller l are contained in those for a larger one.

Order and costs come from a count sketch of fixed size over the shingles of all documents: frequent
shingles come last.  Any order gives the same result; the sketch only makes candidates few.

For the components a posting list isn't expanded into all its pairs: every document is first verified
against the head (least document) of each list, and pairs are formed only between documents that are still
in different components, block by block of the lists of one head.

All links lie within components.  They are counted afterwards over all pairs of a component, by blocks of
whole sets; each pair of blocks gives a count for each document, and no pair leaves it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from . import tokens
from .components import connected_components
from .groups import bit_words, flagged, joined
from .scratch import written

SKETCH_BITS = 18
#: Bits for each id of the filter through which the second reading of the texts passes, and all bits at most; a full filter only lets more through.
BITS_AN_ID, MOST_FILTER_BITS = 8, 27
MOST_MATCHES = 8
#: Cost of verifying a candidate, in postings.
VERIFY_COST = 20.0
#: Documents of a block of a posting list.
BLOCK = 256
#: Documents and shingles of a block of a component whose links are counted, about.
LINK_BLOCK, LINK_SHINGLES = 1024, 1 << 19


def _ids(batch: pa.RecordBatch) -> pa.Array:
    return batch.column(0)


def _signatures(k: int, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = np.zeros(1 << bits, np.int64)
        for batch in batches:
            for row, end, hashes, at in tokens.words(batch.column(1)):
                flat, sizes = tokens.shingle_sets(hashes, at, k)
                sketch += np.bincount((flat >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits)
                total = np.zeros((2, len(flat) + 1), np.uint64)
                np.cumsum(tokens.mix(flat ^ np.uint64(0x5851F42D4C957F2D)), out=total[0, 1:])
                np.cumsum(tokens.mix(flat ^ np.uint64(0x14057B7EF767814F)), out=total[1, 1:])
                one, two = (total[:, sizes[1:]] - total[:, sizes[:-1]]).view(np.int64)
                yield pa.record_batch([_ids(batch)[row:end], pa.array(np.diff(sizes)), pa.array(one), pa.array(two), pa.nulls(end - row, pa.int64()), pa.nulls(end - row, pa.int64())], names=["doc_id", "n", "s1", "s2", "bucket", "hits"])
        used = np.flatnonzero(sketch)
        for a in range(0, len(used), 1 << 16):
            part = used[a : a + (1 << 16)]
            none = pa.nulls(len(part), pa.int64())
            yield pa.record_batch([none, none, none, none, pa.array(part), pa.array(sketch[part])], names=["doc_id", "n", "s1", "s2", "bucket", "hits"])

    return run


def sketch_levels(buckets: np.ndarray, hits: np.ndarray, bits: int) -> np.ndarray:
    """Base-2 level of each sketch bucket's hits above those that chance gives; 0 for buckets of rare shingles."""
    counts = np.zeros(1 << bits, np.int64)
    counts[buckets] = hits
    usual = float(np.median(counts))
    excess = counts - usual
    rare = excess <= 5 * np.sqrt(usual) + 3
    return np.where(rare, 0, np.log2(np.maximum(excess, 2)).astype(np.int64)).astype(np.uint8)


def ordered_prefix(own: np.ndarray, levels: np.ndarray, percent: int) -> tuple[int, np.ndarray]:
    """The number of matches l that costs least by estimate, and the prefix for it, in the global order."""
    bits = len(levels).bit_length() - 1
    level = levels[own >> np.uint64(64 - bits)]
    order = np.argsort((level.astype(np.uint64) << np.uint64(56)) | (tokens.mix(own) >> np.uint64(8)), kind="stable")
    first = len(own) - -(-percent * len(own) // 100)  # for l matches, the prefix has first + l shingles
    most = min(MOST_MATCHES, len(own) - first)
    level = level[order[: first + most]].astype(np.float64)
    if not level.any():
        return 1, own[order[: first + 1]]
    postings = np.cumsum(np.exp2(level) * (level > 0))[first:]
    many = np.arange(1, most + 1)
    matches = int(np.argmin(postings + VERIFY_COST * postings / many)) + 1
    return matches, own[order[: first + matches]]


def _prefixes(k: int, percent: int, levels: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, end, hashes, at in tokens.words(batch.column(1)):
                flat, sizes = tokens.shingle_sets(hashes, at, k)
                found, matches = [], []
                for a, b in zip(sizes[:-1], sizes[1:], strict=True):
                    m, prefix = ordered_prefix(flat[a:b], levels, percent) if b > a else (1, flat[a:b])
                    found.append(prefix)
                    matches.append(m)
                offsets = np.zeros(len(found) + 1, np.int32)
                np.cumsum([len(x) for x in found], out=offsets[1:])
                prefix = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(found).view(np.int64)))
                yield pa.record_batch([_ids(batch)[row:end], pa.array(np.diff(sizes).astype(np.int32)), pa.array(matches, pa.int32()), prefix], names=["doc_id", "n", "l", "prefix"])

    return run


def _wanted(batch: pa.RecordBatch, bitmap: np.ndarray) -> pa.RecordBatch:
    """The rows whose id has its bit in bitmap, bytes of eight bits each, the lowest first."""
    ids = batch.column(0)
    at = np.mod(ids.fill_null(0).to_numpy(zero_copy_only=False), np.int64(8 * len(bitmap)))
    has = (bitmap[at >> 3] >> (at & 7).astype(np.uint8)) & 1
    return batch.filter(pa.array(ids.is_valid().to_numpy(zero_copy_only=False) & has.astype(bool)))


def _sets(k: int, bitmap: np.ndarray, encode):
    """The encoded shingle sets of the documents whose ids pass the filter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = _wanted(batch, bitmap)
            for row, end, hashes, at in tokens.words(batch.column(1)):
                flat, sizes = tokens.shingle_sets(hashes, at, k)
                own = pa.array([encode(flat[a:b]) for a, b in zip(sizes[:-1], sizes[1:], strict=True)], pa.binary())
                yield pa.record_batch([batch.column(0)[row:end], pa.array(np.diff(sizes)), own], names=["id", "n", "own"])

    return run


def as_hashes(own: np.ndarray) -> bytes:
    return own.tobytes()


def as_bits(own: np.ndarray) -> bytes:
    """A map of 4 to 8 bits a shingle, of 2**i bits, with the bit of each shingle set."""
    size = 1 << max(3, (4 * len(own)).bit_length())
    bits = np.zeros(size, np.uint8)
    bits[own >> np.uint64(65 - size.bit_length())] = 1
    return np.packbits(bits).tobytes()


def similar(n: int, a: bytes, m: int, b: bytes, percent: int) -> bool:
    """By the sorted hashes of both sets: exact."""
    both = np.concatenate((np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)))
    both.sort(kind="stable")
    shared = int(np.count_nonzero(both[1:] == both[:-1]))
    return 100 * shared >= percent * (n + m - shared)


def maybe_similar(n: int, a: bytes, m: int, b: bytes, percent: int) -> bool:
    """By the maps of both sets: False only if the sets can't be similar.  A bit that only one map has
    proves a shingle that only that set has; a larger map is first folded to the size of the smaller."""
    x, y = np.unpackbits(np.frombuffer(a, np.uint8)), np.unpackbits(np.frombuffer(b, np.uint8))
    if len(x) > len(y):
        x = x.reshape(len(y), -1).max(1)
    elif len(y) > len(x):
        y = y.reshape(len(x), -1).max(1)
    both = int(np.count_nonzero(x & y))
    most = min(n - int(np.count_nonzero(x)) + both, m - int(np.count_nonzero(y)) + both)
    return 100 * most >= percent * (n + m - most)


def _passing(test, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, m = batch.column(2).to_pylist(), batch.column(4).to_pylist()
            a, b = batch.column(3), batch.column(5)
            keep = [test(n[i], a[i].as_buffer(), m[i], b[i].as_buffer(), percent) for i in range(batch.num_rows)]
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return run


def bitmap_of(ids: DataFrame, column: str, about: int) -> np.ndarray:
    """Bytes with a bit for each of about so many ids modulo their number; the words of the map are combined by Spark and 2**MOST_FILTER_BITS bits reach the driver at most."""
    bits = min(MOST_FILTER_BITS, max(12, (BITS_AN_ID * about).bit_length()))
    at = F.pmod(F.col(column), F.lit(1 << bits))
    word = ids.select((F.shiftright(at, 6)).alias("word"), F.expr(f"shiftleft(1L, cast(pmod({column}, 64) as int))").alias("bit"))
    rows = word.groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    words = np.zeros(1 << (bits - 6), np.int64)
    words[rows["word"].to_numpy()] = rows["bits"].to_numpy()
    return words.view(np.uint8)


def _tested(docs: DataFrame, found: DataFrame, name: str, k: int, percent: int, encode, test) -> DataFrame:
    """The pairs found(u, v) that pass the test; stored first, and their ids counted while they are written."""
    seen = Observation()
    pairs = written(found.observe(seen, F.approx_count_distinct("u").alias("u"), F.approx_count_distinct("v").alias("v")), name)
    ids = pairs.select(F.explode(F.array("u", "v")).alias("id"))
    sets = docs.mapInArrow(_sets(k, bitmap_of(ids, "id", seen.get["u"] + seen.get["v"]), encode), "id long, n long, own binary")
    sided = pairs.join(sets.selectExpr("id as u", "n as n", "own as a"), "u").join(sets.selectExpr("id as v", "n as m", "own as b"), "v")
    return sided.select("u", "v", "n", "a", "m", "b").mapInArrow(_passing(test, percent), "u long, v long").distinct()


def _verified(docs: DataFrame, found: DataFrame, name: str, k: int, percent: int) -> DataFrame:
    """The pairs found(u, v), stored by that name, whose sets are similar enough: first by small maps that rule out most others, then by the exact sets of the whole texts."""
    left = _tested(docs, found, name, k, percent, as_bits, maybe_similar)
    return written(_tested(docs, left, "left", k, percent, as_hashes, similar), "verified")


def _needed(percent: int) -> str:
    """SQL of the least intersection of sets of n and pn shingles that are similar enough."""
    return f"ceil({percent} * (n + pn) / {100 + percent})"


def _able(percent: int) -> str:
    """SQL: sizes and positions of a shared prefix shingle leave room for enough shared shingles (length and positional filters)."""
    return f"100 * least(n, pn) >= {percent} * greatest(n, pn) and least(n - pos, pn - ppos) + least(l, pl) - 1 >= {_needed(percent)}"


def _across(rest: DataFrame, labels: DataFrame, percent: int) -> DataFrame:
    """Pairs (u, v) of different components with enough shared prefix shingles, from the postings rest(token, doc_id, n, l, pos, pid).

    The postings of one head (pid) are dealt into blocks of about BLOCK documents, so that a task holds two
    blocks at a time; only pairs that pass the length and positional filters come out, each with its count,
    and only if that and the shingles that either has under other heads can reach the number needed.
    """
    own = rest.groupBy("pid", "doc_id").agg(F.first("n").alias("n"), F.first("l").alias("l"), F.collect_list(F.struct("token", "pos")).alias("t"))
    own = own.join(rest.groupBy("doc_id").agg(F.count("*").alias("total")), "doc_id").withColumn("elsewhere", (F.col("total") - F.size("t")).cast("long"))
    own = own.join(labels.select(F.col("node").alias("doc_id"), "component"), "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))
    own = written(own, "heads")
    sizes = written(own.groupBy("pid").agg(F.count("*").alias("c")).withColumn("blocks", F.ceil(F.col("c") / BLOCK).cast("int")), "sizes")
    dealt = joined(own, sizes, ["pid"], "c").withColumn("block", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
    dealt = dealt.selectExpr("pid", "least(block, other) as i", "greatest(block, other) as j", "block", "doc_id", "n", "l", "component", "elsewhere", "t.token as tokens", "t.pos as places")
    found = dealt.repartition("pid", "i", "j").groupBy("pid", "i", "j").applyInArrow(_block_pairs(percent), "u long, v long, c long, l long")
    return found.groupBy("u", "v").agg(F.sum("c").alias("c"), F.min("l").alias("l")).where("c >= l").select("u", "v")


#: Pairs of documents times tokens, or pairs of postings, that are compared at once.
CELLS = 1 << 22


def _block_pairs(percent: int):
    def run(table: pa.Table) -> pa.Table:
        ids, n, l, block, component, elsewhere = (table[c].to_numpy() for c in ("doc_id", "n", "l", "block", "component", "elsewhere"))
        lists = table["tokens"].combine_chunks()
        of_row = np.repeat(np.arange(len(ids)), np.diff(lists.offsets.to_numpy()))
        room = n[of_row] - table["places"].combine_chunks().flatten().to_numpy()  # shingles from a token's place to the end
        i, j = table["i"][0].as_py(), table["j"][0].as_py()
        a = np.flatnonzero(block == i)
        b = a if i == j else np.flatnonzero(block == j)
        fits = (component[a][:, None] != component[b][None, :]) & (100 * np.minimum(n[a][:, None], n[b][None, :]) >= percent * np.maximum(n[a][:, None], n[b][None, :]))
        if i == j:
            fits &= ids[a][:, None] > ids[b][None, :]
        p, q = np.nonzero(fits)
        x, y = a[p], b[q]
        least = np.minimum(l[x], l[y])
        need = np.maximum(np.ceil(percent * (n[x] + n[y]) / (100 + percent)) - least + 1, 1)
        c = _places_shared(lists.flatten().to_numpy(), of_row, room, x, y, need)
        good = (c > 0) & (c + np.minimum(elsewhere[x], elsewhere[y]) >= least)
        one, two = ids[x[good]], ids[y[good]]
        return pa.table([np.maximum(one, two), np.minimum(one, two), c[good], least[good].astype(np.int64)], names=["u", "v", "c", "l"])

    return run


def _places_shared(token: np.ndarray, row: np.ndarray, room: np.ndarray, x: np.ndarray, y: np.ndarray, need: np.ndarray) -> np.ndarray:
    """For each pair of rows x, y: the tokens both have with room for need shingles after it in both.

    Tokens are taken some at a time, so a block with very many of them needs no table of all."""
    _, column = np.unique(token, return_inverse=True)
    order = np.argsort(column, kind="stable")
    column, row, room = column[order], row[order], room[order]
    width = int(column[-1]) + 1 if len(column) else 0
    rows = int(max(x.max(), y.max())) + 1 if len(x) else 0
    out = np.zeros(len(x), np.int64)
    at_once = max(1, min(width, 256))
    step = max(1, CELLS // at_once)
    for first in range(0, width if len(x) else 0, at_once):
        lo, hi = np.searchsorted(column, (first, first + at_once))
        mine = row[lo:hi] < rows
        table = np.zeros((rows, at_once), np.int32)
        table[row[lo:hi][mine], column[lo:hi][mine] - first] = room[lo:hi][mine]
        some = table.any(1)
        pairs = np.flatnonzero(some[x] & some[y])
        for at in range(0, len(pairs), step):
            own = pairs[at : at + step]
            out[own] += (np.minimum(table[x[own]], table[y[own]]) >= need[own][:, None]).sum(1)
    return out


def shared_counts(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """The sizes of the intersections of each set of a with each of b; rare shingles by their pairs, others by products of tables."""
    token, column = np.unique(np.concatenate((*a, *b)), return_inverse=True)
    row = [np.repeat(np.arange(len(x)), [len(s) for s in x]) for x in (a, b)]
    column = np.split(column, [len(row[0])])
    order = [np.argsort(c, kind="stable") for c in column]
    row, column = [r[o] for r, o in zip(row, order, strict=True)], [c[o] for c, o in zip(column, order, strict=True)]
    many = [np.bincount(c, minlength=len(token)) for c in column]
    pairs = many[0] * many[1]
    out = np.zeros(len(a) * len(b), np.int64)
    rare = np.flatnonzero(pairs[column[0]] * (pairs[column[0]] <= 64))
    first = np.concatenate(([0], np.cumsum(many[1])))
    for at in range(0, len(rare), 1 << 15):
        own = rare[at : at + (1 << 15)]
        sizes = many[1][column[0][own]]
        other = np.repeat(first[column[0][own]] - np.concatenate(([0], np.cumsum(sizes)[:-1])), sizes) + np.arange(sizes.sum())
        out += np.bincount(np.repeat(row[0][own], sizes) * len(b) + row[1][other], minlength=len(out))
    out = out.reshape(len(a), len(b))
    dense = np.flatnonzero(pairs > 64)
    for at in range(0, len(dense), 2048):
        part = dense[at : at + 2048]
        tables = []
        for x, r, c in zip((a, b), row, column, strict=True):
            place = np.minimum(np.searchsorted(part, c), len(part) - 1)
            good = part[place] == c
            tables.append(np.zeros((len(x), len(part)), np.float32))
            tables[-1][r[good], place[good]] = 1
        out += (tables[0] @ tables[1].T).astype(np.int64)  # whole numbers below 2**24: exact
    return out


def _block_links(percent: int):
    def run(table: pa.Table) -> pa.Table:
        i, j = table["i"][0].as_py(), table["j"][0].as_py()
        ids, block = table["id"].to_numpy(), table["block"].to_numpy()
        own = table["own"].combine_chunks()
        _, once = np.unique(ids, return_index=True)  # a repeated id is one document
        sides = [once[block[once] == x] for x in ([i] if i == j else [i, j])]
        sets = [[np.frombuffer(own[int(r)].as_buffer(), np.uint64) for r in rows] for rows in sides]
        if not all(sets):
            return pa.table([pa.array([], pa.int64())] * 2, names=["rep", "links"])
        shared = shared_counts(sets[0], sets[-1])
        n, m = (np.array([len(x) for x in s], np.int64) for s in (sets[0], sets[-1]))
        linked = 100 * shared >= percent * (n[:, None] + m[None, :] - shared)
        if i == j:
            np.fill_diagonal(linked, False)
        counts = [linked.sum(1), linked.sum(0)][: len(sides)]
        return pa.table([ids[np.concatenate(sides)], np.concatenate(counts).astype(np.int64)], names=["rep", "links"])

    return run


def link_counts(docs: DataFrame, labels: DataFrame, reps: DataFrame, k: int, percent: int) -> DataFrame:
    """(rep, n_links): the links of each document of labels(node, component), over all pairs of its component; reps(rep, n) has sizes."""
    members = labels.join(reps.selectExpr("rep as node", "n"), "node").select(F.col("node").alias("id"), "component", "n")
    sizes = members.groupBy("component").agg(F.count("*").alias("c"), F.ceil(F.greatest(F.count("*") / LINK_BLOCK, F.sum("n") / LINK_SHINGLES)).cast("int").alias("blocks"))
    members = written(joined(written(members, "ids"), written(sizes, "sizes"), ["component"], "c").select("id", "component", "c", "blocks"), "members")
    pairs = members.where("c = 2").select(F.col("id").alias("rep"), F.lit(1).cast("long").alias("links"))  # a component of two has the one link
    members = members.where("c > 2").drop("c")
    about = members.agg(F.count("*")).first()[0]
    sets = docs.mapInArrow(_sets(k, bitmap_of(members, "id", about), as_hashes), "id long, n long, own binary").select("id", "own")
    dealt = sets.join(members, "id").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
    dealt = dealt.selectExpr("component", "least(block, other) as i", "greatest(block, other) as j", "block", "id", "own")
    found = dealt.repartition("component", "i", "j").groupBy("component", "i", "j").applyInArrow(_block_links(percent), "rep long, links long")
    return pairs.union(found).groupBy("rep").agg(F.sum("links").alias("n_links"))


def jaccard_components(docs: DataFrame, k: int = 5, percent: int = 80, id_column: str = "doc_id", text_column: str = "text", sketch_bits: int = SKETCH_BITS) -> DataFrame:
    """(doc_id, n_shingles, component_id, n_links): the components of documents that are linked by similarity.

    Words are runs of non-space characters with A-Z lowered; the set of a document is its distinct
    k-word shingles, or the whole sequence where it has fewer words.  Documents are linked if
    100 * intersection >= percent * union.  Documents without words (null or empty text) are linked
    with nothing.  Documents of equal sets form one class: they are linked with each other, and its
    least document stands for it.  n_links counts all links of the class representative to those of
    other classes.  Rows that repeat an id count as one document; a null id has no component and
    keeps a row of its own.  An empty table gives an empty table.  Other columns are not read.
    """
    return _components(docs, k, percent, id_column, text_column, sketch_bits, True)


def _components(docs: DataFrame, k: int, percent: int, id_column: str, text_column: str, sketch_bits: int, counted: bool) -> DataFrame:
    """The rows of jaccard_components; n_links is null if links aren't counted."""
    docs = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"))
    read = written(docs.mapInArrow(_signatures(k, sketch_bits), "doc_id long, n long, s1 long, s2 long, bucket long, hits long"), "shingles")
    sketch = read.where("bucket is not null").groupBy("bucket").agg(F.sum("hits").alias("hits")).toArrow()  # 2**sketch_bits rows at most
    levels = sketch_levels(sketch["bucket"].to_numpy(), sketch["hits"].to_numpy(), sketch_bits)
    known = read.where("bucket is null and doc_id is not null").select("doc_id", "n", "s1", "s2")

    classes = known.where("n > 0").groupBy("n", "s1", "s2").agg(F.min("doc_id").alias("rep"))
    prefixes = docs.mapInArrow(_prefixes(k, percent, levels), "doc_id long, n int, l int, prefix array<long>")
    own = prefixes.where("n > 0").join(classes.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi")
    postings = own.selectExpr("doc_id", "n", "l", "posexplode(prefix) as (pos, token)")
    lists = postings.groupBy("token").agg(F.count("*").alias("c")).where("c > 1").select("token")
    shared = postings.join(lists, "token", "left_semi")
    heads = shared.groupBy("token").agg(F.min(F.struct("doc_id", "n", "l", "pos")).alias("p"))
    headed = written(shared.join(heads.selectExpr("token", "p.doc_id as pid", "p.n as pn", "p.l as pl", "p.pos as ppos"), "token"), "postings")

    stars = headed.where(f"pid < doc_id and {_able(percent)}").select(F.col("doc_id").alias("u"), F.col("pid").alias("v")).distinct()
    links = _verified(docs, stars, "stars", k, percent)
    labels = connected_components(links)
    rest = headed.select("token", "doc_id", "n", "l", "pos", "pid").join(labels.select(F.col("node").alias("doc_id"), "component"), "doc_id", "left")
    rest = rest.withColumn("component", F.coalesce("component", "doc_id"))
    mixed = rest.groupBy("token").agg(F.min("component").alias("a"), F.max("component").alias("b")).where("a < b").select("token")
    rest = written(rest.join(mixed, "token", "left_semi").drop("component"), "rest")
    if not rest.isEmpty():
        more = _verified(docs, _across(rest, labels, percent), "cross", k, percent)
        if not more.isEmpty():  # the components so far stand for their links
            labels = connected_components(labels.select(F.col("node").alias("u"), F.col("component").alias("v")).union(more))
    reps = classes.select("rep", "n")
    classes = classes.join(labels.select(F.col("node").alias("rep"), "component"), "rep", "left")
    if counted:
        classes = classes.join(link_counts(docs, labels, reps, k, percent), "rep", "left").withColumn("n_links", F.coalesce("n_links", F.lit(0)))
    else:
        classes = classes.withColumn("n_links", F.lit(None).cast("long"))
    out = known.join(classes, ["n", "s1", "s2"], "left").groupBy("doc_id").agg(
        F.max("n").alias("n_shingles"), F.min(F.coalesce("component", "rep", "doc_id")).alias("component_id"), F.coalesce(F.max("n_links"), F.lit(0) if counted else F.lit(None)).cast("long").alias("n_links")
    )
    lost = read.where("bucket is null and doc_id is null").select("doc_id", F.col("n").alias("n_shingles"), F.lit(None).cast("long").alias("component_id"), F.lit(0).cast("long").alias("n_links"))
    return out.union(lost)


def keep_one_of_each(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """The documents that are the least of their component; all columns of docs stay, whatever their names.

    Rows with a null id stay; rows that repeat an id stay or go together.  Only rows whose id may be among
    those that go are shuffled."""
    found = _components(docs, k, percent, "doc_id", "text", SKETCH_BITS, False)
    dropped = written(found.where("component_id <> doc_id").select(F.col("doc_id").alias("gone")), "dropped")
    rows = docs.select(F.struct(*docs.columns).alias("whole"), F.col("doc_id").cast("long").alias("id"))
    rows = flagged(rows, F.coalesce("id", F.lit(0)), bit_words(dropped, F.col("gone")), "maybe")
    rest = rows.where("maybe").join(dropped, F.col("id") == F.col("gone"), "left_anti")
    return rows.where("not maybe").select("whole.*").union(rest.select("whole.*"))
