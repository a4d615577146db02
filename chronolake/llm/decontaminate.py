"""Benchmark decontamination by SimHash over item-sized windows.

For every benchmark item, windows of as many words as the item has slide over each text word by word.  A
window's fingerprint is the 64-bit SimHash of its weighted shingles.  Items are indexed by BLOCKS blocks of
their fingerprints, each entered under every value within RADIUS // BLOCKS bits: by the pigeonhole
principle a look-up of a window's blocks meets every item within RADIUS.  Candidates are then verified by
the exact weighted Jaccard similarity of their shingles.

Fingerprints of windows near the threshold may lie farther than RADIUS from the item's.  Therefore windows
are candidates as well if the weights of the item's shingles that they hold could give the similarity; this
bound holds for every window that is similar enough, so none is lost.

A window that shares no shingle with any item has similarity 0 with all of them and isn't fingerprinted.

The benchmark is a stated query set: it is taken in parts of PART_ITEMS items, of which one is held at a
time.  If there are several, a filter of bounded size first finds the texts that share a shingle with any
item, so that all texts are read once, however many the parts.  Weights are of the whole benchmark.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokens
from .rowwise import only, without
from .scratch import removed, written, written_at

K = 5
SIMILARITY = 0.8
BLOCKS, RADIUS = 4, 15
PART_ITEMS = 1024
#: Bits for each shingle of the benchmark in the filter of texts, and all bits at most.
BITS_A_SHINGLE, MOST_FILTER_BITS = 16, 27
#: Windows that are fingerprinted at once; bounds memory for long texts.
WINDOWS = 1 << 13
#: Weight of a shingle that one item at most has; integer weights keep sums exact.
RARE = 16

_BITS = np.uint64(1) << np.arange(64, dtype=np.uint64)
_WIDTH = 64 // BLOCKS


def simhash(hashes: np.ndarray, weights: np.ndarray, length: int) -> np.ndarray:
    """The SimHash of every length consecutive shingles."""
    signed = np.where(hashes[:, None] & _BITS, weights[:, None], -weights[:, None]).astype(np.int32)
    total = np.zeros((len(hashes) + 1, 64), np.int32)
    np.cumsum(signed, axis=0, out=total[1:])
    return ((total[length:] - total[: len(total) - length]) > 0) @ _BITS


def _multiset(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.unique(hashes, return_counts=True)


class ItemIndex:
    """Shingles, weights and fingerprints of a part of the benchmark; spread has the shingles that several
    items of the whole benchmark have, in order, with the numbers of items, and the number of all items
    with words.  Without it the part is the whole."""

    def __init__(self, ids: list, texts: list[str | None], spread: tuple[np.ndarray, np.ndarray, int] | None = None):
        hashed = [h[a:b] for _, _, h, at in tokens.words(pa.array([t or "" for t in texts], pa.string()), tokens.BY_PUNCTUATION) for a, b in zip(at[:-1], at[1:], strict=True)]
        kept = [i for i, h in enumerate(hashed) if len(h)]
        self.ids = [ids[i] for i in kept]
        self.lengths = np.array([len(hashed[i]) for i in kept], np.int64)
        shingles = [tokens.shingles(hashed[i], K) for i in kept]
        self.sets = [_multiset(s) for s in shingles]
        every = [s[0] for s in self.sets]
        self.known, counts = np.unique(np.concatenate(every), return_counts=True) if every else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        self.common, counts, total = spread or (self.known[counts > 1], counts[counts > 1], len(kept))
        self.common_weight = np.maximum(1, np.round(RARE * (1 - np.log(counts) / np.log(total + 1)))).astype(np.int64)
        self.table = np.zeros(1 << 16, bool)
        self.table[self.known >> np.uint64(48)] = True
        which = np.concatenate([np.searchsorted(self.known, s) for s in every]) if every else np.zeros(0, np.int64)
        owner = np.repeat(np.arange(len(kept)), [len(s) for s in every])
        order = np.argsort(which, kind="stable")
        self.owners, self.owner_at = owner[order], np.searchsorted(which[order], np.arange(len(self.known) + 1))
        self.totals = np.array([int((self.weight(own) * n).sum()) for own, n in self.sets], np.int64)
        self.prints = np.array([simhash(s, self.weight(s), len(s))[0] for s in shingles], np.uint64)
        flips = [0, *(sum(1 << b for b in c) for r in range(1, RADIUS // BLOCKS + 1) for c in combinations(range(_WIDTH), r))]
        flips = np.array(flips, np.uint64)
        self.blocks = []
        for block in range(BLOCKS):
            keys = (self._block(self.prints, block)[:, None] ^ flips).ravel().astype(np.int64)
            items = np.repeat(np.arange(len(kept)), len(flips))
            order = np.argsort(keys, kind="stable")
            self.blocks.append((items[order], np.searchsorted(keys[order], np.arange((1 << _WIDTH) + 1))))
        #: k of short items, whose whole sequence is one shingle
        self.ks = sorted(set(np.minimum(self.lengths, K).tolist()))

    @staticmethod
    def _block(prints: np.ndarray, block: int) -> np.ndarray:
        return (prints >> np.uint64(block * _WIDTH)) & np.uint64((1 << _WIDTH) - 1)

    def weight(self, hashes: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.common, hashes), max(len(self.common) - 1, 0))
        return np.where(self.common[at] == hashes, self.common_weight[at], RARE) if len(self.common) else np.full(len(hashes), RARE)

    def hits(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions of shingles that an item has, and their place in known."""
        at = np.flatnonzero(self.table[hashes >> np.uint64(48)])
        which = np.minimum(np.searchsorted(self.known, hashes[at]), max(len(self.known) - 1, 0))
        good = self.known[which] == hashes[at] if len(self.known) else np.zeros(0, bool)
        return at[good], which[good]

    def within(self, prints: np.ndarray, length: int) -> Iterator[tuple[int, np.ndarray]]:
        """(item, positions of prints): all items of a length whose fingerprint is within RADIUS of a print."""
        candidates = []
        for block, (items, at) in enumerate(self.blocks):
            key = self._block(prints, block).astype(np.int64)
            sizes = at[key + 1] - at[key]
            starts = np.repeat(at[key] - np.concatenate(([0], np.cumsum(sizes)[:-1])), sizes)
            candidates.append(np.repeat(np.arange(len(prints)), sizes) * len(self.ids) + items[starts + np.arange(sizes.sum())])
        pair = np.unique(np.concatenate(candidates))
        window, item = pair // len(self.ids), pair % len(self.ids)
        near = (self.lengths[item] == length) & (np.bitwise_count(prints[window] ^ self.prints[item]) <= RADIUS)
        for i in np.unique(item[near]):
            yield int(i), window[near & (item == i)]

    def similarity(self, item: int, hashes: np.ndarray) -> float:
        """Weighted Jaccard similarity of an item and a window's shingles, as multisets."""
        keys, counts = _multiset(hashes)
        own, own_counts = self.sets[item]
        at = np.minimum(np.searchsorted(keys, own), len(keys) - 1)
        shared = np.where(keys[at] == own, np.minimum(counts[at], own_counts), 0)
        both = int((shared * self.weight(own)).sum())
        return both / (int((self.weight(keys) * counts).sum()) + int((self.weight(own) * own_counts).sum()) - both)

    def able(self, item: int, places: np.ndarray, weights: np.ndarray, summed: np.ndarray, span: int) -> np.ndarray:
        """Starts of the windows of span shingles that hold enough of the item's shingles, which are at places, to be similar enough.

        What a window and an item share weighs no more than the window's shingles that the item has.
        """
        held = np.zeros(len(summed), np.int64)
        held[places + 1] = weights
        held = np.cumsum(held)
        return np.flatnonzero((1 + SIMILARITY) * (held[span:] - held[:-span]) >= SIMILARITY * (self.totals[item] + summed[span:] - summed[:-span]) - 1e-6)

    def leaks(self, words: np.ndarray) -> Iterator[tuple[int, float, int, int]]:
        """(item, similarity, first word, words): the best window of each item that a text holds."""
        best: dict[int, tuple[float, int, int]] = {}
        for k in self.ks:
            if len(words) < k:
                continue
            shingles = tokens.shingles(words, k)
            at, which = self.hits(shingles)
            if not len(at):
                continue
            counts = self.owner_at[which + 1] - self.owner_at[which]
            owners = self.owners[np.repeat(self.owner_at[which] - np.concatenate(([0], np.cumsum(counts)[:-1])), counts) + np.arange(counts.sum())]
            places = np.repeat(at, counts)
            weights = self.weight(shingles[places])
            summed = np.concatenate(([0], np.cumsum(self.weight(shingles))))
            held = np.bincount(owners, weights, len(self.ids))
            for item in np.flatnonzero((np.minimum(self.lengths, K) == k) & (held > 0) & (held >= SIMILARITY * self.totals - 1e-6)).tolist():
                size = min(int(self.lengths[item]), len(words))
                span, mine = size - k + 1, owners == item
                for w in self.able(item, places[mine], weights[mine], summed, span).tolist():
                    found = self.similarity(item, shingles[w : w + span])
                    if found >= SIMILARITY and (item not in best or (-found, w) < (-best[item][0], best[item][1])):
                        best[item] = (found, w, size)
            wanted: dict[int, list[np.ndarray]] = {}
            for item in np.unique(owners):
                if min(K, int(self.lengths[item])) == k:
                    wanted.setdefault(int(self.lengths[item]), []).append(places[owners == item])
            for length, hit in wanted.items():
                size = min(length, len(words))
                span = size - k + 1  # shingles of a window
                touched = np.zeros(len(words) - size + 2, np.int64)
                hit = np.concatenate(hit)
                np.add.at(touched, np.clip(hit - span + 1, 0, len(words) - size), 1)
                np.add.at(touched, np.clip(hit, 0, len(words) - size) + 1, -1)
                starts = np.flatnonzero(np.cumsum(touched[:-1]) > 0)
                runs = np.split(starts, np.flatnonzero(np.diff(starts) > 1) + 1)
                for run in (run[at : at + WINDOWS] for run in runs for at in range(0, len(run), WINDOWS)):
                    near = shingles[run[0] : run[-1] + span]
                    for item, windows in self.within(simhash(near, self.weight(near), span), length):
                        for w in windows.tolist():
                            found = self.similarity(item, near[w : w + span])
                            if found >= SIMILARITY and (item not in best or (-found, run[0] + w) < (-best[item][0], best[item][1])):
                                best[item] = (found, int(run[0] + w), size)
        for item, (found, start, size) in sorted(best.items()):
            yield item, found, start, size


def _held(index: ItemIndex, texts: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    """(row, words) of the texts that share a shingle with an item."""
    for row, _, hashes, at in tokens.words(texts, tokens.BY_PUNCTUATION):
        touched = np.zeros(len(hashes) + 1, np.int64)
        for k in index.ks:
            hit, _ = index.hits(tokens.shingles(hashes, k))
            touched[hit + 1] += 1
        total = np.cumsum(touched)
        for i in np.flatnonzero(total[at[1:]] > total[at[:-1]]):
            yield row + int(i), hashes[at[i] : at[i + 1]]


def _search(index: ItemIndex):
    names = ["doc_id", "item_id", "similarity", "first_word", "n_words"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(batch.column(0)[row].as_py(), index.ids[item], *found) for row, words in _held(index, batch.column(1)) for item, *found in index.leaks(words)]
            columns = list(zip(*rows, strict=True)) or [[]] * 5
            kinds = [pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64()]
            yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=names)

    return run


def _item_shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The distinct shingles of each item with words, and their length in words; a null shingle for the item itself."""
    for batch in batches:
        for _, _, hashes, at in tokens.words(batch.column(0), tokens.BY_PUNCTUATION):
            own = [(np.unique(tokens.shingles(hashes[a:b], K)), min(K, b - a)) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True) if b > a]
            for shingles, k in own:
                yield pa.record_batch([pa.array(shingles.view(np.int64)), pa.array([k] * len(shingles), pa.int32())], names=["shingle", "k"])
            yield pa.record_batch([pa.nulls(len(own), pa.int64()), pa.nulls(len(own), pa.int32())], names=["shingle", "k"])


def item_spread(shingles: DataFrame) -> tuple[np.ndarray, np.ndarray, int]:
    """The shingles that several items have, in order, with the numbers of items; and the number of items with words."""
    rows = shingles.groupBy("shingle").agg(F.count("*").alias("n")).where("n > 1 or shingle is null").toArrow()  # bounded by the benchmark
    found, n = rows["shingle"], rows["n"].to_numpy()
    lone = found.is_null().to_numpy()
    hashes, counts = found.filter(found.is_valid()).to_numpy().astype(np.int64).view(np.uint64), n[~lone]
    order = np.argsort(hashes)
    return hashes[order], counts[order], int(n[lone].sum())


def _touching(shingles: DataFrame):
    """A mask of the texts that share a shingle with an item, and of a few more, as the filter has bits for hashes."""
    known = shingles.where("shingle is not null")
    total, ks = known.agg(F.count("*"), F.collect_set("k")).first()  # K values at most
    bits = min(MOST_FILTER_BITS, max(16, (BITS_A_SHINGLE * total).bit_length()))
    at = known.select(F.shiftrightunsigned("shingle", 64 - bits).alias("at"))
    words = at.select(F.shiftright("at", 6).alias("word"), F.expr("shiftleft(1L, cast(at % 64 as int))").alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()  # 2**(bits - 6) rows at most
    table = np.zeros(1 << (bits - 6), np.int64)
    table[words["word"].to_numpy()] = words["bits"].to_numpy()
    table = table.view(np.uint8)

    def mask(texts: pa.Array) -> np.ndarray:
        out = np.zeros(len(texts), bool)
        for row, end, hashes, cuts in tokens.words(texts, tokens.BY_PUNCTUATION):
            touched = np.zeros(len(hashes) + 1, np.int64)
            for k in ks:
                place = tokens.shingles(hashes, k) >> np.uint64(64 - bits)
                touched[1 : len(place) + 1] += (table[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8)) & 1
            sums = np.cumsum(touched)
            out[row:end] = sums[cuts[1:]] > sums[cuts[:-1]]
        return out

    return mask


def _indexes(items: DataFrame, n: int, spread: tuple | None) -> Iterator[ItemIndex]:
    for part in range(n):
        own = items.where(F.pmod(F.xxhash64("item_id"), F.lit(n)) == part).collect()  # about PART_ITEMS rows, by hash
        yield ItemIndex([r["item_id"] for r in own], [r["text"] for r in own], spread)


def _items(benchmark: DataFrame) -> tuple[DataFrame, int, DataFrame | None, tuple | None]:
    """The items, the number of parts, and if there are several, the shingles of all items and their spread."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text")
    n = -(-max(1, items.count()) // PART_ITEMS)
    if n == 1:  # the only part has them all
        return items, 1, None, None
    shingles = written(items.select("text").mapInArrow(_item_shingles, "shingle long, k int"), "item-shingles")
    return items, n, shingles, item_spread(shingles)


def benchmark_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, similarity, first_word, n_words): the best window of each document for each item it holds.

    Words are runs of characters other than white space and ASCII punctuation, A-Z lowered; shingles
    have five words, or all words of a shorter item.  A shingle weighs less the more items have it.  A
    text shorter than an item is one window.  Null and empty texts and items match nothing; repeated
    rows of either table are reported each; an empty table gives an empty table.  Of windows as similar
    the first is told.  Columns other than the ids and texts are not read.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    items, n, shingles, spread = _items(benchmark)
    search = lambda docs, index: docs.mapInArrow(_search(index), "doc_id long, item_id long, similarity double, first_word long, n_words long")
    if n == 1:
        return search(docs, next(_indexes(items, n, spread)))
    mask = _touching(shingles)
    near = docs.mapInArrow(lambda batches: (batch.filter(pa.array(mask(batch.column(1)))) for batch in batches), docs.schema)
    near, out = written(near, "touching"), None
    for index in _indexes(items, n, spread):
        found = written(search(near, index), "leaks")
        out = found if out is None else out.union(found)
    return out


def drop_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs that hold no benchmark item, with all their columns, whatever their names.

    Each row is judged by its own text, so repeated rows go or stay together; rows with a null id stay."""
    items, n, shingles, spread = _items(benchmark)

    def clean(docs: DataFrame, index: ItemIndex) -> DataFrame:
        def leaking(texts: pa.Array) -> np.ndarray:
            out = np.zeros(len(texts), bool)
            out[[row for row, words in _held(index, texts) if next(index.leaks(words), None)]] = True
            return out

        return without(docs, leaking)

    if n == 1:
        return clean(docs, next(_indexes(items, n, spread)))
    mask = _touching(shingles)
    near, path = written_at(only(docs, mask), "touching")
    for index in _indexes(items, n, spread):
        last = path
        near, path = written_at(clean(near, index), "touching")
        removed(docs.sparkSession, last)
    return without(docs, mask).union(near)
