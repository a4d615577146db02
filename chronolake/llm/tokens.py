"""Vectorised word and shingle hashing over Arrow string columns.

All functions work on the UTF-8 buffer of a column, so no Python string is built.  A word is a
maximal run of bytes that are not separators; separators are ASCII, so they never cut a character.
Hashes are 64 bits wide; two different words or shingles are taken as equal with probability 2**-64, unless
they were made to be: the hash of a word is a polynomial modulo 2**64, for which two words of some thousand
letters can be crafted that agree (Thue-Morse words).  Fixed random values of bytes and a fixed seed make
results the same in every run.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SPACES = bytes([0x20, *range(0x09, 0x0E)])
PUNCTUATION = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"

#: Bytes that are hashed at once; bounds the working memory of a task at about 64 times this.
PIECE_BYTES = 1 << 19

_rng = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE[ord("A") : ord("Z") + 1] = _BYTE[ord("a") : ord("z") + 1]
_BASE = 0x9E3779B97F4A7C15 | 5
_LENGTH = np.uint64(0xD6E8FEB86659FD93)
_PLACE = _rng.integers(1, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, by doubling."""
    out = np.ones(n, dtype=np.uint64)
    done = 1
    while done < n:
        step = np.uint64(pow(base, done, 1 << 64))
        more = min(done, n - done)
        out[done : done + more] = out[:more] * step
        done += more
    return out


_cache: dict[str, np.ndarray] = {}


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "up" not in _cache or len(_cache["up"]) < n:
        size = max(n, PIECE_BYTES + 1)
        _cache["up"] = _powers(_BASE, size)
        _cache["down"] = _powers(pow(_BASE, -1, 1 << 64), size)
    return _cache["up"], _cache["down"]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser that spreads every bit of x."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def separators(extra: bytes = b"") -> np.ndarray:
    """Lookup table: True at the bytes of white space and of extra."""
    table = np.zeros(256, dtype=bool)
    table[list(SPACES + extra)] = True
    return table


BY_SPACE = separators()
BY_PUNCTUATION = separators(PUNCTUATION)


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the offsets of its values; null counts as empty."""
    column = pc.fill_null(column, "")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    if len(column) == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.zeros(0, np.uint8) if data is None else np.frombuffer(data, np.uint8)
    return data, offsets


def _piece(data: np.ndarray, cuts: np.ndarray, is_separator: np.ndarray, stem: int = 0):
    """Word hashes, starts and stem hashes of one piece; a word also ends at every cut."""
    inside = ~is_separator[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    cuts = cuts[(cuts > 0) & (cuts < len(data))]
    first[cuts] = inside[cuts]
    last[cuts - 1] = inside[cuts - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    up, down = _tables(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * up[: len(data)], out=total[1:])
    def hashed(ends: np.ndarray) -> np.ndarray:
        return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64) * _LENGTH)

    return hashed(ends), starts, hashed(np.minimum(ends, starts + stem)) if stem else None


def words(column: pa.Array, is_separator: np.ndarray = BY_SPACE, marks: np.ndarray | None = None, stem: int = 0) -> Iterator[tuple]:
    """Yields (first row, end row, word hashes, word offsets by row) for runs of rows of about PIECE_BYTES.

    Letters A-Z count as a-z.  A longer text is hashed in pieces that end at a separator, so only its
    hashes are held at once.  With marks, a table of bytes, the number of marked bytes before each word
    comes as a fifth item; with stem, the hashes of each word's first stem bytes come last.
    """
    data, offsets = column_bytes(column)
    row, rows = 0, len(offsets) - 1
    while row < rows:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + PIECE_BYTES, "right")) - 1)
        end = min(end, rows)
        lo, hi = int(offsets[row]), int(offsets[end])
        cuts = offsets[row : end + 1] - lo
        found, seen, stems, marked = [], [], [], 0
        while True:
            cut = min(hi, lo + PIECE_BYTES) if hi - lo > PIECE_BYTES else hi
            while cut < hi and not is_separator[data[cut]]:
                cut += 1
            hashes, starts, short = _piece(data[lo:cut], cuts if end - row > 1 else cuts[:0], is_separator, stem)
            found.append(hashes)
            stems.append(short)
            if marks is not None:
                before = np.cumsum(marks[data[lo:cut]])
                seen.append((before[starts] if len(before) else starts) + marked)
                marked += int(before[-1]) if len(before) else 0
            if cut == hi:
                break
            lo = cut
        hashes = np.concatenate(found)
        at = np.searchsorted(starts, cuts) if end - row > 1 else np.array([0, len(hashes)])
        yield row, end, hashes, at, *([np.concatenate(seen)] if marks is not None else []), *([np.concatenate(stems)] if stem else [])
        row = end


def shingles(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of every k consecutive words (k at most 64); one hash of the whole sequence if it is shorter, none if empty."""
    n = len(hashes)
    k = min(k, n)
    if k == 0:
        return np.zeros(0, np.uint64)
    out = np.full(n - k + 1, k * int(_LENGTH) % (1 << 64), np.uint64)
    for j in range(k):
        out += hashes[j : n - k + 1 + j] * _PLACE[j]
    return mix(out)


def shingle_sets(hashes: np.ndarray, at: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of each row, ascending, one after the other; and their offsets by row."""
    whole = shingles(hashes, k)
    sets = []
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        own = whole[a : b - k + 1] if b - a >= k else shingles(hashes[a:b], k)
        own = np.sort(own)
        sets.append(own[np.concatenate(([True], own[1:] != own[:-1]))] if len(own) else own)
    sizes = np.zeros(len(sets) + 1, np.int64)
    np.cumsum([len(x) for x in sets], out=sizes[1:])
    return (np.concatenate(sets) if sets else np.zeros(0, np.uint64)), sizes
