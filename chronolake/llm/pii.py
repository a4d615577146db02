"""Personal data: fixed patterns, and a linear-chain conditional random field over word shapes.

The patterns find e-mail addresses, IP addresses, card and phone numbers with a strict form.  The chain
labels the words of each line; it is trained from a small labelled table and decoded by Viterbi in numpy
batches.  It adds spans that the patterns miss, such as phone numbers without a + and addresses written
with (at); spans of the patterns always stay.

A chain is a whole line.  A word's shape says how many digits, dots and so on it has.
A line in which every word is plain (no digit, @, + or bracket, and at most one dot) has no personal data by the labelled table,
and isn't decoded if the weights prove that the decoder would say the same (see Chain.plain_is_outside).
If they also prove that a plain word between plain words is outside whatever the rest of its line holds
(see Chain.plain_is_settled), only the words near others are decoded, with the labels of the whole line.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokens

KINDS = ["email", "ip", "card", "phone"]
LABELS = ["O", *(f"{p}-{k}" for k in KINDS for p in "BI")]

_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# a match that starts within a run of digits exists only where one starts at the run, so the look-behind changes nothing
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """The domain is found first, then the longest local part before it; the same as the leftmost match from the left."""
    last = 0
    for m in _DOMAIN.finditer(text):
        start = m.start()
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        if start < m.start():
            yield start, m.end()
            last = m.end()


def _valid(kind: str, found: str) -> bool:
    if kind == "ip":
        return all(len(p) <= 3 and int(p or 0) <= 255 for p in (p.lstrip("0") for p in found.split(".")))
    if kind == "card":
        return 13 <= len(d := _digits(found)) <= 19 and luhn(d)
    if kind == "phone":
        return 9 <= len(_digits(found)) <= 15
    return True


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by the fixed patterns, by kind and start."""
    out = [("email", *s) for s in _emails(text)] if "@" in text else []
    for kind, pattern in (("ip", _IP), ("card", _CARD), ("phone", _PHONE)):
        out += [(kind, *m.span()) for m in pattern.finditer(text) if _valid(kind, m[0])]
    return out


# --- the labelled table ---------------------------------------------------------------------------

FILLER = "the a of and to we is on for with later today please ask about our report team office house from page see item they were found near old new Monday river paper was it than more every Le la des que und der die nicht el los por".split()


def labelled_table(rows: int = 300, seed: int = 7) -> list[list[tuple[str, str]]]:
    """Sentences as (word, label) lists, made from forms of personal data and of harmless numbers."""
    r = random.Random(seed)
    number = lambda n: "".join(r.choice("0123456789") for _ in range(n))
    word = lambda: "".join(r.choice("abcdefghijklmnoprstuvw") for _ in range(r.randint(3, 9)))
    host = lambda: f"{word()}{r.choice(['', number(1)])}.{word()}.{r.choice(['com', 'org', 'net'])}"
    personal = [
        lambda: ("email", [f"{word()}{r.choice(['', '.' + number(2), '_' + word(), '.' + word()])}@{host()}"]),
        lambda: ("email", [f"{word()}{r.choice(['', '.' + word()])}{r.choice(['(at)', '[at]'])}{host()}"]),
        lambda: ("ip", [".".join(str(r.randint(0, 255)) for _ in range(4))]),
        lambda: ("card", [number(16)]),
        lambda: ("card", [number(4) for _ in range(4)]),
        lambda: ("phone", [f"+{number(r.randint(1, 2))}", f"({number(3)})", f"{number(3)}-{number(4)}"]),
        lambda: ("phone", [f"({number(3)})", f"{number(3)}-{number(4)}"]),
        lambda: ("phone", [f"{number(3)}-{number(3)}-{number(4)}"]),
        lambda: ("phone", [f"+{number(2)}", number(r.randint(2, 3)), number(r.randint(6, 8))]),
    ]
    harmless = [
        lambda: [r.choice(["19", "20"]) + number(2)], lambda: [number(r.randint(1, 8))], lambda: [f"{number(1)}.{number(1)}"], lambda: [f"{number(1)}.{number(1)}.{number(2)}"],
        lambda: [f"{number(2)}/{number(2)}/{number(4)}"], lambda: [f"20{number(2)}-{number(2)}-{number(2)}"], lambda: [f"{number(1)},{number(3)}.{number(2)}"], lambda: [f"({word()})"],
        lambda: [f"{number(2)}:{number(2)}"], lambda: [f"{word()}-{word()}"], lambda: [f"({number(4)})"], lambda: [f"{word()}{number(2)}"], lambda: ["version", f"{number(1)}.{number(1)}"], lambda: [f"[{number(1)}]"], lambda: [f"{host()}"], lambda: ["+", number(2)],
    ]
    out = []
    for _ in range(rows):
        sentence: list[tuple[str, str]] = []
        for _ in range(r.randint(1, 3)):
            sentence += [(r.choice([r.choice(FILLER), word()]) + r.choice(["", "", "", ",", "."]), "O") for _ in range(r.randint(1, 6))]
            if r.random() < 0.5:
                kind, parts = r.choice(personal)()
                sentence += [(p, f"{'BI'[i > 0]}-{kind}") for i, p in enumerate(parts)]
            else:
                sentence += [(p, "O") for p in r.choice(harmless)()]
        out.append(sentence)
    return out


# --- word shapes ----------------------------------------------------------------------------------

_SIZES = (9, 2, 2, 4, 2, 2, 2)  # digits, letters, @, dots, first +, bracket, -
SHAPES = int(np.prod(_SIZES))
_DIGIT_CLASS = np.array([0, 1, 2, 3, 4, *[5] * 4, *[6] * 4, *[7] * 7, 8])


def _mask(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


_DIGIT, _AT, _DOT, _BRACKET, _DASH = _mask(b"0123456789"), _mask(b"@"), _mask(b"."), _mask(b"(["), _mask(b"-")
_LETTER = _mask(bytes([*range(65, 91), *range(97, 123), *range(128, 256)]))
_TRAILING = _mask(b".,;:!?")
_ODD = _mask(b"0123456789@+([")
_RARE = ~(_LETTER | tokens.BY_SPACE)


def shapes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The shape number of each word data[start:end]; most bytes are letters, so others are found first."""
    rare = np.flatnonzero(_RARE[data])
    byte = data[rare]

    def count(at: np.ndarray) -> np.ndarray:
        return np.searchsorted(at, ends) - np.searchsorted(at, starts)

    dots = count(rare[_DOT[byte]]) - _DOT[data[ends - 1]]
    letters = (ends - starts) > count(rare)
    parts = (_DIGIT_CLASS[np.minimum(count(rare[_DIGIT[byte]]), 20)], letters, count(rare[_AT[byte]]) > 0, np.minimum(dots, 3), data[starts] == ord("+"), count(rare[_BRACKET[byte]]) > 0, count(rare[_DASH[byte]]) > 0)
    return np.ravel_multi_index([np.asarray(p, np.int64) for p in parts], _SIZES)


def _design() -> np.ndarray:
    """Features of each shape: a bias, each part, and the parts' pairs with the digit class."""
    parts = np.unravel_index(np.arange(SHAPES), _SIZES)
    columns = [np.ones((SHAPES, 1))] + [np.eye(n)[p] for p, n in zip(parts, _SIZES, strict=True)]
    columns += [np.eye(9 * n)[parts[0] * n + p] for p, n in zip(parts[1:], _SIZES[1:], strict=True)]
    return np.concatenate(columns, 1)


# --- the chain ------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Chain:
    """Scores by shape for the word itself, the word before and the word after; and of transitions."""

    here: np.ndarray
    before: np.ndarray
    after: np.ndarray
    moves: np.ndarray

    def emissions(self, shape: np.ndarray, chain: np.ndarray) -> np.ndarray:
        out = self.here[shape].copy()
        if len(shape) > 1:
            same = (chain[1:] == chain[:-1])[:, None]
            out[1:] += self.before[shape[:-1]] * same
            out[:-1] += self.after[shape[1:]] * same
        return out

    def plain_is_outside(self, plain: np.ndarray) -> bool:
        """Whether every chain of plain shapes is decoded as all O: no path of labels wins over it.

        A step into a label wins its transition and loses at least cost over O; the longest such path
        over any number of words must not win anything.
        """
        here, before, after = (x[plain] - x[plain][:, :1] for x in (self.here, self.before, self.after))
        gain = here.max(0) + np.maximum(before.max(0), 0) + np.maximum(after.max(0), 0)
        gain[0] = 0
        path = self.moves - self.moves[0, 0] + gain
        for via in range(len(LABELS)):
            path = np.maximum(path, path[:, via, None] + path[None, via, :])
        return bool(np.diag(path)[1:].max() < 0 and path[0].max() <= 0 and (gain[1:] + np.maximum(path[1:].max(1), 0)).max() < 0)

    def plain_is_settled(self, plain: np.ndarray) -> bool:
        """Whether a plain word with plain words or line ends beside it is O in the best labels of every line:
        O in the place of any other label wins, whatever the labels beside it."""
        here, before, after = ((x[plain] - x[plain][:, :1]).max(0) for x in (self.here, self.before, self.after))
        into, out_of = (self.moves - self.moves[:, :1]).max(0), (self.moves - self.moves[:1]).max(1)
        return bool((here + sum(np.maximum(x, 0) for x in (before, after, into, out_of)))[1:].max() < 0)

    def decode(self, shape: np.ndarray, chain: np.ndarray, outside: np.ndarray | None = None) -> np.ndarray:
        """The best label of each word, O where outside is true; chain numbers ascend.  All chains advance together."""
        scores = self.emissions(shape, chain)
        if outside is not None:
            scores[outside, 1:] = -np.inf
        first = np.flatnonzero(np.concatenate(([True], chain[1:] != chain[:-1])))
        sizes = np.diff(np.append(first, len(chain)))
        order = np.argsort(-sizes, kind="stable")
        first, sizes = first[order], sizes[order]
        best = scores[first]
        back = np.zeros((len(shape), len(LABELS)), np.int8)
        for t in range(1, int(sizes[0])):
            live = int(np.searchsorted(-sizes, -t, "left"))  # chains longer than t
            step = best[:live, :, None] + self.moves
            back[first[:live] + t] = step.argmax(1)
            best[:live] = step.max(1) + scores[first[:live] + t]
        out = np.zeros(len(shape), np.int8)
        label = best.argmax(1)
        for t in range(int(sizes[0]) - 1, -1, -1):
            live = int(np.searchsorted(-sizes, -t, "left"))
            out[first[:live] + t] = label[:live]
            if t:
                label[:live] = back[first[:live] + t, label[:live]]
        return out


def train(table: list[list[tuple[str, str]]], steps: int = 120, ridge: float = 0.5) -> Chain:
    """Maximises the conditional log likelihood of the labels by Adam; forward and backward over padded sentences."""
    longest, n, labels = max(len(s) for s in table), len(table), len(LABELS)
    design = _design()
    features = design.shape[1]
    shape, gold, live = np.zeros((n, longest), np.int64), np.zeros((n, longest), np.int64), np.zeros((n, longest), bool)
    for i, sentence in enumerate(table):
        data = np.frombuffer(" ".join(w for w, _ in sentence).encode(), np.uint8)
        starts, ends = word_places(data, np.zeros(0, np.int64))
        shape[i, : len(sentence)] = shapes(data, starts, ends)
        gold[i, : len(sentence)] = [LABELS.index(x) for _, x in sentence]
        live[i, : len(sentence)] = True
    x = np.zeros(3 * features * labels + labels * labels)
    m, v = np.zeros_like(x), np.zeros_like(x)
    split = [features * labels * i for i in (1, 2, 3)]
    one_hot = np.eye(labels)[gold] * live[:, :, None]
    pairs = live[:, 1:]

    def tables(x: np.ndarray, design: np.ndarray) -> Chain:
        *w, moves = np.split(x, split)
        return Chain(*(design @ p.reshape(features, labels) for p in w), moves.reshape(labels, labels))

    used, place = np.unique(shape, return_inverse=True)
    design = design[used]
    place = place.reshape(shape.shape)
    picks = np.eye(len(used))[place]

    def by_shape(at: slice, mass: np.ndarray) -> np.ndarray:
        return (design.T @ np.tensordot(picks[:, at], mass, ((0, 1), (0, 1)))).ravel()

    log_sum = lambda a, axis: (top := a.max(axis)) + np.log(np.exp(a - np.expand_dims(top, axis)).sum(axis))
    for step in range(1, steps + 1):
        model = tables(x, design)
        e = model.here[place]
        e[:, 1:] += model.before[place[:, :-1]] * pairs[:, :, None]
        e[:, :-1] += model.after[place[:, 1:]] * pairs[:, :, None]
        f, b = np.zeros_like(e), np.zeros_like(e)
        f[:, 0] = e[:, 0]
        for t in range(1, longest):
            f[:, t] = np.where(live[:, t, None], log_sum(f[:, t - 1, :, None] + model.moves, 1) + e[:, t], f[:, t - 1])
        for t in range(longest - 2, -1, -1):
            b[:, t] = np.where(live[:, t + 1, None], log_sum(model.moves + (e[:, t + 1] + b[:, t + 1])[:, None, :], 2), 0)
        total = log_sum(f[:, -1], 1)
        node = np.exp(f + b - total[:, None, None]) * live[:, :, None]
        up = one_hot - node
        edge = np.zeros((labels, labels))
        for t in range(1, longest):
            joint = np.exp(f[:, t - 1, :, None] + model.moves + (e[:, t] + b[:, t])[:, None, :] - total[:, None, None]) * live[:, t, None, None]
            edge += (one_hot[:, t - 1, :, None] * one_hot[:, t, None, :] - joint).sum(0)
        gradient = np.concatenate([by_shape(slice(None), up), by_shape(slice(0, -1), up[:, 1:] * pairs[:, :, None]), by_shape(slice(1, None), up[:, :-1] * pairs[:, :, None]), edge.ravel()]) - ridge * x
        m, v = 0.9 * m + 0.1 * gradient, 0.99 * v + 0.01 * gradient**2
        x = x + 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return tables(x, _design())


def word_places(data: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of data; a word also ends at every cut."""
    inside = ~tokens.BY_SPACE[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    cuts = cuts[(cuts > 0) & (cuts < len(data))]
    first[cuts], last[cuts - 1] = inside[cuts], inside[cuts - 1]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def _line_numbers(data: np.ndarray, starts: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Ascending numbers of the lines of the texts."""
    line = np.cumsum(data == ord("\n"))[starts]
    return np.cumsum(np.concatenate(([True], (line[1:] != line[:-1]) | (row[1:] != row[:-1]))))


def _distance(odd: np.ndarray, line: np.ndarray) -> np.ndarray:
    """Words to the nearest odd word of the same line; 3 stands for more than 2."""
    out = np.full(len(line), 3, np.int8)
    out[odd] = 0
    for d in (1, 2):
        for off in (-d, d):
            to = odd + off
            good = (to >= 0) & (to < len(line))
            good[good] = line[to[good]] == line[odd[good]]
            out[to[good]] = np.minimum(out[to[good]], d)
    return out


def _line_end(data: np.ndarray, at: int, stop: int) -> int:
    """The first line end of data[at:stop], or stop."""
    while at < stop:
        found = np.flatnonzero(data[at : min(stop, at + (1 << 16))] == ord("\n"))
        if len(found):
            return at + int(found[0])
        at = min(stop, at + (1 << 16))
    return stop


def _spans(label: np.ndarray, chain: np.ndarray) -> Iterator[tuple[str, int, int]]:
    """(kind, first word, end word) of labelled runs."""
    at, n = 0, len(label)
    hits = np.flatnonzero(label)
    for i in hits.tolist():
        if i < at:
            continue
        kind = (int(label[i]) - 1) // 2
        at = i + 1
        while at < n and chain[at] == chain[i] and label[at] == 2 * kind + 2:
            at += 1
        yield KINDS[kind], i, at


_FORMS = {"email": re.compile(r"[A-Za-z0-9._%+-]+(?:@|\(at\)|\[at\])[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"), "ip": re.compile(r"[0-9]+(?:\.[0-9]+){3}"), "card": re.compile(r"[0-9](?:[\x20-]?[0-9])+"), "phone": re.compile(r"[+(]?[0-9][\x20().0-9-]+[0-9]")}


def _found(model: Chain, plain_out: bool, settled: bool, texts: pa.Array) -> Iterator[tuple[int, str, int, int]]:
    """(row, kind, start, end) in bytes of the text, by the chain; longer texts are taken in pieces of whole lines."""
    data, offsets = tokens.column_bytes(texts)
    row, rows = 0, len(offsets) - 1
    while row < rows:
        end = min(rows, max(row + 1, int(np.searchsorted(offsets, offsets[row] + tokens.PIECE_BYTES, "right")) - 1))
        lo, stop = int(offsets[row]), int(offsets[end])
        while lo < stop:
            hi = _line_end(data, min(stop, lo + tokens.PIECE_BYTES), stop) if end == row + 1 else stop
            piece = data[lo:hi]
            starts, ends = word_places(piece, offsets[row : end + 1] - lo)
            if len(starts):
                of_row = np.searchsorted(offsets[row : end + 1] - lo, starts, "right") - 1
                line = _line_numbers(piece, starts, of_row)
                keep, outside = np.arange(len(starts)), None
                if plain_out or settled:
                    odd = np.flatnonzero(_ODD[piece])
                    dots = np.flatnonzero(piece == ord("."))
                    odd = np.unique(np.concatenate((np.searchsorted(starts, odd, "right") - 1, np.flatnonzero(np.searchsorted(dots, ends) - np.searchsorted(dots, starts) > 1))))
                    if settled:
                        far = _distance(odd, line)
                        keep = np.flatnonzero(far < 3)
                        outside = far[keep] == 2
                    else:
                        wanted = np.zeros(int(line[-1]) + 1, bool)
                        wanted[line[odd]] = True
                        keep = np.flatnonzero(wanted[line])
                s, e, r = starts[keep], ends[keep], of_row[keep]
                if len(s):
                    c = np.cumsum(np.concatenate(([True], (np.diff(keep) > 1) | (np.diff(line[keep]) > 0))))
                    for kind, a, b in _spans(model.decode(shapes(piece, s, e), c, outside), c):
                        right = int(e[b - 1])
                        while right > s[a] and _TRAILING[piece[right - 1]]:
                            right -= 1
                        yield row + int(r[a]), kind, lo + int(s[a]) - int(offsets[row + int(r[a])]), lo + right - int(offsets[row + int(r[a])])
            lo = hi
        row = end


def _finder(model: Chain):
    plain = np.unique(np.arange(SHAPES)[_plain_shapes()])
    plain_out, settled = model.plain_is_outside(plain), model.plain_is_settled(plain)
    names = ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"]
    kinds = [pa.int64()] * 5 + [pa.string()] * 2
    as_text = lambda spans: ",".join(f"{k}:{a}:{b}" for k, a, b in spans)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            more: dict[int, list[tuple[str, int, int]]] = {}
            for row, kind, a, b in _found(model, plain_out, settled, batch.column(1)):
                more.setdefault(row, []).append((kind, a, b))
            data, offsets = tokens.column_bytes(batch.column(1))
            odd = np.concatenate(([0], np.flatnonzero(_mask(b"0123456789@")[data]), [len(data)]))
            has = np.searchsorted(odd[1:-1], offsets)
            rows = []
            for i in range(batch.num_rows):
                text = batch.column(1)[i].as_py() or "" if has[i + 1] > has[i] or i in more else ""
                base = base_spans(text)
                whole = list(base)
                if i in more:
                    raw = text.encode()
                    for kind, a, b in more[i]:
                        m = _FORMS[kind].search(raw[a:b].decode())
                        if not m:
                            continue
                        at = len(raw[:a].decode()) + m.start()
                        if (_valid(kind, m[0]) or kind == "phone" and 10 <= len(_digits(m[0])) <= 15) and not any(at < y and x < at + len(m[0]) for _, x, y in whole):
                            whole.append((kind, at, at + len(m[0])))
                    whole.sort(key=lambda s: (KINDS.index(s[0]), s[1]))
                rows.append((*(sum(k == kind for k, _, _ in base) for kind in KINDS), hashlib.sha256(as_text(base).encode()).hexdigest(), as_text(whole)))
            columns = list(zip(*rows, strict=True)) or [[]] * 6
            yield pa.record_batch([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, kinds[1:], strict=True))], names=names)

    return run


def _plain_shapes() -> np.ndarray:
    digits, _, at, dots, plus, bracket, _ = np.unravel_index(np.arange(SHAPES), _SIZES)
    return (digits == 0) & (at == 0) & (dots < 2) & (plus == 0) & (bracket == 0)


def find_personal_data(docs: DataFrame, table: list[list[tuple[str, str]]] | None = None) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans) for every row of docs.

    Counts and base_sha256 are of the spans of the fixed patterns; spans also has those that the chain
    adds, which overlap no other.  Offsets are code points, ends exclusive.  Null and empty texts have
    none; repeated rows get the same row each; an empty table gives an empty table.
    """
    model = train(table or labelled_table())
    schema = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_finder(model), schema)
