"""Toxicity by multiple-instance learning.

A document is a bag of sentences; a sentence is toxic with a probability that is logistic in its words and
their stems (first STEM bytes), and a document is toxic unless all of its sentences are harmless (noisy-or).  Only documents are labelled;
the weights maximise the likelihood of their labels, and then also tell which sentences offend.

The weights are learned from a bounded sample of labelled documents: SAMPLE[c] rows of class c at most,
those with the least hash of their id, and of those the texts of LEARN_CHARS characters at most; equal texts
count once.  The words and stems that get a weight are
the VOCABULARY whose document counts in the sample tell most for toxicity; Spark counts them.  The driver
gets the hits of those few words, and of documents without a hit only how many have so many sentences.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokens
from .labelled import held_out, to_learn
from .rowwise import without
from .scratch import written

SAMPLE = {0: 16_000, 1: 8_000}
#: Longer texts aren't learned from; they are scored whole like others.
LEARN_CHARS = 50_000
VOCABULARY = 512
#: A word of the vocabulary is in so many times the share of toxic documents that it has of others.
LEAST_RATIO = 2.0
STEM = 5
LEAST_DOCUMENTS = 3
THRESHOLD = 0.5
SENTENCE = re.compile(r"[^.!?\n]+")
#: Keeps the hash of a stem apart from that of the same word.
AS_STEM = np.uint64(0xA5A5A5A55A5A5A5A)
_ENDS = np.zeros(256, bool)
_ENDS[[ord(c) for c in ".!?\n"]] = True


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, toxic documents, other documents) of each batch."""
    for batch in batches:
        label = batch.column(1).to_numpy()
        for row, end, hashes, at, stems in tokens.words(batch.column(0), tokens.BY_PUNCTUATION, stem=STEM):
            sets = [np.unique(np.concatenate((hashes[a:b], stems[a:b] ^ AS_STEM))) for a, b in zip(at[:-1], at[1:], strict=True)]
            word = np.concatenate(sets)
            toxic = np.repeat(label[row:end], [len(s) for s in sets])
            word, which = np.unique(word, return_inverse=True)
            ones = np.bincount(which, toxic, len(word)).astype(np.int64)
            yield pa.record_batch([pa.array(word.view(np.int64)), pa.array(ones), pa.array(np.bincount(which, minlength=len(word)) - ones)], names=["word", "toxic", "other"])


@dataclass(frozen=True)
class Lexicon:
    """Word hashes in ascending order, with a table that tells most other words at once."""

    words: np.ndarray
    table: np.ndarray

    @staticmethod
    def of(words: np.ndarray) -> Lexicon:
        table = np.zeros(1 << 16, bool)
        table[words >> np.uint64(48)] = True
        return Lexicon(np.sort(words), table)

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions of known words, and which words they are."""
        at = np.flatnonzero(self.table[hashes >> np.uint64(48)])
        which = np.searchsorted(self.words, hashes[at])
        which[which == len(self.words)] = 0
        known = self.words[which] == hashes[at] if len(self.words) else np.zeros(0, bool)
        return at[known], which[known]


def _bags(texts: pa.Array, lexicon: Lexicon) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, end row, sentences by row, row of each hit, sentence of each hit, word of each hit)."""
    for row, end, hashes, at, sentence, stems in tokens.words(texts, tokens.BY_PUNCTUATION, _ENDS, STEM):
        first = np.concatenate(([True], sentence[1:] != sentence[:-1])) if len(sentence) else np.zeros(0, bool)
        starts = at[:-1][at[:-1] < at[1:]]
        first[starts] = True
        number = np.cumsum(first)
        total = np.concatenate(([0], number))
        hit, word = lexicon.find(hashes)
        stem_hit, stem = lexicon.find(stems ^ AS_STEM)
        hit, word = np.concatenate((hit, stem_hit)), np.concatenate((word, stem))
        order = np.argsort(hit, kind="stable")
        hit, word = hit[order], word[order]
        yield row, end, total[at[1:]] - total[at[:-1]], np.searchsorted(at, hit, "right") - 1, number[hit], word


def _hits(lexicon: Lexicon):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, end, sentences, of_row, sentence, word in _bags(batch.column(0), lexicon):
                cut = np.searchsorted(of_row, np.arange(end - row + 1)).astype(np.int32)
                lists = [pa.ListArray.from_arrays(pa.array(cut), pa.array(x.astype(t))) for x, t in ((sentence, np.int32), (word, np.int16))]
                yield pa.record_batch([batch.column(1)[row:end], pa.array(sentences.astype(np.int32)), *lists], names=["label", "sentences", "sentence", "word"])

    return run


@dataclass(frozen=True)
class NoisyOr:
    lexicon: Lexicon
    weights: np.ndarray
    bias: float

    def sentence_logits(self, sentence: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First hit of each sentence that has hits (hits come in order), and its logit."""
        new = np.flatnonzero(np.concatenate(([True], sentence[1:] != sentence[:-1]))) if len(sentence) else np.zeros(0, np.int64)
        return new, (np.add.reduceat(self.weights[word], new) + self.bias) if len(new) else np.zeros(0)

    def score(self, rows: int, sentences: np.ndarray, of_row: np.ndarray, sentence: np.ndarray, word: np.ndarray) -> np.ndarray:
        new, logits = self.sentence_logits(sentence, word)
        row = of_row[new]
        harmless = -(sentences - np.bincount(row, minlength=rows)) * np.logaddexp(0, self.bias)
        harmless -= np.bincount(row, np.logaddexp(0, logits), rows)
        return -np.expm1(harmless)


def fit_noisy_or(lexicon: Lexicon, label: np.ndarray, sentences: np.ndarray, of_row: np.ndarray, sentence: np.ndarray, word: np.ndarray, weight: np.ndarray, steps: int = 400, ridge: float = 0.005) -> NoisyOr:
    """Maximises the weighted log likelihood of the document labels by Adam.  Sentence numbers ascend over all rows."""
    rows, size = len(label), len(lexicon.words)
    new = np.flatnonzero(np.concatenate(([True], sentence[1:] != sentence[:-1]))) if len(sentence) else np.zeros(0, np.int64)
    group = np.repeat(np.arange(len(new)), np.diff(np.append(new, len(sentence))))
    row = of_row[new]
    plain = sentences - np.bincount(row, minlength=rows)
    x = np.append(np.zeros(size), -7.0)
    m, v = np.zeros(size + 1), np.zeros(size + 1)
    for step in range(1, steps + 1):
        logits = np.bincount(group, x[word], len(new)) + x[-1]
        harmless = -plain * np.logaddexp(0, x[-1]) - np.bincount(row, np.logaddexp(0, logits), rows)
        harmless = np.minimum(harmless, -1e-9)
        # d(log likelihood) / d(harmless)
        up = weight * np.where(label == 1, -1 / np.expm1(np.minimum(-harmless, 500)), 1.0)
        by_sentence = -up[row] / (1 + np.exp(np.clip(-logits, -500, 500)))
        gradient = np.append(np.bincount(word, by_sentence[group], size), by_sentence.sum() - (up * plain).sum() / (1 + np.exp(-x[-1])))
        gradient[:-1] -= ridge * x[:-1]
        m, v = 0.9 * m + 0.1 * gradient, 0.99 * v + 0.01 * gradient**2
        x += 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        x[-1] = min(x[-1], -4.0)
    return NoisyOr(lexicon, x[:-1], float(x[-1]))


def fit(docs: DataFrame, labels: DataFrame) -> NoisyOr:
    """docs(doc_id, text); labels(doc_id, label) to learn from."""
    sizes = {r["label"]: r["n"] for r in labels.groupBy("label").agg(F.count("*").alias("n")).collect()}
    ids = None
    for label, most in SAMPLE.items():
        one = labels.where(F.col("label") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
        ids = one if ids is None else ids.union(one)
    sample = written(docs.where(F.coalesce(F.length("text"), F.lit(0)) <= LEARN_CHARS).join(F.broadcast(ids), "doc_id").select("text", "label").dropDuplicates(), "sample")  # sum(SAMPLE) ids at most
    counts = sample.mapInArrow(_word_counts, "word long, toxic long, other long").groupBy("word").agg(F.sum("toxic").alias("t"), F.sum("other").alias("o"))
    taken = {r["label"]: r["n"] for r in sample.groupBy("label").agg(F.count("*").alias("n")).collect()}
    ones, zeros = taken.get(1, 0), taken.get(0, 0)
    share = (F.col("t") + 0.5) / (ones + 1)
    ratio = share / ((F.col("o") + 0.5) / (zeros + 1))
    best = counts.where((F.col("t") >= LEAST_DOCUMENTS) & (ratio >= LEAST_RATIO)).select("word", (share * F.log(ratio)).alias("tells"))
    best = best.orderBy(F.desc("tells"), "word").limit(VOCABULARY).select("word").toPandas()
    lexicon = Lexicon.of(best["word"].to_numpy(np.int64).view(np.uint64))
    if not len(lexicon.words):
        return NoisyOr(lexicon, np.zeros(0), -7.0)
    bags = written(sample.mapInArrow(_hits(lexicon), "label int, sentences int, sentence array<int>, word array<short>"), "bags")
    hits = F.size("word") > 0
    known = bags.where(hits).toArrow()  # sum(SAMPLE) rows at most
    plain = bags.where(~hits).groupBy("label", "sentences").agg(F.count("*").alias("n")).toArrow()
    lists = [known[c].combine_chunks() for c in ("sentence", "word")]
    of_row = np.repeat(np.arange(known.num_rows), np.diff(lists[0].offsets.to_numpy()))
    sentence, word = (x.flatten().to_numpy() for x in lists)
    new = np.concatenate(([True], (sentence[1:] != sentence[:-1]) | (of_row[1:] != of_row[:-1]))) if len(sentence) else np.zeros(0, bool)
    label = np.concatenate((known["label"].to_numpy(), plain["label"].to_numpy()))
    sentences = np.concatenate((known["sentences"].to_numpy(), plain["sentences"].to_numpy()))
    weight = np.where(label == 1, sizes.get(1, 0) / max(ones, 1), sizes.get(0, 0) / max(zeros, 1)) * np.concatenate((np.ones(known.num_rows), plain["n"].to_numpy()))
    return fit_noisy_or(lexicon, label, sentences, of_row, np.cumsum(new), word, weight * (ones + zeros) / weight.sum())


def _scores(model: NoisyOr, texts: pa.Array) -> np.ndarray:
    return np.concatenate([model.score(end - row, *bag) for row, end, *bag in _bags(texts, model.lexicon)] or [np.zeros(0)])


def _sentences(model: NoisyOr, text: str) -> tuple[list[tuple[int, int]], np.ndarray]:
    """Spans of the sentences of a text in code points, and their scores."""
    spans = [m.span() for m in SENTENCE.finditer(text)]
    return spans, _scores(model, pa.array([text[a:b] for a, b in spans], pa.string()))


def _offending(model: NoisyOr, text: str) -> str:
    """The spans of the sentences that are toxic on their own, or else of the worst one."""
    spans, score = _sentences(model, text)
    bad = np.flatnonzero(score >= THRESHOLD) if len(score) else []
    if not len(bad) and len(score):
        bad = [int(score.argmax())]
    return ",".join(f"{spans[i][0]}:{spans[i][1]}" for i in bad)


def _scorer(model: NoisyOr):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = _scores(model, batch.column(1))
            bad = {int(i): _offending(model, batch.column(1)[int(i)].as_py()) for i in np.flatnonzero(score >= THRESHOLD)}
            yield pa.record_batch([batch.column(0), pa.array(score), pa.array([bad.get(i, "") for i in range(len(score))], pa.string())], names=["doc_id", "score", "offending"])

    return run


def _locator(model: NoisyOr):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                spans, score = _sentences(model, text or "")
                bad = np.flatnonzero(score >= THRESHOLD)
                n = len(bad)
                yield pa.record_batch([pa.array([doc_id.as_py()] * n, pa.int64()), pa.array([spans[i][0] for i in bad], pa.int64()), pa.array([spans[i][1] for i in bad], pa.int64()), pa.array(score[bad])], names=["doc_id", "start", "end", "score"])

    return run


def score_toxicity(docs: DataFrame, labels: DataFrame, model: NoisyOr | None = None) -> DataFrame:
    """(doc_id, held_out, score, predicted, offending) for every row of docs: score is the probability of label 1.

    offending has start:end in code points, comma-joined, of the sentences that are toxic on their own, or
    of the worst one, of a document that is predicted toxic; it is empty for others.
    labels(doc_id, toxic): rows with a null, a label other than 0 and 1, or a held-out id are not
    learned from; a document that is labelled twice counts once for each label.  Without toxic rows to
    learn from, every score is near 0.  Null and empty texts have no sentence and score 0.  Repeated rows
    get the same row each; an empty table gives an empty table.  Only the text is an input of the score;
    columns other than doc_id and text are not read.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    model = model or fit(docs, to_learn(labels, "toxic"))
    scored = docs.mapInArrow(_scorer(model), "doc_id long, score double, offending string")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "offending")


def toxic_sentences(docs: DataFrame, labels: DataFrame, model: NoisyOr | None = None) -> DataFrame:
    """(doc_id, start, end, score): code points of the sentences that are toxic on their own."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    model = model or fit(docs, to_learn(labels, "toxic"))
    return docs.mapInArrow(_locator(model), "doc_id long, start long, end long, score double")


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that aren't predicted toxic, with all their columns, whatever their names.

    Each row is judged by its own text, so repeated rows go or stay together; rows with a null id stay."""
    model = fit(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), to_learn(labels, "toxic"))
    return without(docs, lambda texts: _scores(model, texts) >= THRESHOLD)
