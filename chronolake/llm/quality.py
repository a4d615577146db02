"""Quality classifier: regularised quadratic discriminant analysis of document statistics.

Every class has a normal density over transformed statistics of a text.  Its covariance is shrunk towards
the pooled covariance and that towards a multiple of the identity (Friedman, 1989); the Cholesky factors
are taken once.  Spark sums the moments of all labelled rows; no sample is drawn.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokens
from .labelled import held_out, to_learn
from .scratch import written

FEATURES = ["words", "word_length", "word_spread", "upper", "symbols", "digits", "lines", "non_ascii", "distinct_words", "distinct_triples", "distinct_lines", "commonest_word"]
THRESHOLD = 0.3
#: Share of the pooled covariance, and then of the identity.
TO_POOLED, TO_IDENTITY = 0.1, 0.02

_KIND = np.zeros(256, np.uint8)
_KIND[ord("a") : ord("z") + 1] = 1
_KIND[ord("A") : ord("Z") + 1] = 2
_KIND[ord("0") : ord("9") + 1] = 3
_KIND[list(tokens.SPACES)] = 4
_KIND[list(tokens.PUNCTUATION)] = 5
_KIND[128:192] = 6  # continuation bytes, which are no characters of their own
_KIND[192:] = 7
_COMMON_PUNCTUATION = [ord(c) for c in ".,"]
_KIND[_COMMON_PUNCTUATION] = 8
_KIND[ord("\n")] = 9
_LINES = np.zeros(256, bool)
_LINES[ord("\n")] = True


def _share(part, whole) -> np.ndarray:
    return np.log((part + 0.5) / (whole + 1.0))


def document_statistics(texts: pa.Array) -> np.ndarray:
    """A row of FEATURES for each text; null counts as empty."""
    data, offsets = tokens.column_bytes(texts)
    out = np.zeros((len(texts), len(FEATURES)))
    for row, end, hashes, at, line_of in tokens.words(texts, marks=_LINES):
        kinds = np.zeros((end - row, 10))
        own = _KIND[data[offsets[row] : offsets[end]]]
        cuts = offsets[row : end + 1] - offsets[row]
        for i in range(end - row):
            kinds[i] = np.bincount(own[cuts[i] : cuts[i + 1]], minlength=10)
        n = np.diff(at).astype(float)
        chars = kinds.sum(1) - kinds[:, 6]
        inside = chars - kinds[:, 4] - kinds[:, 9]
        letters = kinds[:, 1] + kinds[:, 2] + kinds[:, 7]
        distinct, triples, lines, most = (np.zeros(end - row) for _ in range(4))
        n_lines = np.zeros(end - row)
        for i in range(end - row):
            own_words = hashes[at[i] : at[i + 1]]
            if not len(own_words):
                continue
            ordered = np.sort(own_words)
            new = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1], [True])))
            distinct[i], most[i] = len(new) - 1, np.diff(new).max()
            three = np.sort(tokens.shingles(own_words, 3))
            triples[i] = (1 + np.count_nonzero(three[1:] != three[:-1])) / len(three)
            line = line_of[at[i] : at[i + 1]]
            first = np.flatnonzero(np.concatenate(([True], line[1:] != line[:-1])))
            sums = np.sort(np.add.reduceat(own_words, first))
            n_lines[i], lines[i] = len(sums), 1 + np.count_nonzero(sums[1:] != sums[:-1])
        x = out[row:end]
        x[:, 0] = np.log1p(n)
        x[:, 1] = np.log((inside + 1) / (n + 1))
        x[:, 2] = _share(np.abs(inside - 5 * n), n)
        x[:, 3] = _share(kinds[:, 2], letters)
        x[:, 4] = _share(kinds[:, 5], inside)
        x[:, 5] = _share(kinds[:, 3], inside)
        x[:, 6] = _share(n_lines, n)
        x[:, 7] = _share(kinds[:, 7], inside)
        x[:, 8] = _share(distinct, n)
        x[:, 9] = np.log(1.02 - triples)
        x[:, 10] = _share(n_lines - lines, n_lines)
        x[:, 11] = _share(most, n)
    return out


@dataclass(frozen=True)
class Discriminant:
    """Class means, inverse Cholesky factors and log densities at the mean, prior included; classes 0 and 1."""

    means: np.ndarray
    whiten: np.ndarray
    offset: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        """Posterior probability of class 1 from the difference of the Mahalanobis log densities."""
        logs = [self.offset[c] - 0.5 * np.square((x - self.means[c]) @ self.whiten[c].T).sum(1) for c in (0, 1)]
        return 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -500, 500)))


def fit_from_moments(count: np.ndarray, total: np.ndarray, product: np.ndarray) -> Discriminant:
    """count[c], total[c, i] and product[c, i, j]: sums over the rows of each class; both classes must have rows."""
    means = total / count[:, None]
    scatter = product - count[:, None, None] * means[:, :, None] * means[:, None, :]
    size = means.shape[1]
    pooled = scatter.sum(0) / max(count.sum() - 2, 1)
    whiten, offset = [], []
    for c in (0, 1):
        weight = (1 - TO_POOLED) * count[c] / ((1 - TO_POOLED) * count[c] + TO_POOLED * count.sum())
        cov = weight * scatter[c] / max(count[c] - 1, 1) + (1 - weight) * pooled
        cov = (1 - TO_IDENTITY) * cov + TO_IDENTITY * (np.trace(cov) / size + 1e-9) * np.eye(size)
        factor = np.linalg.cholesky(cov)
        whiten.append(np.linalg.inv(factor))
        offset.append(np.log(count[c] / count.sum()) - np.log(np.diag(factor)).sum())
    return Discriminant(means, np.array(whiten), np.array(offset))


def _statistics(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x = document_statistics(batch.column(1))
        yield pa.record_batch([batch.column(0), *(pa.array(x[:, i]) for i in range(len(FEATURES)))], names=["doc_id", *FEATURES])


def fit(statistics: DataFrame, labels: DataFrame) -> Discriminant | None:
    """The discriminant of all rows to learn from; None if a class has none."""
    rows = statistics.join(labels, "doc_id")
    pairs = [(a, b) for i, a in enumerate(FEATURES) for b in FEATURES[i:]]
    sums = rows.groupBy("label").agg(F.count("*").alias("n"), *(F.sum(a).alias(a) for a in FEATURES), *(F.sum(F.col(a) * F.col(b)).alias(f"{a}*{b}") for a, b in pairs)).collect()
    by_class = {r["label"]: r for r in sums}  # two rows
    if set(by_class) != {0, 1}:
        return None
    product = np.zeros((2, len(FEATURES), len(FEATURES)))
    for c in (0, 1):
        for a, b in pairs:
            i, j = FEATURES.index(a), FEATURES.index(b)
            product[c, i, j] = product[c, j, i] = by_class[c][f"{a}*{b}"]
    return fit_from_moments(np.array([by_class[c]["n"] for c in (0, 1)], float), np.array([[by_class[c][f] for f in FEATURES] for c in (0, 1)]), product)


def _scorer(model: Discriminant | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.column_stack([batch.column(1 + i).to_numpy() for i in range(len(FEATURES))])
            score = model.score(x) if model else np.full(len(x), 0.5)
            yield pa.record_batch([batch.column(0), pa.array(score)], names=["doc_id", "score"])

    return run


def score_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of docs: score is the probability of label 1.

    labels(doc_id, quality): rows with a null, a label other than 0 and 1, or a held-out id are not
    learned from; a document that is labelled twice counts twice.  If a class has no rows, every score
    is 0.5.  Null and empty texts are scored as texts without words.  Repeated rows get the same row
    each; an empty table gives an empty table.  Only the text is an input of the score.
    """
    schema = ", ".join(["doc_id long", *(f"{f} double" for f in FEATURES)])
    statistics = written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_statistics, schema), "statistics")
    model = fit(statistics, to_learn(labels, "quality"))
    scored = statistics.mapInArrow(_scorer(model), "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
