"""Document quality by regularised quadratic discriminant analysis.

A document is described by transformed statistics of its whole text: lengths,
shares of character kinds, repetition and compressibility. Each class has a mean
and a covariance that is shrunk towards the common covariance and a multiple of
the identity. The score compares the two Gaussian log densities, Mahalanobis
distances by Cholesky factors that are made once, with the log prior.

Statistics are computed once per document and kept in the shared folder. Means
and covariances are sums over all labelled documents, added in every task before
they are added across tasks, so no sample is drawn and nothing grows.

Defined cases: null counts as the empty text and has a score; documents without
a label are scored but not learned from; where labels of one key contradict each
other the mean, rounded half up, counts; repeated rows of a key are learned from
each for itself; with labels of one class only, or of none, every score is that
class's share with one half added to either count. Empty tables give no rows.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runsieve.llm.common import held_out, labels_of, map_batches, score_column, stage, text_bytes

THRESHOLD = 0.3
#: Shares of the common covariance and of the identity in a class covariance.
TO_COMMON, TO_IDENTITY = 0.1, 0.01

FEATURES = (
    "bytes", "word_length", "upper", "digits", "marks", "symbols", "high",
    "spaces", "lines", "distinct", "top_word", "repeated_lines", "compressed",
    "ends", "marked_words",
)

_LOWER, _UPPER, _DIGIT, _MARK, _SYMBOL, _SPACE, _BREAK, _HIGH = range(8)


def _kinds() -> np.ndarray:
    kinds = np.full(256, _SYMBOL, dtype=np.uint8)
    kinds[ord("a") : ord("z") + 1] = _LOWER
    kinds[ord("A") : ord("Z") + 1] = _UPPER
    kinds[ord("0") : ord("9") + 1] = _DIGIT
    kinds[[ord(c) for c in ".,;:!?'\"()-"]] = _MARK
    kinds[[9, 11, 12, 13, 32]] = _SPACE
    kinds[10] = _BREAK
    kinds[128:] = _HIGH
    return kinds


_KIND_OF = _kinds()
_ENDS = (b".", b"!", b"?", b",", b";", b":")


#: Weight, in characters, words or lines, of the usual share in a document's own,
#: so that the statistics of very short texts stay near those of usual ones.
_PRIOR = 200.0


def _logit(part: float, whole: float, usual: float, weight: float = _PRIOR) -> float:
    return float(np.log((part + weight * usual) / (max(whole - part, 0) + weight * (1 - usual))))


def statistics(text: bytes) -> list[float]:
    """The transformed statistics of a text, in the order of ``FEATURES``."""
    size = len(text)
    kinds = np.bincount(_KIND_OF[np.frombuffer(text, dtype=np.uint8)], minlength=8).tolist()
    words = text.split()
    n = len(words)
    counts = Counter(words)
    lines = [line for line in text.split(b"\n") if line.strip()]
    letters = kinds[_LOWER] + kinds[_UPPER] + kinds[_HIGH]
    packed = len(zlib.compress(text, 1)) if size else 0
    ended = sum(count for word, count in counts.items() if word.endswith(_ENDS))
    marked = sum(count for word, count in counts.items() if not word[-1:].isalnum() and word[-1] < 128)
    return [
        float(np.log1p(size)),
        float(np.log((letters + 5 * _PRIOR) / (n + _PRIOR))),
        _logit(kinds[_UPPER], letters, 0.02),
        _logit(kinds[_DIGIT], size, 0.002),
        _logit(kinds[_MARK], size, 0.02),
        _logit(kinds[_SYMBOL], size, 0.002),
        _logit(kinds[_HIGH], letters, 0.05),
        _logit(kinds[_SPACE], size, 0.15),
        float(np.log((len(lines) + 1) / (n + _PRIOR))),
        _logit(len(counts), n, 0.6),
        _logit(max(counts.values(), default=0), n, 0.04),
        _logit(len(lines) - len(set(lines)), len(lines), 0.02, 10.0),
        float(np.log((packed + 0.4 * 500) / (size + 500))),
        _logit(ended, n, 0.1),
        _logit(marked, n, 0.1),
    ]


def described(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key`` and ``stats`` of every row."""

    def make():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows = [statistics(value) for value in text_bytes(batch.column(1))]
            return pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(rows, type=pa.list_(pa.float64()))], names=["key", "stats"]
            )

        return work

    kind = docs.schema[key].dataType.simpleString()
    lean = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("t"))
    return map_batches(lean, make, f"key {kind}, stats array<double>")


def moments(learned: DataFrame) -> dict[int, np.ndarray]:
    """Per label the sums of ``(1, x)`` times ``(1, x)``, over all rows."""
    width = len(FEATURES) + 1

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = {0: np.zeros((width, width)), 1: np.zeros((width, width))}
        for batch in batches:
            stats = np.array(batch.column(0).flatten()).reshape(batch.num_rows, -1)
            rows = np.hstack([np.ones((len(stats), 1)), stats])
            of = batch.column(1).to_numpy(zero_copy_only=False)
            for label in total:
                own = rows[of == label]
                total[label] += own.T @ own
        for label, matrix in total.items():
            if matrix[0, 0]:
                place = np.arange(width * width)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(place), label)), pa.array(place), pa.array(matrix.ravel())],
                    names=["label", "place", "value"],
                )

    summed = (
        learned.select("stats", "label")
        .mapInArrow(sums, "label long, place long, value double")
        .groupBy("label", "place")
        .agg(F.sum("value").alias("value"))
    )
    out: dict[int, np.ndarray] = {}
    for row in summed.collect():  # two matrices of fixed size
        out.setdefault(row.label, np.zeros(width * width))[row.place] = row.value
    return {label: flat.reshape(width, width) for label, flat in out.items()}


class Discriminant:
    """Two Gaussians with shrunk covariances and cached Cholesky factors."""

    def __init__(self, found: dict[int, np.ndarray], to_common: float = TO_COMMON, to_identity: float = TO_IDENTITY):
        counts = {label: found[label][0, 0] if label in found else 0.0 for label in (0, 1)}
        total = sum(counts.values())
        self.share = (counts[1] + 0.5) / (total + 1)
        self.known = min(counts.values()) > 0
        if not self.known:
            return
        means = {label: found[label][0, 1:] / counts[label] for label in (0, 1)}
        spread = {
            label: found[label][1:, 1:] / counts[label] - np.outer(means[label], means[label])
            for label in (0, 1)
        }
        common = sum(counts[label] * spread[label] for label in (0, 1)) / total
        # Statistics are put on one scale, so that the identity means the same for each.
        self.scale = np.sqrt(np.maximum(np.diag(common), 1e-9))
        common = common / np.outer(self.scale, self.scale)
        identity = np.eye(len(common))
        self.classes = []
        for label in (0, 1):
            own = spread[label] / np.outer(self.scale, self.scale)
            shrunk = (1 - to_common - to_identity) * own + to_common * common + to_identity * identity
            factor = np.linalg.cholesky(shrunk)
            constant = np.log(counts[label] / total) - np.log(np.diag(factor)).sum()
            self.classes.append((means[label], np.linalg.inv(factor), constant))

    def score(self, stats: np.ndarray) -> np.ndarray:
        """Posterior probability of label 1."""
        if not self.known:
            return np.full(len(stats), self.share)
        density = []
        for mean, inverse, constant in self.classes:
            white = ((stats - mean) / self.scale) @ inverse.T
            density.append(constant - 0.5 * (white**2).sum(axis=1))
        return 1 / (1 + np.exp(np.clip(density[0] - density[1], -500, 500)))


def fit(stats: DataFrame, labels: DataFrame, label: str = "quality", label_key: str = "doc_id") -> Discriminant:
    """Learn from labelled rows that are not held out (remainder 0)."""
    known = labels_of(labels, label, label_key)
    learned = stats.filter(~held_out("key", 0)).join(known, F.col("key") == F.col("labelled"))
    return Discriminant(moments(learned))


def classify(
    docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality",
    threshold: float = THRESHOLD,
) -> DataFrame:
    """``key``, ``held_out``, ``score`` and ``predicted`` of every document."""
    stats = stage(described(docs, key, text), "statistics")
    model = fit(stats, labels, label)

    def make():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows = np.array(batch.column(1).flatten()).reshape(batch.num_rows, -1)
            return pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(model.score(rows))], names=["key", "score"]
            )

        return work

    kind = docs.schema[key].dataType.simpleString()
    scored = map_batches(stats, make, f"key {kind}, score double")
    return scored.select(
        F.col("key").alias(key),
        held_out("key", 0).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )


def keep_good(
    docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality",
    threshold: float = THRESHOLD,
) -> DataFrame:
    """The documents predicted as label 1, all columns kept; scored by their own text."""
    model = fit(stage(described(docs, key, text), "statistics"), labels, label)


    def score(texts: list[str]) -> np.ndarray:
        return model.score(np.array([statistics(one.encode()) for one in texts]))

    return docs.filter(score_column(score)(F.col(text).cast("string")) >= threshold)
