"""Quality by a regularised quadratic discriminant over document statistics.

Every text becomes a short vector of transformed statistics. Each class has a mean and a covariance
shrunk towards the covariance of both classes and towards its own diagonal; the score of a vector
is the difference of the classes' log densities, from Mahalanobis distances under Cholesky factors
made once. Sums of the vectors and of their products are all the fit needs; Spark adds them up.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from roster.llm.common import id_text, join_labels, stored, without
from roster.llm.words import Words, chunks, first_of_run

FEATURES = (
    "words", "word_length", "upper", "symbols", "shouts", "marks", "digits", "lines", "different_words",
    "repeated_lines", "commonest_word", "repeated_triples", "sentences", "short_words", "bars", "high_bytes",
)
#: Share of the covariance of both classes and of the own diagonal in each class's covariance.
POOL, DIAGONAL = 0.1, 0.05
#: Log densities count for at most this much each way; Gaussian tails say nothing beyond.
LIMIT = 30.0
FOLDS = 5
THRESHOLD = 0.3
#: Every text counts as if so many words of plain prose stood before it, so that the ratios of very
#: short texts say little; PLAIN has the sums per such word.
PLAIN_WORDS = 8
PLAIN = {
    "upper": 0.15, "letters": 5.0, "symbols": 0.0, "shouts": 0.0, "marks": 0.08, "digits": 0.0, "lines": 0.02,
    "sentences": 0.1, "bars": 0.0, "high": 0.1,
}
PLAIN_LENGTH, PLAIN_SHORT = 6.0, 0.35


def _flags(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


_CLASSES = {
    "upper": _flags(bytes(range(65, 91))),
    "letters": _flags(bytes(range(65, 91)) + bytes(range(97, 123)) + bytes(range(128, 256))),
    "symbols": _flags(b"#*$%&<>~^=_{}[]\\@"),
    "shouts": _flags(b"!?"),
    "marks": _flags(b",;:'\"()-/"),
    "digits": _flags(b"0123456789"),
    "lines": _flags(b"\n"),
    "sentences": _flags(b"."),
    "bars": _flags(b"|"),
    "high": _flags(bytes(range(128, 256))),
}


def _repeats(texts: np.ndarray, hashes: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """Of hashes that belong to texts: how many differ in each text, and how often the commonest comes."""
    if not len(hashes):
        return np.zeros(count), np.zeros(count)
    order = np.lexsort((hashes, texts))
    texts, hashes = texts[order], hashes[order]
    new = first_of_run(texts) | first_of_run(hashes)
    at = np.flatnonzero(new)
    most = np.zeros(count)
    np.maximum.at(most, texts[at], np.diff(np.append(at, len(texts))))
    return np.bincount(texts[at], minlength=count).astype(float), most


def statistics(column: pa.Array) -> np.ndarray:
    """One row of ``FEATURES`` per text; a null or empty text has the values of no words."""
    words = Words(column)
    n = len(words)
    count = words.count.astype(float)
    more = count + PLAIN_WORDS
    sums = {k: words.per_text(flags[words.data]) + PLAIN_WORDS * PLAIN[k] for k, flags in _CLASSES.items()}
    size = words.end - words.start
    hashes = words.hashes()
    different, commonest = _repeats(words.text, hashes, n)
    at, triples = words.grams(hashes, 3)
    different_triples, _ = _repeats(words.text[at], triples, n)
    lines = Words(column, b"\n")
    different_lines, _ = _repeats(lines.text, lines.hashes(), n)
    out = np.column_stack((
        np.log(more),
        np.log((np.bincount(words.text, size, n) + PLAIN_WORDS * PLAIN_LENGTH) / more),
        np.sqrt(sums["upper"] / sums["letters"]),
        np.log(sums["symbols"] / more + 0.01),
        np.log(sums["shouts"] / more + 0.01),
        np.sqrt(sums["marks"] / more),
        np.log(sums["digits"] / more + 0.01),
        np.log(sums["lines"] / more + 0.01),
        (different + PLAIN_WORDS) / more,
        np.sqrt((lines.count - different_lines) / (lines.count + 1)),
        np.sqrt((commonest + 1) / more),
        np.sqrt((np.maximum(count - 2, 0) - different_triples) / more),
        np.sqrt(sums["sentences"] / more),
        np.sqrt((np.bincount(words.text, size <= 3, n) + PLAIN_WORDS * PLAIN_SHORT) / more),
        np.log(sums["bars"] / more + 0.01),
        np.sqrt(sums["high"] / sums["letters"]),
    ))
    return np.ascontiguousarray(out)


def _vectors(part: pa.RecordBatch) -> pa.Array:
    values = statistics(part.column("text"))
    at = pa.array(np.arange(0, values.size + 1, values.shape[1], dtype=np.int32))
    return pa.ListArray.from_arrays(at, pa.array(values.ravel()))


def vectors(docs: DataFrame, carried: str = "doc_id") -> DataFrame:
    """(``carried``, vector) of every document."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, "text"):
            yield pa.RecordBatch.from_arrays([part.column(carried), _vectors(part)], [carried, "vector"])

    schema = T.StructType([docs.schema[carried], T.StructField("vector", T.ArrayType(T.DoubleType()))])
    return docs.select(carried, "text").mapInArrow(make, schema)


@dataclass(frozen=True)
class Discriminant:
    """Means, inverse Cholesky factors and log determinants of both classes, and the log prior odds."""

    means: np.ndarray
    factors: np.ndarray
    log_dets: np.ndarray
    prior: float

    def score(self, values: np.ndarray) -> np.ndarray:
        """Probability of class 1, from 0 to 1."""
        logs = []
        for mean, factor, log_det in zip(self.means, self.factors, self.log_dets):
            scaled = (values - mean) @ factor.T
            logs.append(-0.5 * (scaled * scaled).sum(axis=1) - 0.5 * log_det)
        return 1 / (1 + np.exp(-np.clip(logs[1] - logs[0] + self.prior, -LIMIT, LIMIT)))


def discriminant(moments: dict[int, tuple[float, np.ndarray, np.ndarray]]) -> Discriminant:
    """From count, sum and sum of products of each class. A class without rows borrows the other's
    shape, so that the score is the prior."""
    size = len(FEATURES)
    total = sum(m[0] for m in moments.values())
    counts, means, covariances = [], [], []
    for label in (0, 1):
        n, s, p = moments.get(label, (0.0, np.zeros(size), np.zeros((size, size))))
        mean = s / max(n, 1)
        counts.append(n)
        means.append(mean)
        covariances.append(p / max(n, 1) - np.outer(mean, mean))
    for label in (0, 1):
        if not counts[label]:
            means[label], covariances[label] = means[1 - label], covariances[1 - label]
    pooled = sum(n * c for n, c in zip(counts, covariances)) / max(total, 1) if total else np.eye(size)
    floor = np.diag(1e-4 + 0.01 * np.diag(pooled))
    factors, log_dets = [], []
    for covariance in covariances:
        own = (1 - DIAGONAL) * covariance + DIAGONAL * np.diag(np.diag(covariance))
        lower = np.linalg.cholesky((1 - POOL) * own + POOL * pooled + floor)
        factors.append(np.linalg.inv(lower))
        log_dets.append(2 * np.log(np.diag(lower)).sum())
    prior = float(np.log(counts[1] + 1) - np.log(counts[0] + 1))
    return Discriminant(np.array(means), np.array(factors), np.array(log_dets), prior)


def fit(labelled: DataFrame) -> Discriminant:
    """From (vector, label) rows; any number of them, in one pass. Only sums reach the driver: a few
    hundred numbers per class. Rows without a label of 0 or 1 are ignored."""
    size = len(FEATURES)
    upper = [(i, j) for i in range(size) for j in range(i, size)]

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, list] = {}
        for batch in batches:
            values = np.asarray(batch.column("vector").flatten()).reshape(-1, size)
            labels = np.asarray(batch.column("label"))
            for label in (0, 1):
                own = values[labels == label]
                old = sums.setdefault(label, [0, np.zeros(size), np.zeros((size, size))])
                sums[label] = [old[0] + len(own), old[1] + own.sum(axis=0), old[2] + own.T @ own]
        rows = [(label, [float(n), *s, *(p[i, j] for i, j in upper)]) for label, (n, s, p) in sums.items() if n]
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.list_(pa.float64()))],
            ["label", "sums"],
        )

    parts = labelled.filter("label IN (0, 1)").select("vector", F.col("label").cast("int")).mapInArrow(
        add, "label int, sums array<double>"
    )
    moments = {}
    totals = parts.select("label", F.posexplode("sums")).groupBy("label", "pos").agg(F.sum("col").alias("total"))
    for label, numbers in totals.groupBy("label").agg(F.sort_array(F.collect_list(F.struct("pos", "total")))).collect():
        numbers = np.array([x["total"] for x in numbers])
        products = np.zeros((size, size))
        for (i, j), value in zip(upper, numbers[1 + size :]):
            products[i, j] = products[j, i] = value
        moments[label] = (numbers[0], numbers[1 : 1 + size], products)
    return discriminant(moments)


def held_out(folds: int = FOLDS, fold: int = 0) -> Column:
    return F.crc32(id_text().cast("binary")) % folds == fold


def train(docs: DataFrame, labels: DataFrame, label: str = "quality") -> Discriminant:
    """Fit on the labelled documents outside the held-out fold."""
    known = labels.filter(~held_out()).select("doc_id", F.col(label).alias("label"))
    return fit(vectors(join_labels(docs.select("doc_id", "text"), known), "label"))


def score(docs: DataFrame, model: Discriminant, threshold: float = THRESHOLD) -> DataFrame:
    """All columns of ``docs`` with ``score`` and ``predicted``; columns of these names are replaced."""
    base = without(docs, "score", "predicted")

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, "text"):
            found = model.score(statistics(part.column("text")))
            out = part.append_column("score", pa.array(found))
            yield out.append_column("predicted", pa.array((found >= threshold).astype(np.int32)))

    schema = T.StructType([*base.schema, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    return base.mapInArrow(add, schema)


def classify(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document.

    Statistics are taken once and kept. Empty and null texts have a score like any other. Repeated
    rows have equal scores; null ids are scored and never learned from. Without labels all have the
    score 1/2. Extra columns are ignored.
    """
    known = labels.filter(~held_out()).select("doc_id", F.col("quality").alias("label"))
    found = stored(vectors(docs), "statistics", wide=True)
    model = fit(found.join(known, "doc_id"))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.asarray(batch.column("vector").flatten()).reshape(-1, len(FEATURES))
            scores = model.score(values)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(scores), pa.array((scores >= threshold).astype(np.int32))],
                ["doc_id", "score", "predicted"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    scored = found.mapInArrow(add, f"doc_id {kind}, score double, predicted int")
    return scored.select("doc_id", held_out().alias("held_out"), "score", "predicted")
