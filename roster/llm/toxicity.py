"""Toxicity by class-conditional Kneser-Ney models.

Toxic and ordinary texts each have a bigram model. Both share the bigram counts q(w | v) of all
training texts and differ in how much likelier than there a class uses a word,

    P_c(w | v) = q(w | v) a_c(w) / Z_c(v),

where Z_c(v) makes the words after v sum to one. The factor a_c comes from Kneser-Ney continuation
counts, in how many different bigrams of the class a word comes second, so a word that a few texts
repeat counts little. A class's count is discounted towards what the shared counts let expect of it:
by one, and by ``ERRORS`` times the sampling error. Rare expressions are smoothed by counts they
share: the expectation of a word starts from the factor of all words with the same first letters.

The score of a text is the difference of its log-likelihoods under both models (q cancels), divided
by the root of its length, and put on a scale from 0 to 1 by a logistic curve, fitted on a fold of
texts that aren't counted.

Counts are exact rows summed by Spark, by word: a word's key is 32 bits of the hash of its first
letters and 32 of its own, so no count is shared by words that merely fall together. Scoring holds
sorted keys, only of words, stems and preceding words whose factor isn't exactly 1; that loses nothing,
as all others count 1. These tables grow with the vocabulary.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roster.llm.common import id_text, join_labels, stored
from roster.llm.words import BLANKS, PUNCTUATION, Words, chunks, seeded

HALF = np.uint64(32)
#: The key that comes before the first word of every text.
START = np.uint64(0)
STEM_BYTES = 5
ERRORS = 3.0
PRIOR = 5.0
FOLDS, HELD_OUT, CALIBRATION = 4, 2, 3
THRESHOLD = 0.3
SEPARATORS = BLANKS + PUNCTUATION
ORDINARY, TOXIC = 0, 1
#: Bars of the histogram the calibration sees.
BAR, BARS = 1 / 256, 16384


class Bigrams:
    """Bigrams of lower-cased texts, each begun by ``START``: ``text`` of each, its ``pair`` hash, and the
    keys of its words."""

    def __init__(self, column: pa.Array):
        words = Words(pa.compute.utf8_lower(column), SEPARATORS)
        keys = (words.hashes(prefix=STEM_BYTES) >> HALF << HALF) | (words.hashes() >> HALF)
        at, pair = words.grams(keys, 2)
        first = words.first[:-1][words.count > 0]
        self.text = np.concatenate((words.text[at], words.text[first]))
        self.before = np.concatenate((keys[at], np.full(len(first), START)))
        self.after = np.concatenate((keys[at + 1], keys[first]))
        self.pair = np.concatenate((pair, seeded(keys[first], 2)))
        self.lengths = words.count


def discounted(counts: np.ndarray, expected: np.ndarray) -> np.ndarray:
    """Factor by which a class's counts differ from what is expected, beyond the sampling error."""
    difference = counts - expected
    rest = np.maximum(np.abs(difference) - ERRORS * np.sqrt(expected) - 1, 0)
    return (expected + np.sign(difference) * rest + 1) / (expected + 1)


def _found(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray, other: float) -> np.ndarray:
    """Values of the wanted among sorted keys; ``other`` for those not there."""
    if not len(keys):
        return np.full((*values.shape[:-1], len(wanted)), other)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, values[..., at], other)


@dataclass(frozen=True)
class Factors:
    """Factors of both classes by word and by stem, and log Z_t / Z_o by preceding word; sorted keys."""

    words: np.ndarray
    word_factors: np.ndarray
    stems: np.ndarray
    stem_factors: np.ndarray
    before: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    scale: np.ndarray = field(default_factory=lambda: np.zeros(0))

    def of(self, keys: np.ndarray) -> np.ndarray:
        """a_c of words, for both classes."""
        stems = _found(self.stems, self.stem_factors, keys >> HALF, 1.0)
        return stems * _found(self.words, self.word_factors, keys, 1.0)

    def evidence(self, column: pa.Array) -> np.ndarray:
        """Log-likelihood difference per root of the length; 0 for texts without words."""
        bigrams = Bigrams(column)
        ordinary, toxic = self.of(bigrams.after)
        logs = np.log(toxic / ordinary) - _found(self.before, self.scale, bigrams.before, 0.0)
        return np.bincount(bigrams.text, logs, len(bigrams.lengths)) / np.sqrt(np.maximum(bigrams.lengths, 1))


@dataclass(frozen=True)
class Models:
    """Continuation counts of each class by word, each class's share of them, and what scoring needs."""

    words: np.ndarray
    shares: np.ndarray
    factors: Factors

    def evidence(self, column: pa.Array) -> np.ndarray:
        return self.factors.evidence(column)


def _counts(texts: DataFrame) -> DataFrame:
    """(label, before, after, count): every different bigram of each class."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, "text"):
            found = Bigrams(part.column("text"))
            labels = np.asarray(part.column("label"))[found.text]
            _, one, count = np.unique(
                found.pair ^ seeded(labels.astype(np.uint64), 1), return_index=True, return_counts=True
            )
            yield pa.RecordBatch.from_arrays(
                [pa.array(labels[one]), pa.array(found.before[one].view(np.int64)),
                 pa.array(found.after[one].view(np.int64)), pa.array(count)],
                ["label", "before", "after", "count"],
            )

    rows = texts.select("text", F.col("label").cast("int")).mapInArrow(
        make, "label int, before long, after long, count long"
    )
    return rows.groupBy("label", "before", "after").agg(F.sum("count").alias("count"))


def _keys(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted keys and their order in the column."""
    keys = np.asarray(column).astype(np.int64).view(np.uint64)
    order = np.argsort(keys)
    return keys[order], order


def _kinds(counts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Sorted keys of words and in how many different bigrams of each class they come second, not
    counting the start of texts; the driver gets a row a word."""
    kinds = [F.count(F.when(F.col("label") == c, 1)).cast("float").alias(f"n{c}") for c in (ORDINARY, TOXIC)]
    found = counts.filter(F.col("before") != int(START)).groupBy("after").agg(*kinds).toArrow()
    keys, order = _keys(found.column("after"))
    return keys, np.stack([np.asarray(found.column(f"n{c}"), np.float32)[order] for c in (ORDINARY, TOXIC)])


def _differing(keys: np.ndarray, factors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    some = (factors != 1).any(axis=0)
    return keys[some], factors[:, some]


def _scale(counts: DataFrame, factors: Factors) -> tuple[np.ndarray, np.ndarray]:
    """log Z_t(v) / Z_o(v) by word v, unless 0: the mean factors of the words that follow, over all texts."""
    shared = counts.sparkSession.sparkContext.broadcast(factors)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            before, count = np.asarray(batch.column("before")), np.asarray(batch.column("count"))
            ordinary, toxic = shared.value.of(np.asarray(batch.column("after")).view(np.uint64))
            keys, at = np.unique(before, return_inverse=True)
            sums = [np.bincount(at, count * x, len(keys)) for x in (ordinary, toxic)]
            yield pa.RecordBatch.from_arrays([pa.array(keys), *map(pa.array, sums)], ["before", "o", "t"])

    parts = counts.select("before", "after", "count").mapInArrow(add, "before long, o double, t double")
    sums = parts.groupBy("before").agg(F.sum("o").alias("o"), F.sum("t").alias("t")).filter("o <> t")
    found = sums.select("before", F.log((F.col("t") + PRIOR) / (F.col("o") + PRIOR)).cast("float").alias("scale")).toArrow()
    keys, order = _keys(found.column("before"))
    return keys, np.asarray(found.column("scale"), np.float32)[order]


def fit(texts: DataFrame) -> Models:
    """Both models from (text, label) rows, any number of them."""
    counts = stored(_counts(texts), "bigrams")
    keys, words = _kinds(counts)
    totals = words.sum(axis=1, dtype=np.float64)
    shares = totals / max(totals.sum(), 1)
    # a bigram has one second word, so the bigrams of a stem are those of its words
    stems, stem_of = np.unique(keys >> HALF, return_inverse=True)
    by_stem = np.stack([np.bincount(stem_of, words[c], len(stems)) for c in (ORDINARY, TOXIC)])
    pool = by_stem.sum(axis=0)
    stem_factors = np.stack([discounted(by_stem[c], pool * shares[c]) for c in (ORDINARY, TOXIC)])
    pool = words.sum(axis=0)
    word_factors = np.stack(
        [discounted(words[c], pool * shares[c] * stem_factors[c][stem_of]) for c in (ORDINARY, TOXIC)]
    )
    listed = *_differing(keys, word_factors), *_differing(stems, stem_factors)
    return Models(words, shares, Factors(*listed, *_scale(counts, Factors(*listed))))


def calibrate(evidence: np.ndarray, labels: np.ndarray, counts: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic curve through counted evidence, by Newton steps; a small penalty
    keeps the slope finite where the classes part cleanly."""
    total = max(counts.sum(), 1)
    scale = max(float(np.sqrt((counts * evidence**2).sum() / total)), 1e-6)
    x = np.column_stack((evidence / scale, np.ones(len(evidence))))
    weights, penalty = np.zeros(2), np.array([0.01, 1e-3])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))
        gradient = x.T @ (counts * (labels - p)) - penalty * weights
        hessian = (x * (counts * p * (1 - p))[:, None]).T @ x + np.diag(penalty)
        step = np.clip(np.linalg.solve(hessian, gradient), -2, 2)
        weights += step
        if np.abs(step).max() < 1e-8:
            break
    return float(weights[0] / scale), float(weights[1])


def _fold() -> Column:
    return F.crc32(id_text().cast("binary")) % FOLDS


def score(docs: DataFrame, labels: DataFrame, label: str = "toxic") -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document.

    The models count the labelled texts of two folds, the calibration uses a third, and nothing is
    learned from the held-out one. Words are lower-cased runs between ASCII white space and
    punctuation. A null text, or one without words, has evidence 0 and a score like any other. Repeated rows score alike; null ids are scored and never learned from; extra columns are
    ignored. Without labels every score is 1/2.
    """
    known = labels.filter(F.col(label).isin(0, 1)).select("doc_id", F.col(label).cast("int").alias("label"))
    known = known.withColumn("_fold", _fold()).filter(F.col("_fold") != HELD_OUT)
    learned = known.filter(F.col("_fold") != CALIBRATION).select("doc_id", "label")
    models = fit(join_labels(docs.select("doc_id", "text"), learned).select("text", "label"))
    shared = docs.sparkSession.sparkContext.broadcast(models.factors)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, "text"):
            found = shared.value.evidence(part.column("text"))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(found)], ["doc_id", "evidence"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    scored = stored(docs.select("doc_id", "text").mapInArrow(weigh, f"doc_id {kind}, evidence double"), "evidence", wide=True)
    bar = F.greatest(F.least(F.round(F.col("evidence") / BAR), F.lit(BARS // 2)), F.lit(-BARS // 2)).cast("int")
    bars = (
        scored.join(known.filter(F.col("_fold") == CALIBRATION), "doc_id").groupBy(bar.alias("bar"), "label").count().toPandas()
    )
    slope, offset = calibrate(
        bars["bar"].to_numpy(float) * BAR, bars["label"].to_numpy(float), bars["count"].to_numpy(float)
    )
    log_odds = F.greatest(F.least(F.col("evidence") * slope + offset, F.lit(30.0)), F.lit(-30.0))
    probability = 1 / (1 + F.exp(-log_odds))
    return scored.select(
        "doc_id", (_fold() == HELD_OUT).alias("held_out"), probability.alias("score"),
        F.when(probability >= THRESHOLD, 1).otherwise(0).alias("predicted"),
    )
