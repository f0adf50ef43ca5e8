"""Trained operators: held-out accuracy, folds, and odd rows."""

import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from roster.llm import quality_classifier, toxicity
from roster.llm.words import Words


def auc(labels, scores):
    order = np.argsort(np.argsort(scores, kind="stable")) + 1
    good = labels == 1
    return (order[good].sum() - good.sum() * (good.sum() + 1) / 2) / (good.sum() * (~good).sum())


def labelled(spark, rows, name):
    return spark.createDataFrame(rows, f"doc_id long, {name} int")


@pytest.fixture(scope="module")
def mixed_quality(documents, prose):
    rng = np.random.default_rng(3)
    texts, labels = [], []
    for i in range(400):
        text = ". ".join(prose(9, 50 * i + k).capitalize() for k in range(int(rng.integers(2, 25)))) + "."
        good = i % 4 > 0
        if not good:
            text = text.upper().replace(" ", "!! ") if i % 8 else " | ".join(text.split()[:6] * 20)
        texts.append(text)
        labels.append((i, int(good)))
    return documents(texts), labels


def test_quality_on_the_held_out_fold(spark, mixed_quality):
    docs, labels = mixed_quality
    found = quality_classifier.classify(docs, labelled(spark, labels, "quality")).toPandas().set_index("doc_id").sort_index()
    truth = np.array([q for _, q in labels])
    held = np.array([zlib.crc32(str(i).encode()) % 5 == 0 for i, _ in labels])
    assert (found.held_out == held).all() and found.score.between(0, 1).all()
    assert (found.predicted == (found.score >= 0.3)).all()
    assert auc(truth[held], found.score.to_numpy()[held]) > 0.98
    # what the held-out labels say changes nothing
    flipped = [(i, 1 - q if h else q) for (i, q), h in zip(labels, held)]
    again = quality_classifier.classify(docs, labelled(spark, flipped, "quality")).toPandas().set_index("doc_id").sort_index()
    assert np.allclose(again.score, found.score, atol=1e-9)


def test_discriminant_is_the_log_density_difference():
    rng = np.random.default_rng(1)
    size = len(quality_classifier.FEATURES)
    moments, points = {}, {}
    for label in (0, 1):
        x = rng.normal(label, 1 + label, (500, size))
        points[label] = x
        moments[label] = (500.0, x.sum(axis=0), x.T @ x)
    model = quality_classifier.discriminant(moments)
    value = rng.normal(0.5, 1, (5, size))
    logs = []
    for label in (0, 1):
        cov = np.linalg.inv(model.factors[label].T @ model.factors[label])
        gap = value - model.means[label]
        logs.append(-0.5 * np.einsum("ij,jk,ik->i", gap, np.linalg.inv(cov), gap) - 0.5 * np.linalg.slogdet(cov)[1])
    want = 1 / (1 + np.exp(-np.clip(logs[1] - logs[0], -30, 30)))
    assert np.allclose(model.score(value), want)
    assert auc(np.repeat([0, 1], 500), model.score(np.concatenate([points[0], points[1]]))) > 0.99


def test_odd_rows(spark, odd, documents):
    some = labelled(spark, [(4, 1), (5, 0), (7, 0), (9, 1), (None, 1)], "quality")
    found = quality_classifier.classify(odd.withColumn("score", F.lit("x")), some).collect()
    assert len(found) == odd.count() and all(0 <= r.score <= 1 for r in found)
    none = quality_classifier.classify(odd, labelled(spark, [], "quality")).collect()
    assert {r.score for r in none} == {0.5}
    assert quality_classifier.classify(documents([]), some).collect() == []
    toxic = toxicity.score(odd.withColumn("evidence", F.lit("x")), some.withColumnRenamed("quality", "toxic")).collect()
    assert len(toxic) == odd.count() and all(0 <= r.score <= 1 for r in toxic)
    assert {r.score for r in toxicity.score(odd, labelled(spark, [], "toxic")).collect()} == {0.5}
    assert toxicity.score(documents([]), labelled(spark, [], "toxic")).collect() == []


def test_toxicity_on_the_held_out_fold(spark, documents, prose):
    rng = np.random.default_rng(4)
    insults = ["badword", "nastyone", "vileterm"]
    texts, labels = [], []
    for i in range(600):
        words = prose(int(rng.integers(30, 200)), i, 800).split()
        toxic = i % 5 == 0
        if toxic:
            for _ in range(4):
                words.insert(int(rng.integers(len(words))), insults[rng.integers(3)])
        texts.append(" ".join(words))
        labels.append((i, int(toxic)))
    # an expression met only in other forms of a known stem
    texts += ["nastypeople " + prose(60, 5000 + i, 800) + " nastything" for i in range(10)] + [prose(60, 6000 + i, 800) for i in range(10)]
    docs = documents(texts)
    found = toxicity.score(docs, labelled(spark, labels, "toxic")).toPandas().set_index("doc_id").sort_index()
    truth = np.array([t for _, t in labels])
    held = np.array([zlib.crc32(str(i).encode()) % 4 == 2 for i, _ in labels])
    assert (found.held_out.to_numpy()[:600] == held).all() and (found.predicted == (found.score >= 0.3)).all()
    assert auc(truth[held], found.score.to_numpy()[:600][held]) > 0.97
    assert found.score.to_numpy()[600:610].mean() > found.score.to_numpy()[610:].mean()


def test_folded_counts_are_the_exact_ones(spark, documents):
    texts = ["a b a b c", "A b, c", "x y"]
    labels = spark.createDataFrame([(0, 1), (1, 0), (2, 0)], "doc_id long, label int")
    models = toxicity.fit(documents(texts).join(labels, "doc_id").select("text", "label"))
    # different bigrams: ab ba bc of the first text; ab bc xy of the others
    assert models.words.sum(axis=1).tolist() == [3, 3]
    assert models.shares.tolist() == [0.5, 0.5]


def test_words_share_no_counts(spark, documents):
    other = [f"q{i}" for i in range(3_000_000)]
    low = Words(pa.array(["vileterm"])).hashes() & np.uint64((1 << 20) - 1)
    places = np.flatnonzero(Words(pa.array([" ".join(other)])).hashes() & np.uint64((1 << 20) - 1) == low)
    assert len(places)
    toxic = [" ".join(f"p{i} vileterm" for i in range(30))]

    def evidence(words):
        texts = toxic + [" ".join(f"o{k}x{i} {w}" for i in range(300)) for k, w in enumerate(words)]
        labels = spark.createDataFrame([(i, int(i == 0)) for i in range(len(texts))], "doc_id long, label int")
        models = toxicity.fit(documents(texts).join(labels, "doc_id").select("text", "label"))
        return models.evidence(pa.array(["a vileterm b"]))[0]

    # words that agree in the low 20 bits of their hash are worth the same as any others
    alike = evidence([other[i] for i in places])
    assert alike > 0 and alike == pytest.approx(evidence([other[i + 1] for i in places]))


def test_every_word_has_its_count(spark, documents):
    texts = [" ".join(f"w{i}" for i in range(100_000))]
    labels = spark.createDataFrame([(0, 0)], "doc_id long, label int")
    models = toxicity.fit(documents(texts).join(labels, "doc_id").select("text", "label"))
    assert (models.words[0] > 0).sum() == 99_999


def test_the_first_word_is_weighed(spark, documents):
    texts = [" ".join(f"p{i} vileterm" for i in range(30)), " ".join(f"o{i} plain" for i in range(300))]
    labels = spark.createDataFrame([(0, 1), (1, 0)], "doc_id long, label int")
    models = toxicity.fit(documents(texts).join(labels, "doc_id").select("text", "label"))
    one, first, none, empty = models.evidence(pa.array(["vileterm", "Vileterm of this", "of this of", None]))
    assert one > 0 and first > none and empty == 0


def test_calibration_recovers_a_curve():
    x = np.linspace(-4, 4, 81)
    p = 1 / (1 + np.exp(-(1.5 * x - 0.7)))
    slope, offset = toxicity.calibrate(np.repeat(x, 2), np.tile([0, 1], 81), np.column_stack((1 - p, p)).ravel() * 1000)
    assert slope == pytest.approx(1.5, abs=0.01) and offset == pytest.approx(-0.7, abs=0.01)
