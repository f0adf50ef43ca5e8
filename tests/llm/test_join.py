import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from roster.llm import components, ngram_join

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sets_of(rows):
    out = {}
    for doc, text in rows:
        words = WORD.findall(text or "")
        grams = {tuple(words[i : i + 5]) for i in range(len(words) - 4)}
        out[doc] = frozenset(grams or ({tuple(words)} if words else set()))
    return out


def brute(rows):
    """(class_id, links) of each document, by comparing all pairs."""
    sets = sets_of(rows)
    ids = sorted(sets)
    root = {i: i for i in ids}
    links = Counter()

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in ids:
        for j in ids:
            if i < j:
                a, b = sets[i], sets[j]
                if a == b or len(a & b) >= 0.8 * len(a | b):
                    links[i] += 1
                    links[j] += 1
                    x, y = find(i), find(j)
                    root[max(x, y)] = min(x, y)
    return {i: (find(i), links[i]) for i in ids}


def changed(text, share, rng):
    words = text.split()
    for at in rng.choice(len(words), int(share * len(words)), replace=False):
        words[at] = f"new{rng.integers(1 << 30)}"
    return " ".join(words)


@pytest.fixture(scope="module")
def rows(prose):
    rng = np.random.default_rng(5)
    texts = [prose(int(rng.integers(20, 120)), 100 + i) for i in range(60)]
    base = prose(120, 7)
    texts += [changed(base, 0.02 * rng.random(), rng) for _ in range(220)]  # one large group of near copies
    texts += [changed(texts[i], 0.01 + 0.05 * rng.random(), rng) for i in range(50)]
    texts += [texts[3]] * 30 + ["", None, "one two", "two one", "one two", " \n"]
    passage = prose(40, 9)
    texts += [passage + " " + prose(100, 500 + i) for i in range(40)]  # a common passage links nobody
    return list(enumerate(texts))


@pytest.fixture(scope="module")
def truth(rows):
    return brute(rows)


def test_matches_brute_force(documents, rows, truth):
    found = ngram_join.join(documents(rows)).collect()
    assert {r.doc_id: (r.class_id, r.links) for r in found} == truth


def test_small_nodes_are_split(documents, rows, truth, monkeypatch):
    monkeypatch.setattr(ngram_join, "LEAF", 8)
    monkeypatch.setattr(ngram_join, "BLOCK", 16)
    found = ngram_join.join(documents(rows)).collect()
    assert {r.doc_id: (r.class_id, r.links) for r in found} == truth


def test_keep_one_keeps_each_class_once(documents, rows, truth):
    kept = sorted(r.doc_id for r in ngram_join.keep_one(documents(rows)).collect())
    assert kept == sorted({c for c, _ in truth.values()})


def test_odd_rows(odd, documents):
    found = ngram_join.join(odd).collect()
    assert len(found) == odd.count()
    by = defaultdict(set)
    for r in found:
        by[r.doc_id].add((r.class_id, r.links))
    assert by[5] == by[6] == {(5, 3)}  # with the repeated row and the one without id
    assert by[2] == by[3] == by[12] == {(1, 4)}
    assert by[None] == {(5, 3), (1, 4)}
    kept = [r.doc_id for r in ngram_join.keep_one(odd).collect()]
    assert sorted(kept) == [1, 4, 5, 7, 8, 9, 10, 11]
    assert ngram_join.join(documents([])).collect() == []
    wide = odd.selectExpr("*", "1 AS key", "2 AS class_id", "3 AS tokens")
    assert ngram_join.join(wide).columns == ["doc_id", "class_id", "links"]


def test_recall_formula():
    assert ngram_join.survival(1.0, 3) == pytest.approx(1.0)
    runs = ngram_join.runs_for(0.999)
    assert (1 - ngram_join.survival(0.8, ngram_join.DEPTH)) ** runs <= 0.001


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(100, 400)] + [(1000, 1000 + i) for i in range(1, 300)] + [(7, 7)]
    found = components.components(spark.createDataFrame(edges, "a long, b long")).collect()
    root = {r.node: r.root for r in found}
    assert root == {**{i: 100 for i in range(101, 401)}, **{1000 + i: 1000 for i in range(1, 300)}}


def test_texts_that_share_an_id_are_read_once(documents, prose, monkeypatch):
    texts = [prose(60, 700 + i) for i in range(12)]
    read, sets = [], ngram_join._sets

    def counted(chosen):
        read.append(chosen.count())
        return sets(chosen)

    monkeypatch.setattr(ngram_join, "_sets", counted)
    for doc_id in (None, 5):
        docs = documents([(doc_id, t) for t in texts] + [(doc_id, t + " end") for t in texts])
        assert [r.links for r in ngram_join.join(docs).collect()] == [1] * 24
    assert read == [24, 24]
