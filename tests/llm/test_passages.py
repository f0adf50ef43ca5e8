import hashlib
import re

import pytest
from pyspark.sql import functions as F

from roster.llm import substring_dedup

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows):
    first = {}
    split = {}
    for doc, text in rows:
        words = split[doc] = WORD.findall(text or "")
        for i in range(len(words) - 49):
            window = tuple(words[i : i + 50])
            first[window] = min(doc, first.get(window, doc))
    out = {}
    for doc, words in split.items():
        gone = set()
        for i in range(len(words) - 49):
            if first[tuple(words[i : i + 50])] < doc:
                gone.update(range(i, i + 50))
        kept = " ".join(w for i, w in enumerate(words) if i not in gone)
        out[doc] = (len(words), len(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


@pytest.fixture(scope="module")
def rows(prose):
    shared, edge = prose(75, 1), prose(50, 2)
    texts = [prose(30 + 7 * i % 200, 10 + i) for i in range(40)]
    texts += [prose(40, 100 + i) + "\n" + shared + "  " + prose(45, 200 + i) for i in range(25)]
    texts += [edge, "x " + edge, edge + " y", " ".join(edge.split()[1:]), " ".join(edge.split()[:49])]
    texts += [texts[5]] * 6 + [texts[5] + " end"] + ["same " * 120, "same " * 70, prose(60, 3) * 2, None, ""]
    texts += [prose(20, 400 + i) + " " + shared[: 380 + 5 * i] for i in range(12)]
    return [(1000 - 7 * i, t) for i, t in enumerate(texts)]


def test_matches_brute_force(documents, rows):
    found = substring_dedup.remove_repeats(documents(rows)).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in found} == brute(rows)
    assert all(hashlib.sha256(r.kept.encode()).hexdigest() == r.kept_sha256 for r in found)


def test_a_crowded_sketch_loses_nothing(documents, rows, monkeypatch):
    monkeypatch.setattr(substring_dedup, "WIDTH", 8)
    found = substring_dedup.remove_repeats(documents(rows)).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in found} == brute(rows)


def test_odd_rows(odd, documents):
    found = substring_dedup.remove_repeats(odd.withColumn("starts", F.lit(1))).collect()
    assert len(found) == odd.count()
    by = {}
    for r in found:
        by.setdefault(r.doc_id, []).append((r.n_words, r.n_removed))
    assert by[5] == [(80, 0)] and by[6] == [(80, 80)] * 2
    assert (80, 0) in by[None]  # no id, no order
    assert substring_dedup.remove_repeats(documents([])).collect() == []


def test_repeated_rows_keep_their_own_words(documents, prose):
    passage = prose(50, 1)
    late = prose(20, 3) + " " + passage + " " + prose(130, 4)
    rows = [(1, passage + " " + prose(30, 2)), (2, late), (2, late)]
    found = substring_dedup.remove_repeats(documents(rows)).collect()
    assert sorted((r.doc_id, r.n_words, r.n_removed) for r in found) == [(1, 80, 0), (2, 200, 50), (2, 200, 50)]
    assert {(r.doc_id, r.kept_sha256) for r in found} == {(d, v[2]) for d, v in brute(rows).items()}
