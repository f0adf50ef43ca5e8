import re

import pytest
from pyspark.sql import functions as F

from roster.llm import mixing


def brute_targets(sizes):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    total, target, free = sum(sizes.values()), {}, set(names)
    while free:
        left = total - sum(target.values())
        share = left / sum(weight[s] for s in free)
        over = {s for s in free if share * weight[s] > 3 * sizes[s]}
        if not over:
            target.update({s: share * weight[s] for s in free})
            break
        target.update({s: 3 * sizes[s] for s in over})
        free -= over
    return target


def test_targets_and_budgets(documents, prose):
    rows = [(i, prose(1 + 37 * i % 300, i), None if i % 11 == 0 else "big" if i % 3 else f"s{i % 7}") for i in range(900)]
    found = mixing.mix(documents(rows)).collect()
    sizes = {}
    for r in found:
        assert r.size == len(re.findall(r"[^\x20\x09-\x0D]+", r.text))
        sizes[r.source] = sizes.get(r.source, 0) + r.size
    target = brute_targets(sizes)
    taken = {}
    for r in found:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(target[r.source])
        assert r.taken in (0, r.size, 2 * r.size, 3 * r.size) and r.taken == r.copies * r.size
        taken[r.source] = taken.get(r.source, 0) + r.taken
    for source, want in target.items():
        largest = max(r.size for r in found if r.source == source)
        assert abs(taken[source] - want) <= largest


def test_smaller_budgets_are_nested_and_reruns_agree(documents, prose):
    docs = documents([(i, prose(50, i), f"s{i % 2}") for i in range(400)])

    def taken(weights):
        return {r.doc_id for r in mixing.mix(docs, weights).filter("source = 's0' AND copies > 0").collect()}

    small, more = taken((1, 3)), taken((2, 3))
    assert small < more and taken((1, 3)) == small


def test_odd_rows(odd, documents):
    named = odd.withColumn("source", F.when(F.col("doc_id") > 4, F.col("source"))).withColumn("size", F.lit(9))
    found = mixing.mix(named).collect()
    assert len(found) == odd.count() and all(r.taken <= 3 * r.size for r in found)
    assert mixing.mix(documents([])).collect() == []
    empty = mixing.mix(documents(["", None])).collect()
    assert [(r.target, r.taken) for r in empty] == [(0.0, 0)] * 2
