import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from roster.llm import spelling

LETTERS = "A-Za-zÀ-ÿ"


def words_of(rows):
    """Counts of the words of (doc_id, text) rows, by the rule as it is stated."""
    import re

    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall(f"[{LETTERS}]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}


def near(a, b):
    """Exactly one inserted, deleted or replaced code point apart."""
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    short, long = sorted((a, b), key=len)
    return any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def expected(counts):
    buckets = defaultdict(list)
    for w in counts:
        buckets[len(w)].append(w)
    form, number = {}, {}
    for w in counts:
        around = [o for size in (-1, 0, 1) for o in buckets[len(w) + size] if near(w, o)]
        number[w] = len(around)
        best = min(around, key=lambda o: (-counts[o], o), default=None)
        form[w] = best if best is not None and counts[best] >= 2 * counts[w] else None
    out = []
    for w in counts:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, counts[w], number[w], counts.get(form[w])))
    return sorted(out, key=str)


def found(docs):
    return sorted((tuple(r) for r in spelling.variants(docs).collect()), key=str)


@pytest.fixture
def many_tasks(spark):
    """Range exchanges into many tasks, so tries are cut between words that share nodes."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_brute_force(documents, many_tasks):
    import random

    rng = random.Random(3)
    stems = ["".join(rng.choice("abéÿ") for _ in range(rng.randrange(4, 9))) for _ in range(160)]
    rows = []
    for i in range(150):
        words = []
        for _ in range(60):
            w = rng.choice(stems)
            if rng.random() < 0.4:
                at = rng.randrange(len(w) + 1)
                w = rng.choice([w[:at] + w[at + 1 :], w[:at] + rng.choice("abéÿ") + w[at:], w[:at] + rng.choice("abéÿ") + w[at + 1 :]])
            words.append(w.upper() if rng.random() < 0.1 else w)
        rows.append((i, rng.choice([" ", "-", "9", "\n"]).join(words)))
    # forms of forms
    for i in range(10):
        chain = "".join(rng.choice("cdef") for _ in range(9))
        for k, n in enumerate((90, 30, 10, 4)):
            rows.append((1000 + 10 * i + k, " ".join(["é" * k + chain[k:]] * n)))
    got, want = found(documents(rows)), expected(words_of(rows))
    assert got == want
    assert sum(r[1] is not None for r in got) > 50 and sum(r[2] != r[1] and r[1] is not None for r in got) > 5


def test_runs_of_equal_letters_meet_once(documents):
    """Skipping any of equal letters gives one word, which is one neighbour."""
    texts = ["aaaaa aaaaaa aaaaaaa baaaa aabaa " * 4, "aaaaa " * 20, "aaaaaaa"]
    rows = list(enumerate(texts))
    got = found(documents(rows))
    assert got == expected(words_of(rows))


def test_odd_rows(odd, documents, spark):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    long = "ab" * 20_000
    rows += [(50, f"{long} {long} {long}x {long}x {long}x {long}x {long}"), (51, f"{long} x{long}")] + [(60 + i, "Straße straße STRAßE ×÷ ÀÿÀÿÀ") for i in range(4)]
    got = found(documents(rows).selectExpr("doc_id", "text", "1 AS id", "2 AS word", "3 AS n", "4 AS _task"))
    assert got == expected(words_of(rows))
    assert found(documents([(1, None), (2, ""), (3, "1 2 3")])) == []
    assert found(spark.createDataFrame([], "doc_id long, text string")) == []


def test_crc32_in_step():
    data = np.frombuffer(b"abcdefgh" * 40, np.uint8)
    start = np.array([zlib.crc32(b"7:"), zlib.crc32(b":"), zlib.crc32(b"x:"), 0], np.uint32)
    begin, size = np.array([0, 3, 8, 1]), np.array([5, 0, 300, 64])
    want = [zlib.crc32(data[b : b + n].tobytes(), int(s)) for s, b, n in zip(start, begin, size)]
    assert spelling.crc32_after(start, data, begin, size).tolist() == want


def test_runs_keep_letters_of_two_bytes_together():
    runs = spelling.Runs(pa.array(["Éa×b é", None, "ΩaĀb", "ZZ"]))
    words = [bytes(runs.data[s : s + n]).decode() for s, n in zip(runs.start, runs.size)]
    assert words == ["Éa×b", "é", "a", "b", "zz"] and runs.text.tolist() == [0, 0, 2, 2, 3]
