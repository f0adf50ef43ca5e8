"""Operators on single texts against plain Python: fingerprints, personal data, counting rules."""

import hashlib
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from roster.llm import boosting, fingerprints, pii, quality_rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")


# --- fingerprints ----------------------------------------------------------------------------------


def test_edited_texts_and_equality(documents, odd, prose):
    rows = [(3 * i, prose(5 + 7 * i % 90, i % 40) + (".\n" + prose(9, i)) * (i % 5)) for i in range(300)]
    found = {r.doc_id: r for r in fingerprints.against_next(documents(rows)).collect()}
    prints = {}
    for place, (doc, text) in enumerate(rows):
        after = rows[(place + 1) % len(rows)][1]
        quarter = len(text) // 4
        edited = text[: len(text) - quarter] + after[:quarter]
        row = found[doc]
        assert row.n_chars == len(text) and row.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= row.near_edited <= 1 and 0 <= row.near_next <= 1
        prints.setdefault(row.fingerprint, set()).add(text)
    assert all(len(texts) == 1 for texts in prints.values())
    assert len(prints) == len({t for _, t in rows})


def test_many_groups(documents, prose, monkeypatch):
    monkeypatch.setattr(fingerprints, "GROUP_ROWS", 7)
    rows = [(i * i, prose(6, i)) for i in range(100)]
    found = {r.doc_id: r.edited_sha256 for r in fingerprints.against_next(documents(rows)).collect()}
    for place, (doc, text) in enumerate(rows):
        quarter = len(text) // 4
        edited = text[: len(text) - quarter] + rows[(place + 1) % 100][1][:quarter]
        assert found[doc] == hashlib.sha256(edited.encode()).hexdigest()


def test_order_deletion_and_likeness(spark):
    parts = [f"sentence number {i} of some." for i in range(40)]
    rows = [("\n".join(parts), "\n".join(reversed(parts)), "\n".join(parts[:30]), "\n".join(parts[30:]), "\n".join(f"other {i}" for i in range(40)))]
    df = spark.createDataFrame(rows, "a string, b string, c string, d string, e string")
    v = {n: fingerprints.vector(F.col(n)) for n in df.columns}
    got = df.select(
        (v["a"] == v["b"]).alias("order"), (fingerprints.combine(v["c"], v["d"]) == v["a"]).alias("put"),
        (fingerprints.combine(v["a"], v["d"], -1) == v["c"]).alias("taken"),
        fingerprints.likeness(v["a"], v["c"]).alias("near"), fingerprints.likeness(v["a"], v["e"]).alias("far"),
    ).first()
    assert got.order and got.put and got.taken
    assert got.near == pytest.approx(2 * 30 / 70, abs=0.15) and got.far < 0.3


def test_odd_fingerprints(odd, documents):
    found = fingerprints.against_next(odd.withColumn("_sums", F.lit(1))).collect()
    assert len(found) == odd.count()
    assert len({r.fingerprint for r in found if r.n_chars == 0}) == 1
    assert fingerprints.against_next(documents([])).collect() == []
    one = fingerprints.against_next(documents(["abcdefgh"])).first()
    assert one.edited_sha256 == hashlib.sha256(b"abcdefab").hexdigest() and one.near_next == 1.0
    assert fingerprints.fingerprint(documents(["a", None])).columns[-1] == "fingerprint"


# --- personal data ---------------------------------------------------------------------------------

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        value = int(c) * (1 + i % 2)
        total += value - 9 * (value > 9)
    return total % 10 == 0


def base_spans(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            fits = {
                "email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")),
                "card": 16 <= len(digits) <= 19 and luhn(digits), "phone": 8 <= len(digits) <= 15,
            }[kind]
            if fits:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


TEXTS = [
    "mail a.b@c.de, x@y.com_foo@z.org a@b @c.d e@f..g é😀 u@v.w-1.xy.", "ip 1.2.3.4 256.1.1.1 1.2.3.4.5.6.7.8 001.002.003.255 99999999999.1.1.1",
    "card 4111 1111 1111 1111 and 4111-1111-1111-1111 and 4111111111111112 4111111111111111 5500005555555559",
    "call +1 (555) 010-9999 or +49 30 1234567. +1 +12345678901234567 +1((((((((((((", "😀" * 20 + "+1 555 0109 999",
    "7536784127813050 4845168114407329", "", None, "a@b.c" * 50, "1.1.1.1 " * 40, "4111111111111111\n4111111111111111",
]


def test_base_spans(documents, odd):
    docs = documents(TEXTS).unionByName(odd.withColumn("doc_id", F.col("doc_id") + 100))
    for r in pii.find(docs, pii.train(docs)).select("text", *pii.RESULTS).collect():
        want = base_spans(r.text or "")
        assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(w.startswith(k) for w in want) for k in pii.KINDS]
        spans = r.spans.split(",") if r.spans else []
        assert set(want) <= set(spans)
        assert spans == [f"{pii.KINDS[s.kind]}:{s.start}:{s.end}" for s in r.found]


def test_trees_add_what_looks_alike(documents):
    # half of the numbers fail their check digit but stand like cards; ids stand in quotes
    rows = []
    for i in range(400):
        number = str(4_000_000_000_000_000 + 7919 * i)
        good = next(number[:15] + d for d in "0123456789" if luhn(number[:15] + d))
        bad = number[:15] + str((int(good[15]) + 1) % 10)
        rows.append(f'paid by card {good} today' if i % 10 else f"paid by card {bad} today")
        rows.append(f'token="{bad}" here')
    docs = documents(rows)
    found = pii.find(docs, pii.train(docs)).collect()
    for i, r in enumerate(sorted(found, key=lambda r: r.doc_id)):
        assert (r.spans != "") == (i % 2 == 0), rows[i]
    kept = pii.redact(docs, pii.train(docs)).filter("text LIKE 'paid by card <CARD> today'").count()
    assert kept == 400


def test_redaction(documents):
    docs = documents(["é a.b@c.de +1 (555) 010-9999 😀 1.2.3.4.", None, "nothing"])
    assert [r.text for r in pii.redact(docs, pii.train(docs)).orderBy("doc_id").collect()] == [
        "é <EMAIL> <PHONE> 😀 <IP>.", None, "nothing",
    ]
    assert pii.find(documents([]), pii.train(documents([]))).collect() == []


def test_boosting_learns_an_interaction():
    rows = [((a, b), 50, 50 * (a ^ b)) for a in (0, 1) for b in (0, 1)] + [((0, 1), 10, 0)]
    trees = boosting.fit(rows)
    assert all((trees.margin((a, b)) > 0) == bool(a ^ b) for a in (0, 1) for b in (0, 1))


# --- counting rules --------------------------------------------------------------------------------


def counted(text):
    words = WORD.findall(text)
    triples = Counter(zip(words, words[1:], words[2:]))
    covered = {i + k for i in range(len(words) - 2) if triples[tuple(words[i : i + 3])] > 1 for k in range(3)}
    seen, again = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            again += line in seen
            seen.add(line)
    failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), again, len(covered), failed


def test_counts(documents, odd, spark):
    texts = ["a b c a b c a b", "x x x x", "one\ntwo\none\n \n \n", "#*$%&|<> é\x0bü", "a b c d", "p q r " * 60]
    docs = documents(texts).unionByName(odd.withColumn("doc_id", F.col("doc_id") + 100))
    labels = spark.createDataFrame([(5, 1), (5, 1), (104, 1), (105, 0), (None, 1)], "doc_id long, quality int")
    found = quality_rules.apply_rules(docs.withColumn("score", F.lit("x")), labels).collect()
    assert len(found) == docs.count()
    for r in found:
        own = (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed)
        assert own == counted(r.text or "")
        assert not (r.kept and r.base_failed)
    assert quality_rules.apply_rules(documents([]), labels).collect() == []


def test_ratio_prefers_the_trusted_language(documents, prose, spark):
    good = [prose(100, i, 300) for i in range(60)]
    junk = [" ".join(f"{w}!!" for w in prose(100, 900 + i, 300).split()) for i in range(60)]
    docs = documents(good + junk)
    labels = spark.createDataFrame([(i, 1) for i in range(30)], "doc_id long, quality int")
    found = {r.doc_id: r for r in quality_rules.apply_rules(docs, labels).collect()}
    assert all(found[i].kept for i in range(30)) and not any(found[i].kept for i in range(60, 120))
    assert min(found[i].score for i in range(60)) > max(found[i].score for i in range(60, 120))
    mean = {i: found[i].score for i in found}
    weight = quality_rules.weights(docs, labels)
    assert {r.doc_id: r.score for r in quality_rules.judge(docs, weight).collect()} == mean


@pytest.mark.parametrize("size", [3, 10, 40, 100])
def test_good_texts_outside_the_trusted_are_kept(documents, prose, spark, size):
    good = [prose(200, i, 100) for i in range(200)]
    junk = [" ".join(f"{w}!!" for w in prose(200, 900 + i, 100).split()) for i in range(40)]
    labels = spark.createDataFrame([(i, 1) for i in range(size)], "doc_id long, quality int")
    kept = {r.doc_id: r.kept for r in quality_rules.apply_rules(documents(good + junk), labels).collect()}
    assert sum(kept[i] for i in range(size, 200)) >= 0.95 * (200 - size)
    assert not any(kept[i] for i in range(200, 240))
