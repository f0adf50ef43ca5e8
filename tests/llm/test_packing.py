import zlib

import numpy as np
import pytest

from roster.llm import packing

tokenizers = pytest.importorskip("tokenizers")
public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("word_bpe_49k.json")


def expected(rows, size=2048):
    model = tokenizers.Tokenizer.from_file(PATH)
    out = []
    for doc, text in rows:
        ids = np.array([*model.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        for start in range(0, len(ids), size):
            piece = ids[start : start + size]
            out.append((doc, start // size, start, len(piece), zlib.crc32(piece.tobytes())))
    return out


def check(found, rows):
    def order(row):
        return tuple((x is not None, x) for x in row)

    assert sorted((tuple(r[:5]) for r in found), key=order) == sorted(expected(rows), key=order)
    filled = {}
    for r in sorted(found, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == filled.get(r.sequence_id, 0)
        filled[r.sequence_id] = r.offset + r.length
        assert filled[r.sequence_id] <= 2048
    return filled


def test_pieces_and_places(documents, prose):
    rows = [(i, prose(1 + 13 * i % 1700, i, 300) + " Don't, it's 3.14!") for i in range(200)] + [(900, "ÀÉ ﬁ İ́ ẞ…")]
    filled = check(packing.pack_documents(documents(rows), PATH).collect(), rows)
    total = sum(filled.values())
    assert len(filled) <= -(-total // 2048) + 1


def test_odd_rows(odd, documents):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    check(packing.pack_documents(odd.selectExpr("*", "1 AS length", "2 AS offset"), PATH).collect(), rows)
    assert packing.pack_documents(documents([]), PATH).collect() == []


def test_cache_starts_over(documents, prose, monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(packing, "CACHED_WORDS", 50)
    tokens = packing.WordTokens(PATH)
    for seed in range(6):
        texts = [prose(60, seed, 200), prose(5, seed, 200)]
        ids, counts = tokens.encode(pa.array(texts))
        model = tokenizers.Tokenizer.from_file(PATH)
        plain = [model.encode(t, add_special_tokens=False).ids for t in texts]
        assert ids.tolist() == sum(plain, []) and counts.tolist() == [len(p) for p in plain]


@pytest.mark.parametrize("seed", range(6))
def test_local_search_never_loses(seed):
    rng = np.random.default_rng(seed)
    lengths = rng.integers(1, 2049, 3000)
    if seed % 2:
        lengths = rng.integers(500, 1400, 3000)
    start = packing._Bins(lengths, 2048)
    start.best_fit(np.argsort(-lengths, kind="stable").tolist())
    bins, offset = packing.pack(lengths)
    fill = np.bincount(bins, lengths)
    assert fill.max() <= 2048 and len(fill) <= len(start.bins)
    assert (fill**2).sum() >= sum(f * f for f in start.fill)
    assert len(fill) >= -(-lengths.sum() // 2048)


def test_exchange_empties_a_bin():
    # best fit leaves 3 bins where 2 do
    lengths = np.array([6, 5, 5, 4, 4, 6]) * 100
    bins, _ = packing.pack(lengths, 1500)
    assert bins.max() + 1 == 2
