"""Best-fit packing of token sequences by swap-based local search.

Documents become token ids; those longer than a sequence are cut into full pieces and a rest. The
pieces, as (key, length) rows without text, are dealt by hash into shards of a bounded number of
pieces. A shard starts from best-fit decreasing and then improves the sum of squared fills by
moving pieces between underfull bins: a piece into a gap, one piece against one that fills more, one
piece against two, until no exchange fills a bin better; bins that run empty are saved.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roster.llm.common import stored, without
from roster.llm.words import Words, chunks

SEQUENCE = 2048
SHARD_PIECES = 20_000
CACHED_WORDS = 800_000
ROUNDS = 4

_state: dict = {}


class WordTokens:
    """Token ids of texts under a tokenizer that never joins across ASCII white space.

    Each different word of a slice is looked up once; a worker keeps the ids of the words it has
    met, up to ``CACHED_WORDS``, and then starts over.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.hashes = np.zeros(0, np.uint64)
        self.begin = np.zeros(0, np.int64)
        self.length = np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.uint32)

    def _learn(self, hashes: np.ndarray, words: list[str]) -> None:
        if len(self.hashes) + len(hashes) > CACHED_WORDS:
            self.hashes, self.begin, self.length, self.ids = self.hashes[:0], self.begin[:0], self.length[:0], self.ids[:0]
        found = [e.ids for e in self.model.encode_batch_fast(words, add_special_tokens=False)]
        length = np.fromiter(map(len, found), np.int64, len(found))
        begin = len(self.ids) + np.cumsum(length) - length
        flat = np.fromiter((i for ids in found for i in ids), np.uint32, int(length.sum()))
        self.ids = np.concatenate((self.ids, flat))
        order = np.argsort(np.concatenate((self.hashes, hashes)), kind="stable")
        self.hashes = np.concatenate((self.hashes, hashes))[order]
        self.begin = np.concatenate((self.begin, begin))[order]
        self.length = np.concatenate((self.length, length))[order]

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids, one text after the other, and the number of ids of each text."""
        words = Words(column)
        different, one, which = np.unique(words.hashes(), return_index=True, return_inverse=True)
        at = np.searchsorted(self.hashes, different)
        known = np.zeros(len(different), bool)
        if len(self.hashes):
            known = self.hashes[np.minimum(at, len(self.hashes) - 1)] == different
        if not known.all():
            new = one[~known] if len(self.hashes) + (~known).sum() <= CACHED_WORDS else one
            data = words.data.tobytes()
            strings = [data[a:b].decode("utf-8", "replace") for a, b in zip(words.start[new].tolist(), words.end[new].tolist())]
            if len(new) == len(one):
                self.hashes, self.begin, self.length, self.ids = self.hashes[:0], self.begin[:0], self.length[:0], self.ids[:0]
            self._learn(different[~known] if len(new) < len(one) else different, strings)
            at = np.searchsorted(self.hashes, different)
        begin, length = self.begin[at][which], self.length[at][which]
        total = np.cumsum(length)
        place = np.arange(int(total[-1]) if len(total) else 0) - np.repeat(total - length, length) + np.repeat(begin, length)
        per_text = np.diff(np.concatenate(([0], total))[words.first]) if len(total) else np.zeros(len(words), np.int64)
        return self.ids[place], per_text


def _tokens(path: str) -> WordTokens:
    if _state.get("path") != path:
        _state.update(path=path, tokens=WordTokens(path))
    return _state["tokens"]


def pieces(docs: DataFrame, tokenizer: str, size: int = SEQUENCE) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): every document's ids and a final id 0, cut to ``size``.

    A null text is empty and has the id 0 alone. Texts don't leave the task that reads them.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, "text"):
            ids, counts = _tokens(tokenizer).encode(part.column("text"))
            ends = np.cumsum(counts)
            out: list[tuple] = []
            for doc, (a, b) in enumerate(zip((ends - counts).tolist(), ends.tolist())):
                own = np.append(ids[a:b], np.uint32(0)).astype("<u4")
                for start in range(0, len(own), size):
                    piece = own[start : start + size]
                    out.append((doc, start // size, start, len(piece), zlib.crc32(piece.tobytes())))
            doc, piece, start, length, crc = (np.array(x, np.int64) for x in zip(*out))
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id").take(pa.array(doc)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc)],
                ["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        cut, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long"
    )


class _Bins:
    """Bins of pieces, found by fill; pieces of underfull bins, found by length."""

    def __init__(self, lengths: np.ndarray, size: int):
        self.size, self.lengths = size, lengths.tolist()
        self.bins: list[list[int]] = []
        self.fill: list[int] = []

    def best_fit(self, order: list[int]) -> None:
        """Each piece, longest first, goes where it leaves the smallest gap."""
        open_at: dict[int, list[int]] = {}
        gaps: list[int] = []
        for item in order:
            length = self.lengths[item]
            at = bisect_left(gaps, length)
            if at == len(gaps):
                bin_, gap = len(self.bins), self.size
                self.bins.append([])
                self.fill.append(0)
            else:
                gap = gaps[at]
                bin_ = open_at[gap].pop()
                if not open_at[gap]:
                    del open_at[gap]
                    gaps.pop(at)
            self.bins[bin_].append(item)
            self.fill[bin_] += length
            if left := gap - length:
                if left not in open_at:
                    insort(gaps, left)
                    open_at[left] = []
                open_at[left].append(bin_)

    def _move(self, item: int, source: int, target: int) -> None:
        self.bins[source].remove(item)
        self.bins[target].append(item)
        self.fill[source] -= self.lengths[item]
        self.fill[target] += self.lengths[item]

    def _grows(self, taker: int, first: int, second: int, own: int, a: int, b: int) -> bool:
        """Does the sum of squared fills grow if ``a`` and ``b`` come from two bins and ``own`` goes to the first?"""
        change = {taker: self.lengths[a] + self.lengths[b] - self.lengths[own]}
        change[first] = change.get(first, 0) + self.lengths[own] - self.lengths[a]
        change[second] = change.get(second, 0) - self.lengths[b]
        return sum((self.fill[k] + d) ** 2 - self.fill[k] ** 2 for k, d in change.items()) > 0

    def improve(self) -> bool:
        """One round over the underfull bins, fullest first; true if any exchange was made.

        The emptier bins give, the fuller ones take; every exchange adds to the fuller bin's fill, so
        the sum of squared fills grows.
        """
        under = sorted((b for b in range(len(self.bins)) if 0 < self.fill[b] < self.size), key=lambda b: self.fill[b])
        rank = {b: i for i, b in enumerate(under)}
        where = {item: b for b in under for item in self.bins[b]}
        by_length: dict[int, list[int]] = {}
        for item in sorted(where, key=lambda i: -rank[where[i]]):  # pieces of the emptiest bins come last
            by_length.setdefault(self.lengths[item], []).append(item)
        known = sorted(by_length)
        changed = False

        def giver(length: int, taker: int) -> int | None:
            """A piece of that length from a bin emptier than ``taker``; stale entries go."""
            found = by_length.get(length)
            while found and where.get(found[-1]) is None:
                found.pop()
            if found and rank[where[found[-1]]] < rank[taker] and self.fill[where[found[-1]]] <= self.fill[taker]:
                return found[-1]
            return None

        def take(item: int, target: int) -> None:
            self._move(item, where[item], target)
            where[item] = target

        for bin_ in reversed(under):
            if not self.fill[bin_]:
                continue
            while gap := self.size - self.fill[bin_]:
                best: tuple[int, tuple] | None = None
                # move: the longest piece that fits
                at = bisect_right(known, gap) - 1
                for length in known[max(0, at - 8) : at + 1][::-1]:
                    if (item := giver(length, bin_)) is not None:
                        best = (length, (None, (item,)))
                        break
                # one against one, and one against two
                for own in self.bins[bin_] if best is None or best[0] < gap else ():
                    room = self.lengths[own] + gap
                    at = bisect_right(known, room) - 1
                    for length in known[max(0, at - 4) : at + 1][::-1]:
                        gain = length - self.lengths[own]
                        if gain <= (best[0] if best else 0):
                            break
                        if (item := giver(length, bin_)) is not None:
                            best = (gain, (own, (item,)))
                            break
                    if best and best[0] == gap:
                        break
                    half = bisect_right(known, room // 2) - 1
                    for first in known[max(0, half - 6) : half + 1][::-1]:
                        a = giver(first, bin_)
                        at = bisect_right(known, room - first) - 1
                        if a is None or at < 0:
                            continue
                        second = known[at]
                        gain = first + second - self.lengths[own]
                        if gain <= (best[0] if best else 0):
                            continue
                        b = giver(second, bin_)
                        if b is not None and b != a and self._grows(bin_, where[a], where[b], own, a, b):
                            best = (gain, (own, (a, b)))
                            if gain == gap:
                                break
                    if best and best[0] == gap:
                        break
                if best is None:
                    break
                gain, (own, items) = best
                source = where[items[0]]
                if own is not None and self.fill[source] - sum(self.lengths[i] for i in items if where[i] == source) + self.lengths[own] > self.size:
                    break
                for item in items:
                    take(item, bin_)
                if own is not None:
                    take(own, source)
                changed = True
            # a settled bin neither gives nor takes any more
            for item in self.bins[bin_]:
                where[item] = None
        return changed


def pack(lengths: np.ndarray, size: int = SEQUENCE, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of every piece, for pieces of at most ``size``."""
    bins = _Bins(lengths, size)
    bins.best_fit(np.argsort(-lengths, kind="stable").tolist())
    for _ in range(rounds):
        if not bins.improve():
            break
    bin_of, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    for number, items in enumerate(b for b in bins.bins if b):
        inside = lengths[items]
        bin_of[items] = number
        offset[items] = np.cumsum(inside) - inside
    return bin_of, offset


def pack_documents(docs: DataFrame, tokenizer: str, size: int = SEQUENCE, shard_pieces: int = SHARD_PIECES) -> DataFrame:
    """Pack all documents: (doc_id, piece, start, length, ids_crc32, sequence_id, offset) per piece.

    Repeated rows are packed as often as they come; null ids and texts are packed too. Further
    columns are ignored. At most one or two sequences per shard stay underfull.
    """
    cut = stored(pieces(docs, tokenizer, size), "pieces", wide=True)
    shards = cut.agg(F.ceil(F.count(F.lit(1)) / F.lit(shard_pieces))).first()[0] or 1

    def settle(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["doc_id", "piece", "ids_crc32"], ignore_index=True)
        bin_of, offset = pack(part["length"].to_numpy(), size)
        return part.assign(sequence_id=part["_shard"] * (1 << 32) + bin_of, offset=offset).drop(columns="_shard")

    shard = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(shards)).alias("_shard")
    out = without(cut, "sequence_id", "offset")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in out.schema) + ", sequence_id long, offset long"
    return out.select("*", shard).groupBy("_shard").applyInPandas(settle, schema)
