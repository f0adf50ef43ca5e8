"""Spelling variants of a corpus: its words, and for each the words one code point away.

Words are counted over all texts. Sorted, they spell a trie: a word opens a new node for each of its code
points after those it shares with the word before, and nodes are numbered as they open. The same over
the reversed words numbers what words end in. A pair (prefix node, suffix node) then says all of a
word that one position leaves: words that meet in the pair around a skipped position differ in that
code point, and a word whose pair around a skipped position is another's pair around no position has one
code point more. Joining the pairs gives exactly the neighbours, with no strings compared.

A pair has at most one word for each letter of the alphabet, and one word without the position, so no
group grows with the corpus. Words are sorted by range exchanges: tasks number their own nodes, and a row for
each task tells the next one which nodes they share.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roster.llm.common import id_text, stored
from roster.llm.ranks import ranked
from roster.llm.words import Texts, chunks

#: Words have this many code points, and are counted this often, or more.
LEAST_LENGTH, LEAST_COUNT = 5, 3
#: One distinct (document, run) in so many is misspelt on purpose, as the lexicon's test of itself.
MISSPELT = 97
#: A variant's form is at least so many times as frequent.
RATIO = 2

_A, _Z, _LATIN = ord("A"), ord("Z"), 0xC3  # UTF-8 writes U+00C0 to U+00FF as the byte C3 and one more


# --- words and counts ------------------------------------------------------------------------------


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1).astype(np.uint32)
    return table


_CRC = _crc_table()
_SHORT = 64


def crc32_after(start: np.ndarray, data: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """crc32 of byte strings that each continue another's crc32 (``start``), all in step."""
    order = np.argsort(-size, kind="stable")
    crc, begin, left = ~start[order].astype(np.uint32), begin[order], size[order]
    for step in range(min(int(left[0]) if len(left) else 0, _SHORT)):
        live = int(np.searchsorted(-left, -step, side="left"))  # those longer than ``step``
        value = data[begin[:live] + step]
        crc[:live] = _CRC[(crc[:live] ^ value) & 0xFF] ^ (crc[:live] >> np.uint32(8))
    crc = ~crc
    for i in range(int(np.searchsorted(-left, -_SHORT, side="left"))):  # the few long ones, each for itself
        crc[i] = zlib.crc32(data[begin[i] + _SHORT : begin[i] + left[i]].tobytes(), int(crc[i]))
    out = np.empty_like(crc)
    out[order] = crc
    return out


class Runs(Texts):
    """Maximal runs of letters A-Z, a-z and U+00C0 to U+00FF of some texts: ``start``, ``size`` (bytes) and ``text``.

    ``data`` has A-Z lower-cased.
    """

    def __init__(self, column: pa.Array):
        super().__init__(column)
        data = self.data
        upper = (data >= _A) & (data <= _Z)
        self.data = data = np.where(upper, data | 0x20, data).astype(np.uint8)
        lead = data == _LATIN
        inside = lead | ((data >= ord("a")) & (data <= ord("z")))
        inside[1:] |= lead[:-1]
        n = len(data)
        cuts = np.zeros(n + 1, bool)
        cuts[self.at] = True
        opens, closes = inside.copy(), inside.copy()
        if n:
            opens[1:] &= ~inside[:-1] | cuts[1:n]
            closes[:-1] &= ~inside[1:] | cuts[1:n]
        self.inside = inside
        self.start = np.flatnonzero(opens)
        self.size = np.flatnonzero(closes) + 1 - self.start
        self.text = np.searchsorted(self.at, self.start, side="right") - 1

    def words(self, ids: list[str]) -> pa.Array:
        """The runs as words; where ``MISSPELT`` divides crc32 of ``<id>:<run>``, without one code point, which the crc32 names."""
        prefix = np.array([zlib.crc32(f"{i}:".encode()) for i in ids] or [0], np.uint32)
        crc = crc32_after(prefix[self.text], self.data, self.start, self.size)
        odd = np.flatnonzero(crc % MISSPELT == 0)
        values = pa.StringArray.from_buffers(
            len(self.start), pa.py_buffer(np.concatenate(([0], np.cumsum(self.size))).astype(np.int32)),
            pa.py_buffer(self.data[self.inside]),
        )
        if not len(odd):
            return values
        changed = []
        for i in odd.tolist():
            run = self.data[self.start[i] : self.start[i] + self.size[i]].tobytes().decode()
            gone = int(crc[i]) % len(run)
            changed.append(run[:gone] + run[gone + 1 :])
        whole = np.ones(len(self.start), bool)
        whole[odd] = False
        return pa.concat_arrays([values.filter(pa.array(whole)), pa.array(changed, pa.string())])


def count_words(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(word, n) of the words of all texts with at least ``LEAST_LENGTH`` code points and ``LEAST_COUNT`` occurrences.

    Each slice of texts counts its own words before anything is exchanged. A null text has no words; a null id counts as
    an empty one. Repeated rows count again.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, "text"):
            runs = Runs(part.column("text"))
            words = runs.words(part.column("id").to_pylist())
            counted = words.filter(pa.compute.greater_equal(pa.compute.utf8_length(words), LEAST_LENGTH)).value_counts()
            yield pa.RecordBatch.from_arrays([counted.field("values"), counted.field("counts")], ["word", "n"])

    texts = docs.select(id_text(key).alias("id"), F.col(text).alias("text"))
    found = texts.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return found.filter(F.col("n") >= LEAST_COUNT)


# --- tries -----------------------------------------------------------------------------------------


def _shared(a: str, b: str) -> int:
    """How many code points two words begin with alike."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    low, high = 0, n - 1  # the first ``low`` are alike, and not ``high + 1``
    while low < high:
        middle = (low + high + 1) // 2
        low, high = (middle, high) if a[:middle] == b[:middle] else (low, middle - 1)
    return low


def _numbered(words: DataFrame, name: str, nodes: str) -> DataFrame:
    """Number the nodes of the trie of the distinct, non-empty strings ``name``, over all tasks.

    Adds ``nodes``, the node of each prefix from the empty one, 0, to the whole string. A task's nodes are numbered from 1
    as they open; the first string of the next one shares some of them, and the rest moves up by the nodes before. What
    the driver sees is one row a task, with that task's first and last string.
    """
    kind = f"{nodes} array<long>, _task int, _place long"

    def open_nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, before, path, opened, at = TaskContext.get().partitionId(), "", [0], 0, 0
        for batch in batches:
            paths = []
            for word in batch.column(name).to_pylist():
                keep = _shared(before, word)
                path = path[: keep + 1] + list(range(opened + 1, opened + 1 + len(word) - keep))
                opened += len(word) - keep
                paths.append(path)
                before = word
            more = [pa.array(paths, pa.list_(pa.int64())), pa.array([task] * batch.num_rows, pa.int32()), pa.array(range(at, at + batch.num_rows), pa.int64())]
            at += batch.num_rows
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], [*batch.schema.names, nodes, "_task", "_place"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in words.schema.fields)
    local = stored(
        words.repartitionByRange(name).sortWithinPartitions(name).mapInArrow(open_nodes, f"{fields}, {kind}"), "trie", wide=True
    )
    ends = local.groupBy("_task").agg(
        F.min_by(name, "_place").alias("first"), F.max_by(F.struct(F.col(name).alias("word"), F.col(nodes).alias("path")), "_place").alias("last"),
        F.max(F.element_at(nodes, -1)).alias("opened"),
    ).orderBy("_task").collect()
    moves, base, before, path = [], 0, "", [0]
    for end in ends:
        shared = path[: _shared(before, end["first"]) + 1]
        # nodes 0 to len(shared) - 1 of this task are ``shared``; the others are new
        shift = base - (len(shared) - 1)
        moves.append((end["_task"], shared, shift))
        before, path = end["last"]["word"], [shared[n] if n < len(shared) else n + shift for n in end["last"]["path"]]
        base += end["opened"] - (len(shared) - 1)
    moved = words.sparkSession.createDataFrame(moves, "_task int, _shared array<long>, _shift long")
    whole = F.transform(nodes, lambda n: F.when(n < F.size("_shared"), F.get("_shared", n.cast("int"))).otherwise(n + F.col("_shift")))
    return local.join(F.broadcast(moved), "_task").withColumn(nodes, whole).drop("_task", "_place", "_shared", "_shift")


def _pairs(words: DataFrame) -> DataFrame:
    """The pair dictionary: (prefix, suffix, id, kind) around every skipped position and between all positions.

    ``kind`` is 2 between positions, else 1 where the skipped code point is the first of equal ones, else 0: skipping
    another of them gives the same word, which is to be met once.
    """
    size = F.size("prefixes") - 1
    skipped = F.transform(
        F.sequence(F.lit(0), size - 1),
        lambda i: F.struct(
            F.get("prefixes", i).alias("prefix"), F.get("suffixes", size - i - 1).alias("suffix"),
            F.when((i > 0) & (F.substring("word", i, F.lit(1)) == F.substring("word", i + 1, F.lit(1))), 0).otherwise(1).alias("kind"),
        ),
    )
    between = F.transform(
        F.sequence(F.lit(0), size),
        lambda i: F.struct(F.get("prefixes", i).alias("prefix"), F.get("suffixes", size - i).alias("suffix"), F.lit(2).alias("kind")),
    )
    return words.select("id", F.inline(F.concat(skipped, between)))


_NONE = np.iinfo(np.int64).max


def _met(prefix: np.ndarray, suffix: np.ndarray, word: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, ...]:
    """(id, number of neighbours, least neighbour) of the words that meet in a pair; rows of a pair are next to each other."""
    new = np.ones(len(word), bool)
    new[1:] = (prefix[1:] != prefix[:-1]) | (suffix[1:] != suffix[:-1])
    size = np.diff(np.append(np.flatnonzero(new), len(word)))
    use = np.repeat(size > 1, size)
    word, kind, size = word[use], kind[use], size[size > 1]
    if not len(word):
        return word, word, word
    first = np.cumsum(size) - size

    def per_pair(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        least = np.minimum.reduceat(np.where(flags, word, _NONE), first)
        return np.repeat(np.add.reduceat(flags.astype(np.int64), first), size), np.repeat(least, size)

    # a word that skips the position meets the others that do, and the word without it; that one meets those that skip it
    around, top = per_pair(kind < 2)
    _, second = per_pair((kind < 2) & (word != top))
    longer, longest = per_pair(kind == 1)
    shorter, short = per_pair(kind == 2)
    near = np.where(kind == 2, longer, around - 1 + np.where(kind == 1, shorter, 0))
    other = np.where(word == top, second, top)
    best = np.where(kind == 2, longest, np.where(kind == 1, np.minimum(other, short), other))
    return word[near > 0], near[near > 0], best[near > 0]


def neighbours(words: DataFrame) -> DataFrame:
    """(id, n_near, best) of the words (id, word, prefixes, suffixes) with neighbours; ``best`` is the least id of them."""

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, np.int64)] * 4

        def found(rows: list[np.ndarray]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x) for x in _met(*rows)], ["id", "near", "best"])

        for batch in batches:
            held = [np.concatenate((h, batch.column(c).to_numpy())) for h, c in zip(held, ("prefix", "suffix", "id", "kind"))]
            if len(held[0]):
                # the last pair may go on in the next batch
                others = np.flatnonzero((held[0] != held[0][-1]) | (held[1] != held[1][-1]))
                last = int(others[-1]) + 1 if len(others) else 0
                yield found([h[:last] for h in held])
                held = [h[last:] for h in held]
        yield found(held)

    together = _pairs(words).withColumn("kind", F.col("kind").cast("long")).repartition("prefix", "suffix").sortWithinPartitions("prefix", "suffix")
    met = together.select("prefix", "suffix", "id", "kind").mapInArrow(meet, "id long, near long, best long")
    return met.groupBy("id").agg(F.sum("near").alias("n_near"), F.min("best").alias("best"))


def _last(forms: DataFrame) -> DataFrame:
    """(id, root): where following (id, form) ends; every round doubles the steps taken."""
    forms = stored(forms.select("id", F.col("form_id").alias("root")), "forms", wide=True)
    while True:
        on = forms.select(F.col("id").alias("_id"), F.col("root").alias("_root"))
        jumped = forms.join(on, F.col("root") == F.col("_id"), "left")
        if jumped.filter("_id IS NOT NULL").isEmpty():
            return forms
        forms = stored(jumped.select("id", F.coalesce("_root", "root").alias("root")), "forms", wide=True)


def variants(docs: DataFrame) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of the texts of ``docs`` (doc_id, text); see ``count_words``.

    ``form`` is the neighbour of greatest n (of equal ones the first in code-point order), if it is ``RATIO`` times as frequent
    or more; ``root`` the last of the word's form, that form's form and so on, or the word itself. Other columns are ignored.
    Empty tables, and texts without words, give no rows.
    """
    # a word's id is its place by n, greatest first, and code points: the least id of some words is the form they ask for
    counted = stored(count_words(docs).withColumn("order", -F.col("n")), "counted", wide=True)
    words = stored(ranked(counted, ["order", "word"], place="id").select("id", "word", "n"), "words", wide=True)
    forward = _numbered(words.select("id", "word"), "word", "prefixes")
    backward = _numbered(forward.withColumn("_back", F.reverse("word")), "_back", "suffixes")
    near = stored(neighbours(backward), "near", wide=True)
    named = words.select(F.col("id").alias("_id"), F.col("word").alias("_word"), F.col("n").alias("_n"))
    judged = words.join(near, "id").join(named, F.col("best") == F.col("_id")).filter(F.col("_n") >= RATIO * F.col("n"))
    forms = stored(judged.select("id", F.col("best").alias("form_id"), F.col("_word").alias("form"), F.col("_n").alias("form_n")), "forms", wide=True)
    roots = _last(forms).join(named, F.col("root") == F.col("_id")).select("id", F.col("_word").alias("root"))
    rows = words.join(near.select("id", "n_near"), "id", "left").join(forms, "id", "left").join(roots, "id", "left")
    return rows.select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n",
        F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n",
    )
