"""Removal of repeated passages of 50 words, with a count-min prefilter.

A window is 50 consecutive words. It is counted by its minimiser, the 24-word run in it with the
least hash: equal windows have equal minimisers, so a minimiser comes at least as often as each of its
windows, and a text has only one in about 14 words. Every slice of texts makes a count-min sketch of
its minimisers with two rows of 2^40 cells, kept sparse as (cell, count); adding up cells merges the
sketches. What the lesser of its two cells says beyond a text's own copies is never less than
the count elsewhere, so a window without such a rest is not repeated. Only the others are grouped,
exactly, by 96 bits of their words.

Exact copies of a text are settled by the text's hash: all but the one with the least doc_id lose
every word that a window covers, and only that one takes part in the rest.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roster.llm.common import stored
from roster.llm.words import Words, chunks, first_of_run, mix, seeded

WINDOW, RUN = 50, 24
WIDTH, DEPTH = 1 << 40, 2


def minimisers(words: Words, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First word of every window and the hash of its minimiser."""
    at, runs = words.grams(hashes, RUN)
    span = WINDOW - RUN + 1
    if len(at) < span:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    ranks = seeded(runs, 7)
    # sliding minimum over `span` runs by doubling
    least, width = ranks, 1
    while width * 2 <= span:
        least = np.minimum(least[: len(least) - width], least[width:])
        width *= 2
    least = np.minimum(least[: len(ranks) - span + 1], least[span - width : span - width + len(ranks) - span + 1])
    first = at[: len(ranks) - span + 1]
    inside = words.text[first] == words.text[at[span - 1 :]]
    return first[inside], least[inside]


def _texts(docs: DataFrame) -> DataFrame:
    """(doc_id, _text, text): ``_text`` names the text beside its doc_id, so repeated ids don't mix."""
    filled = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return filled.select("doc_id", F.xxhash64("text").alias("_text"), "text")


def _runs(texts: DataFrame) -> DataFrame:
    """(doc_id, _text, run, own): every minimiser of every text and how often it comes there."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, "text"):
            words = Words(part.column("text"))
            first, runs = minimisers(words, words.hashes())
            text = words.text[first]
            new = first_of_run(runs) | first_of_run(text)
            text, runs = text[new], runs[new]
            order = np.lexsort((runs, text))
            text, runs = text[order], runs[order]
            at = np.flatnonzero(first_of_run(runs) | first_of_run(text))
            own = np.diff(np.append(at, len(runs)))
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id").take(pa.array(text[at])), part.column("_text").take(pa.array(text[at])),
                 pa.array(runs[at].view(np.int64)), pa.array(own)],
                ["doc_id", "_text", "run", "own"],
            )

    kind = texts.schema["doc_id"].dataType.simpleString()
    return texts.mapInArrow(make, f"doc_id {kind}, _text long, run long, own long")


def _cell(row: int) -> Column:
    return F.pmod(F.xxhash64("run", F.lit(row)), F.lit(WIDTH)) + row * WIDTH


def sketch(runs: DataFrame) -> DataFrame:
    """(cell, count): the merged sketch; cells of count 1 are left out, they never pass."""
    cells = runs.select(F.explode(F.array(*[_cell(row) for row in range(DEPTH)])).alias("cell"), "own")
    merged = cells.groupBy(F.struct("cell").alias("_g")).agg(F.sum("own").alias("count"))
    return merged.filter("count > 1").select("_g.cell", "count")


def suspects(texts: DataFrame, firsts: DataFrame) -> DataFrame:
    """(doc_id, _text, runs): minimisers that the sketch says come in other texts too.

    ``firsts`` has the least doc_id and the number of copies of each text.
    """
    runs = _runs(texts)
    merged = stored(sketch(runs), "sketch")
    left = runs
    for row in range(DEPTH):
        cells = merged.filter((F.col("cell") >= row * WIDTH) & (F.col("cell") < (row + 1) * WIDTH))
        named = cells.select(F.col("cell").alias("_cell"), F.col("count").alias(f"_count{row}"))
        left = left.withColumn("_at", _cell(row)).join(named, F.col("_at") == F.col("_cell")).drop("_at", "_cell")
    estimate = F.least(*[f"_count{row}" for row in range(DEPTH)])
    per_text = left.groupBy("doc_id", "_text").agg(F.collect_list(F.struct("run", "own", estimate.alias("count"))).alias("found"))
    own = firsts.select(F.col("first").alias("_first"), F.col("_text").alias("_copy"), "copies")
    return (
        per_text.join(own, (F.col("_text") == F.col("_copy")) & (F.col("doc_id") == F.col("_first")))
        .select("doc_id", "_text", F.expr("transform(filter(found, r -> r.count > r.own * copies), r -> r.run)").alias("runs"))
        .filter(F.size("runs") > 0)
    )


def _windows(texts: DataFrame) -> DataFrame:
    """(h, g, doc_id, _text, pos): the windows of texts whose minimiser is among the text's ``runs``."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, "text"):
            words = Words(part.column("text"))
            hashes = words.hashes()
            first, runs = minimisers(words, hashes)
            lists = part.column("runs")
            owner = np.repeat(np.arange(len(lists)), np.diff(np.asarray(lists.offsets)))
            wanted = mix(np.asarray(lists.flatten()).view(np.uint64) + seeded(owner.astype(np.uint64), 1))
            chosen = np.isin(mix(runs + seeded(words.text[first].astype(np.uint64), 1)), wanted)
            first = first[chosen]
            at, h = words.grams(hashes, WINDOW)
            _, g = words.grams(words.hashes(2), WINDOW)
            place = np.searchsorted(at, first)
            text = pa.array(words.text[first])
            yield pa.RecordBatch.from_arrays(
                [pa.array(h[place].view(np.int64)), pa.array((g[place] >> np.uint64(32)).astype(np.uint32).view(np.int32)),
                 part.column("doc_id").take(text), part.column("_text").take(text),
                 pa.array((first - words.first[words.text[first]]).astype(np.int32))],
                ["h", "g", "doc_id", "_text", "pos"],
            )

    kind = texts.schema["doc_id"].dataType.simpleString()
    return texts.select("doc_id", "_text", "text", "runs").mapInArrow(
        make, f"h long, g int, doc_id {kind}, _text long, pos int"
    )


def _cut(texts: DataFrame) -> DataFrame:
    """Texts without the words covered by windows at the different ``starts``, or by any window if ``copy``."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, "text"):
            rows = []
            for text, starts, copy in zip(part.column("text").to_pylist(), part.column("starts"), part.column("copy").to_pylist()):
                words = text.encode("utf-8", "surrogatepass").split()
                count = len(words)
                if copy and count >= WINDOW:
                    words = []
                elif starts.is_valid:
                    edge = np.zeros(count + 1, np.int64)
                    at = np.asarray(starts.values)
                    edge[at] += 1
                    np.subtract.at(edge, at + WINDOW, 1)
                    words = [words[i] for i in np.flatnonzero(np.cumsum(edge[:count]) == 0)]
                kept = b" ".join(words)
                rows.append((count, count - len(words), hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "surrogatepass")))
            n, removed, digest, kept = zip(*rows)
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(digest), pa.array(kept)],
                ["doc_id", "n_words", "n_removed", "kept_sha256", "kept"],
            )

    kind = texts.schema["doc_id"].dataType.simpleString()
    return texts.select("doc_id", "text", "starts", "copy").mapInArrow(
        make, f"doc_id {kind}, n_words long, n_removed long, kept_sha256 string, kept string"
    )


def remove_repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256, kept) of every document.

    A word goes if a window over it starts, with the same 50 words, in a document with a smaller
    doc_id. Words are separated by ASCII white space; ``kept`` has the kept ones joined by a space. A
    null text has no words. Repeated rows have the same doc_id and so keep the same words; a document
    without doc_id neither loses words nor takes them from others. Extra columns are ignored.
    """
    texts = _texts(docs)
    known = texts.filter("doc_id IS NOT NULL")
    firsts = stored(
        known.groupBy(F.struct("_text").alias("_g")).agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("copies"))
        .select("_g._text", "first", "copies"),
        "firsts",
    )
    found = stored(suspects(known, firsts), "suspects")
    windows = _windows(texts.join(found, ["doc_id", "_text"]))
    origin = windows.groupBy(F.struct("h", "g").alias("_g")).agg(F.min("doc_id").alias("_first"), F.max("doc_id").alias("_last"))
    origin = origin.filter("_first < _last").select("_g.h", "_g.g", "_first")
    starts = (
        windows.join(origin, ["h", "g"]).filter("doc_id > _first")
        .groupBy("doc_id", "_text").agg(F.collect_set("pos").alias("starts"))
    )
    copies = firsts.filter("copies > 1").select("_text", "first")
    copied = (
        known.select("doc_id", "_text").join(copies, "_text").filter("doc_id > first")
        .select("doc_id", "_text").distinct().select("doc_id", "_text", F.lit(True).alias("copy"))
    )
    state = starts.join(copied, ["doc_id", "_text"], "full")
    return _cut(texts.join(state, ["doc_id", "_text"], "left"))
