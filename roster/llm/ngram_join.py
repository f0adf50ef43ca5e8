"""Similarity join of documents on word 5-grams by chosen paths.

Documents with equal sets of 5-grams are one class; classes are joined where the Jaccard similarity
of their sets is at least 0.8. Candidates come from chosen paths: a set is embedded as 64 min-hash
tokens, every node of a path tree samples one token position, or two with a chance of 1/0.8 - 1, and
sends a set down the child named by its token there. Nodes of few sets are compared; larger ones are
split again, up to ``DEPTH`` times, and what is still large then is compared in blocks. Independent
runs repeat this until the chance that a pair at the threshold meets in none is under 1 - ``RECALL``.

Comparing has two steps. Sets of one node whose tokens agree often enough become neighbours; each
block reports a spanning forest of its neighbours, never pairs. Then each connected group of
neighbours is compared exactly, in blocks, on the 5-grams themselves; every block reports for each
class how many documents it is similar to, and a spanning forest of the links.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import ceil, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roster.llm.common import stored
from roster.llm.components import components
from roster.llm.words import Words, chunks, first_of_run, mix, seeded

GRAM, SIMILARITY = 5, 0.8
TOKENS = 64
#: Sets are neighbours if this share of their tokens agrees; at a similarity of 0.8 fewer do with a chance of 4e-6.
AGREE = 0.56
LEAF, DEPTH, RECALL = 200, 3, 0.9999
BLOCK = 256

_A = np.random.default_rng(11).integers(1, 1 << 63, TOKENS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = np.random.default_rng(12).integers(1, 1 << 63, TOKENS, dtype=np.uint64)


def survival(similarity: float, depth: int) -> float:
    """Chance that a pair still shares a node after ``depth`` splits of one run."""
    chance = 1.0
    for _ in range(depth):
        miss = 1 - similarity * chance
        second = 1 / similarity - 1
        chance = 1 - ((1 - second) * miss + second * miss * miss)
    return chance


def runs_for(recall: float = RECALL, similarity: float = SIMILARITY, depth: int = DEPTH) -> int:
    return ceil(log(1 - recall) / log(1 - survival(similarity, depth)))


# --- sets and tokens -------------------------------------------------------------------------------


def gram_sets(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Cuts and sorted 5-gram hashes of every text's set. A text of one to four words has one gram,
    all its words; a text without words has none."""
    words = Words(column)
    hashes = words.hashes()
    at, grams = words.grams(hashes, GRAM)
    texts = words.text[at]
    short = np.flatnonzero((words.count > 0) & (words.count < GRAM))
    if len(short):
        whole = np.zeros(len(short), np.uint64)
        for i in range(GRAM - 1):
            has = words.count[short] > i
            whole[has] = mix(whole[has] + hashes[words.first[short][has] + i])
        texts, grams = np.concatenate((texts, short)), np.concatenate((grams, whole))
    order = np.lexsort((grams, texts))
    texts, grams = texts[order], grams[order]
    new = first_of_run(texts) | first_of_run(grams)
    texts, grams = texts[new], grams[new]
    return np.searchsorted(texts, np.arange(len(words) + 1)), grams


def _set_sums(cuts: np.ndarray, values: np.ndarray) -> np.ndarray:
    return np.diff(np.concatenate((np.zeros(1, np.uint64), np.cumsum(values, dtype=np.uint64)))[cuts])


def set_keys(cuts: np.ndarray, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit keys of every set, equal for equal sets."""
    size = np.diff(cuts).astype(np.uint64)
    return mix(_set_sums(cuts, seeded(grams, 1)) + size), mix(_set_sums(cuts, seeded(grams, 2)) + size)


def tokens(cuts: np.ndarray, grams: np.ndarray) -> np.ndarray:
    """Min-hash tokens, one row of 32-bit numbers per set; an empty set's are all 0."""
    out = np.zeros((len(cuts) - 1, TOKENS), np.uint32)
    some = np.flatnonzero(np.diff(cuts) > 0)
    if len(some):
        starts = cuts[some]
        for i in range(TOKENS):
            least = np.minimum.reduceat(grams * _A[i] + _B[i], starts)
            out[some, i] = (mix(least) >> np.uint64(32)).astype(np.uint32)
    return out


def _binary_rows(values: np.ndarray) -> pa.Array:
    width = values.shape[1] * values.itemsize
    at = pa.array(np.arange(len(values) + 1, dtype=np.int32) * width)
    return pa.Array.from_buffers(pa.binary(), len(values), [None, at.buffers()[1], pa.py_buffer(np.ascontiguousarray(values))])


def _rows(column: pa.Array, dtype: type, width: int) -> np.ndarray:
    """Fixed-width binary values as rows of numbers."""
    at = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], np.uint8)[at[0] : at[-1]].view(dtype).reshape(-1, width)


def _long(values: np.ndarray) -> pa.Array:
    return pa.array(values.astype(np.uint64).view(np.int64))


def _signed(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, key, check, tokens) of every document."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, "text"):
            cuts, grams = gram_sets(part.column("text"))
            key, check = set_keys(cuts, grams)
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), part.column("text_hash"), _long(key), _long(check), _binary_rows(tokens(cuts, grams))],
                ["doc_id", "text_hash", "key", "check", "tokens"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text").mapInArrow(
        make, f"doc_id {kind}, text_hash long, key long, check long, tokens binary"
    )


# --- paths -----------------------------------------------------------------------------------------


def _children(nodes: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers and child nodes of rows with tokens ``own`` at ``nodes``: the node samples one
    position, or two with a chance of 1 / SIMILARITY - 1."""
    first = seeded(nodes, 3) % np.uint64(TOKENS)
    rows, out = [], []
    row = np.arange(len(nodes))
    step = seeded(nodes, 4) % np.uint64(TOKENS - 1) + np.uint64(1)
    twice = (seeded(nodes, 5) >> np.uint64(11)).astype(np.float64) / 2.0**53 < 1 / SIMILARITY - 1
    for chosen, position in ((np.ones(len(nodes), bool), first), (twice, (first + step) % np.uint64(TOKENS))):
        at = row[chosen]
        value = own[at, position[at].astype(np.int64)].astype(np.uint64)
        rows.append(at)
        out.append(mix(seeded(nodes[at], 6) + position[at] * np.uint64(0x9E3779B1) + (value << np.uint64(20))))
    return np.concatenate(rows), np.concatenate(out)


def _split_root(classes: DataFrame, runs: int) -> DataFrame:
    """(node, key): every class under the first nodes of every run."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = _rows(batch.column("tokens"), np.uint32, TOKENS)
            keys = np.asarray(batch.column("key"))
            for run in range(runs):
                root = np.full(len(keys), seeded(np.zeros(1, np.uint64), 100 + run)[0])
                at, nodes = _children(root, own)
                yield pa.RecordBatch.from_arrays([_long(nodes), pa.array(keys[at])], ["node", "key"])

    return classes.select("key", "tokens").mapInArrow(split, "node long, key long")


def _split(members: DataFrame) -> DataFrame:
    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes = np.asarray(batch.column("node")).view(np.uint64)
            at, below = _children(nodes, _rows(batch.column("tokens"), np.uint32, TOKENS))
            yield pa.RecordBatch.from_arrays([_long(below), batch.column("key").take(pa.array(at))], ["node", "key"])

    return members.select("node", "key", "tokens").mapInArrow(split, "node long, key long")


def _sized(rows: DataFrame) -> DataFrame:
    """Rows of nodes with company, with the node's size."""
    sizes = rows.groupBy(F.struct("node").alias("_g")).agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    return rows.join(sizes.select("_g.node", "size"), "node")


def leaves(classes: DataFrame, runs: int) -> DataFrame:
    """(node, key, size) of the nodes to be compared."""
    found = stored(_sized(stored(_split_root(classes, runs), "paths")), "nodes")
    done = found.filter(F.col("size") <= LEAF)
    for _ in range(DEPTH - 1):
        large = found.filter(F.col("size") > LEAF)
        if large.isEmpty():
            return done
        below = _split(large.join(classes.select("key", "tokens"), "key"))
        found = stored(_sized(stored(below, "paths")), "nodes")
        done = done.unionByName(found.filter(F.col("size") <= LEAF))
    return done.unionByName(found.filter(F.col("size") > LEAF))


# --- comparing in blocks ---------------------------------------------------------------------------


def in_blocks(rows: DataFrame, group: str, size: str, key: str, block: int) -> DataFrame:
    """Deal groups into pairs of blocks of about ``block`` rows: (_task, _side, and the columns).

    A group of one block is one task; a larger one has a task for each pair of its blocks, and one
    of its rows goes to as many tasks as it has blocks. Any two rows of a group meet in one task.
    """
    blocks = F.ceil(F.col(size) / block).cast("int")
    return (
        rows.withColumn("_n", blocks)
        .withColumn("_own", F.pmod(F.xxhash64(key, group), F.col("_n")).cast("int"))
        .withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
        .withColumn("_task", F.xxhash64(group, F.least("_own", "_other"), F.greatest("_own", "_other")))
        .withColumn("_side", F.when(F.col("_own") == F.col("_other"), 0).otherwise(F.when(F.col("_own") < F.col("_other"), 1).otherwise(2)))
        .drop("_n", "_own", "_other")
    )


def whole_tasks(batches: Iterator[pa.RecordBatch], limit: int = 8 << 20) -> Iterator[pa.Table]:
    """Tables of whole tasks from rows sorted by ``_task``; each holds little more than one task or ``limit`` bytes."""
    held: list[pa.RecordBatch] = []
    count = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        count += batch.nbytes
        if count >= limit:
            joined = pa.Table.from_batches(held).combine_chunks()
            tasks = np.asarray(joined.column("_task"))
            cut = int(np.searchsorted(tasks, tasks[-1]))
            if cut:
                yield joined.slice(0, cut)
                held, count = joined.slice(cut).combine_chunks().to_batches(), 0
            else:
                held = joined.to_batches()
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def forest(count: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least row connected to each of ``count`` rows by links a-b."""
    root = np.arange(count)
    while True:
        least = np.minimum(root[a], root[b])
        before = root.copy()
        np.minimum.at(root, root[a], least)
        np.minimum.at(root, root[b], least)
        np.minimum.at(root, a, least)
        np.minimum.at(root, b, least)
        root = root[root]
        if np.array_equal(root, before):
            return root


def _pairs(sides: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs a task has to compare: within a block, or across its two."""
    if sides.any():
        left, right = np.flatnonzero(sides == 1), np.flatnonzero(sides == 2)
        return np.repeat(left, len(right)), np.tile(right, len(left))
    return np.triu_indices(len(sides), 1)


def _compare(rows: DataFrame, columns: Callable[[pa.Table], dict], work: Callable[[dict, slice], tuple | None]) -> DataFrame:
    """(a, b, links): what ``work`` finds among the rows of every task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in whole_tasks(batches):
            tasks = np.asarray(whole.column("_task"))
            starts = np.flatnonzero(first_of_run(tasks))
            own = columns(whole)
            out = []
            for begin, end in zip(starts.tolist(), [*starts[1:].tolist(), len(tasks)]):
                if end - begin > 1 and (found := work(own, slice(begin, end))) is not None:
                    out.append(found)
            if out:
                arrays = [pa.array(np.concatenate(x)) for x in zip(*out)]
                yield pa.RecordBatch.from_arrays(arrays, ["a", "b", "links"])

    return rows.repartition("_task").sortWithinPartitions("_task").mapInArrow(run, "a long, b long, links long")


def _token_columns(whole: pa.Table) -> dict:
    return {
        "tokens": _rows(whole.column("tokens").chunk(0), np.uint32, TOKENS),
        "key": np.asarray(whole.column("key")), "side": np.asarray(whole.column("_side")),
    }


def _neighbours(rows: dict, at: slice) -> tuple | None:
    """Spanning forest of rows of a task whose tokens agree often enough."""
    own, keys = rows["tokens"][at], rows["key"][at]
    left, right = _pairs(rows["side"][at])
    agree = np.zeros(len(left), bool)
    for begin in range(0, len(left), 1 << 15):
        cut = slice(begin, begin + (1 << 15))
        agree[cut] = (own[left[cut]] == own[right[cut]]).sum(axis=1) >= AGREE * TOKENS
    if not agree.any():
        return None
    root = forest(len(keys), left[agree], right[agree])
    moved = np.flatnonzero(root != np.arange(len(keys)))
    return keys[moved], keys[root[moved]], np.zeros(len(moved), np.int64)


def shared(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections of some sets: products of incidence matrices of the shared members."""
    counts = np.zeros((len(sets), len(sets)), np.float32)
    members = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    order = np.argsort(members, kind="stable")
    members, owner = members[order], owner[order]
    column = np.cumsum(first_of_run(members)) - 1
    often = np.bincount(column, minlength=0)[column] > 1
    owner, column = owner[often], column[often]
    if not len(column):
        return counts
    column = np.cumsum(first_of_run(column)) - 1
    width = 4096
    for at in range(0, int(column[-1]) + 1, width):
        a, b = np.searchsorted(column, (at, at + width))
        matrix = np.zeros((len(sets), width), np.float32)
        matrix[owner[a:b], column[a:b] - at] = 1
        counts += matrix @ matrix.T
    return counts


def _set_columns(whole: pa.Table) -> dict:
    return {
        "sets": [np.frombuffer(x.as_buffer(), np.uint64) for x in whole.column("grams")],
        "key": np.asarray(whole.column("key")), "side": np.asarray(whole.column("_side")),
        "copies": np.asarray(whole.column("copies")),
    }


def _links(rows: dict, at: slice) -> tuple | None:
    """Numbers of similar documents, and a spanning forest of the links, of the rows of a task."""
    # a class whose document was read twice counts once
    one = np.unique(rows["key"][at], return_index=True)[1]
    keys, sides, copies = rows["key"][at][one], rows["side"][at][one], rows["copies"][at][one]
    sets = [rows["sets"][at][i] for i in one]
    size = np.array([len(s) for s in sets], np.float64)
    both = shared(sets).astype(np.float64)
    similar = both >= SIMILARITY * (size[:, None] + size[None, :] - both) - 1e-9
    similar &= both > 0
    if sides.any():
        similar &= sides[:, None] != sides[None, :]
    np.fill_diagonal(similar, False)
    if not similar.any():
        return None
    root = forest(len(keys), *np.nonzero(np.triu(similar)))
    some = np.flatnonzero(similar.any(axis=1))
    return keys[some], keys[root[some]], (similar @ copies)[some].astype(np.int64)


def _sets(chosen: DataFrame) -> DataFrame:
    """The 5-grams of each class, from the document that stands for it."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, "text"):
            cuts, grams = gram_sets(part.column("text"))
            at = pa.array((cuts * 8).astype(np.int32)).buffers()[1]
            data = pa.py_buffer(np.ascontiguousarray(grams))
            out = part.drop_columns(["text"]).append_column(
                "grams", pa.Array.from_buffers(pa.binary(), part.num_rows, [None, at, data])
            )
            # another text with the same doc_id is another class
            yield out.filter(pa.array(set_keys(cuts, grams)[0].view(np.int64) == np.asarray(part.column("key"))))

    schema = "key long, copies long, group long, size long, grams binary"
    return chosen.select("key", "copies", "group", "size", "text").mapInArrow(make, schema)


# --- the join --------------------------------------------------------------------------------------


def _linked(docs: DataFrame, recall: float) -> tuple[DataFrame, DataFrame]:
    """(doc_id, text_hash, key, check) of every document, and (key, check, rep, root, links) of every class."""
    texts = docs.select("doc_id", "text")
    signed = stored(_signed(texts), "signed", wide=True)
    first = F.struct(F.col("doc_id").isNull().alias("_null"), "doc_id", "text_hash")
    classes = stored(
        signed.groupBy("key", "check").agg(
            F.min(first).alias("_first"), F.count(F.lit(1)).alias("copies"), F.min("tokens").alias("tokens")
        ).select("key", "check", F.col("_first.doc_id").alias("rep"), F.col("_first.text_hash").alias("rep_hash"), "copies", "tokens"),
        "classes",
    )
    named = leaves(classes, runs_for(recall))
    blocks = in_blocks(named.join(classes.select("key", "tokens"), "key"), "node", "size", "key", 4 * BLOCK)
    near = _compare(blocks.select("_task", "_side", "key", "tokens"), _token_columns, _neighbours)
    roots = components(near.select("a", "b"))
    # groups of neighbours, with their sizes and the sets of one document of each class
    heads = roots.select(F.col("root").alias("key"), F.col("root").alias("group")).distinct()
    members = roots.select(F.col("node").alias("key"), F.col("root").alias("group")).unionByName(heads)
    sizes = members.groupBy(F.struct("group").alias("_g")).agg(F.count(F.lit(1)).alias("size")).select("_g.group", "size")
    grouped = stored(members.join(sizes, "group").join(classes.select("key", "check", "rep", "rep_hash", "copies"), "key"), "groups")
    # many texts may have one doc_id or none, so the text's hash joins too
    chosen = (
        texts.withColumn("text_hash", F.xxhash64("text"))
        .join(grouped.hint("merge"), F.col("doc_id").eqNullSafe(F.col("rep")) & (F.col("text_hash") == F.col("rep_hash")))
        .select("key", "copies", "group", "size", "text")
    )
    exact = in_blocks(_sets(chosen), "group", "size", "key", BLOCK)
    found = stored(_compare(exact.select("_task", "_side", "key", "copies", "grams"), _set_columns, _links), "links")
    linked = components(found.select("a", "b"))
    links = found.groupBy("a").agg(F.sum("links").alias("links"))
    state = (
        classes.select("key", "check", "rep", "copies")
        .join(linked, F.col("key") == F.col("node"), "left")
        .join(links, F.col("key") == F.col("a"), "left")
        .select("key", "check", "rep", F.coalesce("root", "key").alias("root"),
                (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"))
    )
    return signed.select("doc_id", "text_hash", "key", "check"), stored(state, "states")


def join(docs: DataFrame, recall: float = RECALL) -> DataFrame:
    """(doc_id, class_id, links) of every document.

    ``links`` counts the other documents whose set of word 5-grams has a Jaccard similarity of at
    least 0.8 with the document's; ``class_id`` is the least doc_id among the documents connected by
    links. Words are separated by ASCII white space and taken as they are. Documents with equal sets,
    so also all documents without words (null texts too), are similar to each other. A repeated row
    is a document like any other. A null doc_id is a document too; it names a class only if no other
    id of the class can. Extra columns are ignored.
    """
    signed, state = _linked(docs, recall)
    names = state.groupBy(F.struct("root").alias("_g")).agg(F.min("rep").alias("class_id")).select("_g.root", "class_id")
    named = stored(state.join(names, "root").select("key", "check", "class_id", "links"), "states")
    return signed.join(named, ["key", "check"]).select("doc_id", "class_id", "links")


def keep_one(docs: DataFrame, recall: float = RECALL) -> DataFrame:
    """One document of each class connected by links, with all its columns: that with the least doc_id.

    Documents without doc_id stay only where their class has no other; of rows that repeat an id and a
    text one stays.
    """
    signed, state = _linked(docs, recall)
    first = F.struct(F.col("doc_id").isNull().alias("_null"), "doc_id", F.col("text_hash").alias("_hash"))
    chosen = (
        signed.join(state.select("key", "check", "root"), ["key", "check"])
        .groupBy(F.struct("root").alias("_g")).agg(F.min(first).alias("_first")).select("_first.*")
    )
    marked = docs.withColumns({"_null_key": F.col("doc_id").isNull(), "_hash_key": F.xxhash64("text")})
    kept = marked.join(
        stored(chosen.withColumnRenamed("doc_id", "_id"), "chosen").hint("merge"),
        (F.col("_hash_key") == F.col("_hash")) & F.col("doc_id").eqNullSafe(F.col("_id")),
    )
    return kept.dropDuplicates(["doc_id", "_hash_key"]).select(*docs.columns)
