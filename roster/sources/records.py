"""Records of delimited files whose quoted values may hold line breaks, cut from blocks of lines.

Files are read as lines, in blocks that tasks take independently. Whether a line starts a record depends
on the quotes before it, which may be in other blocks. So every line is a map from the state before it
(0: between records, 1: inside quotes) to the state after it, and a block is the composition of its lines'
maps. One pass makes a row for each block; composing these rows in block order says which blocks begin inside
quotes, and a second pass cuts every block by its own. Only the ends of a record that goes over blocks
are brought together.

Lines with an even number of quotes leave the state as it is. Of the others, those whose odd quote neither
opens a value (after a separator or the line's start) nor ends one do so too: ``5" pipe`` is plain text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from roster.session import ship

ship(__name__)

SEPARATORS = (";", ",", "\t")  # fixed value: candidates, earlier wins a tie
#: A value with more bytes of lines than this is taken as one whose quote was never closed.
RECORD_BYTES = 8 << 20
SAME = (0, 1)  # the map that leaves the state as it is: what 0 and 1 become
_LAST = (1 << 63) - 1


class Quotes:
    """How lines of a file with this separator change the state."""

    def __init__(self, sep: str):
        s = re.escape(sep).encode()
        self._value = re.compile(rb'(^|' + s + rb')"[^"]*"(?=' + s + rb'|$)')
        self._opens = re.compile(rb'(?:^|' + s + rb')"[^"]*$')
        self._closes = re.compile(rb'"(?=' + s + rb'|$)')

    def _open_after(self, line: bytes) -> int:
        return int(self._opens.search(self._value.sub(rb"\1", line)) is not None)

    def map(self, line: bytes) -> tuple[int, int]:
        """The map of a line with an odd number of quotes."""
        bare = line.rstrip(b"\r").replace(b'""', b"")  # doubled quotes are text
        end = self._closes.search(bare)
        return self._open_after(bare), 1 if end is None else self._open_after(bare[end.end() :])


def compose(first: tuple[int, int], then: tuple[int, int]) -> tuple[int, int]:
    return then[first[0]], then[first[1]]


def _odd(values: pa.Array) -> np.ndarray:
    """True for values with an odd number of quotes."""
    wide = pa.types.is_large_binary(values.type) or pa.types.is_large_string(values.type)
    at = np.frombuffer(values.buffers()[1], np.int64 if wide else np.int32)[values.offset : values.offset + len(values) + 1]
    first, last = int(at[0]), int(at[-1])
    if last == first:
        return np.zeros(len(values), bool)
    quote = np.frombuffer(values.buffers()[2], np.uint8)[first:last] == ord('"')
    if not quote.any():
        return np.zeros(len(values), bool)
    total = np.concatenate(([0], np.cumsum(quote)))
    return (np.diff(total[np.asarray(at, np.int64) - first]) & 1).astype(bool)


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[tuple[str, int], pa.RecordBatch]]:
    """Slices of a batch of one block each, with (path, block)."""
    blocks, paths = batch.column("block").to_numpy(), batch.column("path")
    begin = 0
    while begin < batch.num_rows:
        block, path = blocks[begin], paths[begin].as_py()
        # blocks that follow each other differ in number or, for small files, in path
        end = begin + 1
        if blocks[-1] == block and paths[batch.num_rows - 1].as_py() == path:
            end = batch.num_rows
        else:
            while end < batch.num_rows and blocks[end] == block and paths[end].as_py() == path:
                end += 1
        yield (path, int(block)), batch.slice(begin, end - begin)
        begin = end


def text_lines(spark: SparkSession, paths: Sequence[str], glob: str | None = None) -> DataFrame:
    """(path, block, seq, value) of all lines; ``value`` is bytes, and keeps a carriage return at its end."""
    reader = spark.read.option("lineSep", "\n")
    if glob is not None:
        reader = reader.option("pathGlobFilter", glob)
    return reader.text(list(paths)).select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("seq"), F.col("value").cast("binary").alias("value"),
    )


# --- first pass ------------------------------------------------------------------------------------

_BLOCK = (
    "path string, block long, valid boolean, lines long, head binary, returns long, torn array<boolean>, "
    + ", ".join(f"map{k} array<int>" for k in range(len(SEPARATORS)))
)


def _is_utf8(values: pa.Array) -> bool:
    try:
        values.cast(pa.string())
    except pa.ArrowInvalid:
        return False
    return True


def scan_blocks(lines: DataFrame, header_line: int = 0) -> DataFrame:
    """A row for each block of ``text_lines``.

    ``valid``: it is UTF-8; ``lines``: their number; ``head``: in a file's first block its line ``header_line``, from 0;
    ``returns``: carriage returns in its first line, but at its end; for each separator ``torn``, whether quotes go over line
    ends, and the block's map.
    """
    kinds = [
        pa.string(), pa.int64(), pa.bool_(), pa.int64(), pa.binary(), pa.int64(), pa.list_(pa.bool_()),
        *[pa.list_(pa.int32())] * len(SEPARATORS),
    ]
    names = [f.split()[0] for f in _BLOCK.split(", ")]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        quotes = [Quotes(s) for s in SEPARATORS]
        at = None
        valid, count, head, returns, torn, maps = True, 0, None, 0, [], []

        def row() -> pa.RecordBatch:
            found = (*at, valid, count, head, returns, torn, *map(list, maps))
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(found, kinds)], names)

        for batch in batches:
            for here, part in _runs(batch):
                values = part.column("value")
                if here != at:
                    if at is not None:
                        yield row()
                    at, valid, count, head = here, True, 0, None
                    returns = values[0].as_py().rstrip(b"\r").count(b"\r")
                    torn, maps = [False] * len(SEPARATORS), [SAME] * len(SEPARATORS)
                valid = valid and _is_utf8(values)
                if here[1] == 0 and count <= header_line < count + len(values):
                    head = values[header_line - count].as_py()
                count += len(values)
                for i in np.flatnonzero(_odd(values)).tolist():
                    line = values[i].as_py()
                    for k, q in enumerate(quotes):
                        if (m := q.map(line)) != SAME:
                            torn[k], maps[k] = True, compose(maps[k], m)
        if at is not None:
            yield row()

    return lines.select("path", "block", "value").mapInArrow(scan, _BLOCK)


def inside_blocks(blocks: DataFrame, sep: str) -> DataFrame:
    """(path, block) of the blocks that begin inside quotes, and (path, null) of files that end so, of ``scan_blocks``."""
    name = f"map{SEPARATORS.index(sep) if sep in SEPARATORS else 0}"
    maps = F.array_sort(F.collect_list(F.struct("block", F.col(name).alias("map"))))
    walk = F.aggregate(
        maps, F.struct(F.lit(0).alias("state"), F.array().cast("array<long>").alias("found")),
        lambda acc, b: F.struct(
            F.get(b["map"], acc["state"]).alias("state"),
            F.when(acc["state"] == 1, F.array_append(acc["found"], b["block"])).otherwise(acc["found"]).alias("found"),
        ),
        lambda acc: F.concat(acc["found"], F.when(acc["state"] == 1, F.array(F.lit(None).cast("long"))).otherwise(F.array().cast("array<long>"))),
    )
    return blocks.groupBy("path").agg(walk.alias("found")).select("path", F.explode("found").alias("block"))


# --- second pass -----------------------------------------------------------------------------------

_PIECE = "path string, block long, seq long, value string, lines long, part string"


def _cut(
    lines: DataFrame, sep: str, inside: Mapping[str, Sequence[int]], header_lines: int, parts: bool, limit: int
) -> DataFrame:
    """Whole records of the lines, or, for ``parts``, what is in a block of records that go over its ends.

    ``value`` of the lines must be text. A part is ``tail``, ``through`` or ``head``: from the record's first line to the
    block's end, the whole block, or from its start to the record's last line. Parts over ``limit`` bytes have no value.
    """
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string()]
    names = [f.split()[0] for f in _PIECE.split(", ")]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        quotes = Quotes(sep)
        at, state, skip = None, 0, 0
        held: list[str] = []  # lines of the record that is open
        size = count = start = 0
        begun = False  # the open record began in this block

        def rows(out: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*out)) if out else [[] for _ in kinds]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

        def piece(kind: str) -> tuple:
            return (*at, start, "\n".join(held) if size <= limit else None, count, kind)

        def hold(line: str) -> None:
            nonlocal size, count
            size, count = size + len(line) + 1, count + 1
            if size <= limit:
                held.append(line)
            else:
                held.clear()

        for batch in batches:
            for here, part in _runs(batch):
                if parts and here[0] not in inside:
                    continue
                if here != at:
                    if at is not None and parts and count:
                        yield rows([piece("tail" if begun else "through")])
                    at, held, size, count, begun = here, [], 0, 0, False
                    state = int(here[1] in inside.get(here[0], ()))
                    skip = header_lines if here[1] == 0 else 0
                if skip:
                    gone = min(skip, part.num_rows)
                    part, skip = part.slice(gone), skip - gone
                if not part.num_rows:
                    continue
                values, seqs = part.column("value"), part.column("seq")
                flags = _odd(values)
                if not flags.any() and not state:
                    if not parts:
                        n = part.num_rows
                        yield pa.RecordBatch.from_arrays(
                            [part.column("path"), part.column("block"), seqs, values, pa.array(np.ones(n, np.int64)), pa.array(["whole"] * n)], names
                        )
                    continue
                out = []
                for line, seq, odd in zip(values.to_pylist(), seqs.to_pylist(), flags.tolist()):
                    after = quotes.map(line.encode())[state] if odd else state
                    if state == 0 and after == 0:
                        if not parts:
                            out.append((*at, seq, line, 1, "whole"))
                    else:
                        if not count:
                            start, begun = seq, state == 0
                        hold(line)
                        if after == 0:
                            # a head's record began in an earlier block
                            if begun != parts:
                                out.append(piece("whole" if begun else "head"))
                            held, size, count, begun = [], 0, 0, False
                    state = after
                yield rows(out)
        if at is not None and parts and count:
            yield rows([piece("tail" if begun else "through")])

    return lines.mapInArrow(cut, _PIECE)


def records(
    lines: DataFrame, sep: str, inside: Mapping[str, Sequence[int | None]], header_lines: int, limit: int = RECORD_BYTES
) -> DataFrame:
    """(path, block, seq, value, lines) of the records of ``lines``; block and place are those of their first line.

    ``inside`` has what ``inside_blocks`` found, by path, in blocks of the same files: Spark sizes blocks by all it reads, so
    nothing may be filtered out between the passes. ``value`` is null for a record that is never closed: its file ends inside
    quotes, or it has more than ``limit`` bytes over several lines. Blank lines between records are no records.
    """
    whole = _cut(lines, sep, inside, header_lines, False, limit)
    columns = ("path", "block", "seq", "value", "lines")
    found = whole.select(*columns)
    if inside:
        in_file = Window.partitionBy("path").orderBy("block", "seq")
        first = F.last(F.when(F.col("part") == "tail", F.struct("block", "seq")), ignorenulls=True).over(in_file)
        pieces = _cut(lines, sep, inside, header_lines, True, limit).withColumn("first", first)
        joined = pieces.groupBy("path", "first").agg(
            F.array_sort(F.collect_list(F.struct("block", "seq", "value"))).alias("parts"), F.sum("lines").alias("lines"),
            F.bool_or(F.col("part") == "head").alias("closed"), F.every(F.col("value").isNotNull()).alias("short"),
        )
        text = F.array_join(F.transform("parts", lambda p: p["value"]), "\n")
        whole_text = F.when(F.col("closed") & F.col("short") & (F.length(text) <= limit), text)
        # a record that goes on in the next block is its block's last
        stitched = joined.select("path", F.col("first.block").alias("block"), F.lit(_LAST).alias("seq"), whole_text.alias("value"), "lines")
        found = found.unionByName(stitched.select(*columns))
    return found.where(F.col("value").isNull() | (F.btrim("value", F.lit(" \t\r\n")) != ""))


# --- fields ----------------------------------------------------------------------------------------


def fault(record: Column, sep: str, columns: int) -> Column:
    """What is wrong with a record that does not have a value for each column: ``unclosed``, ``long`` or ``short``.

    Empty fields at the end of a record are none; null if nothing is wrong.
    """
    s = f"\\Q{sep}\\E"
    bare = F.replace(record, F.lit('""'), F.lit(""))
    plain = F.regexp_replace(bare, rf'(^|{s})"[^"]*+"(?={s}|$)', "$1")
    fields = F.length(plain) - F.length(F.replace(plain, F.lit(sep), F.lit(""))) + 1
    line = F.rtrim(record, F.lit("\r"))
    blank_end = F.length(line) - F.length(F.rtrim(line, F.lit(sep)))  # separators with nothing after them
    return (
        F.when(plain.rlike(rf'(?:^|{s})"[^"]*$'), "unclosed")
        .when(fields - blank_end > columns, "long")
        .when(fields < columns, "short")
    )
