"""Reading folders of delimited files with mixed separators, encodings and headers.

Every column is text. One pass over the bytes finds, per block, whether its lines are valid UTF-8, what a file's
first line is and what quotes do to line ends; per file that is a table, and one row for each
(header, separator, encoding) reaches the driver, with the paths a reader has to be given. Files of one such
kind are then read by one scan. Files whose quoted values hold line breaks are cut into records block by block
(``records``), so any file is read by many tasks.
"""

from __future__ import annotations

import csv
import os
import re
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from roster.functions.text import column, strip, windows_1252
from roster.operators.merge import merge_sources
from roster.session import cut_lineage
from roster.sources.records import SEPARATORS, fault, inside_blocks, records, scan_blocks, text_lines

SOURCE = "source_file"
ORDER = "row_order"  # struct (path, block, sequence): sorts rows as they stand in the files
REASON, RECORD = "reason", "record"
LISTS = "{*.csv,part-*.txt}"  # files that are read as lists: also those of ``writers.write_sources``
UTF8, SINGLE_BYTE = "UTF-8", "windows-1252"
_BAD, _LINES = "_bad_record", "_lines"


@dataclass(frozen=True)
class Reading:
    """Files that one scan can read: equal in header, separator, encoding and in whether quotes go over line ends."""

    header: tuple[str, ...]
    sep: str
    encoding: str
    torn: bool
    paths: tuple[str, ...]


@dataclass(frozen=True)
class Folder:
    """What the probe found out: a row per file in ``files``, and the files to read, by kind, in order of their paths.

    ``files``: path, source_file, encoding, sep, head (the header line), lines, torn. Files without any line have no head.
    """

    seen: DataFrame
    blocks: DataFrame
    names: tuple[str, ...]
    readings: tuple[Reading, ...]
    root: str
    header_line: int

    @property
    def spark(self) -> SparkSession:
        return self.blocks.sparkSession

    @property
    def files(self) -> DataFrame:
        listed = self.spark.createDataFrame([(n,) for n in self.names], "path string").select(_decoded(F.col("path")).alias("path"))
        return (
            listed.join(self.seen, "path", "left").withColumn(SOURCE, _source(F.col("path"), self.root))
            .withColumns({"encoding": F.coalesce("encoding", F.lit(UTF8)), "sep": F.coalesce("sep", F.lit(",")), "lines": F.coalesce("lines", F.lit(0))})
        )


def find_separator(line: str) -> str:
    """The most frequent separator of a line; a comma when there is none."""
    best = max(SEPARATORS, key=line.count)
    return best if best in line else ","


def _header(line: str, sep: str) -> tuple[str, ...]:
    """Column names of a header line; a repeated name gets a number."""
    names: list[str] = []
    for place, raw in enumerate(next(csv.reader([line.lstrip("\ufeff")], delimiter=sep))):
        base = raw if raw != "" else f"Unnamed: {place}"
        name, n = base, 0
        while name.lower() in (k.lower() for k in names):
            n += 1
            name = f"{base}.{n}"
        names.append(name)
    return tuple(names)


def _literal(path: str) -> str:
    """A path for a reader, which takes some characters as patterns."""
    return re.sub(r"([\[\]{}*?\\])", r"\\\1", path)


def _plain_path(uri: str) -> str:
    """A path Spark reports, in the one form it can be read by again."""
    return unquote(re.sub("^file:/+", "file:/", uri))


def _decoded(uri: Column) -> Column:
    """A path without percent-encoding; a plus stands for itself."""
    return F.regexp_replace(F.url_decode(F.replace(uri, F.lit("+"), F.lit("%2B"))), "^file:/+", "file:/")


def _source(path: Column, root: str) -> Column:
    """A file's name, or its path from ``root``, the folder that all files are under."""
    return F.substring(path, F.lit(len(root) + 1), F.length(path))


def probe(
    spark: SparkSession,
    path: str | Sequence[str],
    glob: str = LISTS,
    sep: str | None = None,
    encoding: str | None = None,
    header_line: int = 0,
) -> Folder:
    """Encoding, separator, header and line ends of every file, from one scan of all bytes.

    ``sep`` and ``encoding`` override what the files show. ``header_line`` counts from 0. Where files lie in several
    folders, ``source_file`` has their path from the folder that holds all of them, so equal names stay apart.
    """
    paths = [path] if isinstance(path, str) else list(path)
    # the listing Spark's readers make on the driver anyway; scans don't show empty files
    names = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(paths).inputFiles()
    blocks = cut_lineage(scan_blocks(text_lines(spark, paths, glob), header_line))
    seen = blocks.groupBy(_decoded(F.col("path")).alias("path")).agg(
        F.every("valid").alias("valid"), F.sum("lines").alias("lines"), F.max("head").alias("head"),
        F.max(F.when(F.col("block") == 0, F.col("returns"))).alias("returns"),
        *[F.bool_or(F.get("torn", F.lit(k))).alias(f"torn{k}") for k in range(len(SEPARATORS))],
    )
    # lines that end in a carriage return alone are one line so far
    old = (F.col("lines") == 1) & (F.col("returns") > 0)
    first = F.when(old, F.get(F.split(F.col("text"), "\r"), F.lit(header_line))).otherwise(F.rtrim("text", F.lit("\r")))
    single = windows_1252(F.decode(F.col("head"), "ISO-8859-1"))
    counts = [F.length("head") - F.length(F.replace("head", F.lit(s), F.lit(""))) for s in SEPARATORS]
    most = F.greatest(*counts)
    found = F.when(most == 0, ",")
    for s, n in zip(SEPARATORS, counts):
        found = found.when(n == most, s)
    torn = F.col("torn0")
    for k, s in enumerate(SEPARATORS):
        torn = F.when(F.col("sep") == s, F.col(f"torn{k}")).otherwise(torn)
    seen = (
        seen.withColumn("encoding", F.lit(encoding) if encoding else F.when(F.col("valid"), UTF8).otherwise(SINGLE_BYTE))
        .withColumn("text", F.when(F.col("encoding") == SINGLE_BYTE, single).otherwise(F.make_valid_utf8(F.col("head").cast("string"))))
        .withColumn("head", F.nullif(first, F.lit("")))
        .withColumn("sep", F.lit(sep) if sep else F.coalesce(found, F.lit(",")))
        .select(
            "path", "encoding", "sep", "head", F.when(old, F.col("lines") + F.col("returns")).otherwise(F.col("lines")).alias("lines"),
            F.coalesce(torn & ~old, F.lit(False)).alias("torn"),
        )
    )
    shared = os.path.commonprefix([_plain_path(n) for n in names])
    root = shared[: shared.rfind("/") + 1]
    kinds = seen.where("head IS NOT NULL").groupBy("head", "sep", "encoding", "torn").agg(F.array_sort(F.collect_list("path")).alias("paths"))
    readings = tuple(
        Reading(_header(k["head"], k["sep"]), k["sep"], k["encoding"], k["torn"], tuple(k["paths"]))
        for k in sorted(kinds.collect(), key=lambda k: k["paths"][0])  # a row for each kind of file
    )
    return Folder(seen, blocks, tuple(names), readings, root, header_line)


def _schema(names: Sequence[str]) -> StructType:
    return StructType([StructField(n, StringType()) for n in names])


def _options(sep: str) -> dict[str, str]:
    return {"sep": sep, "quote": '"', "escape": '"', "mode": "PERMISSIVE"}


def _placed(path: str = "_metadata.file_path", block: str = "_metadata.file_block_start", seq: Column | None = None) -> Column:
    seq = F.monotonically_increasing_id() if seq is None else seq
    return F.struct(F.col(path).alias("path"), F.col(block).alias("block"), seq.alias("seq"))


def _drop_second_line(rows: DataFrame) -> DataFrame:
    """Drop the first row of every file (the header, when line 1 was junk the reader skipped)."""
    firsts = (
        rows.where(f"{ORDER}.block = 0")
        .groupBy(F.col(f"{ORDER}.path").alias("_path"))
        .agg(F.min(f"{ORDER}.seq").alias("_seq"))
    )
    mine = (F.col(f"{ORDER}.path") == F.col("_path")) & (F.col(f"{ORDER}.seq") == F.col("_seq"))
    return rows.join(firsts, mine & (F.col(f"{ORDER}.block") == 0), "left_anti")


def _scan(spark: SparkSession, reading: Reading, header: bool) -> DataFrame:
    """Rows of files without line breaks in values, straight from the reader, which splits them."""
    reader = spark.read.options(
        encoding="ISO-8859-1" if reading.encoding == SINGLE_BYTE else reading.encoding, header=header,
        columnNameOfCorruptRecord=_BAD, columnPruning=False, **_options(reading.sep),  # all fields, whichever are asked for
    )
    rows = reader.schema(_schema([*reading.header, _BAD])).csv([_literal(p) for p in reading.paths])
    # the reader refuses to read only what it rejects, so that has a part, of no length, of a column
    none = F.substring(F.coalesce(column(reading.header[0]), F.lit("")), 1, 0)
    return rows.select(
        *[column(c) for c in reading.header], F.concat(_BAD, none).alias(_BAD), F.lit(1).cast("long").alias(_LINES), _placed().alias(ORDER)
    )


def _cut(folder: Folder, reading: Reading) -> DataFrame:
    """Rows of files with line breaks in values, cut from blocks of lines."""
    lines = text_lines(folder.spark, [_literal(p) for p in reading.paths])
    blocks = folder.blocks
    if len(folder.readings) > 1:  # blocks are sized by all that is read, so only these files' own will do
        blocks = scan_blocks(lines)
    inside: dict[str, list] = {}
    for row in inside_blocks(blocks, reading.sep).collect():  # at most one row a block
        inside.setdefault(row["path"], []).append(row["block"])
    text = (
        F.decode(F.col("value"), "ISO-8859-1") if reading.encoding == SINGLE_BYTE else F.make_valid_utf8(F.col("value").cast("string"))
    )
    found = records(lines.withColumn("value", text), reading.sep, inside, folder.header_line + 1)
    names = ", ".join(f"`{n.replace('`', '``')}` string" for n in [*reading.header, _BAD])
    whole = F.rtrim("value", F.lit("\r"))
    parsed = F.from_csv(whole, names, {**_options(reading.sep), "columnNameOfCorruptRecord": _BAD})
    rows = found.select(
        parsed.alias("_row"), F.col("lines").alias(_LINES), _placed("path", "block", F.col("seq")).alias(ORDER),
        F.col("value").isNull().alias("_open"),
    )
    # an open record has no text, but the quote that is wrong with it
    bad = F.when(F.col("_open"), '"').otherwise(F.col("_row").getField(_BAD))
    return rows.select(*[F.col("_row").getField(c).alias(c) for c in reading.header], bad.alias(_BAD), _LINES, ORDER)


def _rows(folder: Folder, reading: Reading) -> DataFrame:
    """All rows of a reading, with the file's name, what is wrong with the record and, if something is, its text."""
    if reading.torn:
        rows = _cut(folder, reading)
    else:
        rows = _scan(folder.spark, reading, True)
        if folder.header_line:
            rows = _drop_second_line(rows)
    shown = windows_1252 if reading.encoding == SINGLE_BYTE else column
    return rows.select(
        *[shown(c).alias(c) for c in reading.header], _source(_decoded(F.col(f"{ORDER}.path")), folder.root).alias(SOURCE), ORDER,
        F.when(F.col(_BAD).isNotNull(), fault(F.col(_BAD), reading.sep, len(reading.header))).alias(REASON),
        shown(_BAD).alias(RECORD), _LINES,
    )


def tables(folder: Folder) -> list[DataFrame]:
    """One table per header of a probed folder; see ``read_sources``."""
    groups: dict[tuple[str, ...], list[DataFrame]] = {}
    for reading in folder.readings:
        fits = F.col(REASON).isNull() | (F.col(REASON) == "short")
        kept = _rows(folder, reading).where(fits).drop(REASON, RECORD, _LINES)
        groups.setdefault(reading.header, []).append(kept)
    return [reduce(DataFrame.unionByName, parts) for parts in groups.values()]


def read_rejects(
    spark: SparkSession,
    path: str | Sequence[str] | Folder,
    glob: str = LISTS,
    sep: str | None = None,
    encoding: str | None = None,
    skip_first_line: bool = False,
) -> DataFrame:
    """Records that do not fit their file's header: (source_file, row_order, reason, lines, record).

    ``long``: more fields than columns, the surplus not empty; ``unclosed``: a quote that nothing closes, ``lines`` lines up to
    the file's end. These are in no table. ``short``: fewer fields than columns; the row is kept, without the missing ones.
    """
    folder = path if isinstance(path, Folder) else probe(spark, path, glob, sep, encoding, int(skip_first_line))
    found = [
        _rows(folder, r).where(F.col(REASON).isNotNull()).select(SOURCE, ORDER, REASON, F.col(_LINES).alias("lines"), RECORD)
        for r in folder.readings
    ]
    if not found:
        return spark.createDataFrame([], f"{SOURCE} string, {ORDER} struct<path: string, block: bigint, seq: bigint>, {REASON} string, lines bigint, {RECORD} string")
    return reduce(DataFrame.unionByName, found)


def read_sources(
    spark: SparkSession,
    path: str | Sequence[str] | Folder,
    glob: str = LISTS,
    sep: str | None = None,
    encoding: str | None = None,
    skip_first_line: bool = False,
) -> list[DataFrame]:
    """One table per header found in the folder, in file-name order, with file name and row order.

    Files that differ only in separator or encoding share a table. Empty files are left out, and so are records with too many
    fields or an unclosed quote; see ``quality_report`` and ``read_rejects``. Quoted values may hold line breaks, and large
    files are split all the same. A folder probed before is not probed again.
    """
    folder = path if isinstance(path, Folder) else probe(spark, path, glob, sep, encoding, int(skip_first_line))
    return tables(folder)


def read_lists(
    spark: SparkSession,
    path: str | Sequence[str] | Folder,
    glob: str = LISTS,
    sep: str | None = None,
    encoding: str | None = None,
    skip_first_line: bool = False,
    with_order: bool = True,
) -> DataFrame:
    """All files of a folder (or one file) as one table of text columns.

    Columns a file lacks are empty text. ``source_file`` names the file; ``row_order`` (unless
    ``with_order`` is off) sorts rows as they stand in the files.
    """
    found = read_sources(spark, path, glob, sep, encoding, skip_first_line)
    if not found:
        raise ValueError(f"no readable rows under {path}")
    if len(found) == 1:
        merged = found[0]
    else:
        names = list(dict.fromkeys(c for t in found for c in t.columns if c not in (SOURCE, ORDER)))
        merged = None
        for t in found:
            part = t.select(
                *[(column(c) if c in t.columns else F.lit("")).alias(c) for c in names], SOURCE, ORDER
            )
            merged = part if merged is None else merged.unionAll(part)
    return merged if with_order else merged.drop(ORDER)


def merge_folder(
    spark: SparkSession, path: str | Folder, glob: str = LISTS, skip_first_line: bool = False
) -> DataFrame:
    """Union of all files of a folder, id columns cleaned and quotes removed."""
    found = read_sources(spark, path, glob, skip_first_line=skip_first_line)
    return merge_sources([t.drop(SOURCE, ORDER) for t in found])


def read_key_list(
    spark: SparkSession, path: str, name: str = "CNPJ", encoding: str = UTF8
) -> DataFrame:
    """A list without a header; of its columns the first."""
    rows = _scan(spark, Reading((name,), ",", encoding, False, (path,)), False)
    shown = windows_1252 if encoding == SINGLE_BYTE else column
    root = _decoded(F.regexp_replace(F.col(f"{ORDER}.path"), "^.*/", ""))
    return rows.select(shown(name).alias(name), root.alias(SOURCE), ORDER)


def read_id_text(spark: SparkSession, path: str, name: str = "CNPJ") -> DataFrame:
    """Text lines of comma-separated ids, one row per id.

    The reader takes the commas for line ends, so a file of one line is read by many tasks.
    """
    return (
        spark.read.option("lineSep", ",").text(path)
        .select(F.explode(F.split("value", "[\r\n]+")).alias(name))
        .select(strip(name).alias(name))
        .where(F.col(name) != "")
    )


def quality_report(
    spark: SparkSession,
    path: str | Sequence[str] | Folder,
    needed: Sequence[str] = (),
    glob: str = LISTS,
    skip_first_line: bool = False,
) -> DataFrame:
    """Per file: encoding, separator, columns, lines, records by fault and what is wrong with it (``ok`` if nothing).

    ``short``, ``long`` and ``unclosed`` count records as ``read_rejects`` has them. A file with ``long`` or ``unclosed`` ones
    is read without them, and its status says so.
    """
    folder = path if isinstance(path, Folder) else probe(spark, path, glob, header_line=int(skip_first_line))
    kinds = [(r.paths, list(r.header)) for r in folder.readings]
    names = spark.createDataFrame(kinds, "paths array<string>, columns array<string>").select(F.explode("paths").alias("path"), "columns")
    faults = read_rejects(spark, folder).groupBy(F.col(SOURCE).alias("_source")).agg(
        *[F.count_if(F.col(REASON) == r).alias(r) for r in ("short", "long", "unclosed")]
    )
    joined = folder.files.join(names, "path", "left").join(faults, F.col(SOURCE) == F.col("_source"), "left")
    lacks = F.filter(F.array(*[F.lit(c) for c in needed]).cast("array<string>"), lambda c: ~F.array_contains("columns", c))
    rejected = F.coalesce(F.col("long") + F.col("unclosed"), F.lit(0))
    status = (
        F.when(F.col("head").isNull(), "empty")
        .when(F.size(lacks) > 0, F.concat(F.lit("missing columns: "), F.array_join(lacks, ", ")))
        .when(rejected > 0, F.concat(F.lit("rejected rows: "), rejected.cast("string")))
        .when(F.col("lines") <= 1 + folder.header_line, "no rows")
        .otherwise("ok")
    )
    return joined.select(
        SOURCE, "encoding", "sep", F.coalesce("columns", F.array().cast("array<string>")).alias("columns"), "lines",
        *[F.coalesce(r, F.lit(0)).cast("long").alias(r) for r in ("short", "long", "unclosed")], status.alias("status"),
    )
