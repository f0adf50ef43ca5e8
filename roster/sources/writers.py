"""Writing lists. Every sink writes a directory of part files from all tasks."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from roster.functions.text import column, slug, text
from roster.operators.order import split_in_parts
from roster.operators.shape import clean_id_columns
from roster.session import ship
from roster.sources.readers import LISTS, ORDER, SOURCE, Folder, read_sources

ship(__name__)

BOM = "\ufeff"


def _flat(df: DataFrame, clean: bool, keep: Sequence[str] = ()) -> DataFrame:
    rows = df.drop(*[c for c in (ORDER, SOURCE) if c not in keep])
    return clean_id_columns(rows) if clean else rows


_STYLE = {"sep": ";", "quote": '"', "escape": '"', "emptyValue": ""}
_PLACE = ("_path", "_block", "_seq")


def _csv(df: DataFrame, path: str, mode: str, *by: str) -> None:
    writer = df.write.mode(mode).options(header=True, **_STYLE)
    (writer.partitionBy(*by) if by else writer).csv(path)


def write_list(
    df: DataFrame, path: str, bom: bool = False, clean: bool = True, mode: str = "errorifexists"
) -> None:
    """Semicolon-separated UTF-8 with a header; id columns cleaned first.

    ``bom`` starts each part file with a byte-order mark for spreadsheet programs.
    """
    rows = _flat(df, clean)
    if bom:
        first = rows.columns[0]
        rows = rows.select(column(first).alias(BOM + first), *[column(c) for c in rows.columns[1:]])
    _csv(rows, path, mode)


def _spread(df: DataFrame, by: str) -> DataFrame:
    """Bring rows of one target together, in even pieces: a large target stays split over tasks."""
    return df.hint("rebalance", column(by))


def output_name(source: Column, prefix: Column) -> Column:
    """The name of an input's output: the prefix and the file's name without its ending, in the file's folder."""
    return F.concat(F.regexp_extract(source, "^(.*/)?", 1), prefix, F.regexp_replace(source, r"^.*/|\.[^./]*$", ""))


def _headed(lines: DataFrame, headers: Sequence[str], by: Sequence[str]) -> DataFrame:
    """``lines`` (by, place, layout, value) with a header row, of an empty place, for each output that a task has rows of."""

    def head(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begun, first = set(), dict(zip(_PLACE, ("", -1, -1)))
        for batch in batches:
            targets = pa.Table.from_batches([batch]).group_by([*by, "layout"]).aggregate([]).to_pylist()
            new = [t for t in targets if tuple(t.values()) not in begun]
            begun.update(tuple(t.values()) for t in new)
            if new:
                yield pa.RecordBatch.from_pylist([{**t, **first, "value": headers[t["layout"]]} for t in new], batch.schema)
            yield batch

    return lines.mapInArrow(head, lines.schema)


def write_sources(
    tables: Sequence[DataFrame], path: str, by: Sequence[str] = (SOURCE,), clean: bool = True, mode: str = "errorifexists"
) -> None:
    """Tables of any headers in one write: one output folder for each value of the columns ``by``, with its own header.

    The columns ``by`` are not part of the lists. Rows are in file order where the tables have it. A target with many rows has
    several files, each with the header; rows are exchanged once, and large targets stay split. Tables of several headers
    are written as lines, each header before its rows, and Spark names such files ``part-*.txt``; the reader takes these too.
    """
    cleaned = [clean_id_columns(t) if clean else t for t in tables]
    if not cleaned:
        return
    order = [F.asc_nulls_first(ORDER)] if all(ORDER in t.columns for t in cleaned) else []
    if len(cleaned) == 1:
        rows = cleaned[0].hint("rebalance", *by).sortWithinPartitions(*by, *order)
        return _csv(_flat(rows, False, keep=by), path, mode, *by)
    headers, parts = [], []
    for layout, table in enumerate(cleaned):
        names = [c for c in table.columns if c not in (ORDER, SOURCE, *by)]
        headers.append(";".join('"' + n.replace('"', '""') + '"' if re.search('[;"\\r\\n]', n) else n for n in names))
        cells = F.struct(*[text(c).alias(f"c{i}") for i, c in enumerate(names)])
        parts.append(table.select(
            *[column(c).cast("string").alias(c) for c in by],
            *[(F.col(f"{ORDER}.{n[1:]}") if order else F.lit(value)).alias(n) for n, value in zip(_PLACE, ("", F.lit(0).cast("bigint"), F.lit(0).cast("bigint")))],
            F.lit(layout).alias("layout"), F.to_csv(cells, {k: str(v) for k, v in _STYLE.items()}).alias("value"),
        ))
    lines = _headed(reduce(DataFrame.unionByName, parts).hint("rebalance", *by), headers, by)
    ready = lines.sortWithinPartitions(*by, "layout", *_PLACE).select("value", *by)
    ready.write.mode(mode).partitionBy(*by).text(path)


def write_per_source(
    df: DataFrame | Sequence[DataFrame], path: str, prefix: str = "", clean: bool = True, mode: str = "errorifexists"
) -> None:
    """One output folder per input file: ``source_file=<prefix><stem>``, of one table or of tables with several headers."""
    tables = [df] if isinstance(df, DataFrame) else list(df)
    named = [t.withColumn(SOURCE, output_name(column(SOURCE), F.lit(prefix))) for t in tables]
    write_sources(named, path, [SOURCE], clean, mode)


def write_by_value(
    df: DataFrame, name: str, path: str, clean: bool = True, mode: str = "errorifexists"
) -> None:
    """One output folder per value of a column, named by the value's file-name form.

    Rows without a value are left out, as they belong to no output. Values with the same name form
    share a folder, so no row is lost.
    """
    rows = _flat(df, clean).where(column(name).isNotNull()).withColumn("bucket", slug(name))
    _csv(_spread(rows, "bucket"), path, mode, "bucket")


def write_flagged(
    df: DataFrame, flag: str, path: str, names: Sequence[str], clean: bool = True, mode: str = "errorifexists"
) -> None:
    """Both sides of a flagged table in one pass: ``side=<name>``, first the side without the flag."""
    side = F.when(column(flag), names[1]).otherwise(names[0])
    _csv(_flat(df.withColumn("side", side).drop(flag), clean), path, mode, "side")


def write_flagged_per_source(
    df: DataFrame | Sequence[DataFrame], flag: str, path: str, prefixes: Sequence[str], clean: bool = True, mode: str = "errorifexists"
) -> None:
    """Both sides of every input file in one pass: ``side=<prefix>/source_file=<prefix><stem>``."""
    tables = [df] if isinstance(df, DataFrame) else list(df)
    side = F.when(column(flag), prefixes[1]).otherwise(prefixes[0])
    named = [t.withColumn("side", side).withColumn(SOURCE, output_name(column(SOURCE), F.col("side"))).drop(flag) for t in tables]
    write_sources(named, path, ["side", SOURCE], clean, mode)


def write_parts(
    df: DataFrame,
    rows_per_part: int,
    order_by: Sequence[Column | str] | None,
    path: str,
    clean: bool = True,
    mode: str = "errorifexists",
) -> None:
    """Consecutive parts of exactly ``rows_per_part`` rows, one output folder each; without ``order_by`` in file order."""
    parts = split_in_parts(df, rows_per_part, order_by, "part")
    _csv(_flat(parts, clean), path, mode, "part")


def id_lines(
    ids: DataFrame, name: str, order_by: Sequence[Column | str], ids_per_file: int
) -> DataFrame:
    """Ids joined by commas, ``ids_per_file`` per line and part, in order."""
    parts = split_in_parts(ids, ids_per_file, order_by, "_part")
    listed = F.array_sort(F.collect_list(F.struct(*[column(o) for o in order_by], column(name).alias("_id"))))
    lines = parts.groupBy("_part").agg(F.concat_ws(",", F.transform(listed, lambda x: x["_id"])).alias("line"))
    return lines.select(F.col("_part").alias("part"), "line")


def write_id_text(
    ids: DataFrame,
    name: str,
    order_by: Sequence[Column | str],
    path: str,
    ids_per_file: int | None = None,
    mode: str = "errorifexists",
) -> None:
    """Text files of comma-joined ids, one folder ``part=NNN`` per ``ids_per_file`` ids.

    Without a size all ids are one comma-joined stream, in order over the part files.
    """
    if ids_per_file is None:
        rows = ids.repartitionByRange(*[column(o) for o in order_by]).sortWithinPartitions(*order_by)
        rows.select(column(name).cast("string")).write.mode(mode).option("lineSep", ",").text(path)
        return
    lines = id_lines(ids, name, order_by, ids_per_file)
    lines.withColumn("part", F.format_string("%03d", "part")).write.mode(mode).partitionBy("part").text(path)


def write_report(report: DataFrame, path: str, mode: str = "errorifexists") -> None:
    _csv(report, path, mode)


def convert_utf8(
    spark: SparkSession, path: str | Folder, out: str, glob: str = LISTS, mode: str = "errorifexists"
) -> None:
    """Rewrite every file of a folder as semicolon-separated UTF-8, one output folder per input, in one write.

    Each file keeps its own columns.
    """
    tables = [
        t.withColumn(SOURCE, F.regexp_replace(SOURCE, r"(\.[^./]*)?$", "_utf8$1")) for t in read_sources(spark, path, glob)
    ]
    write_per_source(tables, out, mode=mode)
