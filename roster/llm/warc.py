"""WARC archives: writing them, and reading them back by boundary-chain verification.

A reader task sees a byte range of a file and can't know whether ``WARC/1.1`` at a line's start opens a
record or is part of a payload. So every occurrence is a candidate, and each candidate with a valid
header names the offset of its successor, from its header's and its content's length. The first
record is at the file's start; pointer jumping from there, four steps a round, finds all offsets on
the chain. Candidates off the chain are payload, and go back into the record they lie in.

Tasks report offsets, lengths and digests; a payload leaves its task only if it holds the magic.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from roster.llm.common import stored
from roster.session import scratch_path

MAGIC = "WARC/1.1\r\n"
END = "\r\n\r\n"
#: Payloads this long are written once, and equal ones refer to that record.
SHARED_BYTES = 1000
RECORD_ID = "urn:page:"
DATE = "2024-01-01T00:00:00Z"


# --- writing ---------------------------------------------------------------------------------------


def _plan(pages: DataFrame, key: str, payload: str) -> DataFrame:
    """Pages with ``_payload``, ``_bytes``, ``_sha1`` and the page whose record an equal payload is in."""
    ready = pages.withColumn("_payload", F.coalesce(payload, F.lit(""))).withColumns({
        "_bytes": F.octet_length("_payload").cast("long"), "_sha1": F.sha1(F.col("_payload").cast("binary")),
    })
    long = F.col("_bytes") >= SHARED_BYTES
    # equal payloads have equal digests; a digest that only one page has is in no one's way
    owners = (
        ready.filter(long).groupBy(F.struct("_sha1", "_bytes").alias("_g"))
        .agg(F.max(key).alias("_owner"), F.count(F.lit(1)).alias("_n")).filter("_n > 1")
        .select("_g._sha1", "_g._bytes", "_owner")
    )
    # stored, so its size is known: pages stay where they are when few payloads are shared
    return ready.join(stored(owners, "owners"), ["_sha1", "_bytes"], "left")


def write_warc(pages: DataFrame, path: str, key: str = "page_id", url: str = "url", payload: str = "html") -> None:
    """One record per row, in uncompressed WARC files, one per task.

    Of the rows with equal payloads of at least ``SHARED_BYTES``, that with the greatest key is a
    response; the others revisit it and have no content. A null payload is empty; a null key or url
    is left out of the header.
    """
    revisit = F.col("_owner").isNotNull() & ~F.col("_owner").eqNullSafe(F.col(key))
    kind = F.when(revisit, "revisit").otherwise("response")

    def field(name: str, value: Column) -> Column:
        return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")), F.lit(""))

    def named(value: Column) -> Column:
        return F.concat(F.lit(f"<{RECORD_ID}"), value.cast("string"), F.lit(">"))

    text = F.concat(
        F.lit(MAGIC),
        field("WARC-Type", kind),
        field("WARC-Record-ID", named(F.col(key))),
        field("WARC-Date", F.lit(DATE)),
        field("WARC-Target-URI", F.regexp_replace(url, r"[\r\n]", " ")),
        field("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "_sha1")),
        field("WARC-Payload-Length", F.col("_bytes").cast("string")),
        F.when(revisit, F.concat(
            field("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
            field("WARC-Refers-To", named(F.col("_owner"))),
        )).otherwise(""),
        field("Content-Length", F.when(revisit, 0).otherwise(F.col("_bytes")).cast("string")),
        F.lit("\r\n"),
        F.when(revisit, "").otherwise(F.col("_payload")),
    )
    # the writer's line end is what ends a record
    _plan(pages, key, payload).select(text.alias("value")).write.option("lineSep", END).text(path)


# --- reading ---------------------------------------------------------------------------------------

_KNOWN = "type string, id string, refers_to string, payload_bytes long, payload_digest string"
_CANDIDATE = f"file string, block long, at long, size long, next long, {_KNOWN}, complete boolean"
_TYPES = {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary()}


def _batch(schema: str, rows: list[tuple]) -> pa.RecordBatch:
    fields = [f.split() for f in schema.split(", ")]
    columns = zip(*rows) if rows else [[] for _ in fields]
    return pa.RecordBatch.from_arrays(
        [pa.array(c, _TYPES[kind]) for c, (_, kind) in zip(columns, fields)], [name for name, _ in fields]
    )


def _header(data: bytes) -> tuple[dict[str, str], int] | None:
    """Fields of a record header that follows the magic, and its length; None if it isn't one."""
    end = data.find(b"\r\n\r\n")
    if end < 0:
        return None
    fields = {}
    for line in data[:end].decode("utf-8", "replace").split("\r\n"):
        name, colon, value = line.partition(":")
        if not colon:
            return None
        fields[name.strip().lower()] = value.strip()
    if not fields.get("content-length", "").isdigit() or "warc-type" not in fields:
        return None
    return fields, end + 4


def _record(data: bytes, header: tuple[dict[str, str], int]) -> tuple:
    """(type, id, refers_to, payload_bytes, payload_digest) of a record whose content is all there."""
    fields, length = header
    digest = fields.get("warc-payload-digest", "").removeprefix("sha1:")
    if fields["warc-type"] == "revisit":
        size = fields.get("warc-payload-length", "")
        known = (int(size) if size.isdigit() else None, digest)
    else:
        payload = data[length : length + int(fields["content-length"])]
        known = (len(payload), hashlib.sha1(payload).hexdigest())
    return fields["warc-type"], fields.get("warc-record-id"), fields.get("warc-refers-to"), *known


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("lineSep", MAGIC).text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.col("value").cast("binary").alias("value"),
    )


def _candidates(spark: SparkSession, path: str) -> DataFrame:
    """One row for each piece of a file between two magics, with its place in its block.

    ``at`` is where the piece's bytes start and ``next`` how far the magic before them is from the next record.
    """
    magic = len(MAGIC)

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, at = None, 0
        for batch in batches:
            rows = []
            for file, start, value in zip(batch.column("file").to_pylist(), batch.column("block").to_pylist(), batch.column("value")):
                if (file, start) != block:
                    block, at = (file, start), 0
                data = value.as_buffer().to_pybytes()
                header = _header(data)
                total = None if header is None else header[1] + int(header[0]["content-length"])
                # the piece is the record, its end and nothing else
                whole = total is not None and len(data) >= total and data[total:] in (b"", END.encode())
                rows.append((
                    file, start, at, len(data) + magic, None if total is None else magic + total + len(END),
                    *(_record(data, header) if whole else (None,) * 5), whole,
                ))
                at += len(data) + magic
            yield _batch(_CANDIDATE, rows)

    return _pieces(spark, path).mapInArrow(parse, _CANDIDATE)


def chain(pointers: DataFrame) -> DataFrame:
    """(file, offset) of all records reachable from offset 0 of each file, by (file, offset, next).

    With jumps over L records, a round reaches L, 2 L and 3 L records further from all it has, and
    makes jumps over 4 L: k rounds reach 4^k records. Rounds end when one finds nothing new.
    """

    def ahead(rows: DataFrame, jumps: DataFrame) -> DataFrame:
        named = jumps.select(F.col("file").alias("_file"), F.col("offset").alias("_from"), F.col("next").alias("_to"))
        return rows.join(named, (F.col("file") == F.col("_file")) & (F.col("offset") == F.col("_from"))).drop("_file", "_from")

    def double(jumps: DataFrame) -> DataFrame:
        moved = jumps.select("file", F.col("offset").alias("start"), F.col("next").alias("offset"))
        return ahead(moved, jumps).select("file", F.col("start").alias("offset"), F.col("_to").alias("next"))

    jumps = stored(pointers.select("file", "offset", "next"), "jumps")
    reached = jumps.filter("offset = 0").select("file", "offset")
    size = 0
    while (now := reached.count()) > size:
        size = now
        twice = stored(double(jumps), "jumps")
        once = reached.unionByName(ahead(reached, jumps).select("file", F.col("_to").alias("offset")))
        reached = stored(
            once.unionByName(ahead(once, twice).select("file", F.col("_to").alias("offset"))).distinct(), "reached"
        )
        jumps = stored(double(twice), "jumps")
    # a pointer past the last record is no record
    return reached.join(pointers.select("file", "offset"), ["file", "offset"], "left_semi")


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """(file, offset, type, id, refers_to, payload_bytes, payload_digest) of every record of the files.

    Digests are of the payloads read, in hexadecimal; those of revisits are the header's. What isn't
    reachable from a file's start is not a record. A record cut short by the file's end counts with
    the bytes that are there. Files without records give no rows.
    """
    found = stored(_candidates(spark, path), "candidates", wide=True)
    by_block = Window.partitionBy("file").orderBy("block")
    blocks = found.groupBy("file", "block").agg(F.sum("size").alias("_sum")).select(
        "file", "block", (F.sum("_sum").over(by_block) - F.col("_sum") - len(MAGIC)).alias("_begin")
    )
    placed = stored(
        found.join(blocks, ["file", "block"])
        .withColumn("offset", F.col("_begin") + F.col("at")).filter("offset >= 0")
        .withColumn("next", F.col("offset") + F.col("next")).drop("_begin"),
        "placed",
    )
    reached = stored(chain(placed.filter("next IS NOT NULL")), "records")
    records = placed.join(reached, ["file", "offset"])
    known = ["file", "offset", "type", "id", "refers_to", "payload_bytes", "payload_digest"]
    whole = records.filter("complete").select(*known)
    if records.filter("NOT complete").isEmpty():
        return whole
    # pieces of records whose payload has the magic; only places are sorted by file
    in_file = Window.partitionBy("file").orderBy("offset")
    owner = F.last(F.when(F.col("_is"), F.struct(F.col("offset").alias("record"), "complete")), ignorenulls=True).over(in_file)
    torn = (
        placed.select("file", "block", "at", "offset", "complete")
        .join(reached.withColumn("_is", F.lit(True)), ["file", "offset"], "left")
        .withColumn("_of", owner).filter("NOT _of.complete")
        .select(F.col("file").alias("_file"), F.col("block").alias("_block"), F.col("at").alias("_at"), "offset", F.col("_of.record").alias("record"))
    )
    magic = len(MAGIC)

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, at = None, 0
        for batch in batches:
            rows = []
            for file, start, value in zip(*(batch.column(c).to_pylist() for c in ("file", "block", "value"))):
                if (file, start) != block:
                    block, at = (file, start), 0
                rows.append((file, start, at, value))
                at += len(value) + magic
            yield _batch("file string, block long, at long, value binary", rows)

    raw = _pieces(spark, path).mapInArrow(places, "file string, block long, at long, value binary")
    joined = (
        raw.join(torn, (F.col("file") == F.col("_file")) & (F.col("block") == F.col("_block")) & (F.col("at") == F.col("_at")))
        .groupBy("file", "record").agg(F.sort_array(F.collect_list(F.struct("offset", "value"))).alias("parts"))
    )

    def mend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for file, record, parts in zip(*(batch.column(c).to_pylist() for c in ("file", "record", "parts"))):
                data = MAGIC.encode().join(p["value"] for p in parts)
                rows.append((file, record, *_record(data, _header(data))))
            yield _batch(f"file string, offset long, {_KNOWN}", rows)

    return whole.unionByName(joined.mapInArrow(mend, f"file string, offset long, {_KNOWN}"))


def round_trip(pages: DataFrame, path: str | None = None) -> DataFrame:
    """Write ``pages`` (page_id, url, html) to archives and read them back, a row per record:
    (page_id, payload_bytes, payload_digest, record_type, refers_to).

    Repeated rows are records each; of rows with the greatest page_id of equal payloads all are
    responses. A record without page_id has a null one. Extra columns are ignored.
    """
    spark = pages.sparkSession
    path = path or scratch_path(spark, "warc")
    write_warc(pages.select("page_id", "url", "html"), path)

    def number(column: str) -> Column:
        return F.regexp_extract(column, f"^<{RECORD_ID}(-?[0-9]+)>$", 1).try_cast("long")

    return read_warc(spark, path).select(
        number("id").alias("page_id"), "payload_bytes", "payload_digest",
        F.col("type").alias("record_type"), number("refers_to").alias("refers_to"),
    )
