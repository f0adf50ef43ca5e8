"""What the operators share: tables cut from their lineage, and the small registry of queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from roster.session import scratch_path

FILES_PER_CORE = 2
LABEL_ROWS = 1_000_000
WORD = r"[^\x20\x09-\x0D]+"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query over the tables of a folder; ``sql`` is its oracle."""

    def add(build: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = build
        if sql is not None:
            ORACLES[name] = sql
        return build

    return add


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def stored(df: DataFrame, name: str, wide: bool = False) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Lost executors then cost a read, not a recomputation, and Spark knows the table's size, so it
    broadcasts it in joins when, and only when, it is small. ``wide`` tables come straight from reading
    the input and keep its partitions. Others have at most ``FILES_PER_CORE`` files a core, so that
    small tables of many partitions don't become thousands of files.
    """
    path = scratch_path(df.sparkSession, name)
    if not wide:
        df = df.coalesce(FILES_PER_CORE * df.sparkSession.sparkContext.defaultParallelism)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def without(df: DataFrame, *names: str) -> DataFrame:
    """Drop columns whose names an operator's results take."""
    taken = {n.lower() for n in names}
    return df.drop(*[c for c in df.columns if c.lower() in taken])


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often ``body`` uses it, also in lambdas."""
    return F.element_at(F.transform(F.array(value), body), 1)


def id_text(doc_id: str = "doc_id") -> Column:
    """The id as text; a null id counts as empty."""
    return F.coalesce(F.col(doc_id).cast("string"), F.lit(""))


def join_labels(docs: DataFrame, labels: DataFrame, how: str = "inner") -> DataFrame:
    """Documents with their labels, by doc_id.

    Up to ``LABEL_ROWS`` labels, counted, go to the documents, whose texts then stay where they are;
    more are joined by exchanging both sides.
    """
    if labels.limit(LABEL_ROWS + 1).count() <= LABEL_ROWS:
        labels = F.broadcast(labels)
    return docs.join(labels, "doc_id", how)
