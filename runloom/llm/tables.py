"""Where operators keep intermediate tables, and how they read the given ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from runloom.sources.scratch import discard, saved, shared_folder

__all__ = ["SENT_ROWS", "WORD", "by_row", "discard", "documents", "keep_ids", "own_ids", "saved", "shared_folder", "text_bytes", "without_ids"]

#: At most this many rows of one or two short columns are sent to every task; larger sides are joined.
SENT_ROWS = 1_000_000

#: Word characters end at ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def text_bytes(name: str = "text") -> Column:
    """UTF-8 bytes of a text column, for Arrow functions."""
    return F.col(name).cast("binary").alias(name)


def keep_ids(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows of ``df`` whose ``key`` is among the distinct ``ids``: the list is sent to all tasks if it is short, else both sides are shuffled."""
    few = ids.limit(SENT_ROWS + 1).count() <= SENT_ROWS
    return df.join(F.broadcast(ids) if few else ids, key, "left_semi")


def without_ids(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows of ``df`` whose ``key`` is not among the distinct ``ids``; sent or shuffled as in keep_ids()."""
    few = ids.limit(SENT_ROWS + 1).count() <= SENT_ROWS
    return df.join(F.broadcast(ids) if few else ids, key, "left_anti")


def own_ids(docs: DataFrame) -> bool:
    """Whether each row has a doc_id, and one that no other row has."""
    return docs.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1 or doc_id is null").isEmpty()


def by_row(docs: DataFrame) -> DataFrame:
    """row, doc_id and text of ``docs``, written, so that a row's number stays the same however often it is read."""
    return saved(docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text"))
