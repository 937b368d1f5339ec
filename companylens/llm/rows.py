"""Row identity, and the folds that queries fix by checksum of doc_id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from companylens.operators.distributed import materialize


ROW = "__row"
# All columns of a row, in a struct, so that no helper column meets one of the same name.
WHOLE = "__whole"


def with_rows(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """Add the column ROW: the key where it is one, else a stored number of the row.

    A key with nulls or repeats can't address rows; then the table is stored once with
    numbers, so that a repeated task sees the same ones.
    """
    bad = docs.groupBy(key).agg(F.count("*").alias("n")).where((F.col("n") > 1) | F.col(key).isNull())
    if bad.limit(1).count():
        return materialize(docs.withColumn(ROW, F.monotonically_increasing_id()), "numbered")
    return docs.withColumn(ROW, F.col(key).cast("long"))


def with_whole_rows(docs: DataFrame) -> DataFrame:
    """ROW, doc_id, text and the struct WHOLE of all columns, whatever these are called."""
    text = F.col("text").cast("string").alias("text")
    return with_rows(docs.select("doc_id", text, F.struct("*").alias(WHOLE)))


def in_fold(doc_id: Column, folds: int, fold: int) -> Column:
    """crc32 of the id's text modulo ``folds`` is ``fold``; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == fold, F.lit(False))
