"""Bounded, reproducible samples of labelled texts for the classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def labelled_sample(
    docs: DataFrame, labels: DataFrame, label: str, allowed: Column, per_class: int
) -> DataFrame:
    """doc_id, text and label (0 or 1) of at most ``per_class`` texts of each class.

    ``allowed`` says which labels may be learnt from. Ids are taken in the order of a hash,
    so the sample is the same each time and does not lean on the order of ids. Its ids are
    few by construction and are broadcast; texts are only read where they match. Rows with
    a null id or label, and ids with contradicting labels, are left out.
    """
    known = (
        labels.select("doc_id", F.col(label).cast("int").alias("label"))
        .where(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1) & allowed)
        .groupBy("doc_id")
        .agg(F.min("label").alias("label"), F.max("label").alias("__high"))
        .where(F.col("label") == F.col("__high"))
        .select("doc_id", "label")
    )
    parts = [
        known.where(F.col("label") == value).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
        for value in (0, 1)
    ]
    sample = F.broadcast(parts[0].unionAll(parts[1]))
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).join(sample, "doc_id")
